"""Text expressions: stripping, cutting and the two reasoning splits."""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# The characters str.strip() removes; Spark's plain trim would remove the space only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, for a costly value that is named repeatedly."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fill(template: str, **parts: Column) -> Column:
    """The template with its ``{name}`` places filled from columns."""
    pieces = re.split(r"\{([a-z_]+)\}", template)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def cut(text: Column, max_len: int) -> Column:
    """The text, or its first ``max_len`` characters and ``...`` when it is longer."""
    return F.when(F.length(text) > max_len, F.concat(F.substring(text, 1, max_len), F.lit("..."))).otherwise(text)


def brief(prompt: Column, max_len: int = 80) -> Column:
    """A prompt on one line, cut for a table."""
    return cut(strip(F.replace(prompt, F.lit("\n"), F.lit(" "))), max_len)


def _tagged(text: Column, opening: str, closing: str) -> tuple[Column, Column, Column]:
    """Whether the text has a closed tag pair, the start of the first pair's body, and its end.

    A search for the literal tags gives what the lazy pattern ``open(.*?)close`` gives, without
    running a regular expression over a long reasoning trace.
    """
    start = F.position(F.lit(opening), text) + len(opening)
    end = F.position(F.lit(closing), text, start)
    return (start > len(opening)) & (end > 0), start, end


def split_reasoning(text: Column) -> Column:
    """Struct (reasoning, output): first ``<think>`` body, and all that follows its closing tag.

    Text before the tag is dropped. Without a closed pair the whole text is the output.
    """
    found, start, end = _tagged(text, fixed.THINK_OPEN, fixed.THINK_CLOSE)
    body = F.substr(text, start, end - start)
    rest = F.substr(text, end + len(fixed.THINK_CLOSE))
    return F.struct(
        F.when(found, strip(body)).otherwise(F.lit("")).alias("reasoning"),
        strip(F.when(found, rest).otherwise(text)).alias("output"),
    )


def split_reasoning_multi(text: Column) -> Column:
    """Struct (reasoning, response) for the first of three tag styles that the text holds.

    All pairs of that style leave the response; text without any keeps its blanks and has a NULL
    reasoning.
    """
    reasoning, response = F.lit(None).cast("string"), text
    for opening, closing in reversed(fixed.TAG_STYLES):
        found, start, end = _tagged(text, opening, closing)
        pattern = rf"(?s)\Q{opening}\E.*?\Q{closing}\E"
        reasoning = F.when(found, strip(F.substr(text, start, end - start))).otherwise(reasoning)
        response = F.when(found, strip(F.regexp_replace(text, pattern, ""))).otherwise(response)
    return F.struct(reasoning.alias("reasoning"), response.alias("response"))


def question_key(prompt: Column) -> Column:
    """The part of a choice prompt before its options, which do not keep their order."""
    return F.when(F.contains(prompt, F.lit("Options:")), strip(F.substring_index(prompt, "Options:", 1))).otherwise(
        prompt
    )


def bar(percent: Column, width: int = 50) -> Column:
    """A text bar of ``width`` cells, filled up to ``percent``."""
    filled = (percent / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def json_string(text: Column) -> Column:
    """The text as an ASCII-only JSON string, or ``null``."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        out = F.when(code.between(32, 126), ch)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000) % 0x400
        out = out.when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))
        for plain, escaped in short.items():
            out = F.when(ch == plain, F.lit(escaped)).otherwise(out)
        return out

    body = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.when(text.isNull(), "null").when(text == "", '""').otherwise(F.concat(F.lit('"'), body, F.lit('"')))
