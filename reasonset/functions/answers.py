"""Expressions that read an answer out of a model's text and compare it with a target."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let, rstrip, strip


def _last(text: Column, pattern: str) -> Column:
    """Group 1 of the pattern's last match; NULL when it never matches."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def boxed_answer(text: Column) -> Column:
    """The last boxed answer, or NULL."""
    return strip(F.coalesce(_last(text, fixed.BOXED_NESTED), _last(text, fixed.BOXED_SIMPLE)))


def extract_answer(text: Column) -> Column:
    """The last boxed answer, else the last ``ANSWER:`` line, else an empty text."""
    return F.coalesce(boxed_answer(text), strip(_last(text, fixed.ANSWER_LINE)), F.lit(""))


def normalise_answer(answer: Column) -> Column:
    """Dollar signs and commas dropped; then the first signed integer, if there is one."""
    plain = strip(F.translate(answer, "$,", ""))
    return F.coalesce(F.regexp_substr(plain, F.lit(fixed.SIGNED_INTEGER)), plain)


def canonical_answer(answer: Column) -> Column:
    """One spelling for all answers that agree once normalised.

    An answer with an integer becomes that integer, of any length, without ``+`` and leading
    zeros; every other answer stays as it is.
    """
    plain = strip(F.translate(answer, "$,", ""))
    integer = F.regexp_replace(plain, r"(?s)^.*?(?:(-)|\+)?0*(\d+).*$", "$1$2")
    return F.regexp_replace(integer, "^-0$", "0")


def same_answer(answer: Column, target: Column) -> Column:
    """Whether two answers agree, as normalised texts or as integers."""
    return F.coalesce(canonical_answer(answer) == canonical_answer(target), F.lit(False))


def extract_letter(text: Column) -> Column:
    """The letter of the first boxed choice, or an empty text."""
    return F.regexp_extract(text, fixed.BOXED_LETTER, 1)


def extract_code(text: Column) -> Column:
    """The body of the last code fence as it would be run; NULL when there is none."""
    def runnable(code: Column) -> Column:
        body = F.replace(F.substring_index(code, "</code>", 1), F.lit("```python"), F.lit(""))
        body = F.replace(F.substring_index(body, "```", 1), F.lit("<code>"), F.lit(""))
        return F.when(code != "", body)

    return let(_last(text, fixed.CODE_FENCE), runnable)


def expected_output(text: Column) -> Column:
    """A test's expected output: stripped, and cut at the last dash when it ends with one."""
    plain = strip(text)
    return F.when(F.endswith(plain, F.lit("-")), rstrip(F.substr(plain, F.lit(1), F.length(plain) - 1))).otherwise(plain)


def same_output(actual: Column, expected: Column) -> Column:
    return strip(actual) == expected_output(expected)


def final_answer(solution: Column) -> Column:
    """What follows the last ``####`` of a worked solution; NULL when the mark is missing."""
    tail = F.substring_index(solution, fixed.FINAL_ANSWER_MARK, -1)
    return F.when(F.contains(solution, F.lit(fixed.FINAL_ANSWER_MARK)), strip(F.replace(tail, F.lit(","), F.lit(""))))


def reward(response: Column, solution: Column) -> Column:
    """1.0 when the boxed answer equals the solution's final answer, else 0.0.

    The comparison rules are those of :func:`same_answer`; a missing box or mark gives 0.0.
    """
    given, truth = boxed_answer(response), final_answer(solution)
    return F.when(same_answer(given, truth), 1.0).otherwise(0.0)
