"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its text alone under
the loss mask. A conversation that does not end with an assistant turn gets one more example without a target,
so that the output holds every turn.

The template marks a turn as ``<|start|>role<|says|>text<|end|>``. Control strings (those and the usual ones of
other templates) that occur inside a role or text get a backslash behind their first character; where backslashes
stand there already, one more is added. Reading back takes one away, so escaping is reversible.

A conversation is read as a stream of its turns, sorted inside a partition; its longest example is the whole
conversation, so a conversation has to fit into a row, and nothing else has to fit anywhere.

Defined results: null texts and roles count as empty; null turns come first; turns of equal number are ordered by
role and text, so repeated rows stay; null conversation ids form one conversation. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, SAYS, END = "<|start|>", "<|says|>", "<|end|>"
# The control strings of this template and of other common ones.
CONTROL = (START, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_HEADS = "[" + "".join(re.escape(c) for c in sorted({c[0] for c in CONTROL})) + "]"
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"({_HEADS})(\\*)({_RESTS})"
_ESCAPE, _UNESCAPE = re.compile(ESCAPE), re.compile(rf"({_HEADS})\\(\\*)({_RESTS})")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted example."""
    return [(unescape(role), unescape(said)) for role, said in _TURN.findall(text)]


_EXAMPLES = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("is_last", pa.bool_())]
)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, examples = [], 0, 0
    prefix: list[str] = []
    waiting = None  # an example that becomes the last one if the conversation ends here
    now, begun = None, False

    def closed():
        """What the end of a conversation adds."""
        if waiting is not None:
            return (*waiting, True)
        text = "".join(prefix)
        return (now, examples, text, len(text), len(text), True)

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _EXAMPLES)], schema=_EXAMPLES)

    for batch in batches:
        for conv_id, role, said in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not begun or conv_id != now:
                if begun:
                    held.append(closed())
                now, begun, prefix, examples, waiting = conv_id, True, [], 0, None
            if waiting is not None:
                held.append((*waiting, False))
                waiting = None
            head = f"{START}{escape(role)}{SAYS}"
            said = escape(said)
            prefix.append(f"{head}{said}{END}")
            if role == "assistant":
                text = "".join(prefix)
                prefix = [text]
                end = len(text) - len(END)
                waiting = (now, examples, text, end - len(said), end)
                examples, size = examples + 1, size + len(text)
            if held and (size > 4 << 20 or len(held) > 5000):
                yield batch_of()
                held, size = [], 0
    if begun:
        held.append(closed())
    if held:
        yield batch_of()


def examples(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (from 0), ``text``, the mask ``loss_start`` to ``loss_end`` (exclusive) in
    code points, and ``is_last``."""
    conv_id, turn, role, text = columns
    only = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = only.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_expand, "conv_id long, example int, text string, loss_start int, loss_end int, is_last boolean")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv_id, example, text, start, end, last in zip(*(c.to_pylist() for c in batch.columns)):
            turns = parse(text) if last else []
            digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest() if last else None
            rows.append((conv_id, example, len(turns) if last else None, digest, unescape(text[start:end]), len(text)))
        columns = zip(*rows) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its examples: turns, loss texts in order, and sizes."""
    rows = formatted.select("conv_id", "example", "text", "loss_start", "loss_end", "is_last")
    parsed = rows.mapInArrow(_read, "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long")
    per = parsed.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_TRIAL = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRIAL).alias("text")
    )
    return read_back(examples(turns.union(trial)))


_SQL_PATTERN = ESCAPE.replace("'", "''")
_MARKS = len(START) + len(SAYS) + len(END)
OP2_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TRIAL}' UNION ALL SELECT -7, 1, 'assistant', '{_TRIAL}'
), e AS (
  SELECT *, length(regexp_replace(role, '{_SQL_PATTERN}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_SQL_PATTERN}', '\1\\\2\3', 'g')) + {_MARKS} AS size FROM t
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS until,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR back = 1 THEN until ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
