"""Best-fit packing under conflicts.

Documents are packed into sequences of ``capacity``: no sequence holds two documents of one source or of one
duplicate cluster. A bin carries a bitmap of its sources and one of its clusters; bins are ordered by what is left
in them. A document goes into the tightest bin that has room, and on to the next larger as long as the bitmaps clash;
without one it opens a bin. Longer documents come first.

A duplicate cluster is a class of near duplicates where ``clusters`` gives the class of the text (in the registered query classes of
plain Jaccard similarity, see ``text_classes``), and otherwise the exact text.

Documents are dealt by a hash to groups of about ``group_rows``, which are packed independently: a group is
what one task holds at a time, of bounded size whatever the data or its skew. Only ids, lengths, sources and
clusters are shuffled. A document longer than the capacity is cut into pieces; full pieces are bins of their own and
the rest is packed like a document.

Defined results: a null or negative length counts as 0; empty documents are placed like others and take no room; a null source
or cluster clashes with nothing; rows with equal ids are packed one by one; ties go by id, then source, then cluster.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .text_classes import linked_texts

CAPACITY, GROUP_ROWS = 32_768, 4096


def best_fit(rows: list[tuple[int, int | None, int | None]], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Per row (length, source, cluster), longest first: its pieces as (piece, bin, start in the bin, length)."""
    bins: list[tuple[int, int]] = []  # (left, number), ascending
    sources: list[int] = []
    clusters: list[int] = []
    source_bit: dict[int, int] = {}
    cluster_bit: dict[int, int] = {}
    placed = []
    for length, source, cluster in rows:
        one = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        two = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        pieces = []
        for piece in range(length // capacity):
            pieces.append((piece, len(sources), 0, capacity))
            sources.append(one)
            clusters.append(two)
        rest = length % capacity
        if rest or not pieces:
            at = bisect_left(bins, (rest, -1))
            while at < len(bins) and (sources[bins[at][1]] & one or clusters[bins[at][1]] & two):
                at += 1
            if at < len(bins):
                left, number = bins.pop(at)
            else:
                left, number = capacity, len(sources)
                sources.append(0)
                clusters.append(0)
            sources[number] |= one
            clusters[number] |= two
            insort(bins, (left - rest, number))
            pieces.append((len(pieces), number, capacity - left, rest))
        placed.append(pieces)
    return placed


_OUT = "doc_id long, piece int, bin_group int, bin int, start long, length long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("bin_group", pa.int32()), ("bin", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
)


def _pack_group(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        ids, number = group["doc_id"].to_pylist(), group["grp"][0].as_py()
        placed = best_fit(list(zip(group["length"].to_pylist(), group["source"].to_pylist(), group["cluster"].to_pylist())), capacity)
        rows = [(i, piece, number, bin_, start, length) for i, pieces in zip(ids, placed) for piece, bin_, start, length in pieces]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def pack(
    docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", length: Column | None = None, source: Column | None = None, cluster: Column | None = None, clusters: DataFrame | None = None
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, its bin (``bin_group``, ``bin``), ``start`` in the bin and ``length``.

    The length is by default the bytes of the text, tokens of a byte vocabulary; the cluster a hash of the text. Texts with a
    row in ``clusters`` (``tid``, their MD5, and ``component``) have the component as their cluster instead.
    """
    length = F.octet_length(F.coalesce("text", F.lit(""))) if length is None else length
    source = F.xxhash64("source") if source is None else F.xxhash64(source)
    cluster = F.xxhash64("text") if cluster is None else F.xxhash64(cluster)
    named = F.coalesce("source", F.lit(None)) if "source" in docs.columns else F.lit(None)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length"),
        F.when(named.isNotNull(), source).alias("source"),
        F.when(F.octet_length(F.coalesce("text", F.lit(""))) > 0, cluster).alias("cluster"),
        *([] if clusters is None else [F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid")]),
    )
    if clusters is not None:
        near = F.when(F.col("cluster").isNotNull(), F.coalesce(F.when(F.col("component").isNotNull(), F.xxhash64("component")), "cluster"))
        rows = rows.join(clusters.select("tid", "component"), "tid", "left").select("doc_id", "length", "source", near.alias("cluster"))
    groups = max(1, math.ceil(docs.count() / group_rows))
    # The hash takes all that is known of a row, so that rows of one id or source are spread.
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "length", "cluster"), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").applyInArrow(_pack_group(capacity), _OUT)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, clusters=linked_texts(docs))
