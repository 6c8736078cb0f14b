"""Repair of conversations by survivor-coalescence Viterbi.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: nothing, or pairs of user and assistant after at most one system
turn. Four edits lead there: keep a turn (K), give it another role (R), delete it (D), insert an empty turn (I). The cheapest
sequence of edits is found turn by turn over four states: nothing written, a system turn, a user turn or an assistant turn written last.

Each state has one survivor, a leaf of a tree of backpointers with reference counts. A survivor that another one can imitate for
less is dropped, and what only it referred to goes with it. As long as the root has a single child, all survivors share that edit:
it is emitted, with its turn, and the child becomes the root. So a task holds the turns since the last common ancestor, not the conversation.

Sequences of equal cost are compared by their letters. A strict order between two survivors holds for all that is appended to
them (neither is a prefix of the other: they used the same turns, so only insertions, which cost, could be longer), so it is kept
from turn to turn; two leaves are compared by walking to their common ancestor where no order is known.

A turn is blank (no visible character), a duplicate (role and text stood earlier), or truncated (ends without ``.``, ``!`` or ``?``); the first
that holds counts. Blank and duplicate turns have to be deleted. Repeated texts are found by an aggregate over digests; only those that
come back on a later turn are joined to the turns. Turns are read as a stream, sorted inside a partition; turns of one
conversation have to be read in order, so they are one stream however many they are.

Defined results: null roles and texts count as one space; null turns come first; turns of equal number are ordered by role and text, so
repeated rows stand next to each other and all but the first are duplicates; null conversation ids form one conversation; a conversation whose rows are all
absent has one output row without an edit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonset.session import saved_once

from .common import table

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Which state may follow which when a turn of that role is written.
FOLLOWS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
FINAL = (START, ASSISTANT)
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if self.insert <= 0 or min(self.keep, self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("insertions need a positive cost, other edits one that is not negative")

    def imitation(self) -> list[list[int]]:
        """What it costs at most to go on from one state with whatever is done from another."""
        i, d = self.insert, self.delete
        return [[0, 0, i, 0], [2 * i + d, 0, i, 2 * i], [i + d, i, 0, i], [d, 0, i, 0]]


class Node:
    """An edit; ``refs`` counts the children and the survivors that hold it."""

    __slots__ = ("parent", "refs", "depth", "edit", "cost", "state", "turn")

    def __init__(self, parent: Node | None, edit: str, cost: int, state: int, turn):
        self.parent, self.edit, self.cost, self.state, self.turn = parent, edit, cost, state, turn
        self.refs, self.depth = 0, 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


def released(node: Node | None) -> None:
    """Takes one reference from a node, and from its ancestors as they lose their last."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


def compared(a: Node, b: Node) -> int:
    """The order of two sequences by their letters from the common ancestor on: -1, 0 or 1."""
    if a is b:
        return 0
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    left.reverse()
    right.reverse()
    return -1 if left < right else left > right


class Survivors:
    """The cheapest sequences of one conversation, one per state, and what they have in common."""

    def __init__(self, costs: Costs, emit: Callable[[Node], None]):
        self.costs, self.emit, self.imitation = costs, emit, costs.imitation()
        self.root = Node(None, "", 0, START, None)
        self.live: dict[int, tuple[int, Node]] = {}
        self.order: dict[tuple[int, int], int] = {}
        self.root.refs = 1
        self.hold({START: (0, self.root, START, 0)})

    def before(self, one: tuple, two: tuple) -> bool:
        """Whether candidate ``one`` (cost, leaf, survivor it grew from, edits since) is the better way to its state."""
        if one[0] != two[0]:
            return one[0] < two[0]
        known = self.order.get((one[2], two[2]), 0) if one[2] != two[2] else 0
        return (known or compared(one[1], two[1])) < 0

    def hold(self, candidates: dict[int, tuple]) -> None:
        """Takes the candidates, and the reference that each has, as survivors, without those that another can imitate for less."""
        dropped = []
        for state, (cost, node, _, _) in list(candidates.items()):
            for other, (least, _, _, _) in candidates.items():
                if other != state and least + self.imitation[other][state] < cost:
                    dropped.append(node)
                    del candidates[state]
                    break
        order = {}
        for i, one in candidates.items():
            for j, two in candidates.items():
                if i < j:
                    known = self.order.get((one[2], two[2]), 0) if one[2] != two[2] else 0
                    known = known or self._strict(one[1], two[1])
                    order[i, j], order[j, i] = known, -known
        for node in [*dropped, *(node for _, node in self.live.values())]:
            released(node)
        self.live = {state: (cost, node) for state, (cost, node, _, _) in candidates.items()}
        self.order = order

    @staticmethod
    def _strict(a: Node, b: Node) -> int:
        """Their order if neither sequence is a prefix of the other, else 0."""
        low, high = (a, b) if a.depth <= b.depth else (b, a)
        while high.depth > low.depth:
            high = high.parent
        return 0 if high is low else compared(a, b)

    def _inserted(self, candidates: dict[int, tuple]) -> None:
        """Adds what insertions reach, until nothing gets cheaper."""
        changed = True
        while changed:
            changed = False
            for state in (USER, ASSISTANT):
                for old in FOLLOWS[state]:
                    if old in candidates:
                        cost, node, origin, edits = candidates[old]
                        if state not in candidates or cost + self.costs.insert <= candidates[state][0]:
                            way = (cost + self.costs.insert, node, origin, edits)
                            changed = self._offer(candidates, state, way, "I", self.costs.insert, None) or changed

    def _offer(self, candidates: dict[int, tuple], state: int, way: tuple, edit: str, cost: int, turn) -> bool:
        """Puts an edit behind a way (cost with the edit, leaf, origin, edits) if that is the better way to its state."""
        total, parent, origin, edits = way
        leaf = Node(parent, edit, cost, state, turn)
        leaf.refs = 1
        found = (total, leaf, origin, edits + 1)
        if state not in candidates or self.before(found, candidates[state]):
            if state in candidates and candidates[state][3]:  # not a survivor of the turn before
                released(candidates[state][1])
            candidates[state] = found
            return True
        released(leaf)
        return False

    def step(self, turn) -> None:
        """One more turn; ``turn.fault`` and ``turn.role`` decide which edits it allows."""
        costs = self.costs
        ways = {state: (cost, node, state, 0) for state, (cost, node) in self.live.items()}
        self._inserted(ways)
        out: dict[int, tuple] = {}
        extra = costs.truncated if turn.fault == TRUNCATED else 0
        own = INITIALS.get(turn.role[:1])
        for state, (cost, node, origin, edits) in ways.items():
            self._offer(out, state, (cost + costs.delete, node, origin, edits), "D", costs.delete, turn)
            if turn.fault in (BLANK, DUPLICATE):
                continue
            if own is not None and state in FOLLOWS[own]:
                self._offer(out, own, (cost + costs.keep + extra, node, origin, edits), "K", costs.keep + extra, turn)
            for new in (USER, ASSISTANT):
                if state in FOLLOWS[new]:
                    self._offer(out, new, (cost + costs.rerole + extra, node, origin, edits), "R", costs.rerole + extra, turn)
        for _, node, _, edits in ways.values():
            if edits:  # insertions that nothing grew from go
                released(node)
        self.hold(out)
        self.coalesce()

    def path(self, node: Node) -> list[Node]:
        """The edits from the root to a leaf."""
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]

    def coalesce(self) -> None:
        """Emits the edits that all survivors share."""
        if self.root.refs > 1:
            return
        for child in self.path(next(iter(self.live.values()))[1]):
            if self.root.refs > 1:
                return
            self.emit(child)
            child.parent = None
            self.root = child

    def finish(self) -> int:
        """Emits what is left of the cheapest sequence that may end here; its cost."""
        ways = {state: (cost, node, state, 0) for state, (cost, node) in self.live.items()}
        self._inserted(ways)
        ends = [ways[state] for state in FINAL if state in ways]
        best = ends[0] if len(ends) == 1 or self.before(ends[0], ends[1]) else ends[1]
        for node in self.path(best[1]):
            self.emit(node)
        return best[0]


@dataclass(slots=True)
class Turn:
    turn: int | None
    role: str
    text: str
    fault: str | None


def fault_of(text: str, repeated: bool) -> str | None:
    visible = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
    return BLANK if not visible else DUPLICATE if repeated else None if visible[-1] in ".!?" else TRUNCATED


_EDITS = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("turn", pa.int64()), ("fault", pa.string())]
    + [(c, pa.string()) for c in ("old_role", "role", "text")]
)
_OUT = "conv_id long, place long, edit string, cost long, turn long, fault string, old_role string, role string, text string"


def _repair(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state = {"place": 0, "size": 0}
        now, begun, ways, last = None, False, None, None

        def emit(node: Node) -> None:
            turn = node.turn
            if node.edit == "I":
                row = (now, state["place"], "I", node.cost, None, None, None, ROLES[node.state], "")
            else:
                role, text = (None, None) if node.edit == "D" else (turn.role if node.edit == "K" else ROLES[node.state], turn.text)
                row = (now, state["place"], node.edit, node.cost, turn.turn, turn.fault, turn.role, role, text)
            state["place"] += 1
            state["size"] += len(row[8] or "")
            rows.append(row)

        def finished() -> None:
            if ways is None:
                rows.append((now, 0, None, 0, None, None, None, None, None))
            else:
                ways.finish()
            state["place"] = 0

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDITS)], schema=_EDITS)
            rows.clear()
            state["size"] = 0
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for conv_id, turn, role, text, present, again in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    if not begun or conv_id != now:
                        if begun:
                            finished()
                        now, begun, ways, last = conv_id, True, None, None
                    if present:
                        ways = ways or Survivors(costs, emit)
                        row = (turn, role, text)
                        ways.step(Turn(turn, role, text, fault_of(text, again or row == last)))
                        last = row
                    if len(rows) > 5000 or state["size"] > 4 << 20:
                        yield batch_of()
        if begun:
            finished()
        if rows:
            yield batch_of()

    return run


def _key(*parts: Column) -> Column:
    """A digest of texts; their lengths keep them apart."""
    return F.unhex(F.md5(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])))


def repair(turns: DataFrame, costs: Costs = Costs(), columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), present: str | None = None) -> DataFrame:
    """One row per edit in order: ``conv_id``, ``place``, ``edit``, ``cost``, the source's ``turn``, ``fault`` and ``old_role``, and the
    ``role`` and ``text`` that stand in the repaired conversation (null for deleted turns).

    Rows where ``present`` is not true only make their conversation appear.
    """
    conv_id, turn, role, text = columns
    only = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    ).withColumn("key", F.when(F.col("present"), _key(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("role"), F.col("text"))))
    # Texts that come back on a later turn, with the turn that they first stood on (null if that is null).
    some = only.where("present").groupBy("key").agg(F.count("*").alias("n"), F.count("turn").alias("numbered"), F.min("turn").alias("least"), F.max("turn").alias("most"))
    some = some.where("(numbered < n AND numbered > 0) OR least < most").select("key", F.when(F.col("numbered") == F.col("n"), F.col("least")).alias("first"), F.lit(True).alias("_again"))
    # Written first, so that its true size decides how it is joined.
    marked = only.join(saved_once(some, "repeats"), "key", "left")
    again = F.col("_again").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first")))
    ordered = marked.select("conv_id", "turn", "role", "text", "present", again.alias("again")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_repair(costs), _OUT)


def _legal(a: str, b: str) -> bool:
    return (a[:1] + b[:1]) in ("su", "ua", "au")


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    now, begun = None, False

    def closed() -> tuple:
        gaps = highest - lowest + 1 - distinct if distinct else 0
        return (now, gaps, *(faults[f] for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, "".join(audit), digest.hexdigest())

    for batch in batches:
        for conv_id, _, edit, paid, turn, fault, old, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv_id != now:
                if begun:
                    rows.append(closed())
                now, begun = conv_id, True
                faults, illegal, cost, audit, digest = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0), 0, 0, [], hashlib.sha256()
                lowest = highest = before = None
                distinct, written = 0, False
            if edit is None:
                continue
            audit.append(edit)
            cost += paid
            if fault:
                faults[fault] += 1
            if edit != "I":
                illegal += before is not None and not _legal(before, old)
                before = old
                if turn is not None and turn != highest:  # turns ascend
                    lowest, highest, distinct = turn if lowest is None else lowest, turn, distinct + 1
            if role is not None:
                digest.update(f"{chr(10) if written else ''}{role}:{text}".encode())
                written = True
        if len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)
            rows = []
    if begun:
        rows.append(closed())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)


def summary(edits: DataFrame) -> DataFrame:
    """Per conversation of ``repair``, whose rows are read in its order: gaps, faults, illegal neighbours, cost, the edits, and a digest of the repaired turns."""
    return edits.mapInArrow(_summarise, ", ".join(["conv_id long", *[f"{c} long" for c in _FIGURES], "audit string", "repaired_sha256 string"]))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``present`` after faults chosen by a checksum of conversation and turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), "fate"
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return changed.withColumn("_copy", copies).select("conv_id", "turn", "role", "text", "present")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(repair(damaged(table(spark, sf_dir, "conversations")), present="present"))


#: Without insertions, which these costs never allow: deleting the other turn of a pair, or both it and a system turn, is cheaper.
OP11_SQL = r"""
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS fate
  FROM conversations, tbl
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM given WHERE fate > 0
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS own,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, trim(text, E' \t\n\x0B\f\r') AS seen
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(own) OVER (PARTITION BY conv_id ORDER BY i) || own AS pair FROM rows
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM figures
  UNION ALL
  SELECT conv_id, i,
         lpad((n[:9]::BIGINT + 2)::VARCHAR, 9, '0') || n[10:] || 'D',
         least(lpad((s[:9]::BIGINT + 2)::VARCHAR, 9, '0') || s[10:] || 'D', CASE WHEN may AND own = 's' THEN lpad((n[:9]::BIGINT + extra)::VARCHAR, 9, '0') || n[10:] || 'K' END),
         least(lpad((u[:9]::BIGINT + 2)::VARCHAR, 9, '0') || u[10:] || 'D',
               CASE WHEN may THEN lpad((least(n, s, a)[:9]::BIGINT + extra + CASE WHEN own = 'u' THEN 0 ELSE 1 END)::VARCHAR, 9, '0') || least(n, s, a)[10:] || CASE WHEN own = 'u' THEN 'K' ELSE 'R' END END),
         least(lpad((a[:9]::BIGINT + 2)::VARCHAR, 9, '0') || a[10:] || 'D',
               CASE WHEN may THEN lpad((u[:9]::BIGINT + extra + CASE WHEN own = 'a' THEN 0 ELSE 1 END)::VARCHAR, 9, '0') || u[10:] || CASE WHEN own = 'a' THEN 'K' ELSE 'R' END END)
  FROM (SELECT ways.*, f.i AS next, own, fault NOT IN ('blank', 'duplicate') AS may, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra
        FROM ways JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM ways.conv_id AND f.i = ways.i + 1) x(conv_id, j, n, s, u, a, i, own, may, extra)
), best AS (
  SELECT ways.conv_id, least(ways.n, ways.a) AS way FROM ways JOIN figures f ON f.conv_id IS NOT DISTINCT FROM ways.conv_id AND f.n = ways.i
), edits AS (
  SELECT conv_id, unnest(string_split(way[10:], '')) AS edit, unnest(range(1, length(way) - 8)) AS i FROM best
), numbered AS (
  SELECT e.*, f.role, f.text, sum((edit <> 'D')::INT) OVER (PARTITION BY e.conv_id ORDER BY e.i DESC) AS back
  FROM edits e JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN back % 2 = 1 THEN 'assistant' ELSE 'user' END || ':' || text, chr(10) ORDER BY i) AS whole
  FROM numbered WHERE edit <> 'D' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(way[:9]::BIGINT, 0) AS cost, coalesce(way[10:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
