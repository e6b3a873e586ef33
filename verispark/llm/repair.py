"""Repair of conversations by the cheapest edits of their rows.

A conversation's rows and the roles a repaired one may have next span a lattice: a node is the number of
rows used and the state ``nothing yet``, ``system``, ``user`` or ``assistant``; an edit leads from node to node.  Two searches
walk it, one from the first row and one back from the end, and take the nearer node from their heaps in turn.  When
they have met they go on until no crossing of equal cost can be left, and the least of the audits
joined at the crossings is the answer.  An audit determines its path, so no audit of a node is the beginning of
another of equal cost, and the least one can be built up from either end.

The rows' order, faults and texts stay in Spark; the search sees one symbol per row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import Stages

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that is inserted or takes its role, and after a kept row by its initial.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
BEFORE = {to: [q for q in range(4) if NEXT[q] == to] for to in range(4)}
ENDS = (NOTHING, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("blank", "duplicate", "truncated")
#: Turns whose number falls into one block are numbered together.
TURN_BLOCK = 512
#: Distinct short conversations whose answers a worker keeps.
KNOWN, SHORT = 20_000, 64


def _out(rows: str, i: int, q: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Letter, cost and end of each edit at a node; a row is its role's initial (``-`` for others), upper case if truncated, ``!`` if it must go."""
    yield "I", INSERT, (i, NEXT[q])
    if i < len(rows):
        row = rows[i]
        yield "D", DELETE, (i + 1, q)
        if row != "!":
            more = TRUNCATED if row.isupper() or row == "+" else 0
            kept = KEPT.get((q, row.lower()))
            if kept is not None:
                yield "K", more, (i + 1, kept)
            yield "R", REROLE + more, (i + 1, NEXT[q])


def _into(rows: str, i: int, q: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Letter, cost and start of each edit that ends at a node."""
    for p in BEFORE[q]:
        yield "I", INSERT, (i, p)
    if i:
        row = rows[i - 1]
        yield "D", DELETE, (i - 1, q)
        if row != "!":
            more = TRUNCATED if row.isupper() or row == "+" else 0
            for p in range(4):
                if KEPT.get((p, row.lower())) == q:
                    yield "K", more, (i - 1, p)
            for p in BEFORE[q]:
                yield "R", REROLE + more, (i - 1, p)


class _Half:
    """One of the two searches: distances, the best edit of each node towards the search's source, and the settled nodes."""

    def __init__(self, rows: str, sources: list[tuple[int, int]], forward: bool) -> None:
        self.rows, self.forward, self.edges = rows, forward, _out if forward else _into
        self.cost = dict.fromkeys(sources, 0)
        #: Letter, neighbour towards the source and letters up to the source.
        self.link: dict[tuple[int, int], tuple[str, tuple[int, int] | None, int]] = {s: ("", None, 0) for s in sources}
        self.done: set[tuple[int, int]] = set()
        self.heap = [self._entry(s) for s in sources]
        heapq.heapify(self.heap)

    def _entry(self, node: tuple[int, int]) -> tuple[int, int, int]:
        # Free edits lead from row to row, so at one cost the rows nearer to the source come first and a node's links are final when it is taken.
        return self.cost[node], node[0] if self.forward else -node[0], node[1]

    def top(self) -> int | None:
        while self.heap and self._node(self.heap[0]) in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def _node(self, entry: tuple[int, int, int]) -> tuple[int, int]:
        return (entry[1] if self.forward else -entry[1]), entry[2]

    def step(self) -> tuple[int, int]:
        node = self._node(heapq.heappop(self.heap))
        self.done.add(node)
        for letter, cost, other in self.edges(self.rows, *node):
            total, known = self.cost[node] + cost, self.cost.get(other)
            if other in self.done or known is not None and known < total:
                continue
            link = (letter, node, self.link[node][2] + 1)
            if known is None or total < known or self._less(link, self.link[other]):
                self.cost[other], self.link[other] = total, link
            if known is None or total < known:
                heapq.heappush(self.heap, self._entry(other))
        return node

    def _less(self, a: tuple, b: tuple) -> bool:
        """Whether one audit of a node comes before another of the same cost."""
        while self.forward and a[1] != b[1]:  # back to where the paths part; a letter at a node has one end, so they part by different letters
            if a[2] >= b[2]:
                a = self.link[a[1]]
            else:
                b = self.link[b[1]]
        return a[0] < b[0]

    def audit(self, node: tuple[int, int]) -> str:
        """The letters between the source and a node, in the order of the rows."""
        out = []
        letter, other, _ = self.link[node]
        while other is not None:
            out.append(letter)
            letter, other, _ = self.link[other]
        return "".join(reversed(out) if self.forward else out)


def cheapest(rows: str) -> tuple[int, str]:
    """Cost and least audit of the cheapest edits."""
    ahead, back = _Half(rows, [(0, NOTHING)], True), _Half(rows, [(len(rows), q) for q in ENDS], False)
    best = DELETE * len(rows)  # deleting every row is always allowed
    while True:
        a, b = ahead.top(), back.top()
        if a is None or b is None or a + b > best:
            break
        side, other = (ahead, back) if a <= b else (back, ahead)
        node = side.step()
        if node in other.cost:
            best = min(best, side.cost[node] + other.cost[node])
    # Every cheapest path has one edit that first leaves what the search ahead has settled, and it ends where the other has settled.
    ends = [(len(rows), q) for q in ENDS]
    joined = [ahead.audit(n) for n in ends if n in ahead.done and ahead.cost[n] == best]
    for node in ahead.done:
        for letter, cost, to in _out(rows, *node):
            if to not in ahead.done and to in back.done and ahead.cost[node] + cost + back.cost[to] == best:
                joined.append(ahead.audit(node) + letter + back.audit(to))
    return best, min(joined)


_short = lru_cache(KNOWN)(cheapest)


def solve(rows: str) -> tuple[int, str]:
    return _short(rows) if len(rows) <= SHORT else cheapest(rows)


def edits_by_row(rows: str, audit: str) -> list[tuple[int, str, int]]:
    """Place (from 1), letters and state before them, for every row whose letters are more than K; letters are insertions and then the row's own, if it has one."""
    out, letters, q = [], "", NOTHING
    place, before = 1, NOTHING
    for letter in audit:
        letters += letter
        if letter == "K":
            q = KEPT[q, rows[place - 1].lower()]
        elif letter != "D":
            q = NEXT[q]
        if letter != "I":
            if letters != "K":
                out.append((place, letters, before))
            place, letters, before = place + 1, "", q
    return [*out, (place, letters, before)] if letters else out


def _placed(df: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text and place: a row's number in its conversation by turn (nulls first), role and text; ``key`` tells a null conv_id from all others."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = df.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"), "conv_id",
                     F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                     F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(1 << 62))).alias("block"))
    # Numbers within blocks of turns and the rows of the blocks before, so that a long conversation is no single group.
    within = Window.partitionBy("key", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    sizes = rows.groupBy("key", "block").agg(F.count("*").alias("n"))
    before = sizes.select("key", "block", (F.sum("n").over(Window.partitionBy("key").orderBy("block")) - F.col("n")).alias("before"))
    return (rows.withColumn("nth", F.row_number().over(within)).join(before, ["key", "block"])
            .select("key", "conv_id", "turn", "role", "text", (F.col("before") + F.col("nth")).alias("place")))


def _facts(placed: DataFrame) -> DataFrame:
    """key, conv_id, turn, place, initial, fault (1 blank, 2 duplicate, 3 truncated, 0 none: the first that a row has) and symbol; no text."""
    texts = F.struct("role", "text")
    marked = placed.select(
        "key", "conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"), F.xxhash64(texts).alias("h1"), F.xxhash64(F.lit(1), texts).alias("h2"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    firsts = marked.groupBy("key", "h1", "h2").agg(F.min("place").alias("place")).select("key", "place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    symbol = (F.when(F.col("fault").isin(1, 2), "!")
              .when(F.col("fault") == 3, F.when(known == "-", "+").otherwise(F.upper(known))).otherwise(known))
    return marked.join(firsts, ["key", "place"], "left").select("key", "conv_id", "turn", "place", "initial", fault.alias("fault")).withColumn("symbol", symbol)


def _plan(facts: DataFrame, partitions: int) -> DataFrame:
    """key, place, cost, letters, state: for every conversation its cost and audit at place 0, and the edits of rows that are not just kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.repair import edits_by_row, solve

        def solved(key: str, rows: str) -> list[tuple]:
            cost, audit = solve(rows)
            return [(key, 0, cost, audit, None)] + [(key, place, None, letters, q) for place, letters, q in edits_by_row(rows, audit)]

        def flush(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["key", "place", "cost", "letters", "state"])

        key, symbols = None, []
        for batch in batches:
            done: list[tuple] = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    done += solved(key, "".join(symbols)) if key is not None else []
                    key, symbols = k, []
                symbols.append(s)
            yield flush(done)
        if key is not None:
            yield flush(solved(key, "".join(symbols)))

    ordered = facts.select("key", "place", "symbol").repartition(partitions, "key").sortWithinPartitions("key", "place").select("key", "symbol")
    return ordered.mapInArrow(run, "key string, place long, cost long, letters string, state int")


def _repaired(placed: DataFrame, plan: DataFrame, partitions: int) -> DataFrame:
    """key, role, text in order, partitioned by key: rows and their edits meet in one sorted stream."""
    nothing = {name: F.lit(None).cast(kind) for name, kind in (("role", "string"), ("text", "string"), ("letters", "string"), ("state", "int"))}
    edits = plan.filter("place > 0").select("key", "place", F.lit(0).alias("kind"), nothing["role"].alias("role"), nothing["text"].alias("text"), "letters", "state")
    rows = placed.select("key", "place", F.lit(1).alias("kind"), "role", "text", nothing["letters"].alias("letters"), nothing["state"].alias("state"))
    stream = rows.unionByName(edits).repartition(partitions, "key").sortWithinPartitions("key", "place", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, str, int] | None = None
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for key, role, text, letters, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if letters is None and held is None:
                    out.append((key, role, text))
                    continue
                if held is not None:
                    # A row's edits come just before it; those without a row end their conversation.
                    own, todo, state = held
                    mine = letters is None and own == key and todo[-1] != "I"
                    for letter in todo:
                        if letter == "I" or letter == "R":
                            state = NEXT[state]
                            out.append((own, ("user", "assistant")[state - USER], text if letter == "R" else ""))
                        elif letter == "K":
                            out.append((key, role, text))
                            state = KEPT[state, role[:1]]
                    held = None
                    if letters is None and not mine:
                        out.append((key, role, text))
                if letters is not None:
                    held = (key, letters, q)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], names=["key", "role", "text"])
        if held is not None:
            roles, state = [], held[2]
            for _ in held[1]:
                state = NEXT[state]
                roles.append(("user", "assistant")[state - USER])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([held[0]] * len(roles), roles, [""] * len(roles))], names=["key", "role", "text"])

    return stream.select("key", "role", "text", "letters", "state").mapInArrow(run, "key string, role string, text string")


def repair(df: DataFrame, stages: Stages, partitions: int) -> tuple[DataFrame, DataFrame]:
    """The conversations of ``df`` (conv_id, turn, role, text) as a report and as repaired rows.

    Report, one row per conversation: key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  Repaired rows: key, role,
    text, each conversation in one partition and in order.  Keeping a row costs 0, giving it the role user or assistant 3, deleting it 4
    (blank and duplicate rows must go), inserting an empty user or assistant row 3, and a truncated row that stays 3 more.  The role
    initials afterwards are ``(s?(ua)+)?``; of the cheapest audits the ASCII-least is taken.

    Rows of a conversation are ordered by turn, role and text, null turns first; a null role or text is one space, null ids are one
    conversation (``key`` is n), rows that are equal throughout are duplicates of the first, texts of any length and other columns are
    allowed; an empty table has neither conversations nor rows.
    """
    placed = stages.put(_placed(df), "placed")
    facts = stages.put(_facts(placed), "facts")
    plan = stages.put(_plan(facts, partitions), "plan")
    ahead = facts.select("key", (F.col("place") + 1).alias("place"), F.col("initial").alias("last"))
    pair = F.concat("last", "initial")
    seen = facts.join(ahead, ["key", "place"], "left").select("key", "conv_id", "turn", "fault", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"))
    by_turn = seen.groupBy("key", "turn").agg(
        F.first("conv_id").alias("conv_id"), *[F.count_if(F.col("fault") == k + 1).alias(name) for k, name in enumerate(FAULTS)],
        F.count_if("illegal").alias("illegal"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counted = by_turn.groupBy("key").agg(F.first("conv_id").alias("conv_id"), gaps.alias("gaps"), *[F.sum(c).alias(c) for c in (*FAULTS, "illegal")])
    report = counted.join(plan.filter("place = 0").select("key", "cost", F.col("letters").alias("audit")), "key")
    return report, _repaired(placed, plan, partitions)


def repaired_digests(rows: DataFrame) -> DataFrame:
    """key, repaired_sha256 of rows as ``repair`` returns them: SHA-256 of ``role:text`` joined by line breaks, taken up row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    digest.update(b"\n")
                else:
                    done += [(key, digest.hexdigest())] if key is not None else []
                    key, digest = k, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in range(2)], names=["key", "repaired_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    return rows.select("key", "role", "text").mapInArrow(run, "key string, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it the user's; nulls are one space, but a null conv_id or turn stays null."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", kind.alias("kind"), said("role").alias("role"), said("text").alias("text")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")
