"""Removal of passages that repeat an earlier document, through FM-indexes.

A window is ``WIDTH`` consecutive words.  The word sequence of ``GRAM`` words with the least hash
within a window is its anchor, so equal windows have equal anchors, and neighbouring windows that
share one are a segment.  Segments whose anchor occurs in two documents are gathered, equal ones
once with their smallest document, and dealt out to shards by anchor.  A shard's segments are
indexed in a compressed FM-index; its segments are streamed against it by backward search, which gives
for every window all places where it occurs, and hence the smallest document.  Segments of anchors with
very many are cut into single windows, whose smallest document is a minimum over equal windows.

Work and space grow with the text: no document is compared with a shard that shares no anchor with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Stages

WIDTH, GRAM = 13, 5
SPAN = WIDTH - GRAM + 1
#: Words of an index, segments of an anchor beyond which its windows are dealt out one by one, windows hashed together.
SHARD_WORDS = 300_000
CROWD = 2000
SLICE = 1 << 16
#: What stands for a null id: before all others.
NO_ID = -(1 << 63)

_BASE = 0xD6E8FEB86659FD93
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLICE + 2 * WIDTH, base, np.uint64)]))


POWER, INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text: eight bytes of all words at a time are mixed into what came before."""
    joined = b" ".join(texts)
    raw = np.frombuffer(joined + b" " + bytes(8), np.uint8)
    edge = np.diff((~_SPACE[raw[:len(joined) + 1]]).view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    left = ends - starts
    loads = np.ndarray((len(joined) + 1,), "<u8", raw.data, 0, (1,))
    out = left.astype(np.uint64) * _MIX
    live, at = np.arange(len(starts)), starts
    while len(live):
        mixed = (out[live] ^ loads[at] & _MASK[np.minimum(left, 8)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(_BASE)
        out[live] = mixed ^ mixed >> np.uint64(32)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    # A text begins after the one before it and a space.
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.split(out, np.searchsorted(starts, begins[1:-1])) if texts else []


def _cut(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of documents that lie one after another: anchor, hash of the words, first word and windows; ``bounds`` are the documents' ends."""
    n = len(h) - WIDTH + 1
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * POWER[:len(h)], out=sums[1:])
    gram = (sums[GRAM:] - sums[:-GRAM]) * INVERSE[:len(h) - GRAM + 1]
    gram ^= gram >> np.uint64(29)
    gram *= _MIX
    gram ^= gram >> np.uint64(32)
    # The low bits of the place ride along, so minima alone find the least of each window and where it is.
    place = np.arange(len(gram), dtype=np.uint64)
    least = gram & ~np.uint64(15) | place & np.uint64(15)
    two = np.minimum(least[:-1], least[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    value = np.minimum(eight[:n], least[SPAN - 1:SPAN - 1 + n])
    at = (place[:n] + ((value - place[:n]) & np.uint64(15))).astype(np.int64)
    # Windows across the end of a document are none.
    crossing = np.zeros(len(h) + 1, np.int64)
    np.add.at(crossing, np.maximum(bounds[:-1] - WIDTH + 1, 0), 1)
    np.add.at(crossing, bounds[:-1], -1)
    at[np.cumsum(crossing)[:n] > 0] = -1
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], n)
    inside = at[first] >= 0
    first, last = first[inside], last[inside]
    words = (sums[last + WIDTH - 1] - sums[first]) * INVERSE[first]
    return gram[at[first]].view(np.int64), words.view(np.int64), first, last - first


def segments(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash of its words, first word and number of windows of each segment, and the number of its document; from hashes of words.

    Short documents are taken together; a long one is taken in slices, which cut segments but lose no window.
    """
    parts, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            ends = np.cumsum([len(documents[k]) for k in held])
            anchor, words, first, n = _cut(np.concatenate([documents[k] for k in held]), ends)
            own = np.searchsorted(ends, first, "right")
            parts.append((anchor, words, first - np.concatenate([[0], ends])[own], n, np.array(held)[own]))
        held, size = [], 0

    for k, hashes in enumerate(documents):
        if len(hashes) < WIDTH:
            continue
        if len(hashes) > SLICE:
            for a in range(0, len(hashes) - WIDTH + 1, SLICE):
                part = hashes[a:a + SLICE + WIDTH - 1]
                anchor, words, first, n = _cut(part, np.array([len(part)]))
                parts.append((anchor, words, first + a, n, np.full(len(first), k)))
            continue
        if size + len(hashes) > SLICE:
            flush()
        held.append(k)
        size += len(hashes)
    flush()
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def text_tag(text: str | bytes) -> int:
    """24 bits that tell rows with one id but different texts apart."""
    import xxhash

    return xxhash.xxh64_intdigest(text) & 0xFFFFFF


def _occurrences(docs: DataFrame, whole: bool) -> DataFrame:
    """doc and anchor of every segment, or with ``whole`` also its words and place: anchor, segment, doc, place (first word, tag of the text, windows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.substring import segments, text_tag, word_hashes

        def made(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            anchor, segment, first, n, own = segments(word_hashes(texts))
            doc = np.array(ids, np.int64)[own]
            if not whole:
                return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc)], names=["anchor", "doc"])
            tags = np.array([text_tag(t) for t in texts], np.int64)[own]
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(segment), pa.array(doc), pa.array(first << 32 | tags << 8 | n)],
                                              names=["anchor", "segment", "doc", "place"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    ids.append(doc)
                    texts.append(text)
                    size += len(text)
                if size > 2_000_000:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.mapInArrow(run, "anchor long, segment long, doc long, place long" if whole else "anchor long, doc long")


def _pieces(rows: DataFrame) -> DataFrame:
    """From doc, text and chosen segments: key, anchor, segment, offset, n, doc, words; a crowded anchor's segment becomes one row per window."""
    names = ["key", "anchor", "segment", "offset", "n", "doc", "words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from verispark.llm.substring import text_tag

        for batch in batches:
            out: list[tuple] = []
            for doc, text, chosen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                if not text:
                    continue
                words, tag = text.encode().split(), text_tag(text)
                for s in chosen.as_py():
                    first, n = s["place"] >> 32, s["place"] & 255
                    if s["place"] >> 8 & 0xFFFFFF != tag:
                        continue
                    if s["crowded"]:
                        for k in range(n):
                            window = b" ".join(words[first + k:first + k + WIDTH])
                            out.append((xxhash.xxh64_intdigest(window) - (1 << 63), s["anchor"], s["segment"], k, 1, doc, window))
                    else:
                        out.append((s["anchor"], s["anchor"], s["segment"], 0, n, doc, b" ".join(words[first:first + n + WIDTH - 1])))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, "key long, anchor long, segment long, offset int, n int, doc long, words binary")


def search_shard(words: list[bytes], docs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For each segment, a text of words joined by spaces, the smallest document of each of its windows: all values, and where each segment's begin."""
    from .fm_index import FMIndex

    lengths = np.array([w.count(b" ") + 1 for w in words])
    flat = b" ".join(words).split(b" ")
    number = {w: k for k, w in enumerate(dict.fromkeys(flat), 1)}
    symbols = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    index = FMIndex(symbols, lengths, width)
    owner = np.repeat(docs, lengths + 1)
    smallest = np.minimum.reduceat(owner[index.order], index.group_start)
    starts = index.ends - lengths
    query, offset, group = index.matching(starts, lengths, index.text)
    counts = lengths - width + 1
    base = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(int(base[-1]), np.iinfo(np.int64).max)
    out[base[query] + offset] = smallest[group]
    return out, base


def _search(pieces: DataFrame, partitions: int) -> DataFrame:
    """anchor, segment, offset, docs: the smallest document of each window from ``offset`` on."""
    dealt = pieces.repartition(partitions, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.substring import SHARD_WORDS, WIDTH, search_shard

        names = ["anchor", "segment", "offset", "docs"]
        held: list[tuple] = []
        n_words = 0

        def flush() -> pa.RecordBatch:
            values, begins = search_shard([h[6] for h in held], np.array([h[5] for h in held], np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.int64()), pa.array([h[3] for h in held], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values))], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                # A shard ends between keys: equal windows have equal keys.
                if n_words > SHARD_WORDS and row[0] != held[-1][0]:
                    yield flush()
                    held, n_words = [], 0
                held.append(row)
                n_words += row[4] + WIDTH
        if held:
            yield flush()

    return dealt.mapInArrow(run, "anchor long, segment long, offset int, docs array<long>")


def repeated_windows(docs: DataFrame, stages: Stages, partitions: int) -> DataFrame:
    """From doc (an id) and text: doc, places (long) and masks (int), the windows that also start in a document with a smaller id.

    A place has the first word in its upper 32 bits, a tag of the text below and the number of windows; bit k of its mask
    stands for the window that starts k words later.
    """
    spread = (_occurrences(docs, False).groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
              .filter("low < high").select("anchor"))
    # A written table on this side of the join leaves Spark free to split the rows of a common anchor.
    spread = stages.put(spread, "spread")
    stages.release()
    found = stages.put(_occurrences(docs, True).join(spread.hint("merge"), "anchor"), "found")
    stages.drop(spread)
    stages.release()
    # Equal segments once, with their smallest document; then how crowded the anchor is.
    distinct = stages.put(found.groupBy("anchor", "segment").agg(F.min(F.struct("doc", "place")).alias("least")), "distinct")
    crowds = stages.put(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("anchor", F.lit(True).alias("crowded")), "crowds")
    chosen = (distinct.join(crowds, "anchor", "left")
              .select("least.doc", F.struct("least.place", "anchor", "segment", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("one")))

    def pieces(crowded: bool) -> DataFrame:
        mine = chosen.filter(F.col("one.crowded") == crowded).groupBy("doc").agg(F.collect_list("one").alias("chosen"))
        return _pieces(docs.join(mine, "doc").select("doc", "text", "chosen"))

    answers, held = _search(pieces(False), partitions), []
    if not crowds.isEmpty():
        # Equal windows of a crowd are combined before they meet, and a written table lets Spark split the rows that ask for a common one.
        windows = stages.put(pieces(True), "windows")
        least = stages.put(windows.groupBy("key", "words").agg(F.min("doc").alias("low")), "least")
        held = [windows, least]
        answers = answers.unionByName(windows.join(least.hint("merge"), ["key", "words"]).select("anchor", "segment", "offset", F.array("low").alias("docs")))
    searched = stages.put(answers, "searched")
    stages.drop(*held)
    stages.release()
    earlier = F.aggregate(F.transform("docs", lambda d, k: F.when(d < F.col("doc"), F.call_function("shiftleft", F.lit(1), (k + F.col("offset")).cast("int"))).otherwise(0)),
                          F.lit(0), lambda a, b: a + b)
    marked = found.join(searched, ["anchor", "segment"]).select("doc", "place", earlier.alias("mask")).filter("mask <> 0")
    out = stages.put(marked.groupBy("doc").agg(F.collect_list(F.struct("place", "mask")).alias("marks")), "marks")
    stages.drop(found, distinct, searched)
    stages.release()
    return out.select("doc", F.col("marks.place").alias("places"), F.col("marks.mask").alias("masks"))


def kept_words(text: str | None, places: list[int] | None, masks: list[int] | None) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space."""
    words = text.encode().split() if text else []
    if not places:
        return len(words), 0, b" ".join(words)
    tag, gone = text_tag(text), np.zeros(len(words) + 1, np.int64)
    for place, mask in zip(places, masks, strict=True):
        if place >> 8 & 0xFFFFFF == tag:
            first, k = place >> 32, 0
            while mask:
                if mask & 1:
                    gone[first + k] += 1
                    gone[first + k + WIDTH] -= 1
                mask >>= 1
                k += 1
    keep = np.cumsum(gone)[:-1] == 0
    kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
    return len(words), len(words) - int(keep.sum()), kept


def remove_repeats(df: DataFrame, id_column: str, text_column: str, stages: Stages, partitions: int) -> DataFrame:
    """All columns of ``df``, with the text replaced by its kept words, and n_words and n_removed.

    Removed is every word covered by a window whose words also start in a document with a smaller id, judged on
    the input.  A null text stays null and has no words; a null id counts as smaller than all others; rows that
    share an id are one document to each other, so they do not remove each other's words, but each is cut by its own text.
    A column named like an internal one keeps its values; n_words and n_removed replace columns of those names.
    """
    names = [c for c in df.columns if c not in ("n_words", "n_removed")]
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    docs = df.select(doc.alias("doc"), F.col(text_column).cast("string").alias("text"))
    marks = repeated_windows(docs, stages, partitions)
    rows = df.select(doc.alias("doc"), F.col(text_column).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_column]).alias("rest"))
    schema = df.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_column]).alias("rest")).schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.substring import kept_words

        for batch in batches:
            made = [kept_words(t.as_py(), p.as_py(), m.as_py()) for t, p, m in zip(batch.column(0), batch.column(2), batch.column(3), strict=True)]
            null = np.array([not t.is_valid for t in batch.column(0)], bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[2].decode() for m in made], pa.string(), mask=null), batch.column(1), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.int64())], names=["text", "rest", "n_words", "n_removed"])

    cut = rows.join(marks, "doc", "left").select("text", "rest", "places", "masks").mapInArrow(run, f"text string, rest {schema}, n_words long, n_removed long")
    return cut.select(*[F.col("text").alias(c) if c == text_column else F.col("rest")[c].alias(c) for c in names], "n_words", "n_removed")
