"""Lines that many documents share, as compressed per-document bitmaps of the lines to keep.

Each line of enough code points becomes a row of hashes; no text is shuffled to judge it.  The space of
the hashes is cut into equal ranges, one per partition, and each range is sorted by hash, then document, then
position.  A pass along that order meets the first occurrence of every key and marks the others.
A sketch of the most frequent hashes says which keys to spread over several ranges; their first
occurrences meet once more, a few rows per key.  The answer is a bitmap per document in
words of 64 lines of which only those that drop a line are stored.

Everything is a DataFrame or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import Stages

WORD = 64
#: Parts of the hashes with a sketch each, so that no task merges the sketches of all.
SKETCH_PARTS = 64
_BLANKS, _UPPER = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITMAP = "array<struct<word: int, bits: bigint>>"


def line_key(line: Column) -> Column:
    """The line without surrounding blanks, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _UPPER.lower())


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _long_lines(df: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """id, body (hash of the whole text), at, h1, h2 of the lines that can be dropped."""
    lines = df.select(F.col(id_column).alias("id"), F.xxhash64(_text(text_column)).alias("body"),
                      F.posexplode(F.split(_text(text_column), "\n", -1)).alias("at", "line"))
    return (lines.select("id", "body", "at", line_key(F.col("line")).alias("line")).filter(F.char_length("line") >= min_chars)
            .select("id", "body", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


def _frequent(lines: DataFrame, partitions: int) -> DataFrame:
    """h1 and spread of the keys that hold more than half a partition's share of all lines: at most twice as many rows as partitions."""
    most = max(64, 8 * partitions // SKETCH_PARTS)
    # A sketch of m keys is off by about 3.5 / m of its part's lines, here far less than half a partition's share.
    tops = (lines.groupBy(F.pmod("h1", F.lit(SKETCH_PARTS)).alias("part"))
            .agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {most}, {4 * most})").alias("top")))
    seen = tops.withColumn("n", F.sum("n").over(Window.partitionBy()))  # a row per part
    share = F.col("top.count") * (2 * partitions) / F.col("n")
    return (seen.select("n", F.explode("top").alias("top")).filter(share > 1)
            .groupBy(F.col("top.item").alias("h1")).agg(F.max(F.ceil(share).cast("int")).alias("spread")))


def keep_bitmaps(df: DataFrame, id_column: str, text_column: str, stages: Stages, partitions: int, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per id and distinct text with dropped lines: id, body, n_dropped, keep (array of word and bits).

    Keys of at least ``min_chars`` code points in at least ``min_docs`` (two or more) distinct ids lose all their lines except those of the
    largest id.  ``keep`` holds, for each word of 64 lines that drops any, its number and its bits, 1 for a kept line (bits past
    the end are 1); all other words are kept whole.  Null ids are one document below all others; a null text is one empty
    line; rows of one id count as one document and are told apart by ``body``, the hash of their text, so equal rows have
    equal bitmaps; other columns are ignored; an empty table has no rows.
    """
    lines = _long_lines(df, id_column, text_column, min_chars)
    frequent = stages.put(_frequent(lines, partitions), "frequent")
    # The topmost 31 bits of the hash, scaled: equal ranges in hash order. A frequent key takes ``spread`` ranges in turn, by document.
    place = (F.shiftright(F.col("h1"), 33) + (1 << 30)) * partitions
    salt = F.pmod(F.xxhash64("id"), F.coalesce("spread", F.lit(1)))
    dealt = (lines.join(F.broadcast(frequent), "h1", "left")
             .withColumn("range", F.pmod(F.shiftright(place, 31) + salt, F.lit(partitions)).cast("int"))
             .select("range", "h1", "h2", "id", "at", "body", F.col("spread").isNotNull().alias("hot"))
             .repartitionById(partitions, F.col("range")))
    key = Window.partitionBy("range", "h1", "h2")
    latest_first = key.orderBy(F.desc_nulls_last("id"))
    ranked = dealt.withColumn("rank", F.dense_rank().over(latest_first))
    whole = latest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = ranked.withColumn("docs", F.max("rank").over(whole))
    left = stages.put(judged.filter(F.col("hot") | ((F.col("rank") > 1) & (F.col("docs") >= min_docs))), "candidates")
    # A document of a frequent key is in one range only, so ranges add up.
    firsts = left.filter("hot and rank = 1").select("range", "h1", "h2", "id", "docs").distinct()
    order = F.struct(F.col("id").isNotNull(), "id")
    totals = firsts.groupBy("h1", "h2").agg(F.sum("docs").alias("all"), F.max_by("id", order).alias("last"))
    hot = (left.filter("hot").join(F.broadcast(totals), ["h1", "h2"]).filter((F.col("all") >= min_docs) & ~F.col("id").eqNullSafe(F.col("last"))))
    dropped = left.filter("not hot").select("id", "body", "at").unionByName(hot.select("id", "body", "at"))
    words = (dropped.groupBy("id", "body", F.floor(F.col("at") / WORD).cast("int").alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, at % {WORD})")).alias("gone")))
    return words.groupBy("id", "body").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def dense_words(keep: Column) -> Column:
    """The bitmap with its whole words filled in, up to the last stored one."""
    def filled(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(keep, i - 1)["word"] + 1)
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - before), F.array(x["bits"]))
    return F.flatten(F.transform(keep, filled))


def apply_bitmaps(df: DataFrame, id_column: str, text_column: str, bitmaps: DataFrame) -> DataFrame:
    """Every row of ``df`` with the kept lines as its text, and n_lines and n_dropped; a null text becomes empty.  Columns of ``df`` with these two names are replaced."""
    # The words are laid out before the join, so that looking one up does not lay them out again.
    side = bitmaps.select(F.col("id").alias("__id"), F.col("body").alias("__body"), F.col("n_dropped").alias("__dropped"), dense_words(F.col("keep")).alias("__words"))
    whole = df.drop(*(c for c in ("n_lines", "n_dropped") if c not in (id_column, text_column))).withColumn("__hash", F.xxhash64(_text(text_column)))
    both = whole.join(side, F.col(f"`{id_column}`").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__body")), "left")
    lines = F.split(_text(text_column), "\n", -1)

    def stays(_: Column, at: Column) -> Column:
        word = F.coalesce(F.get("__words", F.floor(at / WORD).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(word, at % WORD) == 1

    out = both.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("__dropped", F.lit(0).cast("long"))})
    text = F.when(F.col("__words").isNull(), _text(text_column)).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return out.withColumn(text_column, text).drop("__id", "__body", "__dropped", "__words", "__hash")
