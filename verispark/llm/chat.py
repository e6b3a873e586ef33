"""Conversations as formatted training windows of bounded size.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside a text are escaped by one
more backslash between ``<`` and ``|``, which is undone on reading; roles also escape line breaks.
Prefix sums of turn costs decide the windows: a window's new turns start in one stretch of
``stride`` tokens, half of what the budget leaves beside the system turn and the history, and a turn
longer than a stride closes its stretch in a window of its own.  New turns therefore fit the budget
unless a single turn does not, and that window says so.  Each window repeats the system turn and the
turns that start within ``history`` tokens before it; only new assistant turns bear loss.

Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
MARKUP_TOKENS = 6
#: Turns whose number falls into one block are summed together first, so a conversation of any length is spread.
TURN_BLOCK = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", "<$1\\\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def estimated_tokens(role: Column, text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and the markup."""
    return F.ceil((F.octet_length(role) + F.octet_length(text)) / 4).cast("long") + MARKUP_TOKENS


def format_windows(df: DataFrame, budget: int = 1024, history: int = 256, tokens: str | None = None) -> DataFrame:
    """One row per window: conv_id, window_start, n_context, n_new, n_tokens, over_budget, formatted, loss_spans.

    Input columns conv_id, turn, role, text and, if named, the turn costs in ``tokens``; others are
    ignored.  Turns are ordered by turn, role and text, null turns first; repeated rows are turns of
    their own.  A null role or text is empty, null conversation ids form one conversation, an empty
    table has no window.  ``window_start`` counts the tokens of the conversation before the window's
    new turns, without the system turn; ``n_context`` turns are repeated, ``n_new`` are new, and
    ``loss_spans`` are (start, length) in characters of ``formatted``.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    cost = F.greatest(F.col(tokens).cast("long"), F.lit(1)) if tokens else estimated_tokens(role, text)
    turns = df.select(
        F.col("conv_id"), F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), cost.alias("cost"),
        F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-(1 << 62))).alias("block"))
    within = Window.partitionBy("key", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.withColumns({"place": F.row_number().over(within), "upto": F.sum("cost").over(within),
                               "next_cost": F.lead("cost").over(within)})
    # Totals of blocks, the conversation's first row among them, and from these what comes before each block.
    first = F.min_by(F.struct("role", "text", "cost"), F.col("place"))
    blocks = turns.groupBy("key", "block").agg(F.sum("cost").alias("n"), first.alias("first"))
    over = Window.partitionBy("key").orderBy("block")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first("first").over(whole)
    bases = blocks.select(
        "key", "block", (F.sum("n").over(over) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"),
        (F.row_number().over(over) == 1).alias("opens"), F.when(head["role"] == "system", head).alias("system"))
    system_cost = F.coalesce(F.col("system.cost"), F.lit(0))
    stride = F.greatest(F.lit(budget - history) - system_cost, F.lit(budget // 4)).cast("long")
    turns = (turns.join(bases, ["key", "block"])
             .withColumn("is_system", F.col("opens") & (F.col("place") == 1) & (F.col("role") == "system"))
             .withColumn("stride", F.floor(stride / 2))
             .withColumn("start", F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("before") + F.col("upto") - F.col("cost") - system_cost))
             .withColumn("bin", F.floor(F.col("start") / F.col("stride")))
             .withColumn("long", F.when(F.col("is_system"), F.coalesce(F.col("next_cost") > F.col("stride"), F.lit(False)))
                         .otherwise(F.col("cost") > F.col("stride"))))
    last_bin = F.floor((F.col("total") - system_cost - 1) / F.col("stride"))
    reach = F.least(F.floor((F.col("start") + history) / F.col("stride")), last_bin)
    own = F.array(F.struct(F.col("bin"), F.col("long"), F.lit(True).alias("new")))
    later = F.flatten(F.transform(F.sequence(F.col("bin"), reach), lambda b: F.array(
        F.struct(b.alias("bin"), F.lit(False).alias("long"), F.lit(False).alias("new")),
        F.struct(b.alias("bin"), F.lit(True).alias("long"), F.lit(False).alias("new")))))
    later = F.filter(later, lambda w: (w["bin"] > F.col("bin")) | (w["long"] & ~F.col("long")))
    targets = F.when(F.col("is_system") | (reach < F.col("bin")), own).otherwise(F.concat(own, later))
    entries = turns.withColumn("target", F.explode(targets)).select(
        "conv_id", "key", "system", "target.bin", "target.long",
        F.struct(F.col("start"), (~F.col("is_system")).alias("after"), F.col("turn"), F.col("place"), F.col("target.new").alias("new"),
                 F.col("role"), F.col("text"), F.col("cost")).alias("entry"))
    groups = entries.groupBy("key", "bin", "long").agg(
        F.first("conv_id").alias("conv_id"), F.first("system").alias("system"), F.array_sort(F.collect_list("entry")).alias("all"))
    fresh = F.filter("all", lambda e: e["new"])
    groups = groups.withColumn("fresh", fresh).filter(F.size("fresh") > 0).withColumn("window_start", F.col("fresh")[0]["start"])
    position, opening = F.col("window_start"), F.col("fresh")[0]
    old = F.filter("all", lambda e: ~e["new"] & (e["start"] < position) & (e["start"] + history >= position))
    shape = lambda e, new: F.struct(e["role"].alias("role"), e["text"].alias("text"), e["cost"].alias("cost"), new.alias("new"))
    again = F.when(F.col("system").isNotNull() & ~((opening["role"] == "system") & (opening["start"] == 0) & ~opening["after"]),
                   F.array(shape(F.col("system"), F.lit(False)))).otherwise(F.array().cast("array<struct<role:string,text:string,cost:bigint,new:boolean>>"))
    context = F.concat(again, F.transform(old, lambda e: shape(e, F.lit(False))))
    groups = groups.withColumn("n_context", F.size(context)).withColumn(
        "turns", F.transform(F.concat(context, F.transform("fresh", lambda e: shape(e, F.lit(True)))), lambda e: F.struct(
            F.concat(F.lit(START), escape_role(e["role"]), F.lit("\n")).alias("head"), escape(e["text"]).alias("body"),
            (e["new"] & (e["role"] == "assistant")).alias("loss"), e["cost"].alias("cost"))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, e: Column) -> Column:
        start, size = acc["at"] + F.length(e["head"]), F.length(e["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END)).alias("at"), F.when(e["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, e: acc + e["cost"])
    return groups.select(
        "conv_id", "window_start", F.col("n_context").cast("long"), F.size("fresh").cast("long").alias("n_new"), n_tokens.alias("n_tokens"),
        (n_tokens > budget).alias("over_budget"),
        F.array_join(F.transform("turns", lambda e: F.concat(e["head"], e["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", empty, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per window, from the formatted text alone: conv_id, window_start, n_new, turns (role, text) that are new, loss (the texts under the mask)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    fresh = F.slice(pieces, (F.col("n_context") + 1).cast("int"), F.col("n_new").cast("int"))
    body = len(START) + 1
    turns = F.transform(fresh, lambda p: F.struct(
        unescape_role(F.substring(F.substring_index(p, "\n", 1), body, 1 << 30)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window_start", "n_new", turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("formatted_chars"))


def conversation_digests(read: DataFrame) -> DataFrame:
    """Per conversation, from what was read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest needs the text of its conversation in one place; windows, not conversations, are the unit of everything before.
    """
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", "formatted_chars", F.struct("window_start", "n_new", turns.alias("turns"), F.array_join("loss", "").alias("loss")).alias("part"))
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("formatted_chars").alias("formatted_chars"))
    loss = F.array_join(F.col("parts.loss"), "")
    return joined.select(
        "conv_id", F.aggregate("parts.n_new", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_turns"),
        F.sha2(F.array_join(F.col("parts.turns"), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
