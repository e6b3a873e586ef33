"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    coded = bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text",
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(coded, "doc_id")


@query("op4_flat_tokens")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import flat_tokens
    from .files import Stages

    shards = flat_tokens.write_flat(table(spark, sf_dir, "documents"), "doc_id", "text",
                                    public_tokenizers.path("byte_bpe_50k.json"), 0, Stages(spark, "op4"), _partitions(spark))
    back = flat_tokens.read_flat(shards, "doc_id")
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_chat_windows", r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt, replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n') AS r2,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ord FROM c),
u AS (
  SELECT *, CAST(ceil((octet_length(encode(role)) + octet_length(encode(txt))) / 4.0) AS BIGINT) + 6 AS cost,
    24 + length(r2) + len(regexp_extract_all(r2, '<\\*\|')) + length(txt) + len(regexp_extract_all(txt, '<\\*\|')) AS size FROM t),
s AS (SELECT conv_id, cost AS sys_cost, size AS sys_size FROM u WHERE ord = 1 AND role = 'system'),
v AS (
  SELECT u.*, coalesce(sys_cost, 0) AS sys_cost, coalesce(sys_size, 0) AS sys_size, ord = 1 AND role = 'system' AS is_sys,
    greatest(1024 - 256 - coalesce(sys_cost, 0), 256) // 2 AS stride,
    sum(cost) OVER (PARTITION BY u.conv_id ORDER BY ord) - cost - coalesce(sys_cost, 0) AS place,
    lead(cost) OVER (PARTITION BY u.conv_id ORDER BY ord) AS next_cost FROM u LEFT JOIN s ON u.conv_id = s.conv_id),
y AS (
  SELECT *, CASE WHEN is_sys THEN 0 ELSE place END AS start, CAST(CASE WHEN is_sys THEN 0 ELSE place END AS BIGINT) // stride AS bin,
    CASE WHEN is_sys THEN coalesce(next_cost > stride, FALSE) ELSE cost > stride END AS big FROM v),
w AS (
  SELECT conv_id, bin, big, min(start) AS p, sum(size) + CASE WHEN bool_or(is_sys) THEN 0 ELSE max(sys_size) END AS size FROM y GROUP BY ALL),
h AS (
  SELECT w.conv_id, sum(y.size) AS size FROM w JOIN y ON w.conv_id = y.conv_id AND NOT y.is_sys AND y.start < w.p AND y.start + 256 >= w.p GROUP BY ALL),
f AS (SELECT conv_id, sum(size) AS size FROM (SELECT conv_id, size FROM w UNION ALL SELECT conv_id, size FROM h) GROUP BY ALL),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY ord)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN txt END, '' ORDER BY ord), '') AS loss FROM t GROUP BY ALL)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f.size AS BIGINT) AS formatted_chars
FROM g JOIN f ON g.conv_id = f.conv_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    windows = chat.format_windows(turns.unionByName(more))
    return chat.conversation_digests(chat.read_windows(windows))


@query("op10_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM q
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from .files import Stages

    pages, stages, partitions = table(spark, sf_dir, "pages"), Stages(spark, "op10"), _partitions(spark)
    captures = warc.write_archive(warc.plan_revisits(pages), stages)
    shards = warc.write_index(captures, stages, partitions)
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    found = stages.put(warc.look_up(shards, keys, partitions), "found")
    return warc.payload_facts(warc.read_records(found), stages)


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash
    from .files import Stages

    return simhash.groups(table(spark, sf_dir, "documents"), "doc_id", "text", Stages(spark, "op7"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.select("doc_id", "toxic").filter(toxicity.fold() != 2))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op2_fm_substring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring
    from .files import Stages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.remove_repeats(docs, "doc_id", "text", Stages(spark, "op2"), _partitions(spark))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_cgk_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    benchmark = decontaminate.Benchmark(table(spark, sf_dir, "benchmark"))
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), benchmark)


@query("op1_embedding_graph")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann_graph
    from .files import Stages

    return ann_graph.link_groups(table(spark, sf_dir, "embeddings"), Stages(spark, "op1"))


@query("op13_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.key IS NOT NULL AND s.last <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup
    from .files import Stages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, "doc_id", "text", Stages(spark, "op13"), _partitions(spark))
    return line_dedup.apply_bitmaps(docs, "doc_id", "text", bitmaps).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_lexical_blas", r"""
WITH p AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), term)) AS w
  FROM documents, p),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), term)) AS w
  FROM benchmark, p),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM n, a),
f AS (SELECT doc_id, w, count(*) AS tf FROM t SEMI JOIN i ON t.w = i.w GROUP BY ALL),
v AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, a GROUP BY w, docs),
s AS (
  SELECT item_id, f.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN v ON i.w = v.w JOIN f ON f.w = i.w JOIN m ON m.doc_id = f.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical
    from .files import Stages

    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Stages(spark, "op11"))


@query("op12_repair", r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, tab),
x AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt
  FROM k, range(2) AS copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS place FROM x),
f AS (
  SELECT conv_id, turn, role, txt, place, left(role, 1) AS one, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(txt, '[^\x20\x09-\x0D]') THEN 1 WHEN place > min(place) OVER (PARTITION BY conv_id, role, txt) THEN 2
      WHEN NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM p),
ins(q, q2, ls, c, says) AS (
  VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, chr(10) || 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'),
    (3, 2, 'I', 3, chr(10) || 'user:'), (2, 3, 'I', 3, chr(10) || 'assistant:'),
    (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
acts(q, a, one, q2, c) AS (
  VALUES (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4), (0, 'R', '', 2, 3), (1, 'R', '', 2, 3), (2, 'R', '', 3, 3), (3, 'R', '', 2, 3),
    (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
d AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'says': ''} AS best FROM f
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT d.conv_id, d.i + 1 AS i, acts.q2 AS q, {
      'cost': d.best.cost + ins.c + acts.c + CASE WHEN acts.a <> 'D' AND f.fault = 3 THEN 3 ELSE 0 END,
      'audit': d.best.audit || ins.ls || acts.a,
      'says': d.best.says || ins.says || CASE acts.a WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.txt
        ELSE chr(10) || CASE acts.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.txt END} AS best
    FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = d.i + 1 JOIN ins ON ins.q = d.q JOIN acts ON acts.q = ins.q2
    WHERE acts.a = 'D' OR (f.fault NOT IN (1, 2) AND (acts.a = 'R' OR acts.one = f.one))) GROUP BY ALL),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n FROM f GROUP BY conv_id),
e AS (
  SELECT d.conv_id, min({'cost': best.cost + ins.c, 'audit': best.audit || ins.ls, 'says': best.says || ins.says}) AS best
  FROM d JOIN g ON d.conv_id IS NOT DISTINCT FROM g.conv_id AND d.i = g.n JOIN ins ON ins.q = d.q WHERE ins.q2 IN (0, 3) GROUP BY d.conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(substr(e.best.says, 2), '')) AS repaired_sha256
FROM o LEFT JOIN g ON o.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair
    from .files import Stages

    original = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, rows = repair.repair(repair.damage(original), Stages(spark, "op12"), _partitions(spark))
    ids = original.select("conv_id").distinct().select("conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"))
    whole = ids.join(report.drop("conv_id"), "key", "left").join(repair.repaired_digests(rows), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
