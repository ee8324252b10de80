"""The operators of this package on the driver's tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm import (chat, decontaminate, jaccard_join, pieces, pii, quality_rules, ranked, runs, secret_scan, shards, token_counts, token_files,
                       warc)
from shelf.llm.spans import count_kind, joined, of_kinds
from shelf.session import scratch_path

END_ID = 2
SHARDS = [1.0] * 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_tokens(spark, path)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives its text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents"), model)
    same = pieces.decode(coded, model).withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")))
    return same.select("doc_id", "n_pieces", "piece_ids", "round_trip")


def edits_of(text: str) -> F.Column:
    """Three edits of every text: an insertion at its fourth, a removal at its middle, a replacement near its end."""
    n = F.length(text)

    def edit(start, end, put):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), put.alias("put"))

    return F.array(
        edit(F.floor(n / 4), F.floor(n / 4), F.lit(" as amended")),
        edit(F.floor(n / 2), F.floor(n / 2) + 12, F.lit("")),
        edit(F.floor(n * 3 / 4), F.floor(n * 3 / 4) + 5, F.substring(text, 1, 20)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits, and how many characters the edits had encoded again."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.build_trees(table(spark, sf_dir, "documents"), tokenizer)
    edited = token_counts.apply_edits(counted.withColumn("edits", edits_of("text")), tokenizer)
    return edited.select("doc_id", "n_tokens", F.col("edited.n_tokens").alias("n_tokens_edited"), F.col("edited.n_chars").alias("n_chars_edited"),
                         F.col("edited.n_reencoded").alias("n_reencoded"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    s = F.col("secrets")
    return found.select(
        "doc_id", *(count_kind(s, k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS),
        F.sha2(joined(of_kinds(s, secret_scan.BASE_KINDS)), 256).alias("base_sha256"), joined(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["checked"])).cast("long").alias("n_checked"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = chat.rotate(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return rotated.select("conv_id", "segment", "speaker", "n_turns", "rendered", masks.alias("masks"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words",
                         "rules.base_failed", "rules.kept", F.round("rules.p_good", 6).alias("p_good"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    s = F.col("pii")
    return found.select(
        "doc_id", *(count_kind(s, k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(joined(of_kinds(s, pii.BASE_KINDS)), 256).alias("base_sha256"), joined(s).alias("spans"),
        F.array_max(F.transform(s, lambda x: x["score"])).alias("top_score"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


def with_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a repeated stretch in one text of ten, dealt by its id's checksum; rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.withColumn("_h", h).withColumn("_g", F.floor(h / 10)).withColumn(
        "_w", F.when(F.col("_h") % 10 == 0, F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")))
    n = words.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")))
    rest = F.col("_n") - F.col("_a")
    unit = n.withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    made = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), rest)), " ")
    return unit.withColumn("text", F.when(F.col("_n") > 0, made).otherwise(F.col("text"))).select(docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    r = F.col("repeats.runs")
    longest = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size(r).cast("long").alias("n_runs"), longest.alias("l"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("repeats.collapsed", 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", (-F.col("l.start")).alias("start"), F.col("l.length").alias("length"), (-F.col("l.period")).alias("period"),
        F.floor(1000 * F.col("l.length") / -F.col("l.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    return warc.resolved(records).select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_sentencepiece, op3_token_counts, op4_secret_scan, op5_perspectives, op6_quality_rules,
    op7_jaccard_join, op8_pii, op9_sharding, op10_decontaminate, op11_periodic_runs, op12_ranked_search, op13_warc)}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_perspectives": """
WITH said AS (
  SELECT DISTINCT conv_id AS c, CAST(turn AS BIGINT) AS t, coalesce(role, 'unknown') AS r,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') AS x
  FROM conversations),
placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, x) - 1) // 64 AS BIGINT) AS g FROM said),
speakers AS (SELECT DISTINCT c, r AS speaker FROM said WHERE r <> 'system'),
turns AS (
  SELECT p.c, g, speaker, t, r, x, r = speaker AS own,
         '<|im_start|>' || CASE WHEN r = speaker THEN 'assistant' WHEN r = 'system' THEN 'system' ELSE 'user name=' ||
           replace(replace(r, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') END || chr(10) AS head,
         x || '<|im_end|>' AS body
  FROM placed p JOIN speakers s ON p.c IS NOT DISTINCT FROM s.c),
offsets AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY c, g, speaker ORDER BY t NULLS FIRST, r, x) AS BIGINT) - length(body) - 1 AS start FROM turns)
SELECT c AS conv_id, g AS segment, speaker, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY t NULLS FIRST, r, x) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN start || ':' || (start + length(body)) END, ',' ORDER BY t NULLS FIRST, r, x), '') AS masks
FROM offsets GROUP BY c, g, speaker""",
    "op7_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("text")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op10_decontaminate": f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents),
iw AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM (SELECT item_id, ws, CAST(least(len(ws), 10) AS BIGINT) AS n FROM item WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM doc, sizes),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op12_ranked_search": f"""
WITH t AS (
  SELECT rowid_ AS d, doc_id, unnest(regexp_extract_all({LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
sizes AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY d),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS k
  FROM (SELECT item_id, unnest(regexp_extract_all({LOWERED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
w AS (SELECT item_id, term, k, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN df USING (term), total),
m AS (SELECT d, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM sizes, total),
s AS (
  SELECT item_id, doc_id, d, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN m USING (d) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)""",
}
