"""The queries opN_<name> and pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, interactions, mixing, outliers, pii, quality, rollups, secrets, simhash, toxicity, urls, warc
from .shared import fresh_path, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"), remainder(4) != 2)
    return quality.score(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf, "documents")))


def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf, "documents")))


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    named = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    classes = simhash.dedup_classes(table(spark, sf, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), ["doc_id", "source", "lang"])


def op8_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches: all documents; revisions of texts that repeat a line to ones
    that do not; removal of documents labelled toxic. Two of them are sent twice."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    lines = F.split("text", "\n", -1)
    docs = docs.withColumn("single", F.array_join(F.array_distinct(lines), "\n"))
    docs = docs.withColumn("changed", F.coalesce(F.char_length("single") < F.char_length("text"), F.lit(False)))
    sides = F.array(F.struct(F.lit(False).alias("new"), F.col("text")), F.when(F.col("changed"), F.struct(F.lit(True).alias("new"), F.col("single").alias("text"))))
    sides = docs.select("doc_id", "source", "lang", "changed", F.explode(F.array_compact(sides)).alias("side")).select("doc_id", "source", "lang", "changed", "side.*")
    # Counts are kept by document: later batches find theirs without the texts.
    counts = stored(rollups.counted(sides, ["doc_id", "source", "lang", "changed", "new"]), "token-counts")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    load = counts.where(~F.col("new")).withColumn("sign", F.lit(1))
    revise = counts.where("changed").withColumn("sign", F.when(F.col("new"), 1).otherwise(-1))
    remove = counts.where(F.col("changed") == F.col("new")).join(toxic, "doc_id", "left_semi").withColumn("sign", F.lit(-1))
    store = fresh_path(spark, "token-rollup")
    rollups.create(spark, store)
    for batch, changes in (("load", load), ("revise", revise), ("load", load), ("remove", remove), ("revise", revise)):
        rollups.commit_counts(store, batch, changes)
    return rollups.totals(spark, store)


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = outliers.verdicts(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judged(table(spark, sf, "pages"), table(spark, sf, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


def op12_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def op13_filter_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return interactions.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


_WINDOWS = """
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS pattern
    FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
          FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc_words, sizes WHERE len(w) >= size),
hits AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS pattern FROM places) p
    JOIN windows x ON x.size = p.size AND x.pattern = p.pattern),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS word FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
"""
OP5_SQL = f"""
WITH {_WINDOWS}
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256,
    coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
sums AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS BIGINT) AS total
    FROM groups g LEFT JOIN counts c USING (lang, source) LEFT JOIN kept k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
cells AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.total + 5 * l.v) AS p,
        1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
    FROM sums s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * d}) & 31 AS INTEGER), 1)"
    for g in range(4)
    for d in range(8)
)
OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT payload, max(page_id) AS first FROM p GROUP BY payload),
told AS (SELECT *, page_id IS DISTINCT FROM first AND first IS NOT NULL AS again FROM p JOIN firsts USING (payload))
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, true AS verified
FROM told
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
        + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
        + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > first, false) AS INTEGER) AS mask
    FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
        CASE WHEN strpos(filter_order, 'A') < step THEN 1 ELSE 0 END + CASE WHEN strpos(filter_order, 'B') < step THEN 2 ELSE 0 END
        + CASE WHEN strpos(filter_order, 'C') < step THEN 4 ELSE 0 END + CASE WHEN strpos(filter_order, 'D') < step THEN 8 ELSE 0 END
        + CASE WHEN strpos(filter_order, 'E') < step THEN 16 ELSE 0 END AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (SELECT part, filter_order, step, x,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
    FROM c, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM told
"""

_ALL = (
    op1_quality,
    op2_toxicity,
    op3_pii,
    op4_secrets,
    op5_decontamination,
    op6_simhash,
    op7_mixing,
    op8_token_rollup,
    op9_quality_rules,
    op10_url_filter,
    op11_source_divergence,
    op12_warc,
    op13_filter_interactions,
    pipeline,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op5_decontamination": OP5_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_filter_interactions": OP13_SQL,
}
