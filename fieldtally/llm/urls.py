"""URL filters by association rules.

Hand-written rules of host and path decide first; the longest that fits wins. For
other URLs, Spark's FP-growth mines combinations of URL tokens from labelled pages.
Combinations that imply a verdict with enough support and confidence become
rules; a rule that a shorter one with no less confidence implies is pruned. Rules are
kept in an inverted index by their rarest token, so a page is only held against
rules that it has that token of; the most confident fitting rule gives the verdict.

Edge cases: a URL that is null or has no ``://`` has an empty host and path, and its
tokens are those of the empty URL. Pages without a label are not mined. Rows that
repeat a page_id each get their row; in mining the label of a page counts once for
each of its rows. Without labels, or without rules that pass, the verdict is
``DEFAULT``. Of equally confident rules the one with more support wins, then ``block``.
Only page_id and url, doc_id, quality and toxic are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_join, stored

# verdict, host suffix, start of the path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT = 0.002  # share of labelled pages that have the combination
CONFIDENCE = 0.6
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.char_length(rest) + 4, F.char_length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), lower).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.char_length(rest) + 4, F.char_length(url))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """rule (host and path joined) and verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Host and path length decide; the last to match in this order wins.
    for verdict, suffix, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(suffix + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and host, path segments with digits masked, query keys."""
    masked = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), masked(x)))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    keys = F.transform(query, lambda x: F.concat(F.lit("query:"), masked(x)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1))))
    known = F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.array(F.concat(F.lit("site:"), host)), labels, segments, keys))
    return F.array_distinct(F.coalesce(known, F.array(F.lit("no url"))))


def tokenized(pages: DataFrame) -> DataFrame:
    """page_id, host, path, hand (rule and verdict) and tokens of every page."""
    url = F.col("_url")
    first = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("_url"))
    first = first.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    return first.select("page_id", "host", "path", ruled(F.col("host"), F.col("path")).alias("hand"), tokens_of(url, F.col("host"), F.col("path")).alias("tokens"))


def page_labels(labels: DataFrame) -> DataFrame:
    """page_id, label: block for toxic or low quality, else allow."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    usable = labels.where(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    return usable.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.when(bad, 1).otherwise(0)).alias("bad")).select("page_id", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label"))


def mined(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """antecedent (tokens), verdict, confidence, support of the rules that stay."""
    verdict = F.concat(F.lit("verdict:"), "label")
    baskets = stored(pages.join(labels, "page_id").select(F.concat("tokens", F.array(verdict)).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict:"))
    rules = rules.where(~F.exists("antecedent", lambda t: t.startswith("verdict:"))).select(
        F.sort_array("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), len("verdict:") + 1, 99).alias("verdict"), "confidence", "support", "lift"
    )
    # A rule must say more than the share of its verdict does.
    rules = stored(rules.where(F.col("lift") > 1.0).drop("lift"), "rules")
    # Pruned: those of which leaving out one token keeps the verdict at no less confidence.
    shorter = rules.where(F.size("antecedent") > 1).withColumn("short", F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))))
    kept = rules.select(F.col("antecedent").alias("short"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    weaker = shorter.join(kept, "short").where((F.col("verdict") == F.col("_v")) & (F.col("_c") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    return rules.join(weaker, ["antecedent", "verdict"], "left_anti")


def indexed(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """token, rules: the inverted index, each rule at the token fewest pages have."""
    members = rules.select(F.explode("antecedent").alias("token")).distinct()
    # Counted before they meet the rules: a token that most pages have is one row then.
    counts = pages.select(F.explode("tokens").alias("token")).groupBy("token").count().join(members, "token", "left_semi")
    places = rules.select("*", F.explode("antecedent").alias("token")).join(counts, "token")
    placed = places.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    return placed.groupBy("token").agg(F.collect_list(F.struct("confidence", "support", "verdict", "antecedent")).alias("rules"))


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, source of the verdict, and the mined rule's tokens."""
    table = stored(tokenized(pages), "urls")
    index = stored(indexed(mined(table, page_labels(labels)), table), "url-rules")
    # Pages that share their tokens are looked up once.
    kinds = table.where("hand is null").select("tokens").distinct().withColumn("kind", F.xxhash64(F.array_join("tokens", "\n")))
    each = kinds.select("kind", "tokens", F.explode("tokens").alias("token"))
    met = bounded_join(each, index, ["token"], F.col("kind")).where(F.col("rules").isNotNull())
    fitting = met.select("tokens", F.explode("rules").alias("r")).where(F.size(F.array_except("r.antecedent", "tokens")) == 0)
    best = fitting.groupBy("tokens").agg(F.max(F.struct("r.confidence", "r.support", "r.verdict", "r.antecedent")).alias("best"))
    best = stored(best.select(F.col("tokens").alias("_tokens"), "best"), "url-verdicts")
    out = table.join(best, F.col("tokens") == F.col("_tokens"), "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("hand.rule").alias("rule"),
        F.coalesce("hand.verdict", "best.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("hand").isNotNull(), "rule").when(F.col("best").isNotNull(), "mined").otherwise("default").alias("decided_by"),
        F.array_join("best.antecedent", " ").alias("mined_rule"),
    )
