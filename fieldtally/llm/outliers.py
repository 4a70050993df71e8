"""Quality rules by robust multivariate outliers, with built-in functions only.

Each text gets five statistics, transformed so that ordinary texts scatter evenly:
log of its words, letters per word, and the square roots of the shares of signs,
repeated lines and repeated words. For each language and source, each language, and
all texts, the minimum covariance determinant is sought: from several starts (the
medians with fixed scales, and a few rows picked by hash) means and covariances are
taken from the ``KEEP`` share of rows that are closest by the last estimate, until the
determinant falls no more; the start with the least determinant counts. A floor on
each statistic's variance, inside the determinant, keeps statistics that are nearly
always zero from rejecting small deviations.

Estimates are scaled so that the median distance fits a normal cloud, and shrunk:
a group of n texts takes n / (n + ``SHRINK``) of its own estimate and the rest of its
language's, which is shrunk towards that of all texts in the same way. Rows are
rejected whose squared Mahalanobis distance exceeds ``CUT``. Verdicts change smoothly
with the size of a group, and every text with words is judged.

Texts are read once into a slim stored table. Every step joins the estimates that
still move to it (broadcast if few, else salted) and sums moments before the shuffle, so
a group with a third of all rows is no single task. Closest shares and medians are
quantiles to one part in ``ACCURACY``.

Edge cases: a null or empty text has no words and fails the base rule. Very long texts
take one row like others. Null languages and sources are groups of their own. Rows that
repeat a doc_id each get their row. Ties at the closest share are all taken. An empty
table gives none. Only doc_id, text, lang and source are read, whatever other columns
are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, WORD, bounded_join, fresh_path, stored, whole

WINDOW = 8
NAMES = ("length", "letters", "signs", "lines", "repeats")
FLOOR = (0.3, 0.5, 0.04, 0.15, 0.15)  # least standard deviation of each statistic
KEEP = 0.75
STARTS = 4  # the medians, and three picks
PICK = 6  # rows of a picked start, on average: one more than statistics
REST = 1e-3  # least relative fall of a determinant for another step
CUT = 45.0  # a normal cloud in five dimensions exceeds it once in 7e7 rows
MEDIAN = 4.351  # of the chi-squared distribution with five degrees of freedom
SHRINK = 50
ACCURACY = 10_000
GROUP = ["level", "g_lang", "g_source"]
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
CENTRE = [f"c_{n}" for n in NAMES]
COVARIANCE = [f"v_{i}_{j}" for i, j in PAIRS]


def with_repeated_words(rows: DataFrame, words: str) -> DataFrame:
    """Adds n_repeat_words: words in 8-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes. Only where two are equal are they sorted with
    their places; each repeated window then covers the words up to the next one. Each
    step is a column of its own, so that Spark evaluates it once.
    """
    rows = rows.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(1), F.size("_hashes") - WINDOW + 1)
    windows = F.when(F.size("_hashes") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))))
    rows = rows.withColumn("_windows", windows)
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ranked = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_ranked", F.when(twice, ranked))

    def repeated(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_ranked", i - 1)["h"])
        return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(F.get("_ranked", i + 1)["h"])

    rows = rows.withColumn("_places", F.sort_array(F.transform(F.filter("_ranked", repeated), lambda x: x["i"])))
    covered = F.transform("_places", lambda p, i: F.least(F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_hashes", "_windows", "_ranked", "_places")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = F.col("_text")
    first = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), whole(F.col("text")).alias("_text"))
    split = first.withColumn("_words", F.filter(F.split(text, SPACES + "+", -1), lambda w: w != ""))
    split = split.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    lines = F.col("_lines")
    return with_repeated_words(split, "_words").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
        "n_repeat_words",
    )


def with_vector(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    vector = {
        "length": F.log1p("n_words"),
        "letters": F.least(F.col("word_chars") / words, F.lit(100.0)),
        "signs": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return stats.select("*", *[v.alias(f"x_{k}") for k, v in vector.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def grouped(rows: DataFrame, level: Column) -> DataFrame:
    """Adds ``GROUP``, the key of the estimate of a level: 0 language and source,
    1 language, 2 all."""
    rows = rows.withColumn("level", level)
    return rows.withColumn("g_lang", F.when(F.col("level") < 2, F.col("lang"))).withColumn("g_source", F.when(F.col("level") == 0, F.col("source")))


def _moments(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per key the means and the covariances with floors, about the last centre so
    that no digits are lost."""
    x = [F.col(f"x_{n}") - F.col(c) for n, c in zip(NAMES, CENTRE)]
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("m"),
        *[F.first(c).alias(c) for c in CENTRE],
        *[F.sum(x[i]).alias(f"s_{i}") for i in range(len(NAMES))],
        *[F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i, j in PAIRS],
    )
    mean = lambda name: F.col(name) / F.col("m")
    centre = [(F.col(c) + mean(f"s_{i}")).alias(c) for i, c in enumerate(CENTRE)]
    floor = lambda i, j: F.lit(FLOOR[i] ** 2 if i == j else 0.0)
    cov = [(mean(f"q_{i}_{j}") - mean(f"s_{i}") * mean(f"s_{j}") + floor(i, j)).alias(f"v_{i}_{j}") for i, j in PAIRS]
    return out.select(*key, *centre, *cov)


def factored(estimate: DataFrame) -> DataFrame:
    """Adds the inverse of the covariance's Cholesky factor and the log of its determinant.

    With the floors no pivot falls below its floor, but for rounding."""
    log_det = F.lit(0.0)
    for i, j in PAIRS:
        rest = F.col(f"v_{i}_{j}")
        for m in range(j):
            rest = rest - F.col(f"l_{i}_{m}") * F.col(f"l_{j}_{m}")
        estimate = estimate.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j else rest / F.col(f"l_{j}_{j}"))
        if i == j:
            log_det = log_det + 2 * F.log(F.col(f"l_{i}_{i}"))
    for i, j in PAIRS:  # its inverse
        below = F.lit(1.0 if i == j else 0.0)
        for m in range(j, i):
            below = below - F.col(f"l_{i}_{m}") * F.col(f"w_{m}_{j}")
        estimate = estimate.withColumn(f"w_{i}_{j}", below / F.col(f"l_{i}_{i}"))
    return estimate.withColumn("log_det", log_det).drop(*[f"l_{i}_{j}" for i, j in PAIRS])


def _distance(rows: DataFrame) -> DataFrame:
    """d2: the squared distance, a sum of squares with the inverse factor."""
    rows = rows.select("*", *[(F.col(f"x_{n}") - F.col(c)).alias(f"_d_{i}") for i, (n, c) in enumerate(zip(NAMES, CENTRE))])
    parts = [sum((F.col(f"w_{i}_{j}") * F.col(f"_d_{j}") for j in range(i)), F.col(f"w_{i}_{i}") * F.col(f"_d_{i}")) for i in range(len(NAMES))]
    rows = rows.select("*", *[part.alias(f"_y_{i}") for i, part in enumerate(parts)])
    total = sum((F.col(f"_y_{i}") * F.col(f"_y_{i}") for i in range(1, len(NAMES))), F.col("_y_0") * F.col("_y_0"))
    return rows.withColumn("d2", total).drop(*[f"_{k}_{i}" for k in "dy" for i in range(len(NAMES))])


def _quantile(column: str, share: float) -> Column:
    return F.percentile_approx(column, share, ACCURACY)


def _matched(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables of estimates on a key whose nulls are values."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in key], *[c for c in right.columns if c not in key])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key]
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in key])


def _starts(used: DataFrame, spread: Column) -> DataFrame:
    """The starts of every group with its number of texts."""
    medians = used.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *[_quantile(f"x_{n}", 0.5).alias(c) for n, c in zip(NAMES, CENTRE)])
    medians = stored(medians, "robust-medians")
    fixed = [F.lit(FLOOR[i] ** 2 if i == j else 0.0).alias(f"v_{i}_{j}") for i, j in PAIRS]
    first = medians.select(*GROUP, F.lit(0).alias("start"), *CENTRE, *fixed)
    rows = bounded_join(used, medians, GROUP, spread).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    drawn = F.pmod(F.xxhash64("start", "doc_id", *[f"x_{n}" for n in NAMES]), F.col("n")) < PICK
    picked = _moments(rows.where(drawn), [*GROUP, "start"])
    return _matched(first.unionByName(picked), medians.select(*GROUP, "n"), GROUP)


def estimates(used: DataFrame, spread: Column) -> DataFrame:
    """Per group the number of texts, centre, covariance and log determinant of the
    best start. ``used`` has ``GROUP`` and the vectors; it is stored already.

    A step takes the rows within the ``KEEP`` quantile of each estimate. The least
    determinant seen of a start is kept; it rests when a step lowers it by less than
    ``REST``. Determinants only fall, and not below that of the floors, so it ends.
    """
    key = [*GROUP, "start"]
    columns = [*key, "n", *CENTRE, *COVARIANCE, "log_det"]
    # The determinant of a start is that of other rows: any first step replaces it.
    moving = stored(factored(_starts(used, spread)).withColumn("log_det", F.lit(float("inf"))), "robust-starts")
    folder, step_no = fresh_path(used.sparkSession, "robust-rested"), 0
    moving.select(*columns).limit(0).write.parquet(f"{folder}/step=0")
    while moving.limit(1).count():
        step_no += 1
        far = _distance(bounded_join(used, moving, GROUP, spread)).where("d2 is not null")
        cut = far.groupBy(*key).agg(_quantile("d2", KEEP).alias("cut"))
        cut = stored(_matched(moving, cut, key), "robust-cut")
        near = _distance(bounded_join(used, cut, GROUP, spread)).where("d2 <= cut")
        last = moving.select(*columns).withColumnsRenamed({c: f"_{c}" for c in columns[len(key) + 1 :]})
        step = stored(_matched(factored(_moments(near, key)), last, key), "robust-step")
        lower = F.col("log_det") < F.col("_log_det")
        falls = F.col("log_det") < F.col("_log_det") - REST
        best = [F.when(lower, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in columns[len(key) + 1 :]]
        step.where(~falls).select(*key, "n", *best).write.parquet(f"{folder}/step={step_no}")
        moving = step.where(falls).drop(*[f"_{c}" for c in columns[len(key) + 1 :]])
    least = F.min(F.struct("log_det", "start", *CENTRE, *COVARIANCE)).alias("b")
    rested = used.sparkSession.read.schema(moving.select(*columns).schema).parquet(folder)
    return stored(rested.groupBy(*GROUP, "n").agg(least).select(*GROUP, "n", "b.*"), "robust-estimate")


def shrunk(used: DataFrame, spread: Column) -> DataFrame:
    """The estimate that each language and source is judged by."""
    found = estimates(used, spread)
    known = stored(factored(found), "robust-factors")
    far = _distance(bounded_join(used, known, GROUP, spread)).where("d2 is not null")
    middle = stored(far.groupBy(*GROUP).agg(_quantile("d2", 0.5).alias("middle")), "robust-middle")
    # Tight groups are not stretched: the scale is 1 at least.
    scale = F.greatest(F.col("middle") / MEDIAN, F.lit(1.0))
    found = _matched(found, middle, GROUP).select(*GROUP, "n", *CENTRE, *[(F.col(v) * scale).alias(v) for v in COVARIANCE])
    found = stored(found, "robust-scaled")
    own = F.col("n") / (F.col("n") + SHRINK)

    def towards(small: DataFrame, large: DataFrame, key: list[str]) -> DataFrame:
        wider = large.select(*key, *[F.col(c).alias(f"_{c}") for c in [*CENTRE, *COVARIANCE]])
        mixed = [(own * F.col(c) + (1 - own) * F.col(f"_{c}")).alias(c) for c in [*CENTRE, *COVARIANCE]]
        return _matched(small, wider, key).select(*GROUP, "n", *mixed)

    every = found.where("level = 2").withColumn("one", F.lit(1))
    langs = towards(found.where("level = 1").withColumn("one", F.lit(1)), every, ["one"])
    groups = towards(found.where("level = 0"), langs, ["g_lang"])
    return stored(factored(stored(groups, "robust-shrunk")), "robust-groups")


def verdicts(docs: DataFrame) -> DataFrame:
    """The counts, base_failed, the distance and kept for every document."""
    rows = stored(with_vector(statistics(docs)).withColumn("base_failed", base_failed()), "text-statistics")
    spread = F.col("doc_id")
    every_level = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    used = grouped(rows.where("n_words > 0").select("doc_id", "lang", "source", *[f"x_{n}" for n in NAMES]), every_level)
    out = _distance(bounded_join(grouped(rows, F.lit(0)), shrunk(used, spread), GROUP, spread))
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d2").alias("distance"),
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUT)).alias("kept"),
    )
