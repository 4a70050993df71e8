"""Source divergence audit by one-hot level products.

How far apart two sources of a language are is the sum over all kept terms of the difference of
their smoothed shares. A share depends only on the source and on how often the term occurs in it,
its count level. So each (source, level) is an indicator column over terms, and the
product of that matrix with its transpose is the joint table of every pair of sources: for how many
terms one has level a and the other level b. The tables are priced with the differences of the
levels' shares. All are whole numbers and sums of products stay exact.

The matrix is blocked. Terms of a language are dealt to blocks of about ``TERMS`` by a hash, apart
for each magnitude of their total count, so that a block of rare terms has few levels; a block is cut further
where its levels are more than ``LEVELS``. Sources are dealt to blocks of ``SOURCES``, and a task has one
block of terms and two of sources, however many of either there are. Pricing is linear, so a block's joint tables are
priced where they are made and only prices by pair of sources are summed.

Texts are read once: tasks count terms of whole texts by (language, source) before anything is shuffled.
Shares are exact decimal divisions. The leading terms of a source are a window with a limit on ranks, which Spark cuts in each task.

Edge cases: null text, language and source are empty strings. A source without terms still has its rows
in part ``pair`` (and is the item of others); a language without kept terms has values 0. Ties are ordered by
the item's UTF-8 bytes. Rows that repeat are documents each. Very long texts are
a slice of a batch of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_join, stored

BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # between terms
LEAST_DOCS = 30
LEADING = 50
TERMS = 2048
LEVELS = 512
SOURCES = 64
SLICE = 8 << 20

COUNTS = "lang string, source string, term string, n long, docs long"


def _emit(langs, sources, terms, n, docs) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    cols = [x.cast(k) if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((langs, sources, terms, n, docs), kinds)]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])


def _term_counts(batches):
    """Terms of each slice of texts counted by group; and a row without a term for each group."""
    groups: dict[tuple[str, str], int] = {}
    for batch in batches:
        texts, langs, sources = (pc.fill_null(batch.column(i).cast(pa.large_string()), "") for i in range(3))
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        named = list(zip(langs.to_pylist(), sources.to_pylist()))
        for g in named:
            groups[g] = groups.get(g, 0) + 1
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
            yield from _counted_slice(texts.slice(start, stop - start), named[start:stop])
            start = stop
    if groups:
        yield _emit([g[0] for g in groups], [g[1] for g in groups], [None] * len(groups), [0] * len(groups), list(groups.values()))


def _counted_slice(texts, named):
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    words, doc = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(words, "")
    words, doc = words.filter(real).dictionary_encode(), doc.filter(real).to_numpy(zero_copy_only=False)
    if not len(doc):
        return
    code, width = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    per_doc, n = np.unique(doc.astype(np.int64) * width + code, return_counts=True)
    names = list(dict.fromkeys(named))
    number = {g: i for i, g in enumerate(names)}
    group = np.array([number[g] for g in named])
    key, inverse = np.unique(group[per_doc // width] * width + per_doc % width, return_inverse=True)
    lang, source = (pa.array([g[i] for g in names]).take(pa.array(key // width)) for i in (0, 1))
    yield _emit(lang, source, words.dictionary.take(pa.array(key % width)), np.bincount(inverse, n).astype(np.int64), np.bincount(inverse))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs; a row with a null term for each group."""
    slim = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    return slim.mapInArrow(_term_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * (cast({n} as decimal(19, 0)) + 5)) div (cast({total} as decimal(19, 0)) + 5 * cast({terms} as decimal(19, 0)))")


PRICES = "lang string, source string, item string, value long"


def _tables_priced(counts: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """Sums by pair of columns of |price - price| over the rows, through the joint tables of their levels."""
    rows, width = counts.shape
    levels, column = np.unique(counts + np.arange(width) * (counts.max() + 1), return_inverse=True)
    column = column.reshape(rows, width)
    if len(levels) > LEVELS and rows > 1:
        return _tables_priced(counts[: rows // 2], prices[: rows // 2]) + _tables_priced(counts[rows // 2 :], prices[rows // 2 :])
    hot = np.zeros((rows, len(levels)), np.float32)  # products count rows: exact up to 2^24 of them
    hot[np.arange(rows)[:, None], column] = 1
    joint = (hot.T @ hot).astype(np.int64)
    price = np.zeros(len(levels), np.int64)
    price[column] = prices
    joint *= np.abs(price[:, None] - price)
    first = np.searchsorted(levels, np.arange(width) * (counts.max() + 1))
    return np.add.reduceat(np.add.reduceat(joint, first, axis=0), first, axis=1)


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    roster = rows[rows["term"].isna()].sort_values(["side", "source"])
    at = {s: i for i, s in enumerate(roster["source"])}
    floor, side = roster["price"].to_numpy(np.int64), roster["side"].to_numpy()
    entries = rows[rows["term"].notna()]
    codes, present = pd.factorize(entries["term"])
    # Terms of the block that no source here has.
    value = (int(roster["terms"].iloc[0]) - len(present)) * np.abs(floor[:, None] - floor)
    if len(present):
        column = entries["source"].map(at).to_numpy()
        counts, prices = np.zeros((len(present), len(at)), np.int64), np.tile(floor, (len(present), 1))
        counts[codes, column], prices[codes, column] = entries["n"].to_numpy(), entries["price"].to_numpy()
        order = np.argsort(counts.sum(axis=1), kind="stable")
        value = value + _tables_priced(counts[order], prices[order])
    names = roster["source"].to_numpy()
    # Sources of one block meet in that block's own task, others where the two blocks meet.
    wanted = ~np.eye(len(names), dtype=bool) if side.min() == side.max() else side[:, None] != side
    i, j = np.nonzero(wanted)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": names[i], "item": names[j], "value": value[i, j]})


def pair_values(entries: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: of every ordered pair of sources of a language.

    entries: lang, source, term, n, total, price, bin; groups: lang, source, price (at count 0), side
    (its block); langs: lang, sides (how many blocks).
    """
    magnitude = F.when(F.col("total") > 0, F.floor(F.log2("total"))).otherwise(0).cast("int")
    terms = entries.select("lang", "term", magnitude.alias("tier")).distinct()
    tiers = stored(terms.groupBy("lang", "tier").agg(F.ceil(F.count("*") / TERMS).cast("int").alias("parts")), "divergence-tiers")
    rows = entries.select("lang", "source", "term", "n", "price", "side", "sides", magnitude.alias("tier"))
    rows = bounded_join(rows, tiers, ["lang", "tier"], F.col("term"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    rows = stored(rows, "divergence-blocks")
    blocks = rows.groupBy("lang", "tier", "part", "term").agg(F.lit(1)).groupBy("lang", "tier", "part").agg(F.count("*").alias("terms"))
    # A block without terms, so that languages that keep none have their pairs.
    blocks = blocks.unionByName(langs.select("lang", F.lit(-1).alias("tier"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("terms")))
    roster = blocks.join(groups, "lang").join(langs, "lang")
    columns = ["lang", "tier", "part", "source", "term", "n", "price", "side", "sides", "terms"]
    both = roster.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}).select(*columns)
    both = both.unionByName(rows.withColumn("terms", F.lit(0).cast("long")).select(*columns))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    both = both.select(*columns, other.alias("other"))
    both = both.withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")}).drop("other", "sides")
    # One block against itself has each row once; of two, each source is in one.
    return both.groupBy("lang", "tier", "part", "one", "two").applyInPandas(_block, PRICES).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, leading: int = LEADING) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counts = stored(term_counts(docs), "divergence-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = stored(kept.where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
    found = stored(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "divergence-found")
    groups = counts.where("term is null").select("lang", "source")
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = groups.join(sums, ["lang", "source"], "left").fillna(0, ["in_group"]).withColumn("side", F.floor(number / SOURCES).cast("int"))
    langs = groups.groupBy("lang").agg((F.max("side") + 1).alias("sides"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("in_lang")), "lang", "left").fillna(0, ["terms", "in_lang"])
    groups = stored(groups.join(langs, "lang"), "divergence-groups")
    langs = stored(groups.select("lang", "sides").distinct(), "divergence-langs")
    rows = bounded_join(found, groups, ["lang", "source"], F.col("term"))
    rows = rows.withColumns({"price": share("n", "in_group", "terms"), "usual": share("total", "in_lang", "terms")})
    rows = stored(rows.select("lang", "source", "term", "n", "total", "price", "usual", "side", "sides"), "divergence-entries")
    floor = F.when(F.col("terms") > 0, share("0", "in_group", "nullif(terms, 0)")).otherwise(0)
    pairs = pair_values(rows, groups.select("lang", "source", floor.alias("price"), "side"), langs)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = rows.where("price > usual").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("price") - F.col("usual")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best).cast("int"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= leading))
