"""Near duplicates against exact similarities of all pairs."""

import random

import corpus_pipeline
import numpy as np
from fieldtally.llm import near
from fieldtally.llm.shared import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def plain_kept(rows, size=5, least=0.8):
    """doc_ids that stay; all rows have one."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    kept = {}
    for i, (d, _) in enumerate(rows):
        kept[root(i)] = min(d, kept.get(root(i), d))
    return sorted(kept.values())


def edited(text, rng, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"other{rng.randrange(1000)}"
    return " ".join(words)


def test_stage_against_all_pairs(spark):
    rng = random.Random(5)
    base = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    long = [t for _, t in base if t and len(t.split()) > 150][:60]
    rows = base + [(10**6 + i, edited(t, rng, max(1, len(t.split()) * (i % 5) // 150))) for i, t in enumerate(long)]
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "two words"), (10**7 + 3, "Two  words")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(rows) - 20


def test_large_groups_give_a_forest():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 256, (2, 64), np.uint8)
    rows = np.array([one] * 30 + [two] * 30)
    for r in rows:
        r[rng.integers(0, 64, 3)] = rng.integers(0, 256, 3)
    a, b = near.bucket_pairs(rows, 0.6)
    assert len(a) == 58 and ((a < 30) == (b < 30)).all()


def test_no_link_is_lost_in_large_buckets(spark, monkeypatch):
    # Edited copies of templates, at similarities around the limit; small tiles, so that there are many.
    monkeypatch.setattr(near, "TILE", 40)
    rng = random.Random(9)
    rows = []
    for t in range(3):
        base = " ".join(f"w{t}x{rng.randrange(5000)}" for _ in range(300))
        rows += [(1000 * t + i, edited(base, rng, rng.randrange(2, 12))) for i in range((300, 120, 40)[t])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in near.one_of_each(docs).collect())
    want = plain_kept(rows)
    assert 30 < len(want) < len(rows) - 30 and got == want


def test_clashing_names(spark):
    names = ["_doc", "_key", "_row_key", "id", "row_key", "given", "words", "first"]
    docs = spark.createDataFrame([(1, "a b c d e f", *range(8)), (2, "a b c d e f", *range(8))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = near.one_of_each(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", *range(8))]


def test_rows_and_empty(spark):
    rows = [(None, "a b c d e f g"), (None, "h i j k l m n"), (1, "o p q r s t u"), (1, "a b c d e f g"), (1, "o p q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.one_of_each(docs).collect()
    assert sorted((r.text, r.doc_id) for r in got) == [("a b c d e f g", 1), ("h i j k l m n", None), ("o p q r s t u", 1)]
    assert near.one_of_each(docs.where(F.lit(False))).count() == 0


def test_trie_of_fingerprints_links_without_bands(spark, monkeypatch):
    # One changed word in 2000: fingerprints that differ in few bits. The third text is another one.
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))
    words = text.split()
    rows = [(1, text), (2, " ".join([*words[:1000], "other", *words[1001:]])), (3, " ".join(reversed(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "candidates", lambda distinct, similarity: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in near.one_of_each(docs).collect()) == [1, 3]


def test_whole_rows_are_shuffled_once(spark):
    # The last step only: what picks the rows is stored. One exchange of the rows, one of the keys to keep.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (0, "h i j k l m n"), (None, "h i j k l m n"), (1, "a b c d e f g"), (1, "a b c d e f g"), (None, "u v w")]
        got = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted((r.text, r.doc_id) for r in got.collect()) == [("a b c d e f g", 1), ("h i j k l m n", 0), ("u v w", None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
