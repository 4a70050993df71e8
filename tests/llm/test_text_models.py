"""Classifiers, SimHash, decontamination: the numpy parts and their Spark jobs."""

import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fieldtally.llm import decontamination, quality, queries, simhash, toxicity
from fieldtally.llm.shared import Tokens, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names clash."""
    rows = [
        (1, None, None, None, 1, "a"),
        (2, "", "en", "s", None, "b"),
        (3, LONG, "en", "s", 3, None),
        (4, "you idiot  moron", "en", None, 4, "c"),
        (4, "you idiot  moron", "en", None, 4, "c"),
        (None, "x y z", "de", "s", 5, "d"),
        (7, " \t\n", "de", "s", 5, "d"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, label string")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    return (rank[label == 1].mean() - rank[label == 0].mean()) / len(score) + 0.5


def test_tokens_are_hashed_by_their_bytes():
    texts = [b"one two!! one", b"", b"  two\tthree", "é é".encode(), b"x" * 3_000_000 + b" one"]
    tokens = Tokens(texts, (4,))
    per = [tokens.hash[a:b] for a, b in zip(tokens.first[:-1], tokens.first[1:])]
    assert [len(p) for p in per] == [4, 0, 2, 2, 2]
    assert per[0][0] == per[0][3] == per[4][1] and per[0][1] == per[2][0] and per[3][0] == per[3][1]
    assert len({int(h) for p in per for h in p}) == 6


@pytest.mark.parametrize("name,label,mod,held", [("op1_quality", "quality", 4, 2), ("op2_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, mod, held):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) == table(spark, SF, "documents").count()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % mod == held)).all()
    assert got.score.between(0, 1).all()
    both = got[got.held_out].merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    assert auc(both.score.to_numpy(), both[label].to_numpy()) > 0.9


def test_quality_odd_rows(spark, odd, no_labels):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (4, 0, 1), (99, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for given in (labels, no_labels):
        model = quality.fit(odd, given, F.lit(True))
        got = quality.score(odd, model).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 7)}) == 1
        assert quality.score(odd.limit(0), model).collect() == []


def test_toxicity_odd_rows(spark, odd, no_labels):
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, no_labels, F.lit(True))).collect()} == {0.0}
    clean = ["the cat sat on the mat", "we walk home now", "nice weather today friend"]
    rude = ["you are an idiot now", "what a moron he is", "idiot moron go home"]
    docs = [(i, (rude if i % 2 else clean)[i % 3], "en") for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    score = {(r.doc_id): r.score for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.5) == bool(d % 2) for d, s in score.items())
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert got[4] >= 0.5 > got[1] == got[2] == got[7]
    kept = toxicity.score(odd, model, odd.columns, "_toxicity")
    assert kept.columns == [*odd.columns, "_toxicity"] and kept.count() == 7


def test_scores_do_not_depend_on_batches(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"), F.lit(True), 200)
    texts = [(r.text or "").encode() for r in docs.limit(60).collect()]
    together = toxicity.score_texts(model, texts)
    alone = np.concatenate([toxicity.score_texts(model, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps):
    values = np.array(sorted(set(fps)), np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return {int(v): root(i) for i, v in enumerate(values)}


@pytest.mark.parametrize("direct", [1, 7, 4096])
def test_trie_links_against_all_pairs(direct, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(direct)
    values = set()
    for base in rng.integers(0, 2**63, 20, dtype=np.uint64):
        for _ in range(25):
            v = int(base)
            for b in rng.integers(0, 48, rng.integers(0, 5)):
                v ^= 1 << int(b)
            values.add(v)
    values = np.array(sorted(values), np.uint64)
    a, b = simhash.trie_links(values)
    parent = list(range(len(values)))
    for x, y in zip(a.tolist(), b.tolist()):
        assert np.bitwise_count(values[x] ^ values[y]) <= 3
    left, _ = simhash._forest(a, b, parent)
    assert len(left) == len(a)  # a forest: each link joins two trees

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = plain_components(values.tolist())
    for k, v in enumerate(values.tolist()):
        for m, w in enumerate(values.tolist()[:k]):
            assert (root(k) == root(m)) == (want[v] == want[w]) or values[k] >> np.uint64(48) != values[m] >> np.uint64(48)


def test_simhash_against_brute_force(spark, odd):
    base = table(spark, SF, "documents").select("doc_id", "text")
    words = F.split("text", " ")
    long = base.where(F.size(words) > 300)
    near = long.select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat(F.col("text"), F.lit(" tail")).alias("text"))
    docs = base.unionByName(near).unionByName(odd.select("doc_id", "text"))
    got = simhash.dedup_classes(docs).toPandas()
    rows = docs.collect()
    assert len(got) == len(rows)
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    group = plain_components([f for _, f in fps])
    least = {}
    for d, f in fps:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    want = sorted((-1 if d is None else d, f, least.get(group[f], -1)) for d, f in fps)
    have = sorted((int(d), int(f) & (2**64 - 1), int(c)) for d, f, c in got.fillna(-1).itertuples(index=False))
    assert have == want
    assert got.component_id.nunique() < got.fp.nunique()  # near links were there to be found


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5000, 5000)], "fp_a long, fp_b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000, 1002: 1000}
    assert simhash.components(edges.limit(0)).collect() == []


def test_one_of_each(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_one_of_each_decides_by_row(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (0, texts[3]), (1, texts[4]), (1, texts[3]), (1, texts[4]), (None, texts[4])]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (0, texts[3]), (1, texts[4])]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def plain_scan(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [20_000, 2])
def test_decontamination_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", block)
    long = " ".join(f"w{i % 29}" for i in range(40))
    items = [(1, long), (2, "Short  item, here"), (3, "w1 w2"), (4, None), (5, "..."), (6, long), (2, "other text")]
    texts = [None, "", "short ITEM here é short item HERE", f"x {long.upper()} y", "w1 w2 w2 w1 w2", "w1 w2. w3", "é! Ü w1\nw2 ü", long + " " + long, "other-text"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.find(docs, bench).collect():
        assert (r.n_words, r.n_hit, r["items"]) == plain_scan(texts[r.doc_id], items)
        for (a, b), (first, end) in zip(r.spans, r.hit_words):
            cut = texts[r.doc_id][a:b]
            assert plain_scan(cut, items)[0] == end - first and cut == cut.strip(" .!-\n")
    assert decontamination.find(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.find(docs.limit(0), bench).count() == 0


def test_toxicity_scores_in_short_pieces():
    # 4 MB of short words, a row of floats for each word: 400 MB at once, a quarter of it in pieces.
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(2100)]
    rows = [(i, i % 2, "en", toxicity.features([t.encode()])[0].tobytes()) for i, t in enumerate(texts[:40])]
    model = toxicity.fit_rows(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    want = toxicity.score_texts(model, [t.encode() for t in texts])
    tracemalloc.start()
    got = [x for out in toxicity.score_pieces(model, batch, ["doc_id", "text"], 1) for x in out.column("_score").to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert most < 150e6


def test_toxicity_learns_from_every_label(spark):
    # Each of 40 rude words is in six texts only; 60 rows of each class would not have most of them three times.
    rng = np.random.default_rng(11)
    rude = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(40)]
    plain = [f"word{i}" for i in range(30)]
    docs = [(i, " ".join([*rng.choice(plain, 5), *([rude[i // 2 % 40]] if i % 2 else []), *rng.choice(plain, 5)]), "en") for i in range(480)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(480)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, labels, F.lit(True), 60)
    owned = toxicity.rows_of(toxicity.features([" ".join(rude).encode()])[0], model.row_of, model.tag)
    assert (owned > 0).all()
    score = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert np.mean([(s >= 0.5) == bool(d % 2) for d, s in score.items()]) > 0.95
    again = toxicity.fit(table.repartition(5), labels, F.lit(True), 60)
    assert (again.table == model.table).all() and (again.cut == model.cut).all() and (again.out == model.out).all()


@pytest.mark.parametrize("piece_rows,size", [(400, 1 << 26), (400, 20_000), (20, 1 << 26)])
def test_toxicity_in_pieces_counts_as_in_one_go(spark, piece_rows, size, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE_BYTES", size)
    texts = [f"you idiot number w{i % 7} and w{i % 11}" if i % 3 == 0 else f"nice day w{i % 5} or w{i % 13}" for i in range(200)]
    rows = [(i % 190, int(i % 3 == 0), ["en", "de", None][i % 3 if i % 4 else 0], t) for i, t in enumerate(texts)]
    slim = spark.createDataFrame([(o, y, g, t.encode()) for o, y, g, t in rows], "order long, label int, lang string, text binary")
    one = toxicity.fit_rows([(o, y, g, toxicity.features([t.encode()])[0].tobytes()) for o, y, g, t in rows])
    got = toxicity.fit_pieces(slim.repartition(4), 1, piece_rows)
    assert (got.tag == one.tag).all() and len(np.unique(got.row_of)) == len(np.unique(one.row_of)) == len(got.table)
    assert np.allclose(got.language[got.row_of], one.language[one.row_of]) and np.allclose(got.prior, one.prior)
    raw = [toxicity.score_texts(got, [t.encode()])[0] >= 0.5 for _, _, _, t in rows]
    assert raw == [bool(y) for _, y, _, _ in rows]
    assert toxicity.fit_pieces(slim.where("label = 1"), 2, 20) is None
    # The only toxic rows are aside, fifth in their piece: then training takes all rows.
    few = slim.where("label = 0 and order < 40").withColumn("label", (F.col("order") == sorted(o for o, y, _, _ in rows if not y and o < 40)[4]).cast("int"))
    assert toxicity.fit_pieces(few, 1, 20) is not None


def test_cuts_by_spark_are_those_of_numpy(spark):
    rng = np.random.default_rng(5)
    for n, most in ((1, 3), (7, 3), (60, 6), (60, 40), (200, 1000)):
        raw, label, guess = rng.integers(0, most, n) / 4, rng.integers(0, 2, n), rng.integers(0, 3, n)
        rows = sorted(zip(raw.tolist(), label.tolist(), guess.tolist(), range(n)), key=lambda r: r[3])
        got = toxicity.best_cuts(spark.createDataFrame(rows, "raw double, label int, guess int, order long").repartition(3))
        for k in {-1, *guess.tolist()}:
            own = guess == k if k >= 0 else guess >= 0
            assert got[k] == (toxicity.best_cut(raw[own], label[own]), int((label[own] == 0).sum()), int(label[own].sum()))


def test_labels_meet_their_texts_by_either_join(spark, odd, monkeypatch):
    docs = spark.createDataFrame([(i % 900, f"text {i}") for i in range(1000)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i * 2, 1, i % 2) for i in range(500)] + [(4, 1, 0), (4, 1, 1), (None, 1, 1), (3, 1, None), (5, 1, 2)], "doc_id long, quality int, toxic int")
    some = quality.usable_labels(labels, "toxic", F.lit(True))
    assert 450 <= quality.passing(docs, some, 500).count() < 700
    one = Counter(map(tuple, quality.labelled_rows(docs, labels, "toxic", F.lit(True)).collect()))
    monkeypatch.setattr(quality, "SENT_ROWS", 10)
    two = Counter(map(tuple, quality.labelled_rows(docs, labels, "toxic", F.lit(True)).collect()))
    assert one == two and sum(one.values()) == 502
    assert quality.labelled_rows(odd, labels, "toxic", F.lit(True)).count() == 5
