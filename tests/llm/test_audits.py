"""Divergence of sources, archives and filter interactions against SQL and plain Python."""

import base64
import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from fieldtally.llm import divergence, interactions, queries, warc
from fieldtally.llm.shared import fresh_path, table
from harness import differences, duck
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
NEW = [q for q in queries.ORACLES if q.split("_")[0] in ("op11", "op12", "op13")]


@pytest.mark.parametrize("name", NEW)
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.001"])
def test_query_against_sql(spark, name, sf):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got) and differences(got, duck(sf).execute(queries.ORACLES[name]).df()) is None


def held_against(spark, name, run, **tables):
    """A query over small tables and its SQL over the same."""
    con = duckdb.connect()
    for n, df in tables.items():
        con.register(n, df.toPandas())
    con.execute("SET pandas_analyze_sample = 0")
    assert differences(run.toPandas(), con.execute(queries.ORACLES[name]).df()) is None


def odd_docs(spark, rows=400):
    rng = random.Random(3)
    words = ["The", "cat", "SAT", "on", "éa", "Éa", "mat", "x1y", "😀", "#tag", "zz\x00q"]
    data = []
    for i in range(rows):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 250])))
        text = rng.choice([None, "", "same text", text, text, text, text])
        data.append((rng.choice([i, i // 2, i]), text, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "a", "b", None, ""]), 1, "x"))
    data += [(10**6, "word " * 200_000 + "End\t#", "en", "long", 1, "x"), (10**6 + 1, None, "qq", "none", 1, "x")]
    data += [data[3], data[3]]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, id int, salt string")


def test_divergence_odd_rows(spark, monkeypatch):
    docs = odd_docs(spark)
    clash = docs.withColumn("term", F.lit("t")).withColumn("n", F.lit(2)).withColumn("price", F.lit(3))
    held_against(spark, "op11_source_divergence", divergence.audit(clash), documents=docs)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_in_many_blocks(spark, monkeypatch):
    # Tasks import the module anew, so that only what the driver decides is changed.
    docs = table(spark, SF, "documents")
    monkeypatch.setattr(divergence, "TERMS", 40)
    monkeypatch.setattr(divergence, "SOURCES", 3)
    held_against(spark, "op11_source_divergence", divergence.audit(docs), documents=docs)


def test_divergence_of_rows_without_counts(spark):
    rows = [(i, "", "en", f"s{i % 3}") for i in range(9)] + [(20, "few words", "fr", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.lang, r.source, r.item): (r.part, r.value, r["rank"]) for r in divergence.audit(docs).collect()}
    assert len(got) == 6 and got["en", "s0", "s1"] == ("pair", 0, 1) and got["en", "s0", "s2"] == ("pair", 0, 2)


@pytest.mark.parametrize("limit", [4, 512])
def test_joint_tables_price_as_differences(limit, monkeypatch):
    monkeypatch.setattr(divergence, "LEVELS", limit)
    rng = np.random.default_rng(limit)
    counts = rng.integers(0, 9, (60, 7)) ** rng.integers(0, 3, (60, 7))
    prices = counts * rng.integers(1, 50, 7) + rng.integers(0, 9, 7)
    want = np.abs(prices[:, :, None] - prices[:, None, :]).sum(axis=0)
    assert (divergence._tables_priced(counts, prices) == want).all()


def test_share_is_exact(spark):
    for n, total, terms in ((0, 0, 1), (7, 30, 3), (10**14, 3 * 10**14 + 1, 10**7), (2**60, 2**61, 12345)):
        got = spark.range(1).select(F.lit(n).alias("a"), F.lit(total).alias("b"), F.lit(terms).alias("c")).select(divergence.share("a", "b", "c")).first()[0]
        assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# --- archives ----------------------------------------------------------------

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\n\r\n"


def odd_pages():
    inner = RECORD % (len(HTTP) + 2, HTTP + "hi")
    data = [
        (1, "http://a/", "<p>one</p>"),
        (2, "http://a/\r\nWARC-Type: fake", "<p>one</p>"),
        (3, None, None),
        (4, "é", ""),
        (5, "u", "WARC/1.1\r\n"),
        (6, "u", inner),
        (7, "u", "text before " + inner * 3 + "and after"),
        (8, "u", RECORD % (10**6, "promises more than there is")),
        (9, "u", inner),
        (10, "u", "WARC/1.1\r\nContent-Length: 5"),
        (11, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
        (12, "u", "é😀" * 300_000),
        (13, "u", ("x" * 100 + inner) * 500),
        (14, "u", RECORD[:-4] % (3, "abc")),
        (None, "u", "<p>one</p>"),
        (None, "u", "only null ids"),
        (None, "u", "only null ids"),
    ]
    return data + [data[0], data[12]]


@pytest.fixture(scope="module", params=[1, 6])
def pages(spark, request):
    return spark.createDataFrame(odd_pages(), "page_id long, url string, html string").repartition(request.param)


@pytest.mark.parametrize("split", ["128m", "700", "64"])
def test_round_trip_of_odd_pages(spark, pages, split):
    if split == "64":
        pages = pages.where("coalesce(page_id, 0) not in (12, 13)")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    path = fresh_path(spark, "test-warc")
    warc.write(pages.withColumn("digest", F.lit(1)).withColumn("file", F.lit(2)), path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split if split != "700" else "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = warc.stored(warc.records(spark, path, payload=True), "test-records")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    first = {}
    for p, h in rows:
        first[h] = max((x for x in (p, first.get(h)) if x is not None), default=None)
    want = Counter()
    for p, h in rows:
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        again = first[h] is not None and p != first[h]
        want[p, len(h.encode()), digest, "revisit" if again else "response", first[h] if again else None, True] += 1
    assert Counter(map(tuple, warc.resolved(found).collect())) == want
    texts = Counter((r.page_id, bytes(r.payload).decode()) for r in found.where("record_type = 'response'").collect())
    assert texts == Counter((p, h) for p, h in rows if first[h] is None or p == first[h])


def test_file_is_a_chain_of_records(spark, pages):
    path = fresh_path(spark, "test-warc")
    warc.write(pages, path)
    n = 0
    for r in spark.read.format("binaryFile").load(path + "/*.txt").collect():
        data, at = bytes(r.content), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
            assert data[at:].startswith(b"WARC/1.1\r\n")
            at = end + 8 + int(head[b"Content-Length"])
            assert data[at - 4 : at] == b"\r\n\r\n"
            n += 1
    assert n == len(odd_pages())


def test_damage_ends_a_chain(spark, tmp_path):
    good = RECORD % (len(HTTP) + 2, HTTP + "hi")
    cases = {"a": good * 3 + "garbage" + good, "b": "x" + good, "c": good + good[:-3], "d": "", "e": good + RECORD % (-1, "")}
    for n, text in cases.items():
        (tmp_path / f"{n}.warc").write_bytes(text.encode())
    got = Counter(r.file[-6] for r in warc.records(spark, str(tmp_path)).collect())
    assert got == {"a": 3, "c": 1, "e": 1}


def test_least_bytes_and_empty(spark, pages):
    path = fresh_path(spark, "test-warc")
    warc.write(pages, path, least_bytes=11)
    kinds = {(r.page_id, r.record_type) for r in warc.records(spark, path).collect()}
    assert (1, "response") in kinds and (2, "response") in kinds and (6, "revisit") in kinds
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pointers_double(spark):
    rows = [("f", i, i + 1) for i in range(100)] + [("f", 1000, 50), ("g", 0, 7), ("g", 8, 9), ("h", 0, None)]
    got = warc.reached(spark.createDataFrame(rows, "file string, segment long, successor long")).collect()
    assert Counter(r.file for r in got) == {"f": 101, "g": 2, "h": 1}


# --- filters -----------------------------------------------------------------


def test_interactions_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 5 // 4) for i in range(0, 300, 2)] + [(2, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    clash = docs.withColumn("part", F.lit(1)).withColumn("same", F.lit(2)).withColumn("good", F.lit(True))
    held_against(spark, "op13_filter_interactions", interactions.audit(clash, labels.withColumn("salt", F.lit(9))), documents=docs, labels=labels)
    assert interactions.audit(docs.limit(0), labels).count() == 0


def test_null_ids_are_no_copies(spark):
    rows = [(None, "a", "en"), (None, "a", "en"), (5, "a", "en"), (7, "a", "fr"), (7, "a", "fr"), (5, "a", "en"), (3, "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.part: r for r in interactions.audit(docs, labels).where("filter_order = 'EABCD' and step = 1").collect()}
    assert (got["en"].removed, got["en"].kept, got["fr"].removed, got["fr"].kept) == (0, 5, 2, 0)


def test_adders_against_plain_counts():
    rng = np.random.default_rng(1)
    adder, want = interactions.Adder(), np.zeros(32, int)
    for size in (0, 1, 2, 3, 5, 1000, 7, 4096):
        words = rng.integers(0, 2**32, size, np.uint32)
        plane = int(rng.integers(0, 3))
        adder.add(words, plane)
        want += np.array([int(((words >> b) & 1).sum()) << plane for b in range(32)])
    assert adder.counts() == want.tolist() and all(len(p) <= 2 for p in adder.planes)


def test_survival_words():
    for failed, word in enumerate(interactions.SURVIVAL):
        assert all((int(word) >> s & 1) == (s & failed == 0) for s in range(32))


def test_shapley_sums_removals(spark):
    got = queries.op13_filter_interactions(spark, SF).collect()
    total, removed = defaultdict(int), {}
    for r in got:
        letter = r.filter_order[r.step - 1]
        total[r.part, letter] += r.removed
        removed[r.part, letter] = r.shapley
    assert total == removed and len({r.filter_order for r in got}) == len(list(permutations("ABCDE")))
