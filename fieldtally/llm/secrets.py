"""Secret scans with multipart credential linking, with built-in functions only.

Base spans (assignments, access ids, long hex runs) are plain patterns and always
reported. Other parts of a credential are weak candidates: identifiers such as
``client_id = ...``, endpoints, and opaque tokens of mixed characters. On its own
none of them is evidence; it is reported only where complementary parts stand within
``SCOPE`` code points of it: a token with an identifier or an endpoint, an identifier or
endpoint with a secret. Distances are between starts; a part longer than a scope counts at its end as well.

The interval join runs on scopes: the text is cut into bins as wide as a scope, and
the parts of one role are summed up for each bin to their first and last place. A
candidate then meets three rows of each role, its own bin and both neighbours, whatever the
number of parts: the same answer as from all pairs, since in its own bin any part is in
reach, and in the next only the first (in the one before only the last) can decide.
Texts are read once into a slim stored table of spans; no text is shuffled.

Edge cases: a null text counts as empty. Rows that repeat a doc_id each get their
row; parts are linked by doc_id and text, so texts that share a doc_id do not mix.
Candidates that overlap a base span are not reported again. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, whole
from .spans import find_spans, of_kind

KINDS = ("assign", "access", "hex")
WEAK = ("endpoint", "identifier", "token")
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
)
_ASSIGN_HEAD = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
IDENTIFIER = r"(?<![A-Za-z0-9])(?i:client_?id|access_?id|key_?id|user_?name|user|login|account)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9@._-]{3,}+"
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|jdbc|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9._:/@-]{4,}+"
# At least 20 characters with a capital, a small letter and a digit: what keys look like and words do not.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
SCOPE = 256
# Which roles make a candidate of a role worth reporting.
COMPLEMENTS = {"token": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def base_spans(text: Column) -> dict[str, Column]:
    def long_value(v: Column) -> Column:
        return F.length(F.regexp_replace(v, _ASSIGN_HEAD, "")) >= 6

    return {
        "assign": find_spans(text, ASSIGN, long_value, gate=text.rlike("[:=]")),
        "access": find_spans(text, ACCESS, gate=F.contains(text, F.lit("AKIA"))),
        "hex": find_spans(text, HEX, gate=text.rlike("[0-9a-f]{24}")),
    }


def extracted(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Stored spans of every document: doc_id, text key, base kinds, weak candidates."""
    columns = keep or ["doc_id"]
    first = docs.select(*[F.col(f"`{c}`") for c in columns], whole(F.col("text")).alias("_text")).select(
        *[F.col(f"`{c}`") for c in columns],
        F.xxhash64("_text").alias("text_key"),
        *[c.alias(k) for k, c in base_spans(F.col("_text")).items()],
        find_spans(F.col("_text"), IDENTIFIER, gate=F.col("_text").rlike("[:=]")).alias("identifier"),
        find_spans(F.col("_text"), ENDPOINT, gate=F.contains(F.col("_text"), F.lit("://"))).alias("endpoint"),
        find_spans(F.col("_text"), TOKEN, gate=F.col("_text").rlike("[A-Za-z0-9+/_-]{20}")).alias("token"),
    )
    base = F.concat(*[F.col(k) for k in KINDS])

    def free(name: str) -> Column:
        return F.filter(name, lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["end"]))
    return first.withColumn("_base", base).select(*[F.col(f"`{c}`") for c in columns], "text_key", *[slim(k).alias(k) for k in KINDS], *[slim(free(k)).alias(k) for k in WEAK])


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def linked(table: DataFrame) -> DataFrame:
    """doc_id, text_key and ``weak``: the candidates with complementary parts in reach."""
    key = ["doc_id", "text_key"]
    weak = F.concat(*[_listed(k, F.col(k)) for k in WEAK])
    some = table.where(F.size(weak) > 0).select(*key, weak.alias("weak"), F.concat(*[F.col(k) for k in KINDS]).alias("base"), "access").distinct()

    def placed(spans: str) -> DataFrame:
        """Spans with the places ``at`` from which they reach: the start, and the end of one longer than a scope."""
        rows = some.select(*key, F.explode(spans).alias("c")).select(*key, "c.*")
        return rows.withColumn("at", F.explode(F.array_compact(F.array("start", F.when(F.col("end") - F.col("start") > SCOPE, F.col("end"))))))

    candidates = placed("weak").withColumn("bin", F.floor(F.col("at") / SCOPE))
    parts = placed("base").select(*key, F.lit("secret").alias("role"), "at")
    # An access id is an identifier as well.
    parts = parts.unionByName(placed("access").select(*key, F.lit("identifier").alias("role"), "at"))
    parts = parts.unionByName(candidates.select(*key, F.when(F.col("kind") == "token", "secret").otherwise(F.col("kind")).alias("role"), "at"))
    bins = parts.withColumn("bin", F.floor(F.col("at") / SCOPE)).groupBy(*key, "role", "bin").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    near = bins.select(*key, "role", "lo", "hi", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    a, b = candidates.alias("a"), near.alias("b")
    fits = F.lit(False)
    for kind, roles in COMPLEMENTS.items():
        fits = fits | ((F.col("a.kind") == kind) & F.col("b.role").isin(*roles))
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.bin") == F.col("b.bin")) & fits
    reach = F.least(F.abs(F.col("a.at") - F.col("b.lo")), F.abs(F.col("a.at") - F.col("b.hi"))) <= SCOPE
    between = (F.col("b.lo") <= F.col("a.at")) & (F.col("b.hi") >= F.col("a.at"))  # parts of the own bin
    kept = a.join(b, on & (reach | between), "left_semi")
    return kept.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("weak"))


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if none are named), base spans by kind and ``weak`` spans.

    ``keep`` has to hold doc_id."""
    table = stored(extracted(docs, keep), "secrets")
    weak = linked(table).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "weak")
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return table.join(weak, on, "left").select(*[F.col(f"`{c}`") for c in keep or ["doc_id"]], "text_key", *KINDS, F.coalesce("weak", none).alias("weak"))


def digest(found: DataFrame) -> DataFrame:
    """The spans as text, counts and the base spans' hash; spans by start, then kind."""
    rank = {k: i for i, k in enumerate((*KINDS, *WEAK))}

    def ordered(arrays: list[Column]) -> Column:
        rows = F.array_sort(F.concat(*arrays))
        return F.array_join(F.transform(rows, lambda r: F.concat(r["kind"], F.lit(":"), r["start"].cast("string"), F.lit(":"), r["end"].cast("string"))), ",")

    def sortable(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank[kind]).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = [sortable(k, F.col(k)) for k in KINDS]
    more = [sortable(k, of_kind("weak", k)) for k in WEAK]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(ordered(base).cast("binary"), 256).alias("base_sha256"),
        ordered(base + more).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span found replaced by ``[SECRET]``.

    Text and, if there is one, n_chars are changed; documents without spans stay as
    they are. Spans that overlap are replaced together.
    """
    every = find(docs).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.array_sort(F.concat(*[_place(F.col(k)) for k in KINDS], _place(F.col("weak")))).alias("_spans")
    )
    every = every.where(F.size("_spans") > 0).dropDuplicates(["_doc", "_key"])
    text = whole(F.col("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_key"))
    joined = docs.join(every, on, "left")
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]")))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    found = F.col("_spans").isNotNull()
    out = joined.withColumn("text", F.when(found, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(found, size).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _place(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
