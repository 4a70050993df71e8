"""Personal data by weak supervision, with built-in functions only.

Base spans are plain patterns (e-mail, IP, card, phone). Further candidates
(numbers in groups, account and national numbers, handles, names after a title) are
judged by labelers that vote yes, no or nothing: a strict pattern, a gazetteer, the
words before the candidate, and the form of its characters. Expectation-maximisation
over the counts of vote patterns (at most 3**4 for each kind) estimates how reliable
each labeler is and how likely each pattern marks personal data. These posteriors
train the final span classifier, a naive Bayes model over features of the candidate;
candidates it gives ``ACCEPT`` or more are added to the base spans.

A text is read once into a slim stored table of its spans and votes; nothing is
joined and only counts are shuffled. What the driver holds are the vote patterns and
feature counts, bounded by the number of labelers and features.

Edge cases: a null text counts as empty and has no spans. Rows that repeat a doc_id
each get their row. Candidates that overlap a base span, or an earlier candidate, are not
added. Without candidates nothing is added. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, whole
from .spans import digits, find_spans, named, of_kind

KINDS = ("email", "ip", "card", "phone")
ADDED = ("account", "handle", "national", "number", "person")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"

# Candidates beyond the base kinds, in one pattern; the kind is told from the value.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Don|Doña"
CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:"
    r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    rf"|(?:{TITLES})\.?[\x20]\p{{Lu}}[\p{{L}}'-]+(?:[\x20]\p{{Lu}}[\p{{L}}'-]+)?"
    r"|@[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_@.])"
    r"|\(?[0-9]{2,5}\)?(?:[\x20/.-][0-9]{2,5}){2,4}(?![0-9.])"
    r")"
)
# Given names in the languages of the corpus, and words that announce or deny personal data.
GIVEN_NAMES = (
    "Anna Maria Laura Sofia Julia Emma Paula Elena Marie Claire Camille Sophie Lucie Ingrid Greta Petra Sabine Carmen Lucia "
    "James John Robert Michael David William Thomas Peter Paul Jean Pierre Louis Antoine Hans Karl Jürgen Stefan Klaus José "
    "Juan Carlos Luis Miguel Pedro Antonio Alice Mary Susan Linda Karen Sarah Jane Kevin Brian George Henry"
).split()
CUES = "phone|tel|telefon|téléphone|teléfono|mobile|call|fax|ssn|social security|passport|iban|account|konto|compte|cuenta|contact|name|born|dni|nif|twitter|user"
DENIALS = "version|page|isbn|issn|order|article|section|chapter|figure|table|release|build|line|price|total|date"
LABELERS = ("pattern", "gazetteer", "context", "form")
FEATURES = ("kind", "votes", "length", "signs")
ACCEPT = 0.9
ROUNDS = 30


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    def card(v: Column) -> Column:
        d = digits(v)
        return F.length(d).between(16, 19) & luhn(d)

    digit = text.rlike("[0-9]")
    return {
        "email": find_spans(text, EMAIL, gate=F.contains(text, F.lit("@")), context=False),
        "ip": find_spans(text, IP, lambda v: v.rlike(IP_VALID), gate=digit),
        "card": find_spans(text, CARD, card, gate=digit),
        "phone": find_spans(text, PHONE, lambda v: F.length(digits(v)).between(8, 15), gate=F.contains(text, F.lit("+"))),
    }


def kind_of(value: Column) -> Column:
    return (
        F.when(value.startswith("@"), "handle")
        .when(value.rlike("^[A-Z]{2}[0-9]{2}"), "account")
        .when(value.rlike(r"^\p{L}"), "person")
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national")
        .otherwise("number")
    )


def votes(value: Column, before: Column) -> list[Column]:
    """1, -1 or 0 of each labeler, in the order of LABELERS."""
    n = F.length(digits(value))
    kind = kind_of(value)
    pattern = (
        F.when(kind == "account", F.when(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), 1).otherwise(-1))
        .when(kind == "national", 1)
        .when(kind == "number", F.when(n.between(9, 12), 1).otherwise(-1))
        .when(kind == "handle", F.when(value.rlike("[A-Za-z]"), 1).otherwise(-1))
        .otherwise(0)
    )
    names = "|".join(GIVEN_NAMES)
    gazetteer = F.when(kind == "person", F.when(value.rlike(rf"[\x20](?:{names})(?![\p{{L}}])"), 1).otherwise(-1)).otherwise(0)
    near = F.lower(before)
    context = F.when(near.rlike(rf"(?<!\p{{L}})(?:{CUES})(?!\p{{L}})"), 1).when(near.rlike(rf"(?<!\p{{L}})(?:{DENIALS})(?!\p{{L}})"), -1).otherwise(0)
    form = (
        F.when(digits(value).rlike("^(.)\\1*$|^0|01234|12345|23456|34567|45678|56789"), -1)
        .when((kind == "number") & ~value.rlike(r"[\x20()-]"), -1)
        .when((kind == "number") & (F.length(F.regexp_replace(value, "[^./]", "")) > 0), -1)
        .when(kind.isin("account", "national"), 1)
        .otherwise(0)
    )
    return [pattern, gazetteer, context, form]


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, the base kinds' spans, and candidates with votes and features."""
    text = whole(F.col("text"))
    base = base_spans(F.col("_text"))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        *[c.alias(k) for k, c in base.items()],
        find_spans(F.col("_text"), CANDIDATE, gate=F.col("_text").rlike(rf"[0-9@]|(?:{TITLES})\.?[\x20]"), context=True).alias("_found"),
    )
    every = F.concat(*[F.col(k) for k in KINDS])

    def described(s: Column) -> Column:
        v = F.transform(F.array(*votes(s["value"], s["before"])), lambda x: x.cast("int"))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            kind_of(s["value"]).alias("kind"),
            F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("votes"),
            F.least(F.length(digits(s["value"])), F.lit(20)).cast("string").alias("length"),
            F.left(F.regexp_replace(s["value"], r"[^\x20./()@-]", ""), F.lit(3)).alias("signs"),
        )

    free = F.filter("_found", lambda s: ~F.exists(F.col("_every"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return first.withColumn("_every", every).select("doc_id", *[F.transform(k, lambda s: F.struct(s["start"], s["end"])).alias(k) for k in KINDS], F.transform(free, described).alias("candidates"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) pattern by expectation-maximisation.

    Labelers are independent given the truth; each has one rate of being right
    among the votes it gives, and each kind one share of true candidates. Counts
    of one vote each way keep the rates off 0 and 1.
    """
    right = [0.8] * len(LABELERS)
    share = {k: 0.5 for k, _, _ in patterns}
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(ROUNDS):
        for kind, v, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            odds += sum(x * math.log(a / (1 - a)) for x, a in zip(v, right))
            posterior[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for j in range(len(LABELERS)):
            given = sum(n for _, v, n in patterns if v[j])
            good = sum(n * (posterior[k, v] if v[j] > 0 else 1 - posterior[k, v]) for k, v, n in patterns if v[j])
            right[j] = min(0.99, max(0.5, (good + 4) / (given + 5)))  # a labeler is not worse than chance
        for kind in share:
            own = [(n, posterior[k, v]) for k, v, n in patterns if k == kind]
            share[kind] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)
    return posterior


def lookup(values: dict[str, float], key: Column) -> Column:
    """Value of a bounded table that travels as a literal; 0 where it has none."""
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def span_classifier(table: DataFrame) -> tuple[dict[str, dict[str, float]], float]:
    """Log odds of each feature's values, and the prior log odds."""
    one = table.select(F.explode("candidates").alias("c")).select("c.*")
    counted = one.groupBy("kind", "votes").count().collect()
    patterns = sorted((r["kind"], tuple(map(int, r["votes"].split(","))), r["count"]) for r in counted)
    posterior = reliabilities(patterns)
    soft = {f"{k}|{','.join(map(str, v))}": p for (k, v), p in posterior.items()}
    marked = one.withColumn("p", lookup(soft, F.concat_ws("|", "kind", "votes")))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    sums = marked.select("p", F.explode(pairs).alias("f")).groupBy("f.feature", "f.value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    yes = sum(n * posterior[k, v] for k, v, n in patterns)
    no = sum(n for _, _, n in patterns) - yes
    share = (yes + 0.5) / (yes + no + 1)
    prior = math.log(share / (1 - share))
    odds: dict[str, dict[str, float]] = {f: {} for f in FEATURES}
    # All four have few values: 5 kinds, 81 vote patterns, 21 lengths, 400 runs of three out of seven signs.
    for r in sums.collect():
        # One more candidate with the odds of all: values seen rarely say little.
        odds[r["feature"]][r["value"]] = math.log((r["yes"] + share) / (r["no"] + 1 - share)) - prior
    return odds, prior


def find(docs: DataFrame) -> DataFrame:
    """doc_id, an array of spans for each base kind, and ``added`` spans."""
    table = stored(extracted(docs), "pii")
    odds, prior = span_classifier(table)

    def likely(c: Column) -> Column:
        total = F.lit(prior)
        for f in FEATURES:
            total = total + lookup(odds[f], c[f])
        return total >= math.log(ACCEPT / (1 - ACCEPT))

    picked = F.filter("candidates", likely)
    return table.select("doc_id", *KINDS, F.transform(picked, lambda c: F.struct(c["kind"], c["start"], c["end"])).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The spans as text, counts and the base spans' hash."""
    base = F.concat(*[named(k, F.col(k)) for k in KINDS])
    more = F.concat(*[named(k, of_kind("added", k)) for k in ADDED])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
    )
