"""From raw documents to a training mix: the stages, and the run over a folder of tables.

Each stage gets what its predecessor kept, and returns a DataFrame that is written
as Parquet before the next reads it. All but the last return the columns of documents.

* toxicity: documents scored 0.5 or more by the classifier go.
* near duplicates: of each component of texts whose five-word shingles have a Jaccard similarity of
  0.8 or more the document with the smallest doc_id stays. Pairs come from SimHash fingerprints, walked by their trie,
  and from MinHash bands.
* decontamination: documents of which a twentieth or more is benchmark text go.
* secrets: spans found are replaced in the text; no document goes.
* mixing: documents are sampled to the target weights, with their weight and probability.

An empty table passes through all stages. Rows that repeat a doc_id and text are one
document from the second stage on. Extra columns are passed on whatever their names, but for those that have a name of what
the last stage adds (topic, n_tokens, weight, probability, miss).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import decontamination, mixing, near, secrets, toxicity
from fieldtally.llm.queries import remainder
from fieldtally.llm.shared import stored, table


READ = ("doc_id", "text", "lang", "source")


def beside(stage):
    """The stage on columns that cannot clash with its own: others than it reads are numbered meanwhile."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        numbered = [c if c in READ else f"given column {i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*numbered), sf_dir).select(*[F.col(f"`{n}`").alias(c) for n, c in zip(numbered, names)])

    return run


@beside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model, docs.columns, "_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


@beside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


@beside
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns, prefix="_found_")
    return found.where(~decontamination.contaminated("_found_n_words", "_found_n_hit")).select(*[F.col(f"`{c}`") for c in docs.columns])


@beside
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = {"topic", "n_tokens", "weight", "probability", "miss", "sampled"}
    mixed = mixing.mix(docs, [c for c in docs.columns if c.lower() not in made], stage=False)
    return mixed.where("sampled").drop("sampled")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", sample_mix),
]
# Training, components and fitting are iterative: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
