"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed for each cell of source, language and topic, which is
the only thing that is fitted: in turn, the cells' weights are scaled so that the
token shares of sources, languages and topics meet their targets, until the largest
deviation of a share is below ``TOLERANCE``. A document's weight is its cell's; its sampling
probability is that weight times ``SHARE``; where that exceeds 1, the expected tokens
are raked on with such cells held at 1, so that total and shares are still met. Documents are drawn by a hash of doc_id and text, so
retries and other partitionings draw the same ones.

Targets are shares by value of each dimension; those not given follow the
observed share to the power ``TEMPERATURE``, which lifts small sources. The cell
table has at most sources x languages x topics rows. It is counted: up to
``CELLS`` rows are raked on the driver, since each round would be jobs over a few rows; a
larger table stays distributed and goes through the same rounds as joins. Documents meet the
fitted cells by a size-checked join. ``miss`` is the largest deviation of a share of the
expected sample from its target, the same in all rows: above the tolerance where rounds ended
or targets cannot be met.

Edge cases: a null text has no tokens; its document has the cell's weight all the same.
Null sources and languages are values of their own. A value without a target keeps its
observed share; target values that no document has are left out, and targets are
scaled to 1. An empty table gives an empty result. Rows that repeat a doc_id and
text are drawn together. A very long text counts as any other; its words are counted in one pass. Columns
named in ``keep`` are passed on whatever their names; where one has a name that is added, it is renamed by the caller.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, bounded_join, stored, whole

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = 0.7
TOLERANCE = 1e-6
BOUND_TOLERANCE = 1e-4
MAX_ROUNDS = 200
SLACK = 1e-9  # sums in another order must not decide whether a cell is drawn whole
CELLS = 100_000
SHARE = 0.5
SEED = 20240117

# A document's topic is the first whose pattern its text has.
TOPICS = (
    ("legal", r"(?i)licensed under|all rights reserved|copyright"),
    ("credentials", r"(?i)password|token|api_?key|AKIA[A-Z0-9]{16}"),
    ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9][\x20().0-9-]{6,}[0-9]"),
    ("markup", r"[#*$%&|<>]"),
)
OTHER = "prose"


def topic_of(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(OTHER)


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every document as _given, with _source, _lang, _topic,
    _tokens and _draw (0 to 1) beside them."""
    text = whole(F.col("text"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), text), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_given"),
        F.col("source").cast("string").alias("_source"),
        F.col("lang").cast("string").alias("_lang"),
        topic_of(text).alias("_topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_tokens"),
        draw.alias("_draw"),
    )


def shares(cells: DataFrame, dimension: str, given: dict[str | None, float] | None, temperature: float) -> DataFrame:
    """value, target: what share of all tokens each value of a dimension is to have."""
    observed = cells.groupBy(F.col(f"_{dimension}").alias("value")).agg(F.sum("_tokens").cast("double").alias("tokens"))
    if given is None:
        raw = observed.withColumn("raw", F.pow("tokens", F.lit(temperature)))
    else:
        total = observed.agg(F.sum("tokens")).first()[0] or 1.0
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "named string, wanted double")
        raw = observed.join(named, F.col("value").eqNullSafe(F.col("named")), "left").withColumn("raw", F.coalesce("wanted", F.col("tokens") / F.lit(float(total))))
    raw = stored(raw.select("value", "raw"), "targets")
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select("value", (F.col("raw") / F.lit(float(total))).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """The cells with ``weight``: factors by which their tokens count."""
    now = stored(cells.withColumn("weight", F.lit(1.0)), "cells")
    total = now.agg(F.sum("_tokens")).first()[0]
    if not total:
        return now
    keys = [f"_{x}" for x in DIMENSIONS]
    for _ in range(MAX_ROUNDS):
        for d in DIMENSIONS:
            factor = _share(now, d, total).join(targets[d].withColumnRenamed("value", "goal"), F.col("value").eqNullSafe(F.col("goal")))
            factor = factor.select("value", F.when(F.col("share") > 0, F.col("target") / F.col("share")).otherwise(1.0).alias("factor"))
            now = now.join(factor, F.col(f"_{d}").eqNullSafe(F.col("value"))).select(*keys, "_tokens", (F.col("weight") * F.col("factor")).alias("weight"))
        now = stored(now, "cells")
        # The last dimension fits exactly; what the others are off by decides.
        off = None
        for d in DIMENSIONS[:-1]:
            one = _share(now, d, total).join(targets[d].withColumnRenamed("value", "goal"), F.col("value").eqNullSafe(F.col("goal")))
            one = one.select(F.abs(F.col("share") - F.col("target")).alias("off"))
            off = one if off is None else off.unionAll(one)
        if (off.agg(F.max("off")).first()[0] or 0.0) < TOLERANCE:
            break
    return now


def _share(cells: DataFrame, dimension: str, total: float) -> DataFrame:
    return cells.groupBy(F.col(f"_{dimension}").alias("value")).agg((F.sum(F.col("_tokens") * F.col("weight")) / F.lit(float(total))).alias("share"))


def goals_within(cells: DataFrame, targets: dict[str, DataFrame], share: float, total: float) -> dict[str, DataFrame]:
    """value, goal: the expected tokens of each value. None has more than its tokens;
    what a value cannot give is asked of the others of its dimension, by their targets."""
    out = {}
    for d in DIMENSIONS:
        have = cells.groupBy(F.col(f"_{d}").alias("_value")).agg(F.sum("_tokens").cast("double").alias("have"))
        both = stored(have.join(targets[d], F.col("_value").eqNullSafe(F.col("value"))).select("value", "target", "have"), "goals")
        scale = share * total
        for _ in range(30):
            full = F.col("have") <= F.col("target") * F.lit(scale * (1 + SLACK))
            row = both.agg(F.sum(F.when(full, F.col("have"))), F.sum(F.when(~full, F.col("target")))).first()
            rest = share * total - (row[0] or 0.0)
            if not row[1] or abs(rest / row[1] - scale) <= 1e-9 * scale:
                break
            scale = rest / row[1]
        out[d] = both.select("value", F.least("have", F.col("target") * F.lit(scale)).alias("goal"))
    return out


def _expected(cells: DataFrame, dimension: str) -> DataFrame:
    """Per value the expected tokens of cells drawn whole, of the others, and all before the cut."""
    whole_cell, pull = F.col("pull") >= 1 - SLACK, F.col("_tokens") * F.col("pull")
    return cells.groupBy(F.col(f"_{dimension}").alias("_value")).agg(
        F.sum(F.when(whole_cell, F.col("_tokens")).otherwise(0)).cast("double").alias("held"),
        F.sum(F.when(whole_cell, 0.0).otherwise(pull)).alias("free"),
        F.sum(pull).alias("pulled"),
    )


def probabilities(cells: DataFrame, share: float, targets: dict[str, DataFrame]) -> DataFrame:
    """Adds ``probability``: the weight times ``share``, raked on under the bound of 1.

    Where that cuts cells, the expected tokens min(1, pull) * tokens are raked again to
    ``share`` of all tokens with the targets' shares. A step to a value's goal is a tangent of
    a concave function, so it never goes beyond the goal. Goals that the tokens of
    a value, or the cells together, cannot meet are missed; ``marginals`` tells by how much.
    """
    total = cells.agg(F.sum("_tokens")).first()[0] or 0
    now = cells.withColumn("pull", F.col("weight") * F.lit(float(share)))
    if total and share < 1 and now.where("pull > 1 and _tokens > 0").limit(1).count():
        goals = {d: stored(g, "goals") for d, g in goals_within(cells, targets, share, float(total)).items()}
        before = float("inf")
        for _ in range(MAX_ROUNDS):
            for d in DIMENSIONS:
                step = _expected(now, d).join(goals[d], F.col("_value").eqNullSafe(F.col("value")))
                factor = F.greatest(
                    F.when(F.col("free") > 0, (F.col("goal") - F.col("held")) / F.col("free")),
                    F.when(F.col("pulled") > 0, F.col("goal") / F.col("pulled")),
                    F.when(F.col("goal") >= (F.col("held") + F.col("free")) * (1 - SLACK), F.lit(1.0)),
                )
                step = step.select("value", F.coalesce(factor, F.lit(1.0)).alias("factor"))
                pull = F.greatest(F.least(F.col("pull") * F.col("factor"), F.lit(1e6)), F.lit(1e-12))
                now = now.join(step, F.col(f"_{d}").eqNullSafe(F.col("value"))).select(*cells.columns, pull.alias("pull"))
            now = stored(now, "cells")
            off = None
            for d in DIMENSIONS:
                one = _expected(now, d).join(goals[d], F.col("_value").eqNullSafe(F.col("value")))
                one = one.select(F.abs(F.col("held") + F.col("free") - F.col("goal")).alias("off"))
                off = one if off is None else off.unionAll(one)
            miss = off.agg(F.max("off")).first()[0] or 0.0
            if miss < BOUND_TOLERANCE * share * total or miss > 0.98 * before:  # met, or at rest short of the goals
                break
            before = miss
    return stored(now.withColumn("probability", F.least("pull", F.lit(1.0))).drop("pull"), "cells")


def raked_here(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """The weights of ``raked`` for cells held in arrays; ``codes`` number the values of each dimension."""
    weight, total = np.ones(len(tokens)), tokens.sum()
    for _ in range(MAX_ROUNDS if total else 0):
        for code, target in zip(codes, targets):
            reached = np.bincount(code, tokens * weight, len(target)) / total
            weight *= np.where(reached > 0, target / np.where(reached > 0, reached, 1), 1.0)[code]
        off = [np.abs(np.bincount(c, tokens * weight, len(t)) / total - t).max() for c, t in zip(codes[:-1], targets)]
        if max(off) < TOLERANCE:
            break
    return weight


def probabilities_here(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], weight: np.ndarray, share: float) -> np.ndarray:
    """The probabilities of ``probabilities`` for cells held in arrays."""
    total, pull = tokens.sum(), weight * share
    if not (total and share < 1 and (pull[tokens > 0] > 1).any()):
        return np.minimum(pull, 1)
    goals = []
    for code, target in zip(codes, targets):
        have, scale = np.bincount(code, tokens, len(target)), share * total
        for _ in range(30):
            full = have <= target * scale * (1 + SLACK)
            rest, open_ = share * total - have[full].sum(), target[~full].sum()
            if not open_ or abs(rest / open_ - scale) <= 1e-9 * scale:
                break
            scale = rest / open_
        goals.append(np.minimum(have, target * scale))

    def expected(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = np.bincount(code, np.where(pull >= 1 - SLACK, tokens, 0), n)
        return held, np.bincount(code, np.where(pull >= 1 - SLACK, 0, tokens * pull), n)

    before = np.inf
    for _ in range(MAX_ROUNDS):
        for code, goal in zip(codes, goals):
            held, free = expected(code, len(goal))
            pulled = np.bincount(code, tokens * pull, len(goal))
            steps = np.full((3, len(goal)), -np.inf)
            np.divide(goal - held, free, out=steps[0], where=free > 0)
            np.divide(goal, pulled, out=steps[1], where=pulled > 0)
            steps[2][goal >= (held + free) * (1 - SLACK)] = 1.0
            factor = steps.max(axis=0)
            pull = np.clip(pull * np.where(np.isfinite(factor), factor, 1.0)[code], 1e-12, 1e6)
        miss = max(np.abs(sum(expected(c, len(g))) - g).max() for c, g in zip(codes, goals))
        if miss < BOUND_TOLERANCE * share * total or miss > 0.98 * before:
            break
        before = miss
    return np.minimum(pull, 1)


def fitted_here(cells: DataFrame, given: dict[str, dict[str | None, float]], share: float, temperature: float) -> DataFrame:
    """``fitted`` for a counted, short table of cells."""
    rows = cells.select(*[f"_{d}" for d in DIMENSIONS], "_tokens").collect()
    tokens, codes, targets = np.array([r._tokens for r in rows], float), [], []
    for d in DIMENSIONS:
        values = list(dict.fromkeys(r[f"_{d}"] for r in rows))
        number = {v: i for i, v in enumerate(values)}
        codes.append(np.array([number[r[f"_{d}"]] for r in rows], int))
        have = np.bincount(codes[-1], tokens, len(values))
        raw = have**temperature if d not in given else np.array([float(given[d].get(v, n / (tokens.sum() or 1.0))) for v, n in zip(values, have)])
        targets.append(raw / (raw.sum() or 1.0))
    weight = raked_here(tokens, codes, targets)
    chance = probabilities_here(tokens, codes, targets, weight, share)
    drawn = (tokens * chance).sum()
    miss = max(float(np.abs(np.bincount(c, tokens * chance, len(t)) / drawn - t).max()) for c, t in zip(codes, targets)) if drawn else 0.0
    kinds = ", ".join(f"_{d} string" for d in DIMENSIONS) + ", weight double, probability double, miss double"
    out = [(*(r[f"_{d}"] for d in DIMENSIONS), w, p, miss) for r, w, p in zip(rows, weight.tolist(), chance.tolist())]
    return stored(cells.sparkSession.createDataFrame(out, kinds), "cells")


def fitted_apart(cells: DataFrame, given: dict[str, dict[str | None, float]], share: float, temperature: float) -> DataFrame:
    """``fitted`` for a table of cells of any size: every round is joins and sums by value."""
    targets = {d: stored(shares(cells, d, given.get(d), temperature), "targets") for d in DIMENSIONS}
    found = probabilities(raked(cells, targets), share, targets)
    drawn, off = F.sum(F.col("_tokens") * F.col("probability")), None
    total = found.agg(drawn).first()[0] or 0.0
    for d in DIMENSIONS:
        one = found.groupBy(F.col(f"_{d}").alias("_value")).agg((drawn / F.lit(total or 1.0)).alias("reached"))
        one = one.join(targets[d], F.col("_value").eqNullSafe(F.col("value"))).select(F.abs(F.col("reached") - F.col("target")).alias("off"))
        off = one if off is None else off.unionAll(one)
    miss = off.agg(F.max("off")).first()[0] if total else 0.0
    return found.select(*[f"_{d}" for d in DIMENSIONS], "weight", "probability", F.lit(miss).alias("miss"))


def fitted(cells: DataFrame, given: dict[str, dict[str | None, float]], share: float, temperature: float) -> DataFrame:
    """The cells with weight, probability and miss."""
    short = cells.limit(CELLS + 1).count() <= CELLS
    return (fitted_here if short else fitted_apart)(cells, given, share, temperature)


def marginals(mixed: DataFrame, dimension: str) -> DataFrame:
    """value, expected: the share of the expected sampled tokens of each value."""
    drawn = F.sum(F.col("n_tokens") * F.col("probability"))
    total = mixed.agg(drawn).first()[0] or 1.0
    return mixed.groupBy(F.col(dimension).alias("value")).agg((drawn / F.lit(float(total))).alias("expected"))


def mix(
    docs: DataFrame,
    keep: list[str],
    targets: dict[str, dict[str | None, float]] | None = None,
    share: float = SHARE,
    temperature: float = TEMPERATURE,
    stage: bool = True,
) -> DataFrame:
    """``keep`` columns of every document with topic, n_tokens, weight, probability, miss, sampled.

    With ``stage`` what a text gives is stored, so that texts are read once; without it
    ``keep`` may hold long columns and texts are read twice.
    """
    rows = described(docs, keep)
    rows = stored(rows, "mixing") if stage else rows
    key = [f"_{d}" for d in DIMENSIONS]
    cells = stored(rows.groupBy(*key).agg(F.sum("_tokens").alias("_tokens")), "cells")
    cell = fitted(cells, targets or {}, share, temperature)
    out = bounded_join(rows, cell, key, F.col("_draw"))
    return out.select(
        *[F.col("_given")[c].alias(c) for c in keep],
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        "weight",
        "probability",
        "miss",
        (F.col("_draw") < F.col("probability")).alias("sampled"),
    )
