"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Raking scales the cells'
token weights to the marginals of each dimension in turn until all three hold:
ROUNDS rounds, then more until no marginal is off by more than TOLERANCE of its
target. A warning tells if MOST_ROUNDS do not reach that.
A document's probability is its cell's calibrated weight over its tokens,
times one factor chosen so that the expected tokens meet the budget although
no probability exceeds 1. A uniform number drawn from a hash of the id decides,
so a run can be repeated and does not depend on partitions.

Cells are one row per combination that occurs. Up to MAX_CELLS of them are
raked on the driver; more are raked by windows over the cells table. Both ways
run the same number of rounds.

Rows: a null or empty text has no tokens and is sampled with its cell's
probability; a null source, language or topic is a category of its own, and a
cell without any token has probability 0 (1 if the rate is 1); rows that repeat
an id are sampled together; an empty table gives no rows. Other columns are
carried, never read.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

DIMENSIONS = ("source", "lang", "topic")
#: Target marginals are the input's shares to this power, normalised: 0 is uniform, 1 leaves them.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
RATE, ROUNDS, FACTOR_ROUNDS, SEED = 0.5, 12, 8, "mix"
MAX_CELLS = 50_000
#: The largest error of a marginal as a share of its target, the most rounds for it, and rounds between two tests of it and two writes of the cells.
TOLERANCE, MOST_ROUNDS, WRITE_ROUNDS = 1e-6, 400, 4

WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A stand-in for topics where a table has none: the form of a document."""
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(" | ")), "table").when(tokens < 60, "brief").when(tokens < 600, "article").otherwise("long")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    shown = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(shown.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _report(error: float) -> None:
    if error > TOLERANCE:
        warnings.warn(f"raking stopped after {MOST_ROUNDS} rounds with a marginal off by {error:.2g} of its target", stacklevel=3)


def _rake_local(cells: DataFrame, targets: dict[str, dict], rounds: int) -> DataFrame:
    """Rakes at most MAX_CELLS cells on the driver."""
    rows = cells.collect()
    weight = np.array([float(r["t"]) for r in rows])
    codes, wanted = [], []
    for d in DIMENSIONS:
        names = list(targets[d])
        place = {n: i for i, n in enumerate(names)}
        codes.append(np.array([place[r[d]] for r in rows], np.int64))
        wanted.append(np.array([targets[d][n] for n in names]))
    error = 0.0
    for n in range(max(rounds, MOST_ROUNDS)):
        if n >= rounds and (n - rounds) % WRITE_ROUNDS == 0:
            off = [np.abs(np.bincount(code, weight, len(want)) - want)[want > 0] / want[want > 0] for code, want in zip(codes, wanted)]
            error = max((float(x.max()) for x in off if len(x)), default=0.0)
            if error <= TOLERANCE:
                break
        for code, want in zip(codes, wanted):
            have = np.bincount(code, weight, len(want))
            weight = weight * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code]
    _report(error)
    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", t long, w double"
    return cells.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), r["t"], float(w)) for r, w in zip(rows, weight)], schema)


def _error(cells: DataFrame, d: str) -> float:
    """The largest error of the dimension's marginals as a share of the target."""
    sums = cells.groupBy(d).agg(F.sum("w").alias("have"), F.first(f"__to_{d}").alias("want")).where("want > 0")
    return sums.agg(F.max(F.abs(F.col("have") - F.col("want")) / F.col("want"))).first()[0] or 0.0


def _rake_windows(cells: DataFrame, exponents: dict[str, float], rounds: int) -> DataFrame:
    """The same for any number of cells, by a window over the cells for each step."""
    now = cells.withColumn("w", F.col("t").cast("double"))
    for d in DIMENSIONS:
        total = cells.groupBy(d).agg(F.sum("t").cast("double").alias("__m")).withColumn("__g", F.when(F.col("__m") > 0, F.pow("__m", F.lit(exponents[d]))).otherwise(0.0))
        scale = total.agg(F.sum("__m"), F.sum("__g")).first()
        now = now.join(total.select(d, (F.col("__g") * F.lit((scale[0] or 0.0) / (scale[1] or 1.0))).alias(f"__to_{d}")), d)
    now = written(now, "cells")
    error = 0.0
    for n in range(max(rounds, MOST_ROUNDS)):
        if n >= rounds and (n - rounds) % WRITE_ROUNDS == 0:
            now = written(now, "raked")
            error = max(_error(now, d) for d in DIMENSIONS)
            if error <= TOLERANCE:
                break
        for d in DIMENSIONS:
            have = F.sum("w").over(Window.partitionBy(d))
            now = now.withColumn("w", F.when(have > 0, F.col("w") * F.col(f"__to_{d}") / have).otherwise(0.0))
        if n < rounds and n % WRITE_ROUNDS == WRITE_ROUNDS - 1:
            now = written(now, "raked")
    _report(error)
    return now.select(*DIMENSIONS, "t", "w")


def rake(docs: DataFrame, exponents: dict[str, float] | None = None, rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """Cells with their tokens t and raked weight w, and whether they are few.

    docs has the dimensions without nulls and __tokens.
    """
    exponents = exponents or EXPONENTS
    cells = written(docs.groupBy(*DIMENSIONS).agg(F.sum("__tokens").alias("t")), "mix-cells")
    if cells.limit(max_cells + 1).count() > max_cells:
        return _rake_windows(cells, exponents, rounds), False
    targets = {}
    for d in DIMENSIONS:
        total = {r[d]: float(r["t"]) for r in cells.groupBy(d).agg(F.sum("t").alias("t")).orderBy(d).collect()}
        share = {n: t ** exponents[d] if t > 0 else 0.0 for n, t in total.items()}
        scale = sum(total.values()) / (sum(share.values()) or 1.0)
        targets[d] = {n: s * scale for n, s in share.items()}
    return _rake_local(cells, targets, rounds), True


def probabilities(cells: DataFrame, rate: float = RATE, rounds: int = FACTOR_ROUNDS) -> DataFrame:
    """Adds p to the cells: min(1, factor * w / t), the factor chosen to spend rate of all tokens."""
    total = cells.agg(F.sum("t"), F.sum("w")).first()
    budget, factor = rate * float(total[0] or 0), rate
    for _ in range(rounds):
        full = F.lit(factor) * F.col("w") >= F.col("t")
        spent, open_weight = cells.agg(F.sum(F.when(full, F.col("t").cast("double")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not open_weight:
            break
        factor = max(factor, (budget - spent) / open_weight)
    return cells.withColumn("p", F.when(F.col("t") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("w") / F.col("t"))).otherwise(1.0 if rate >= 1 else 0.0))


def mix(docs: DataFrame, topic: Column | None = None, rate: float = RATE, exponents: dict[str, float] | None = None, seed: str = SEED, max_cells: int = MAX_CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs plus n_tokens, topic, weight (calibrated over plain), prob and kept."""
    own = [c for c in docs.columns if c not in ("n_tokens", "topic", "weight", "prob", "kept")]
    named = docs.withColumn("__tokens", n_tokens(F.col(text_col)))
    drawn = form_topic(F.col(text_col), F.col("__tokens")) if topic is None else topic.cast("string")
    named = named.withColumn("__drawn", drawn).withColumn("__topic", F.coalesce("__drawn", F.lit("(none)")))
    # a null is a category of its own, whatever the others are called
    category = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    keys = {"source": category(F.col("source").cast("string")), "lang": category(F.col("lang").cast("string")), "topic": category(F.col("__drawn"))}
    cells, few = rake(named.select(*[v.alias(k) for k, v in keys.items()], "__tokens"), exponents, max_cells=max_cells)
    cells = written(probabilities(written(cells, "raked-cells"), rate), "mix-probabilities")
    cells = cells.select(*[F.col(d).alias(f"__c_{d}") for d in DIMENSIONS], F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("__w"), F.col("p").alias("__p"))
    if few:
        cells = F.broadcast(cells)  # at most MAX_CELLS rows
    on = [keys[d] == F.col(f"__c_{d}") for d in DIMENSIONS]
    return named.join(cells, on).select(
        *own,
        F.col("__tokens").alias("n_tokens"),
        F.col("__topic").alias("topic"),
        F.round("__w", 6).alias("weight"),
        F.round("__p", 9).alias("prob"),
        (uniform(F.col(id_col), seed) < F.round("__p", 9)).alias("kept"),
    )


def op8_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "n_tokens", "topic", "weight", "prob", "kept")


def _sql() -> str:
    steps = [
        """d AS (SELECT *, CASE WHEN contains(x, ' | ') THEN 'table' WHEN n_tokens < 60 THEN 'brief' WHEN n_tokens < 600 THEN 'article' ELSE 'long' END AS topic
  FROM (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS x,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents))""",
        "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS t, CAST(sum(n_tokens) AS DOUBLE) AS w FROM d GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(f"m_{d} AS (SELECT {d}, CAST(sum(t) AS DOUBLE) AS m, CASE WHEN sum(t) > 0 THEN pow(CAST(sum(t) AS DOUBLE), {EXPONENTS[d]}e0) ELSE 0 END AS g FROM c0 GROUP BY 1)")
        steps.append(f"to_{d} AS (SELECT {d}, g * (SELECT sum(m) / sum(g) FROM m_{d}) AS want FROM m_{d})")
    at = "c0"
    for r in range(ROUNDS):
        for d in DIMENSIONS:
            new = f"c{r}_{d}"
            steps.append(f"{new} AS (SELECT source, lang, topic, t, CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * want / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w FROM {at} JOIN to_{d} USING ({d}))")
            at = new
    steps.append(f"raked AS MATERIALIZED (SELECT * FROM {at})")
    steps.append(f"f0 AS (SELECT CAST({RATE} AS DOUBLE) AS f)")
    for r in range(FACTOR_ROUNDS):
        steps.append(
            f"f{r + 1} AS MATERIALIZED (SELECT greatest(f, coalesce(({RATE} * CAST(sum(t) AS DOUBLE) - sum(CASE WHEN f * w >= t THEN CAST(t AS DOUBLE) ELSE 0 END)) / nullif(sum(CASE WHEN f * w >= t THEN 0 ELSE w END), 0), f)) AS f FROM raked, f{r} GROUP BY f)"
        )
    steps.append(f"p AS (SELECT raked.*, CASE WHEN t > 0 THEN least(1, f * w / t) ELSE 0 END AS p FROM raked, f{FACTOR_ROUNDS})")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, n_tokens, topic, round(CASE WHEN t > 0 THEN w / t ELSE 0 END, 6) AS weight, round(p, 9) AS prob,
       CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0 < round(p, 9) AS kept
FROM d JOIN p USING (source, lang, topic)"""
    )


SQL = _sql()
