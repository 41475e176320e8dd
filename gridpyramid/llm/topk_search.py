"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are quantised to integers. Candidates are dealt to shards by a hash of
the id; a shard's rows are ordered so that similar ones stand together (halved
by the dimension in which they differ most) and cut into blocks; a block keeps
the largest and smallest value of each dimension (the term maxima) and its rows
(the forward index). Over a block no score can exceed

    sum over dimensions of max(q * largest, q * smallest)

A query takes the blocks by falling bound, scores each through its forward
index, and stops once the next bound is below its k-th best score; bounds that
equal it are still scored, since ties go to the smaller id. What is skipped
cannot be in the result, so the search is exact.

Each query first searches one shard of its own; the k-th score it finds there
is where it starts in all others, so a shard without near rows costs bounds
only. Shards and groups of queries are then matched cell by cell: a task holds
one shard and one group, whatever the table's size. Vectors move once for each
group of queries, the queries once for each shard; each cell gives at most k
rows for a query and a window ranks them.

Rows: vectors that are null or hold null or non-finite components, and rows
without an id, take no part. Shorter vectors count as padded with zeros; an
empty vector scores 0. Rows that repeat a query's id count as the query's own.
Repeated ids among candidates each take a rank, and all rows of a repeated
query id ask and are ranked together. Components are whole numbers of any size;
where products could leave 64 bits, Python's integers take over, and a score
beyond a long raises an error. An empty table gives no rows. Other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, table, written

#: Rows of a block, of a shard, and queries of a group.
BLOCK_ROWS, SHARD_ROWS, GROUP_ROWS = 16, 8192, 8192
#: Products are exact in 64-bit floats below this, and in 64-bit integers below that.
EXACT_FLOAT, EXACT_INT = 2.0**52, 2.0**62
LEAST = -(2**63)


def quantised(vectors: list, scale: float = 256.0, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers, padded with zeros; of Python integers if one does not fit 62 bits."""
    width = max(map(len, vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() >= EXACT_INT:
        return np.array([[int(x) for x in row] for row in out], object).reshape(out.shape)
    return out.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; through floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < EXACT_FLOAT:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64) if most < EXACT_INT else a.astype(object) @ b.T.astype(object)


def similar_order(rows: np.ndarray, block_rows: int) -> np.ndarray:
    """An order in which similar rows stand together: parts are halved by the dimension of the widest spread down to blocks."""
    order = np.arange(len(rows))
    if not rows.shape[1]:
        return order
    values, open_ = rows.astype(np.float64), [(0, len(rows))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo <= block_rows:
            continue
        part = values[order[lo:hi]]
        half = max(block_rows, (hi - lo) // 2 // block_rows * block_rows)
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, part.std(0).argmax()], half)]
        open_ += [(lo, lo + half), (lo + half, hi)]
    return order


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None, block_rows: int | None = None):
    """(scores, ids, (blocks scored, blocks)): the k best of a shard for each query, ties to smaller ids.

    Scores below least, a score for each query, need not be found. Unfilled places have the score LEAST.
    """
    n, size = len(query_ids), block_rows or BLOCK_ROWS
    kind = object if object in (queries.dtype, rows.dtype) or _widest(queries, rows) >= EXACT_INT else np.int64
    best, best_ids = np.full((n, k), LEAST, kind), np.full((n, k), np.iinfo(np.int64).max)
    if not n or not len(ids):
        return best, best_ids, (0, 0)
    order = similar_order(rows, size)
    ids, rows = ids[order], rows[order]
    starts = np.arange(0, len(ids), size)
    if rows.shape[1]:
        largest, smallest = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
        bound = products(np.maximum(queries, 0), largest) + products(np.minimum(queries, 0), smallest)
    else:
        bound = np.zeros((n, len(starts)), np.int64)
    by_bound = np.argsort(-bound, axis=1, kind="stable")
    floor = np.full(n, LEAST, kind) if least is None else least.astype(kind)
    active, scored = np.arange(n), 0
    # a query takes several blocks a step, so that there are few steps
    step, width = 0, max(1, -(-4 * k // size))
    while step < len(starts) and len(active):
        reach = min(step + width, len(starts))
        block = by_bound[active, step:reach]
        go = (np.take_along_axis(bound[active], block, 1) >= np.maximum(best[active, -1], floor[active])[:, None]).astype(bool)
        alive = go[:, 0]  # bounds fall, so a query that stops is done
        active, block, go = active[alive], block[alive], go[alive]
        who, place = np.nonzero(go)
        dealt = block[who, place]
        by_block = np.argsort(dealt, kind="stable")
        for part in np.split(by_block, np.flatnonzero(np.diff(dealt[by_block])) + 1) if len(by_block) else []:
            mine, b = active[who[part]], dealt[part[0]]
            lo, hi = starts[b], min(starts[b] + size, len(ids))
            s = products(queries[mine], rows[lo:hi]).astype(kind)
            found = np.where(query_ids[mine][:, None] == ids[None, lo:hi], LEAST, s)
            if kind is object and (found.max() >= 2**63 or found.min() < LEAST):
                raise OverflowError("a score beyond a long")
            found_ids = np.where(found == LEAST, np.iinfo(np.int64).max, ids[None, lo:hi])
            both, both_ids = np.concatenate((best[mine], found), 1), np.concatenate((best_ids[mine], found_ids), 1)
            rank = _ranked(both, both_ids)[:, :k]
            best[mine], best_ids[mine] = np.take_along_axis(both, rank, 1), np.take_along_axis(both_ids, rank, 1)
            scored += len(mine)
        step, width = reach, min(2 * width, 64)
    return best, best_ids, (scored, n * len(starts))


def _widest(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0.0


def _ranked(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, then id."""
    if scores.dtype == object:
        return np.array([sorted(range(scores.shape[1]), key=lambda j: (-s[j], i[j])) for s, i in zip(scores, ids)])
    return np.lexsort((ids, ~scores))  # ~s falls as s rises and never overflows


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, with_blocks: bool = False) -> DataFrame:
    """query_id, rank, id and score of the k best candidates of each query row.

    with_blocks adds blocks_scored and blocks, the numbers of the whole search.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    usable = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(id_col).isNotNull()
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    total = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    shards, groups = max(1, -(-total[0] // SHARD_ROWS)), max(1, -(-total[1] // GROUP_ROWS))
    shard = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    asked = rows.where("q").select("id", "v", group.alias("group"), shard.alias("own"))
    schema = "query_id long, vec_id long, score long, found int, scored long, blocks long"

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = max([len(v) for v in left["v"]] + [len(v) for v in right["v"]], default=0)
        query_ids = right["id"].to_numpy(np.int64)
        queries, candidates = quantised(list(right["v"]), scale, width), quantised(list(left["v"]), scale, width)
        best, ids, (scored, blocks) = search_shard(query_ids, queries, left["id"].to_numpy(np.int64), candidates, k, right["least"].to_numpy(np.int64))
        filled = best > LEAST
        out = pd.DataFrame({"query_id": np.repeat(query_ids, filled.sum(1)), "vec_id": ids[filled], "score": best[filled].astype(np.int64), "found": 1, "scored": 0, "blocks": 0})
        # one row more for a cell: what it has scored
        return pd.concat([out, pd.DataFrame({"query_id": [0], "vec_id": [0], "score": [0], "found": [0], "scored": [scored], "blocks": [blocks]})])

    def searched(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return candidates.groupBy("shard", "group").cogroup(queries.groupBy("c_shard", "c_group")).applyInPandas(cell, schema)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = lambda df, place, least: df.select(F.col(place).alias("c_shard"), F.col("group").alias("c_group"), F.col("id").alias("id"), F.col("v").alias("v"), least.alias("least"))
    blocks = rows.select(shard.alias("shard"), each(groups).alias("group"), "id", "v")
    # a query's own shard gives it a k-th score, with which it enters the others
    found = searched(named(asked, "own", F.lit(LEAST)), blocks)
    if shards > 1:
        found = written(found, "topk-own")
        reached = found.where("found = 1").groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        others = asked.join(reached, asked["id"] == reached["query_id"], "left").withColumn("place", each(shards)).where("place <> own")
        found = found.unionByName(searched(named(others, "place", F.coalesce("least", F.lit(LEAST))), blocks))
    if with_blocks:
        found = written(found, "topk-found")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = found.where("found = 1").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if not with_blocks:
        return ranks
    count = found.agg(F.sum("scored"), F.sum("blocks")).first()
    return ranks.withColumns({"blocks_scored": F.lit(count[0]), "blocks": F.lit(count[1])})


def op7_topk_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
