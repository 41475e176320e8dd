"""Exact dedup over an extendible-hash index on shared files (DataFrame only).

Three steps, all of them built-in expressions:

1. Directory. It starts with one bucket. While a bucket holds more distinct
   64-bit hashes of texts than its capacity, the directory doubles and the bucket splits
   by the next hash bit; buckets that are not overfull keep a shorter depth and
   are shared by several directory slots. Only a histogram of at most
   2**MAX_DEPTH rows reaches the driver; beyond that many buckets, buckets grow instead.
2. Buckets. The directory sends each row by the first bits of its hash to a
   bucket. There rows with one hash are told apart by their bytes: the map side
   combines first, so a text that fills a third of the table leaves one row per
   task. An owner task has whole buckets, each a range of the key space, chains the
   texts that collide on a hash and writes the bucket's file to the shared folder.
3. Lookup. Each document goes by its directory slot to its bucket, to the chain
   of its hash, and takes the entry of its own digest. The few chains that hold
   more than 1/MANY of all rows are copied SALT times, so that no task has all
   their documents.

Rows: null text counts as empty; a null doc_id never stays unless all ids of
its group are null; repeated rows count as copies; an empty table gives no rows.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SCRATCH, ascii_lower, shared_dir, table

#: Directory slots never exceed 2**MAX_DEPTH; beyond that buckets grow instead.
MAX_DEPTH = 14
#: Chains with more than 1/MANY of all rows are copied SALT times for the lookup.
MANY, SALT = 1000, 64


def split_directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) for each slot of the doubled directory.

    histogram counts entries by the first max_depth bits of their hash.
    """
    counts = [[0] * (1 << d) for d in range(max_depth + 1)]
    for prefix, n in histogram.items():
        for d in range(max_depth + 1):
            counts[d][prefix >> (max_depth - d)] += n
    buckets, stack = [], [(0, 0)]
    while stack:
        depth, prefix = stack.pop()
        if counts[depth][prefix] > capacity and depth < max_depth:
            stack += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
        else:
            buckets.append((depth, prefix))
    top = max(d for d, _ in buckets)
    return [
        ((prefix << (top - depth)) + i, number, depth)
        for number, (depth, prefix) in enumerate(buckets)
        for i in range(1 << (top - depth))
    ]


def _slot(hashed: Column, depth: int) -> Column:
    """The first depth bits of a hash as an int."""
    return F.lit(0) if depth == 0 else F.shiftrightunsigned(hashed, 64 - depth).cast("int")


def directory(docs: DataFrame, text_col: str = "text", capacity: int = 2048) -> tuple[DataFrame, int, int]:
    """(__slot and __bucket of each directory slot, global depth, number of buckets)."""
    hashes = docs.select(F.xxhash64(_normal(text_col)).alias("h")).distinct()
    rows = hashes.groupBy(_slot(F.col("h"), MAX_DEPTH).alias("p")).count().collect()  # at most 2**MAX_DEPTH
    histogram = {r["p"]: r["count"] for r in rows}
    slots = split_directory(histogram, max(capacity, 2 * sum(histogram.values()) >> MAX_DEPTH))
    return docs.sparkSession.createDataFrame([(s, b) for s, b, _ in slots], "__slot int, __bucket int"), (len(slots) - 1).bit_length(), 1 + max(b for _, b, _ in slots)


def _normal(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _dealt(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows with the bucket of their hash __h."""
    return rows.withColumn("__slot", _slot(F.col("__h"), depth)).join(F.broadcast(slots), "__slot").drop("__slot")  # at most 2**MAX_DEPTH rows of two ints


def hash_index(docs: DataFrame, slots: DataFrame, depth: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: __bucket, h and chain, the array of (digest, keep_id, group_size) of the distinct texts with that hash."""
    rows = docs.select(F.col(id_col).alias("__id"), _normal(text_col).alias("__t"))
    rows = _dealt(rows.withColumn("__h", F.xxhash64("__t")), slots, depth)
    entries = (
        rows.groupBy("__bucket", "__h", "__t")
        .agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("__bucket", F.col("__h").alias("h"), F.struct(F.unhex(F.sha2("__t", 256)).alias("digest"), "keep_id", "group_size").alias("entry"))
    )
    chains = entries.repartition(buckets, "__bucket").groupBy("__bucket", "h").agg(F.collect_list("entry").alias("chain"))  # texts of one 64-bit hash
    path = shared_dir(docs.sparkSession, "exact-index")
    chains.write.options(**SCRATCH).partitionBy("__bucket").parquet(path)
    return docs.sparkSession.read.schema(chains.select("h", "chain", "__bucket").schema).parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """All columns of docs plus keep_id, group_size, kept and text_sha256.

    Of equal texts (after lower-casing A-Z) the row with the largest id stays;
    if that very id is repeated, each of its rows is marked kept.
    """
    slots, depth, buckets = directory(docs, text_col, capacity)
    size = F.aggregate("chain", F.lit(0).cast("long"), lambda a, x: a + x["group_size"])
    index = hash_index(docs, slots, depth, buckets, id_col, text_col).withColumn("__n", size)
    total = index.agg(F.sum("__n")).first()[0] or 0
    large = index.where(F.col("__n") * MANY > total).select(F.col("h").alias("__h"), F.lit(SALT).alias("__salts"))  # fewer than MANY rows
    salted = index.select("__bucket", F.col("h").alias("__h"), F.col("chain").alias("__chain"), F.explode(F.sequence(F.lit(0), F.when(F.col("__n") * MANY > total, SALT - 1).otherwise(0))).alias("__salt"))
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = docs.select(*own, F.xxhash64(_normal(text_col)).alias("__h"), F.unhex(F.sha2(_normal(text_col), 256)).alias("__digest"))
    rows = _dealt(rows, slots, depth).join(F.broadcast(large), "__h", "left")
    rows = rows.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.spark_partition_id()), "__salts"), F.lit(0)).cast("int"))
    found = rows.join(salted, ["__bucket", "__h", "__salt"]).withColumn("__entry", F.get(F.filter("__chain", lambda x: x["digest"] == F.col("__digest")), F.lit(0)))
    return found.select(
        *own,
        F.col("__entry.keep_id").alias("keep_id"),
        F.col("__entry.group_size").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col("__entry.keep_id")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
