"""Cross-site line dedup by HyperLogLog spread (DataFrame only).

A line that appears on many distinct sites is boilerplate. For each line hash
one aggregation keeps a HyperLogLog sketch of its sites; sketches merge on the
map side and again after the shuffle, so a line that a third of all documents
hold costs one row per task. Estimates far from the threshold decide alone;
near it, between half and twice the threshold, the distinct sites are counted
exactly. With registers for a relative error of 5 % an estimate that is wrong
by a factor of two is out of the question at these counts: a sketch never has
more set registers than distinct sites, and to lose half of them to collisions
has a chance below one in a million for a line.

Up to BROADCAST_LINES boilerplate hashes become a constant of the plan, a table
of short lists in which each document looks up its lines where it is: no text
moves. More are joined with the lines, and the texts with what they lose.

Lines end at \\n and are compared after trimming spaces. Empty lines are never
boilerplate. All copies of a boilerplate line go, in every document.

Rows: null text counts as empty; a null site is no site; repeated rows count
once for their site; an empty table gives no rows. Other columns are carried
or ignored, never read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

MIN_SITES = 5
RELATIVE_ERROR = 0.05
#: A set of at most this many line hashes (8 bytes each) is broadcast or a constant of the plan; a larger one is joined by shuffle.
BROADCAST_LINES = 500_000


def line_hashes(text: Column) -> Column:
    """The hash of each trimmed line by position; null for an empty line."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """line_hash and the sites' number (estimated if far over the threshold) of lines on at least min_sites sites."""
    lines = docs.select(F.col(site_col).alias("__s"), F.explode(F.array_distinct(line_hashes(F.coalesce(F.col(text_col), F.lit(""))))).alias("line_hash")).where("line_hash is not null")
    spread = written(
        lines.groupBy("line_hash")
        .agg(F.approx_count_distinct("__s", RELATIVE_ERROR).alias("sites"))
        .where(F.col("sites") >= F.lit(min_sites / 2)),
        "line-spread",
    )
    near = spread.where(F.col("sites") <= 2 * min_sites)
    sure = spread.where(F.col("sites") > 2 * min_sites)
    exact = (
        lines.join(_sized(near.select("line_hash")), "line_hash", "left_semi")
        .distinct()
        .groupBy("line_hash")
        .agg(F.count("__s").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return written(sure.unionByName(exact), "boilerplate")


def _sized(lines: DataFrame) -> DataFrame:
    """Marks the lines for broadcast if their counted number is within the bound."""
    return F.broadcast(lines) if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else lines


def _among(hashes: list[int]) -> Callable[[Column], Column]:
    """Whether a hash is one of these, by a table of short lists that is a constant of the plan: no text moves."""
    lists: list[list[int]] = [[] for _ in range(1 << max(len(hashes) - 1, 1).bit_length())]
    for h in hashes:
        lists[h & (len(lists) - 1)].append(h)
    known = F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>")
    return lambda h: F.array_contains(F.get(known, h.bitwiseAND(F.lit(len(lists) - 1)).cast("int")), h)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of docs, the text without boilerplate lines, and n_lines and n_removed (long).

    A null text stays null.
    """
    marked = boilerplate(docs, site_col, text_col, min_sites).select("line_hash")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    few = marked.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    if few:
        both, in_drop = docs.select(*own), _among([r[0] for r in marked.collect()])
    else:
        key = F.xxhash64(text)
        hits = (
            docs.select(F.col(id_col).alias("__id"), key.alias("__h"), F.explode(F.array_distinct(line_hashes(text))).alias("line_hash"))
            .join(marked, "line_hash", "left_semi")
            .groupBy("__id", "__h")
            .agg(F.collect_set("line_hash").alias("__drop"))  # at most the lines of one text
        )
        both = docs.select(*own, key.alias("__key")).join(hits, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__h")), "left")
        in_drop = lambda h: F.coalesce(F.array_contains(F.col("__drop"), h), F.lit(False))
    pairs = F.arrays_zip(F.split(text, "\n").alias("l"), line_hashes(text).alias("h"))
    rows = both.withColumn("__kept", F.filter(pairs, lambda x: x["h"].isNull() | ~in_drop(x["h"]))).withColumn("__total", F.size(F.split(text, "\n")).cast("long"))
    gone = F.col("__total") > F.size("__kept")
    return rows.select(
        *[F.when(gone, F.array_join(F.transform("__kept", lambda x: x["l"]), "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in own],
        F.col("__total").alias("n_lines"),
        (F.col("__total") - F.size("__kept")).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), b AS (
  SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a, (SELECT list(line) FROM b) AS drop_lines FROM documents
), k AS (SELECT doc_id, a, list_filter(a, lambda x: NOT coalesce(list_contains(drop_lines, trim(x, ' ')), false)) AS kept FROM d)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(len(a) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
"""
