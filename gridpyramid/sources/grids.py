"""Grid-point relations over plain tables.

Canonical columns: selector, reference_time, valid_time, process, x, y, power
and one integer column for each band (b0, b1). The SQL is shared with the
oracle, which runs it on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import Grid

SPARSE = """
select 'events/' || event_type as selector, timestamp '2024-01-01 00:00:00' as reference_time,
       cast(date_trunc('day', ts) as timestamp) as valid_time,
       case when date_trunc('day', ts) = timestamp '2024-01-01 00:00:00' then 'analysis' else 'forecast' end as process,
       cast(user_id % 64 as int) as x, cast(event_id % 64 as int) as y, 0 as power,
       max(cast(floor(value * 100 + 0.5e0) as int)) as b0
from events group by 1, 2, 3, 4, 5, 6"""

DENSE_SPARK = """
select 'embed/value' as selector, pos as x, cast(vec_id % 512 as int) as y, 0 as power,
       max(cast(floor(cast(e as double) * 1000 + 0.5e0) as int)) as b0
from embeddings lateral view posexplode(embedding) t as pos, e group by 1, 2, 3, 4"""

DENSE_ORACLE = """
select 'embed/value' as selector, cast(i - 1 as int) as x, cast(vec_id % 512 as int) as y, 0 as power,
       max(cast(floor(cast(embedding[i] as double) * 1000 + 0.5e0) as int)) as b0
from (select vec_id, embedding, unnest(generate_series(1, 64)) as i from embeddings) group by 1, 2, 3, 4"""

VECTOR = """
select 'embed/uv' as selector, cast(x >> 1 as int) as x, y, power,
       max(case when x % 2 = 0 then b0 end) as b0,
       max(case when x % 2 = 1 and b0 % 7 <> 0 then b0 end) as b1
from dense group by 1, 2, 3, 4"""

MIXED = """
select 'lineitem/qty' as selector, cast(date_trunc('year', l_shipdate) as timestamp) as valid_time,
       cast(case when l_returnflag = 'R' then ((l_partkey % 256) >> 2) << 2 else l_partkey % 256 end as int) as x,
       cast(case when l_returnflag = 'R' then ((l_orderkey % 128) >> 2) << 2 else l_orderkey % 128 end as int) as y,
       case when l_returnflag = 'R' then 2 else 0 end as power,
       max(cast(l_quantity as int)) as b0, bit_or(1 << (l_linenumber - 1)) as b1
from lineitem group by 1, 2, 3, 4, 5"""

SPARSE_GRID = Grid(120.0, 20.0, 40.0, 50.0)
DENSE_GRID = Grid(120.0, 20.0, 16.0, 20.0)
MIXED_GRID = Grid(110.00625, 10.0 + 1 / 240, 80.0, 120.0)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        text = text.replace(f"from {name} ", f"from {{{name}}} ").replace(f"from {name}\n", f"from {{{name}}}\n")
    return spark.sql(text, **tables)


def _timed(points: DataFrame) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    bands = [c for c in points.columns if c.startswith("b")]
    found = points.withColumn("reference_time", at)
    if "valid_time" not in points.columns:
        found = found.withColumn("valid_time", at)
    return found.withColumn("process", F.lit("forecast")).select("selector", "reference_time", "valid_time", "process", "x", "y", "power", *bands)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band, few points, five selectors, thirty days of which the first is an analysis."""
    return _sql(spark, SPARSE, events=_read(spark, sf_dir, "events"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signed band on every cell of a 64-wide lattice."""
    return _timed(_sql(spark, DENSE_SPARK, embeddings=_read(spark, sf_dir, "embeddings")))


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands, the second with holes."""
    return _timed(_sql(spark, VECTOR, dense=dense(spark, sf_dir).select("x", "y", "power", "b0")))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two sizes with a value and flags."""
    return _timed(_sql(spark, MIXED, lineitem=_read(spark, sf_dir, "lineitem")))
