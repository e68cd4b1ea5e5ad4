"""The tables that stand for trajectories, streams and pairs, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import pose


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, frame_index, vec_id, action, state): 16-channel commands and states of embeddings by label."""
    e = read(spark, sf_dir, "embeddings")
    v = pose.doubles(F.col("embedding"))
    order = Window.partitionBy("episode").orderBy("vec_id")
    rows = e.select(F.col("label").cast("long").alias("episode"), "vec_id", F.slice(v, 1, 16).alias("action"), F.slice(v, 17, 16).alias("state"))
    return rows.withColumn("frame_index", F.row_number().over(order).cast("long") - 1)


TRAJ = """traj as (select label::bigint as episode, row_number() over (partition by label order by vec_id) - 1 as frame_index, vec_id,
    (embedding::double[])[1:16] as action, (embedding::double[])[17:32] as state from embeddings)"""


def rounded(c, digits: int = 6):
    """Rounded, without negative zeros."""
    return F.round(c, digits) + F.lit(0.0)


def spread(v, names: str, digits: int = 6) -> list:
    """One rounded column for each element of an array."""
    return [rounded(F.get(v, F.lit(i)), digits).alias(n) for i, n in enumerate(names.split())]


def sql_spread(v: str, names: str, digits: int = 6) -> str:
    return ", ".join(f"round(({v})[{i + 1}], {digits}) + 0.0 as {n}" for i, n in enumerate(names.split()))


def sql_unit(q: str, canonical: bool = True) -> str:
    """DuckDB: a normalised quaternion (w, x, y, z)."""
    n = f"sqrt(list_dot_product({q}, {q}))"
    sign = f"(case when ({q})[1] < 0 then -1.0::double else 1.0::double end)" if canonical else "1.0::double"
    return f"(case when {n} > 1e-8 then [e * {sign} / {n} for e in {q}] else [1.0, 0.0, 0.0, 0.0]::double[] end)"


def sql_product(a: str, b: str) -> str:
    """DuckDB: Hamilton product of two quaternions."""
    w, x, y, z = [f"({a})[{i}]" for i in range(1, 5)]
    s, t, u, v = [f"({b})[{i}]" for i in range(1, 5)]
    return f"""[{w} * {s} - {x} * {t} - {y} * {u} - {z} * {v}, {w} * {t} + {x} * {s} + {y} * {v} - {z} * {u},
        {w} * {u} - {x} * {v} + {y} * {s} + {z} * {t}, {w} * {v} + {x} * {u} - {y} * {t} + {z} * {s}]"""


def sql_conjugate(q: str) -> str:
    return f"[({q})[1], -({q})[2], -({q})[3], -({q})[4]]"
