"""What the queries share: the 8x8 images that ``embeddings`` holds, and the same relation in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixel
from tessera.operators import raster

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img_id, img``: each embedding as an 8x8 image of bytes, packed."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "embedding")
    return e.select("img_id", pixel.from_unit(F.col("embedding"), -0.6, 0.6).alias("img"))


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img_id, a, b``: each image with the one of the next id."""
    a = images(spark, sf_dir)
    b = a.select((F.col("img_id") - 1).alias("img_id"), F.col("img").alias("b"))
    return a.withColumnRenamed("img", "a").join(b, "img_id")


def pixels(df: DataFrame, value: Column, cols: int = SIDE) -> DataFrame:
    return raster.to_pixels(df.select("img_id", value.alias("img"), F.lit(cols).alias("cols")))


#: The relation img(img_id, y, x, v) in SQL; v is the quantised embedding.
IMG = """img AS (
  SELECT vec_id AS img_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
         CAST(floor(greatest(0.0, least(255.0, (CAST(embedding[i + 1] AS DOUBLE) - (-0.6)) / 1.2 * 255 + 0.5))) AS INT) AS v
  FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(64)) r)"""

U8 = "CAST(floor(greatest(0.0, least(255.0, CAST({} AS DOUBLE) + 0.5))) AS INT)"


def u8(e: str) -> str:
    return U8.format(f"({e})")


#: Each image with the one of the next id, joined as lists; a.v and b.v are the values of one place.
_PAIRS = """im AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(greatest(0.0, least(255.0, (CAST(e AS DOUBLE) - (-0.6)) / 1.2 * 255 + 0.5))) AS INT)) AS vs FROM embeddings
), two AS (
  SELECT p.vec_id AS img_id, p.vs AS va, q.vs AS vb FROM im p JOIN im q ON q.vec_id = p.vec_id + 1
), places AS (
  SELECT img_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, {'v': va[i + 1]} AS a, {'v': vb[i + 1]} AS b FROM two, (SELECT CAST(range AS INT) AS i FROM range(64)) r
)"""


def pair_sql(e: str) -> str:
    return f"WITH {_PAIRS} SELECT img_id, y, x, {e} AS v FROM places"


def point_sql(e: str) -> str:
    return f"WITH {IMG} SELECT img_id, y, x, {e} AS v FROM img"


def stencil_sql(agg: str, offsets: list[tuple[int, int, float]], extra: str = "") -> str:
    """``agg`` over q.v and k.w of the neighbours at (dy, dx) with weight w, edges repeated."""
    rows = ", ".join(f"({dy}, {dx}, {w})" for dy, dx, w in offsets)
    return (
        f"WITH {IMG}, k(dy, dx, w) AS (VALUES {rows}){extra} SELECT p.img_id, p.y, p.x, {agg} AS v FROM img p CROSS JOIN k "
        "JOIN img q ON q.img_id = p.img_id AND q.y = greatest(0, least(7, p.y + k.dy)) AND q.x = greatest(0, least(7, p.x + k.dx)) GROUP BY p.img_id, p.y, p.x"
    )


def offsets_of(kernel) -> list[tuple[int, int, float]]:
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2
    return [(j - ry, i - rx, w) for j, line in enumerate(kernel) for i, w in enumerate(line) if w]
