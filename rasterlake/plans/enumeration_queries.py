"""Formation families, cell names and identifiability over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import enumeration as N
from rasterlake.registry import query

FAM = "(SELECT unnest(['linear_light', 'encoded_srgb']) AS blend) CROSS JOIN (SELECT unnest(['box', 'triangle', 'gaussian_0.5', 'gaussian_1']) AS filter)"


@query("j16_formation_family", "", f"SELECT vec_id AS image_id, CASE WHEN label % 2 = 0 THEN 'transparent' ELSE 'opaque' END AS exterior, blend, filter, blend || '/' || filter || '/' || CASE WHEN label % 2 = 0 THEN 'transparent' ELSE 'opaque' END AS formation_id FROM embeddings CROSS JOIN {FAM}")
def j16(t):
    d = t.table("embeddings").select(F.col("vec_id").alias("image_id"), F.when(F.col("label") % 2 == 0, "transparent").otherwise("opaque").alias("exterior"))
    return N.formations(d)


def cells(t):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    pick = lambda e, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (e % len(v) + 1).cast("int"))
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("16 * shiftleft(1, cast(l_partkey % 6 as int))").alias("size"), pick(p, "exact", "tiny", "super").alias("profile"),
        pick(n, "box", "triangle", "gaussian").alias("psf"), (p % 4 * 0.25 + 0.25).alias("sigma"), pick(p, "linear_light", "encoded_srgb").alias("blend"),
        pick(n, "none", "down-from-2x", "up-from-half").alias("resize"), (n * 0.125).alias("dx"), (p % 5 * 0.25).alias("dy"), pick(p, 1.0, 0.5, 0.001).alias("contrast"),
        (F.col("l_discount") * 40).alias("scale"), (F.col("l_tax") * 5 + 0.05).alias("sep"), (p % 3).alias("members"),
    )


CELLS = """c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 16 * (1 << (l_partkey % 6)::INT) AS size, ['exact', 'tiny', 'super'][1 + l_partkey % 3] AS profile, ['box', 'triangle', 'gaussian'][1 + l_linenumber % 3] AS psf, l_partkey % 4 * 0.25::DOUBLE + 0.25 AS sigma,
  ['linear_light', 'encoded_srgb'][1 + l_partkey % 2] AS blend, ['none', 'down-from-2x', 'up-from-half'][1 + l_linenumber % 3] AS resize, l_linenumber * 0.125::DOUBLE AS dx, l_partkey % 5 * 0.25::DOUBLE AS dy, [1.0, 0.5, 0.001][1 + l_partkey % 3]::DOUBLE AS contrast, l_discount * 40 AS scale, l_tax * 5 + 0.05 AS sep, l_partkey % 3 AS members FROM lineitem)"""


def two(v: str) -> str:
    h = f"round_even({v} * 100, 0)::BIGINT"
    return f"({h} // 100) || '.' || lpad(({h} % 100)::VARCHAR, 2, '0')"


@query("f24_cell_id", "", f"{CELLS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 's' || size || '_p' || profile || '_' || CASE WHEN psf = 'gaussian' THEN 'gauss' || format('{{:.2f}}', sigma) ELSE psf END || '_' || CASE WHEN blend = 'linear_light' THEN 'lin' ELSE 'srgb' END || '_' || resize || '_dx' || {two('dx')} || 'dy' || {two('dy')} || '_c' || format('{{:.2f}}', contrast) AS cell_id FROM c")
def f24(t):
    c = F.col
    full = N.cell_id(c("size"), c("profile"), c("psf"), c("sigma"), c("blend"), c("resize"), c("dx"), c("dy"), c("contrast"))
    return cells(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", full.alias("cell_id"))


ENC = "(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1.0::DOUBLE / 2.4) - 0.055 END)"


@query(
    "f25_identifiability",
    "",
    f"""{CELLS}, e AS (SELECT *, scale * size / 512.0::DOUBLE / (CASE psf WHEN 'box' THEN 1 WHEN 'triangle' THEN 2 ELSE 1 + 2 * sigma END * CASE WHEN resize = 'up-from-half' THEN 2 ELSE 1 END) AS eff, 0.5 + sep * contrast / 2 AS hi, greatest(0.0, 0.5 - sep * contrast / 2) AS lo FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN eff < 0.35 OR 255 * ({ENC.format(v='hi')} - {ENC.format(v='lo')}) < 1 THEN 'information_lost' WHEN members > 1 THEN 'equivalent_family' ELSE 'identifiable' END AS class FROM e""",
)
def f25(t):
    c = F.col
    k = N.identifiability(c("scale"), c("sep"), c("size"), 512, c("psf"), c("sigma"), c("resize"), c("contrast"), c("members"))
    return cells(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.alias("class"))
