"""Queries over voxels: grouped statistics, agreement, geometry.

A line item is a voxel of one volume per return flag: label l_partkey % 10,
value l_extendedprice, x l_quantity, y l_linenumber, z l_suppkey.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.operators import geometry, voxels
from cohortica.plans.driver_tables import table

QUERIES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def _voxels(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("volume_id"), (F.col("l_suppkey") - 1).cast("int").alias("z"), (F.col("l_linenumber") - 1).cast("int").alias("y"),
        (F.col("l_quantity") - 1).cast("int").alias("x"), F.col("l_extendedprice").alias("hu"), (F.col("l_partkey") % 10).cast("int").alias("label"),
    )


def _grids(spark, sf):
    nz = table(spark, sf, "supplier").agg(F.count("*").cast("int").alias("nz"))
    volumes = spark.createDataFrame([("A", 50, 7, 1.0, 1.0, 2.0), ("N", 50, 7, 0.5, 0.5, 5.0), ("R", 50, 7, 1.0, 1.0, 1.0)], "volume_id string, nx int, ny int, sx double, sy double, sz double")
    return volumes.crossJoin(F.broadcast(nz))  # three volumes by one row


VOXELS = """v AS (SELECT l_returnflag AS volume_id, l_suppkey - 1 AS z, l_linenumber - 1 AS y, l_quantity - 1 AS x, l_extendedprice AS hu, l_partkey % 10 AS label FROM lineitem),
g AS (SELECT *, (SELECT count(*) FROM supplier) AS nz, 50 AS nx, 7 AS ny FROM (VALUES ('A', 1.0, 1.0, 2.0), ('N', 0.5, 0.5, 5.0), ('R', 1.0, 1.0, 1.0)) t(volume_id, sx, sy, sz)),
stats AS (SELECT volume_id, label, count(*) AS n, avg(hu) AS mean, stddev_samp(hu) AS sd, quantile_cont(hu, 0.5) AS med, quantile_cont(hu, 0.05) AS p05, quantile_cont(hu, 0.95) AS p95, min(hu) AS lo, max(hu) AS hi,
  bool_or(z IN (0, nz - 1) OR y IN (0, ny - 1) OR x IN (0, nx - 1)) AS border FROM v JOIN g USING (volume_id) WHERE label <> 0 GROUP BY volume_id, label)"""
METRICS_SQL = f"""WITH {VOXELS}
SELECT volume_id, pos::INT AS pos, asked.label::INT AS label, coalesce(n, 0) AS voxel_count, round(coalesce(n, 0) * CAST(sx * sy * sz AS DOUBLE) / 1000, 6) AS volume_ml, round(mean, 6) AS hu_mean, round(sd, 6) AS hu_sd, round(med, 6) AS hu_median, round(p05, 6) AS hu_p05,
  round(p95, 6) AS hu_p95, lo AS hu_min, hi AS hu_max, coalesce(border, false) AS touches_border, CASE WHEN n IS NULL THEN 'empty_label' WHEN border THEN 'truncated' ELSE '' END AS flags
FROM g CROSS JOIN (VALUES (1, 9), (2, 1), (3, 5), (4, 77)) asked(pos, label) LEFT JOIN stats USING (volume_id, label)"""


def _metrics(spark, sf):
    asked = spark.createDataFrame([(1, 9), (2, 1), (3, 5), (4, 77)], "pos int, label int")
    return voxels.label_metrics(_voxels(spark, sf), _grids(spark, sf), asked)


@_query("q_c2_c12_label_metrics", METRICS_SQL)
def _(spark, sf):
    rows = _metrics(spark, sf)
    doubles = ("volume_ml", "hu_mean", "hu_sd", "hu_median", "hu_p05", "hu_p95")
    return rows.withColumns({c: F.round(c, 6) for c in doubles} | {"flags": F.array_join("flags", ",")})


@_query("q_c3_c13_statistics", f"WITH {VOXELS} SELECT volume_id, label::INT AS label, n AS voxel_count, round(mean, 6) AS hu_mean, round(sd, 6) AS hu_sd, round(p95, 6) AS hu_p95, border AS touches_border FROM stats")
def _(spark, sf):
    rows = voxels.statistics(_voxels(spark, sf), _grids(spark, sf))
    return rows.select("volume_id", "label", "voxel_count", F.round("hu_mean", 6).alias("hu_mean"), F.round("hu_sd", 6).alias("hu_sd"), F.round("hu_p95", 6).alias("hu_p95"), "touches_border")


@_query("q_c17_run_summary", f"WITH {VOXELS} SELECT volume_id, count(*) AS labels, count(n) AS present FROM g CROSS JOIN (VALUES (9), (1), (5), (77)) a(label) LEFT JOIN stats USING (volume_id, label) GROUP BY volume_id")
def _(spark, sf):
    return voxels.summary(_metrics(spark, sf))


@_query("q_c1_grid_check", "SELECT 'R' AS volume_id, 50::INT AS nx, 51::INT AS nx_b")
def _(spark, sf):
    grids = _grids(spark, sf)
    other = grids.withColumn("nx", F.when(F.col("volume_id") == "R", F.lit(51)).otherwise(F.col("nx")))
    return voxels.grid_differences(grids, other).select("volume_id", "nx", "nx_b")


def _pairs(spark, sf):
    label = lambda c: F.when(F.col(c).isin("A", "F"), 1).when(F.col(c).isin("N", "O"), 2).otherwise(0)
    return table(spark, sf, "lineitem").select((F.col("l_linenumber") % 3).cast("string").alias("volume_id"), label("l_returnflag").alias("a"), label("l_linestatus").alias("b"))


PAIRS = """p AS (SELECT CAST(l_linenumber % 3 AS STRING) AS volume_id, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 0 END AS a, CASE WHEN l_linestatus = 'F' THEN 1 WHEN l_linestatus = 'O' THEN 2 ELSE 0 END AS b FROM lineitem),
d AS (SELECT volume_id, l AS label, count(*) FILTER (a = l) AS a, count(*) FILTER (b = l) AS b, 2.0 * count(*) FILTER (a = l AND b = l) / (count(*) FILTER (a = l) + count(*) FILTER (b = l)) AS dice,
  100.0 * (count(*) FILTER (a = l) - count(*) FILTER (b = l)) / count(*) FILTER (b = l) AS pct FROM p, (VALUES (1), (2)) t(l) GROUP BY volume_id, l)"""


@_query("q_c14_c15_agreement", f"WITH {PAIRS} SELECT volume_id, label::INT AS label, a, b, round(dice, 6) AS dice, round(pct, 6) AS difference_pct FROM d")
def _(spark, sf):
    return voxels.agreement(_pairs(spark, sf)).withColumns({"dice": F.round("dice", 6), "difference_pct": F.round("difference_pct", 6), "a": F.col("a").cast("long"), "b": F.col("b").cast("long")})


@_query("q_c16_below_threshold", f"WITH {PAIRS} SELECT volume_id, string_agg(CAST(label AS STRING), ',' ORDER BY label) FILTER (dice < 0.99 OR abs(pct) > 1) AS below, bool_and(dice = 1) AS identical FROM d GROUP BY volume_id")
def _(spark, sf):
    return voxels.below_threshold(voxels.agreement(_pairs(spark, sf))).withColumn("below", F.array_join(F.transform("below", lambda x: x.cast("string")), ","))


@_query("q_d16_voxel_join", "SELECT a.l_returnflag AS volume_id, count(*) AS n, round(sum(a.l_extendedprice - b.l_extendedprice), 2) AS delta FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY 1")
def _(spark, sf):
    a = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    both = a.select(*keys, "l_returnflag", "l_extendedprice").join(a.select(*keys, F.col("l_extendedprice").alias("p")), keys)
    return both.groupBy(F.col("l_returnflag").alias("volume_id")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") - F.col("p")), 2).alias("delta"))


# -- geometry ------------------------------------------------------------------------------------------------------------


@_query("q_l1_linear_index", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST((l_quantity - 1) + 50 * ((l_linenumber - 1) + 7 * (l_suppkey - 1)) AS BIGINT) AS linear FROM lineitem")
def _(spark, sf):
    i, j, k = (F.col("l_quantity") - 1).cast("long"), F.col("l_linenumber") - 1, F.col("l_suppkey") - 1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", geometry.linear_index(i, j, k, F.lit(50), F.lit(7)).cast("long").alias("linear"))


def _screen(spark, sf):
    plane = F.element_at(F.array(*map(F.lit, geometry.PLANES)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", plane.alias("plane"), (F.col("l_partkey") % 2 == 0).alias("neuro"),
                                               (F.col("l_quantity") - 1).cast("int").alias("i"), (F.col("l_linenumber") - 1).alias("j"), (F.col("l_suppkey") % 9).cast("int").alias("k"))


SCREEN = """s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ['axial', 'coronal', 'sagittal'][l_orderkey % 3 + 1] AS plane, l_partkey % 2 = 0 AS neuro, CAST(l_quantity - 1 AS INT) AS i, l_linenumber - 1 AS j, CAST(l_suppkey % 9 AS INT) AS k FROM lineitem)"""


@_query("q_l3_voxel_to_pixel", f"""WITH {SCREEN} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, plane,
  CASE WHEN plane = 'sagittal' THEN j WHEN neuro THEN 49 - i ELSE i END AS "column", CASE WHEN plane = 'axial' THEN j ELSE 8 - k END AS "row", CASE plane WHEN 'axial' THEN k WHEN 'coronal' THEN j ELSE i END AS slice, true AS back FROM s""")
def _(spark, sf):
    n = (F.lit(50), F.lit(7), F.lit(9))
    rows = _screen(spark, sf).withColumn("p", geometry.pixel_of(F.col("plane"), F.col("neuro"), F.col("i"), F.col("j"), F.col("k"), *n))
    rows = rows.withColumn("v", geometry.voxel_of(F.col("plane"), F.col("neuro"), F.col("p.column"), F.col("p.row"), F.col("p.slice"), *n))
    back = (F.col("v.i") == F.col("i")) & (F.col("v.j") == F.col("j")) & (F.col("v.k") == F.col("k"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "plane", "p.column", "p.row", "p.slice", back.alias("back"))


@_query("q_l2_l4_planes", """SELECT plane, neuro, CASE plane WHEN 'sagittal' THEN 7 ELSE 50 END AS width, CASE plane WHEN 'axial' THEN 7 ELSE 9 END AS height, CASE plane WHEN 'axial' THEN 9 WHEN 'coronal' THEN 7 ELSE 50 END AS slices,
  CASE plane WHEN 'axial' THEN 1.0 WHEN 'coronal' THEN 5.0 ELSE 5.0 END::DOUBLE AS aspect, CASE plane WHEN 'axial' THEN CASE WHEN neuro THEN 'LRAP' ELSE 'RLAP' END WHEN 'coronal' THEN CASE WHEN neuro THEN 'LRSI' ELSE 'RLSI' END ELSE 'APSI' END AS letters
  FROM (VALUES ('axial'), ('coronal'), ('sagittal')) p(plane), (VALUES (true), (false)) n(neuro)""")
def _(spark, sf):
    rows = spark.createDataFrame([(p, n) for p in geometry.PLANES for n in (True, False)], "plane string, neuro boolean")
    g = geometry.plane_geometry(F.col("plane"), F.lit(50), F.lit(7), F.lit(9), F.lit(1.0), F.lit(1.0), F.lit(5.0))
    letters = geometry.edge_letters(F.col("plane"), F.col("neuro"))
    return rows.select("plane", "neuro", g.alias("g"), letters.alias("l")).select("plane", "neuro", "g.width", "g.height", "g.slices", "g.aspect", F.concat("l.left", "l.right", "l.top", "l.bottom").alias("letters"))


@_query("q_l5_slice", """SELECT volume_id, CAST(y AS INT) AS "row", string_agg(CAST(CAST(hu AS BIGINT) AS STRING), ',' ORDER BY x, hu) AS pixels FROM
  (SELECT l_returnflag AS volume_id, l_linenumber - 1 AS y, l_quantity - 1 AS x, floor(l_extendedprice) AS hu FROM lineitem WHERE l_suppkey = 3) GROUP BY 1, 2""")
def _(spark, sf):
    rows = geometry.extract_slice(_voxels(spark, sf).withColumn("hu", F.floor("hu")), _grids(spark, sf), "axial", 2)
    return rows.select("volume_id", "row", F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("pixels"))


@_query("q_l6_mirror", "SELECT l_returnflag AS volume_id, CAST(sum(CASE l_returnflag WHEN 'A' THEN 50 - l_quantity ELSE l_quantity - 1 END) AS BIGINT) AS x, CAST(sum(CASE l_returnflag WHEN 'N' THEN 7 - l_linenumber ELSE l_linenumber - 1 END) AS BIGINT) AS y FROM lineitem GROUP BY 1")
def _(spark, sf):
    direction = F.when(F.col("volume_id") == "A", F.array(*map(F.lit, (-1.0, 0.2, 0.0)))).when(F.col("volume_id") == "N", F.array(*map(F.lit, (0.1, 0.9, 0.2)))).otherwise(F.array(*map(F.lit, (0.0, 0.1, 0.9))))
    grids = _grids(spark, sf).withColumn("axis", geometry.left_right_axis(direction))
    return geometry.mirrored(_voxels(spark, sf), grids).groupBy("volume_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


@_query("q_l_grid_equality", "SELECT vec_id, true AS same, vec_id % 2 = 0 AS shifted FROM embeddings")
def _(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    grid = lambda shift: F.struct(F.array(F.lit(64)).alias("size"), F.transform(e, lambda x: x + shift).alias("origin"), e.alias("spacing"), e.alias("direction"))
    rows = table(spark, sf, "embeddings").select("vec_id", grid(F.lit(0.0)).alias("a"), grid(F.lit(5e-5)).alias("b"), grid(F.when(F.col("vec_id") % 2 == 0, 5e-5).otherwise(2e-4)).alias("c"))
    return rows.select("vec_id", geometry.same_grid("a", "b").alias("same"), geometry.same_grid("a", "c").alias("shifted"))


@_query("q_l_axis_argmax", "SELECT vec_id, CAST(list_position([abs(x) FOR x IN embedding[1:3]], list_max([abs(x) FOR x IN embedding[1:3]])) - 1 AS INT) AS axis FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", geometry.left_right_axis(F.col("embedding")).alias("axis"))
