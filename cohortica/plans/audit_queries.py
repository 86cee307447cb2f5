"""Queries over files, packages and bundles, and the extensions that the reference only specifies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortica.operators import audit, extensions, geometry, outcomes
from cohortica.plans.driver_tables import table
from cohortica.sources import files

QUERIES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


@_query("q_d15_manifest", """SELECT p_brand AS name, p_name || '/' || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0""")
def _(spark, sf):
    part = table(spark, sf, "part").withColumn("path", F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")))
    manifest = part.select(F.col("p_brand").alias("name"), "path", F.sha2("p_name", 256).alias("sha256"))
    files = part.where("p_partkey % 7 <> 0").select("path", F.sha2(F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("sha256"))
    return audit.manifest_mismatches(manifest, files)


@_query("q_e20_mismatch_list", """SELECT p_brand AS name, string_agg(p_name || '/' || p_partkey, ',' ORDER BY p_name || '/' || p_partkey) AS paths FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0 GROUP BY p_brand""")
def _(spark, sf):
    return audit.mismatch_list(QUERIES["q_d15_manifest"][0](spark, sf)).withColumn("paths", F.array_join("paths", ","))


@_query("q_e17_e21_size_rollup", """WITH f AS (SELECT array_to_string(string_split(url, '/')[1:CASE WHEN starts_with(url, 'https:/') THEN 4 ELSE 2 END], '/') AS g, CAST(strlen(html) AS BIGINT) AS size FROM pages)
 SELECT g AS "group", CAST(sum(size) AS BIGINT) AS bytes, 0::INT AS is_total FROM f GROUP BY g UNION ALL SELECT 'total', CAST(sum(size) AS BIGINT), 1 FROM f""")
def _(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size"))
    return audit.size_rollup(files, inside="https:")


def _report(spark, sf):
    return audit.size_report(QUERIES["q_e17_e21_size_rollup"][0](spark, sf))


QUERIES["q_b13_size_report"] = (_report, f"""SELECT "group", bytes, CASE WHEN is_total = 1 THEN printf('%8.2f GB  %s', bytes / 1e9, "group") ELSE printf('%8.1f MB  %s', bytes / 1e6, "group") END AS line
 FROM ({QUERIES["q_e17_e21_size_rollup"][1]})""")


def _size_order(spark, sf):
    """Place of each line of the roll-up as it comes; its rows are as few as folders of that depth."""
    rows = QUERIES["q_e17_e21_size_rollup"][0](spark, sf).withColumn("_at", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(Window.orderBy("_at")).alias("n"), "group", "bytes")


QUERIES["q_i7_size_order"] = (_size_order, f"""SELECT CAST(row_number() OVER (ORDER BY is_total DESC, bytes DESC, "group") AS INT) AS n, "group", bytes FROM ({QUERIES["q_e17_e21_size_rollup"][1]})""")


@_query("q_d18_dependencies", """SELECT * FROM (VALUES (1, 'fast_vertebrae'), (2, 'body'), (3, 'organs'), (4, 'ribs')) t(pos, model)""")
def _(spark, sf):
    asked = spark.createDataFrame([(1, "body"), (2, "organs"), (3, "fast_vertebrae"), (4, "ribs")], "pos int, model string")
    steps = spark.createDataFrame([("body", 0, "fast_vertebrae"), ("body", 1, "body")], "model string, step_pos int, step string")
    return audit.dependencies(asked, steps)


def _imports(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("s"), F.col("l_partkey") % 50).alias("symbol"))


@_query("q_d19_e18_category_users", """WITH i AS (SELECT CAST(l_orderkey AS STRING) AS path, l_partkey % 50 AS s FROM lineitem), c AS (SELECT * FROM (VALUES ('disk', 1), ('disk', 2), ('time', 7), ('never', 99)) t(category, s))
 SELECT category, count(DISTINCT path) AS files, min(path) AS example, category = 'time' AS declared FROM i JOIN c USING (s) GROUP BY category""")
def _(spark, sf):
    symbols = spark.createDataFrame([("disk", "s1"), ("disk", "s2"), ("time", "s7"), ("never", "s99")], "category string, symbol string")
    return audit.category_users(_imports(spark, sf), symbols, spark.createDataFrame([("time",)], "category string"))


@_query("q_d20_unapproved", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 10 <> 0")
def _(spark, sf):
    packages = table(spark, sf, "supplier").withColumn("name", F.col("s_name"))
    approved = table(spark, sf, "supplier").where("s_suppkey % 10 = 0").select(F.upper("s_name").alias("name"))
    return audit.unapproved(packages, approved).select("s_suppkey", "s_name")


@_query("q_a16_label_inversion", "SELECT n_regionkey, string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey) AS labels FROM nation WHERE n_nationkey <> 0 GROUP BY n_regionkey")
def _(spark, sf):
    maps = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))  # a few nations a region
    pairs = F.array_sort(F.map_entries(audit.invert_labels(F.col("m"))))
    return maps.select("n_regionkey", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",").alias("labels"))


@_query("q_a17_first_packages", "SELECT min(p_partkey) AS pos, upper(p_type) AS name FROM part GROUP BY upper(p_type)")
def _(spark, sf):
    packages = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("name"))
    return audit.first_packages(packages).select("pos", F.upper("name").alias("name"))


@_query("q_a15_manifest_flatten", """SELECT 'm' || n_regionkey AS name, n_name AS path, sha256(n_name) AS sha256 FROM nation""")
def _(spark, sf):
    files = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.sha2("n_name", 256)))).alias("files"))
    raw = files.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("m"), "n_regionkey").alias("name"), "files")).alias("models"))).alias("value"))
    models = raw.select(F.explode(F.from_json("value", "models array<struct<name:string,files:map<string,string>>>").models).alias("m"))
    return models.select("m.name", F.explode("m.files").alias("path", "sha256"))


@_query("q_m3_bundle_rules", """SELECT 'image among models' AS rule, 'models/' || doc_id || '.nii.gz' AS path FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'holds License', CASE WHEN doc_id % 50 = 0 THEN 'models/' || doc_id || '.nii.gz' ELSE 'lib/' || doc_id END FROM documents WHERE contains(text, 'License')""")
def _(spark, sf):
    d = F.col("doc_id").cast("string")
    files = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("models/"), d, F.lit(".nii.gz"))).otherwise(F.concat(F.lit("lib/"), d)).alias("path"), F.encode("text", "utf-8").alias("content"))
    return audit.bundle_violations(files, [b"License"])


@_query("q_m4_lock_check", """SELECT s_name AS model, CASE s_suppkey % 4 WHEN 1 THEN 'url' WHEN 2 THEN 'digest' WHEN 3 THEN 'unknown' END AS problem FROM supplier WHERE s_suppkey % 4 > 0""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    wanted = s.select(F.col("s_name").alias("model"), F.lit("u").alias("url"), F.lit("d").alias("sha256"))
    lock = s.where("s_suppkey % 4 <> 3").select(F.col("s_name").alias("model"), F.when(F.col("s_suppkey") % 4 == 1, "v").otherwise("u").alias("url"), F.when(F.col("s_suppkey") % 4 == 2, "e").otherwise("d").alias("sha256"))
    return audit.lock_check(wanted, lock)


@_query("q_m5_model_folders", """SELECT s_name AS model, CASE s_suppkey % 4 WHEN 1 THEN 'not found' WHEN 2 THEN 'version missing' WHEN 3 THEN 'other version' END AS problem FROM supplier WHERE s_suppkey % 4 > 0""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    models = s.select(F.col("s_name").alias("model"), F.col("s_suppkey").alias("folder"), F.lit("u").alias("url"))
    versions = s.where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("folder"), F.when(F.col("s_suppkey") % 4 == 3, "v").when(F.col("s_suppkey") % 4 == 0, "u").alias("url"))
    return audit.model_folders(models, versions)


@_query("q_i3_i5_i6_sets", "SELECT (SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem) AS seen, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS without, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS with_orders")
def _(spark, sf):
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    seen = table(spark, sf, "lineitem").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("seen"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return seen.crossJoin(count(c.subtract(o), "without")).crossJoin(count(c.intersect(o), "with_orders"))  # one row each


# -- extensions: specified in the reference's plan, without code there ----------------------------------------------------


@_query("q_n5_f8_outliers", """WITH m AS (SELECT l_partkey % 10 AS label, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v, median(l_extendedprice) OVER (PARTITION BY l_partkey % 10) AS med, count(*) OVER (PARTITION BY l_partkey % 10) AS n FROM lineitem),
 d AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY label) AS mad FROM m) SELECT CAST(label AS INT) AS label, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM d WHERE n >= 20 AND mad > 0 AND abs(v - med) / mad > 2.0""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("label", (F.col("l_partkey") % 10).cast("int"))
    return extensions.outliers(rows, "label", "l_extendedprice", 2.0).select("label", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("q_n2_series_selection", """SELECT study, series_key FROM (SELECT l_orderkey AS study, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS series_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_tax, l_returnflag, l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS rn
 FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 20) WHERE rn = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("study"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("series_key"), F.when(F.col("l_linestatus") == "F", "CT").otherwise("PT").alias("modality"),
                                               F.col("l_quantity").alias("image_count"), F.col("l_extendedprice").alias("z_cover"), F.col("l_tax").alias("thickness"), F.col("l_returnflag").alias("kernel"))
    return extensions.select_series(rows, "study", least_images=20).select("study", "series_key")


@_query("q_n1_duplicate_uids", "SELECT min(l_linenumber) AS first_line, l_partkey AS uid, count(*) - 1 AS dropped FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("uid"), F.col("l_linenumber").alias("at"))
    return extensions.first_by_uid(rows, "uid", "at").select(F.col("at").alias("first_line"), "uid", "dropped")


@_query("q_n7_cache_key", "SELECT c_custkey, sha256(c_name || '|' || c_nationkey || '|v1|gpu') AS key FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", extensions.cache_key(F.col("c_name"), F.col("c_nationkey").cast("string"), F.lit("v1"), F.lit("gpu")).alias("key"))


@_query("q_n8_centroids", "SELECT CAST(l_partkey % 10 AS INT) AS label, round(avg(l_quantity), 6) AS x, CASE WHEN avg(l_quantity) > 25.5 + 0.1 THEN 'left' WHEN avg(l_quantity) < 25.5 - 0.1 THEN 'right' ELSE 'middle' END AS side FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 10).cast("int").alias("label"), F.col("l_quantity").alias("x"))
    return extensions.sides(rows, "label", "x", middle=25.5, margin=0.1).withColumn("x", F.round("x", 6))


@_query("q_f9_moving_average", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS eta FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return table(spark, sf, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("eta"))


@_query("q_n3_series_filters", """SELECT o_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS series_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE l_linestatus = 'F' AND l_quantity >= 20 AND l_tax <= 0.04 AND regexp_matches(o_orderpriority, '^[12]') AND CAST(o_orderdate AS DATE) >= DATE '1994-01-01' AND l_discount <= 0.05""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("description"), F.to_date("o_orderdate").alias("study_date"))
    rows = table(spark, sf, "lineitem").join(o, "l_orderkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("series_key"), F.when(F.col("l_linestatus") == "F", "CT").otherwise("PT").alias("modality"),
                                                                      F.col("l_quantity").alias("image_count"), F.col("l_tax").alias("thickness"), "description", "study_date", "l_discount")
    done = rows.where("l_discount > 0.05")
    return extensions.filter_series(rows, "CT", 20, 0.04, "^[12]", since="1994-01-01", not_in=done).select("series_key")


@_query("q_n4_n6_flags", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_extendedprice / 10 > 3071 THEN 'hu_range' END, CASE WHEN l_tax * 100 > 5 THEN 'thick_slices' END, CASE WHEN l_discount > 0 AND l_discount < 0.03 THEN 'tiny' END,
 CASE WHEN l_returnflag <> 'N' THEN 'device_fallback' END) AS flags FROM lineitem""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(0.0).alias("hu_min"), (F.col("l_extendedprice") / 10).alias("hu_max"), (F.col("l_tax") * 100).alias("thickness"),
                                               F.col("l_discount").alias("volume_ml"), F.col("l_returnflag").alias("device"), F.lit("N").alias("requested_device"))
    return extensions.plausibility(rows, tiny_ml=0.03).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("flags", ",").alias("flags"))


@_query("q_j13_rescan", "SELECT page_id FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0")
def _(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.concat("url", F.col("page_id").cast("string")).alias("path"), F.length("html").alias("size"), F.lit(1).alias("mtime"))
    seen = files.where("page_id % 5 <> 0").withColumn("mtime", F.when(F.col("page_id") % 7 == 0, 0).otherwise(1))
    return extensions.rescan(files, seen).select("page_id")


@_query("q_a12_job_files", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no JSON' WHEN event_id % 7 = 1 THEN 'no job_id' WHEN event_id % 7 = 2 THEN 'other protocol version' WHEN event_id % 7 = 3 THEN 'unknown kind' END AS problem,
 CASE WHEN event_id % 7 > 3 THEN 'export' END AS kind FROM events""")
def _(spark, sf):
    n = F.col("event_id") % 7
    text = F.to_json(F.struct(F.when(n == 2, 9).otherwise(1).alias("protocol_version"), F.when(n != 1, F.col("event_id").cast("string")).alias("job_id"),
                              F.when(n == 3, F.col("event_type")).otherwise("export").alias("kind"), F.lit("/p").alias("project_dir")))
    lines = table(spark, sf, "events").select("event_id", F.when(n == 0, F.concat(F.lit("{"), "event_type")).otherwise(text).alias("value"))
    return files.jobs(lines).select("event_id", "problem", F.when(F.col("problem").isNull(), F.col("kind")).alias("kind"))


@_query("q_h22_containment", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/data/p/' || doc_id WHEN 1 THEN NULL WHEN 2 THEN '/data/p/b/' || doc_id WHEN 3 THEN NULL WHEN 4 THEN '/data/p/in/' || doc_id ELSE '/data/p' END AS path FROM documents""")
def _(spark, sf):
    d = F.col("doc_id").cast("string")
    texts = {0: d, 1: F.concat(F.lit("../"), d), 2: F.concat(F.lit("a/.././b//"), d), 3: F.concat(F.lit("/data/public/"), d), 4: F.concat(F.lit("/data/p/in/"), d), 5: F.lit("..//p/.")}
    path = F.coalesce(*[F.when(F.col("doc_id") % 6 == n, t) for n, t in texts.items()])
    return table(spark, sf, "documents").select("doc_id", files.inside_column("/data/p", path).alias("path"))


@_query("q_l7_spacing", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax > 0 AND l_discount > 0 AND l_linenumber - 1 > 0 AS usable FROM lineitem")
def _(spark, sf):
    one = F.lit(1)
    usable = geometry.check_spacing(F.col("l_tax"), F.col("l_discount"), F.lit(0.5), F.col("l_linenumber") - 1, one, one)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", usable.alias("usable"))


@_query("q_j10_j11_outcomes", """SELECT event_id, CASE event_type WHEN 'click' THEN 'cancelled' WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'failed' END AS status,
 CASE event_type WHEN 'click' THEN 130 WHEN 'view' THEN 0 WHEN 'purchase' THEN 0 ELSE 1 END AS exit_code,
 CASE WHEN event_type IN ('click', 'view', 'purchase') THEN NULL WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'disk_full' ELSE 'internal_error' END ELSE 'unsupported_job' END AS code,
 CASE WHEN event_type IN ('click', 'view', 'purchase') THEN NULL WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'true' ELSE 'false' END AS recoverable FROM events""")
def _(spark, sf):
    kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
    ends = table(spark, sf, "events").select(
        "event_id", F.when(kind.isin("click", "view", "purchase", "error"), "segment").otherwise("paint").alias("kind"), (kind == "click").alias("cancelled"),
        F.when((kind == "error") & even, "disk_full").alias("failure"), F.lit("no room on the disk").alias("message"), F.lit(True).alias("recoverable"),
        F.when((kind == "error") & ~even, "ValueError").alias("exception"),
    )
    return outcomes.judge(ends, ["segment", "export"]).select("event_id", "status", "exit_code", "code", F.col("recoverable").cast("string").alias("recoverable"))
