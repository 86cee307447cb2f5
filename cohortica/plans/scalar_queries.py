"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.functions import scalars as S
from cohortica.plans.driver_tables import table

QUERIES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


CLEAN = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@_query("q_h1_h3_names", f"""SELECT p_partkey, {CLEAN.format('p_type')} AS label, CASE WHEN p_partkey % 2 = 0 THEN 'ct_' ELSE '' END || {CLEAN.format('p_name')} AS key,
  upper(p[1]) || p[2:] AS display FROM (SELECT *, array_to_string(list_filter(string_split_regex(p_name || '-x_' || p_brand, '[-_]'), lambda w: w <> ''), ' ') AS p FROM part)""")
def _(spark, sf):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "clin_ct_ct_").otherwise("clin_ct_"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.sanitize(F.col("p_type")).alias("label"), S.model_key(raw).alias("key"), S.display_name(F.concat("p_name", F.lit("-x_"), "p_brand")).alias("display"))


@_query("q_h4_wide_names", "SELECT 'organs__kidney_left__hu_mean__t2__s1' AS \"column\", 'body_composition__status__t3' AS status")
def _(spark, sf):
    return spark.createDataFrame([(S.wide_column("clin_ct_organs", "Kidney left", "hu_mean", 2, 1), S.status_column("clin_ct_body_composition", 3))], "column string, status string")


@_query("q_h5_lenient_date", r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-M-d'T'")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("2021-02-30")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(S.lenient_date(raw), "yyyy-MM-dd").alias("day"))


@_query("q_h6_job_seconds", "SELECT event_id, CAST(event_id % 5000 AS DOUBLE) AS seconds FROM events")
def _(spark, sf):
    start, end = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 5000), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select("event_id", S.seconds_between(start, end).alias("seconds"))


@_query("q_h7_pseudonym", "SELECT c_custkey, 'P' || CASE WHEN c_custkey * 7 < 10000 THEN lpad(CAST(c_custkey * 7 AS STRING), 4, '0') ELSE CAST(c_custkey * 7 AS STRING) END AS pseudonym FROM customer WHERE c_custkey >= 1")
def _(spark, sf):
    return table(spark, sf, "customer").where("c_custkey >= 1").select("c_custkey", S.pseudonym(F.col("c_custkey") * 7).alias("pseudonym"))


def _uids(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.hashed_uid(F.concat(F.lit(" 1.2.840."), F.col("s_suppkey").cast("string")), TEST_KEY).alias("uid"))


#: A key for the query only; HMAC is two nested digests, each begun by the key padded to a block and combined with a constant.
TEST_KEY = bytes(range(32))
INNER, OUTER = (bytes(b ^ pad for b in TEST_KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
QUERIES["q_h8_hashed_uid"] = (_uids, f"""SELECT s_suppkey, sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(trim(' 1.2.840.' || s_suppkey))))) AS uid FROM supplier""")


@_query("q_h9_age", """SELECT o_orderkey, CAST(year(o_orderdate) - 1960 - CASE WHEN (month(o_orderdate), day(o_orderdate)) < (2, 29) THEN 1 ELSE 0 END AS INT) AS age FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.age_in_years(F.lit("1960-02-29").cast("date"), F.to_date("o_orderdate")).alias("age"))


@_query("q_h10_dicom_age", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN n WHEN 1 THEN round(n / 12.0, 9) WHEN 2 THEN round(n / 52.1775, 9) WHEN 3 THEN round(n / 365.2425, 9) END AS years FROM (SELECT p_partkey, CAST(p_size % 1000 AS DOUBLE) AS n FROM part)""")
def _(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("Y", "m ", "W", "D", "X"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.round(S.dicom_age(F.concat(F.lpad((F.col("p_size") % 1000).cast("string"), 3, "0"), unit)), 9).alias("years"))


@_query("q_h11_finite", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber > 2 THEN l_tax END AS clean FROM lineitem")
def _(spark, sf):
    odd = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("-inf")).otherwise(F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.finite(odd).alias("clean"))


@_query("q_h12_h13_spreadsheet_text", "SELECT doc_id, CASE WHEN text[1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END AS safe, replace(CAST(n_chars AS STRING) || '.5', '.', ',') AS number FROM (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || text AS text FROM documents)")
def _(spark, sf):
    mark = F.when(F.col("doc_id") % 3 == 0, "=").when(F.col("doc_id") % 3 == 1, "-").otherwise("")
    return table(spark, sf, "documents").select("doc_id", S.defuse_formula(F.concat(mark, "text")).alias("safe"), S.decimal_comma(F.concat(F.col("n_chars").cast("string"), F.lit(".5"))).alias("number"))


@_query("q_h14_h15_window", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, preset, CAST(greatest(0, least(255, round((hu - (c - w / 2.0)) / w * 255))) AS INT) AS gray FROM
  (SELECT *, l_extendedprice / 50 - 1000 AS hu, l_suppkey % 3 AS m FROM lineitem) JOIN (VALUES (0, 'bone', 400.0::DOUBLE, 1800.0::DOUBLE), (1, 'lung', -600.0::DOUBLE, 1500.0::DOUBLE), (2, 'soft_tissue', 40.0::DOUBLE, 400.0::DOUBLE)) p(m, preset, c, w) USING (m)""")
def _(spark, sf):
    models = F.element_at(F.array(*map(F.lit, ("clin_ct_ribs", "clin_ct_lungs", "clin_ct_organs"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").withColumn("model", models).withColumn("preset", preset_of(F.col("model")))
    presets = spark.createDataFrame([(n, float(c), float(w)) for n, (w, c) in PRESETS.items()], "preset string, center double, width double")
    rows = rows.join(F.broadcast(presets), "preset")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "preset", S.window_level(F.col("l_extendedprice") / 50 - 1000, F.col("center"), F.col("width")).alias("gray"))


# Display windows, width and center.
PRESETS = {"soft_tissue": (400, 40), "lung": (1500, -600), "bone": (1800, 400), "liver": (150, 30), "brain": (80, 40), "mediastinum": (350, 50)}
# Window of models that do not open in soft_tissue.
MODEL_PRESETS = {
    "clin_ct_ribs": "bone", "clin_ct_vertebrae": "bone", "clin_ct_peripheral_bones": "bone", "clin_ct_fast_vertebrae": "bone",
    "clin_ct_lungs": "lung", "clin_ct_cardiac": "mediastinum",
}


def preset_of(model):
    known = F.create_map(*[F.lit(x) for pair in MODEL_PRESETS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, model), F.lit("soft_tissue"))


@_query("q_h16_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.sha256(F.col("text")).alias("digest"))


@_query("q_h17_contains", "SELECT doc_id, contains(text, 'License') AS held FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.holds_bytes(F.encode("text", "utf-8"), b"License").alias("held"))


@_query("q_h18_magic", """SELECT p_partkey, p_partkey % 5 < 3 AS native, CASE WHEN p_partkey % 5 < 3 THEN CAST(p_size % 9 AS STRING) END AS kind FROM part""")
def _(spark, sf):
    big = F.concat(F.lit("000000"), F.lpad((F.col("p_size") % 9).cast("string"), 2, "0"))
    little = F.concat(F.lpad((F.col("p_size") % 9).cast("string"), 2, "0"), F.lit("000000"))
    k = F.col("p_partkey") % 5
    pad = F.lit("00" * 8)
    content = (
        F.when(k == 0, F.concat(F.lit("cffaedfe"), pad, little)).when(k == 1, F.concat(F.lit("feedfacf"), pad, big))
        .when(k == 2, F.concat(F.lit("cafebabe"), F.lit("00000001" + "00" * 8 + "0000001c" + "00" * 8), F.lit("cffaedfe"), pad, little)).otherwise("00112233445566778899aabbccddeeff")
    )
    rows = table(spark, sf, "part").select("p_partkey", F.unhex(content).alias("content"))
    return rows.select("p_partkey", S.is_native(F.col("content")).alias("native"), S.native_file_type(F.col("content")).cast("string").alias("kind"))


HINT = """CASE WHEN length(h) = 0 OR length(h) >= 80 THEN NULL WHEN regexp_matches(h, '(?i)\\bMIT\\b') THEN 'MIT' WHEN regexp_matches(h, '(?i)Apache(?: License)?,? (?:Version )?2') THEN 'Apache-2.0' WHEN regexp_matches(h, '(?i)\\bBSD') THEN 'BSD'
 WHEN regexp_matches(h, '(?i)\\bGPL') THEN 'GPL' END"""


@_query("q_h19_h20_licences", f"""SELECT doc_id, coalesce(hint, 'UNKNOWN') AS licence, CASE WHEN doc_id % 10 = 0 THEN 'ok' WHEN hint IN ('MIT', 'Apache-2.0', 'BSD') THEN 'ok' WHEN hint = 'GPL' THEN 'not allowed' ELSE 'not recognised' END AS verdict FROM (SELECT doc_id, {HINT} AS hint FROM
 (SELECT doc_id, array_to_string(list_filter([trim(x) FOR x IN string_split(trim(t), chr(10))[1:2]], lambda x: x <> ''), ' ') AS h FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'License|MIT|GPL'))[1] AS t FROM documents)))""")
def _(spark, sf):
    line = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike("License|MIT|GPL")), F.lit(0))
    rows = table(spark, sf, "documents").select("doc_id", S.classify_licence(F.lit(None).cast("string"), F.array().cast("array<string>"), line).alias("licence"))
    return rows.withColumn("verdict", S.licence_verdict(F.col("licence"), F.col("doc_id") % 10 == 0))


@_query("q_h21_file_stem", """SELECT p_partkey, p_partkey % 3 = 0 AS ok FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 3
    stem = F.when(k == 0, F.concat(F.lit("run "), F.col("p_partkey").cast("string"))).when(k == 1, F.concat("p_name", F.lit("."))).otherwise(F.concat(F.lit("../"), "p_name"))
    return table(spark, sf, "part").select("p_partkey", S.valid_stem(stem).alias("ok"))


@_query("q_h23_h24_paths", """SELECT page_id, url LIKE '%/en/%' OR url LIKE '%.html' AS pruned, regexp_matches(lower(url), '\\.(nii|nii\\.gz|dcm|mha|mhd|nrrd)$') AS image FROM pages""")
def _(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", S.pruned(url, suffixes=(".html",), folders=("en",)).alias("pruned"), S.is_image(url).alias("image"))


@_query("q_h25_symbols", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS symbol FROM part")
def _(spark, sf):
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("_"), "p_name", F.lit("$INODE64"))).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.symbol(line).alias("symbol"))


@_query("q_h26_sorted_json", """SELECT c_custkey, '{"a":"' || c_nationkey || '","b":"' || c_mktsegment || '"}' AS json FROM customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.sorted_json(F.create_map(F.lit("b"), F.col("c_mktsegment"), F.lit("a"), F.col("c_nationkey").cast("string"))).alias("json"))


@_query("q_h27_e16_flags", "SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN l_linestatus = 'F' THEN 'a,b' ELSE '' END AS flags FROM lineitem GROUP BY ALL")
def _(spark, sf):
    raw = F.when(F.col("l_linestatus") == "F", "a,,b,").otherwise(None)
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).withColumn("flags", F.array_join(S.flags(raw), ","))
