"""Queries over the public logs' own formats and over sinks that are read back.

The test tables are first put into the raw form, all text, of each log; the loaders then make events of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ranking import cut, shared_folder
from ..operators import activity as A
from ..sources import loaders, tables
from ..spec import MOOC, VLE, VLE_TYPES
from . import catalog as C
from .catalog import query

_NAMES = ", ".join(f"'{a}'" for a in MOOC.actions)
_RAW = f"""raw AS (SELECT event_id AS seq, user_id * 10 + k % 10 AS enroll_id, user_id, 'c' || k % 10 AS course_id, CASE WHEN k % 23 = 22 THEN 'other' ELSE [{_NAMES}][k % 23 + 1] END AS action,
  CASE WHEN k % 6 = 0 THEN 'None' ELSE 'o' || k % 40 END AS object_id, CAST(datediff('day', DATE '2024-01-01' + CAST(k % 10 AS INTEGER), CAST(ts AS DATE)) AS INTEGER) AS d
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
lab AS (SELECT enroll_id, min_by(user_id, seq) AS user_id, min_by(course_id, seq) AS course_id, CAST(enroll_id % 4 = 0 AS INTEGER) AS label FROM raw GROUP BY 1),
node AS (SELECT row_number() OVER (ORDER BY enroll_id) - 1 AS node_id, * FROM lab),
kept AS (SELECT node_id, raw.enroll_id, raw.user_id, raw.course_id, label, action, object_id, d FROM raw JOIN (SELECT node_id, enroll_id, label FROM node) n ON raw.enroll_id = n.enroll_id WHERE d >= 0 AND d < 35 AND action <> 'other')"""


def mooc_raw(spark, sf):
    """(logs, truths, courses) as the log's files hold them."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = tables.read_table(spark, sf, "events").withColumn("k", k).withColumn("e", F.col("user_id") * 10 + F.col("k") % 10)
    action = F.when(F.col("k") % 23 == 22, "other").otherwise(F.element_at(F.array(*map(F.lit, MOOC.actions)), F.least(F.col("k") % 23 + 1, F.lit(22)).cast("int")))
    logs = e.select(
        F.col("e").cast("string").alias("enroll_id"), F.col("user_id").cast("string").alias("username"), F.concat(F.lit("c"), F.col("k") % 10).alias("course_id"),
        action.alias("action"), F.when(F.col("k") % 6 == 0, " None ").otherwise(F.concat(F.lit("o"), F.col("k") % 40)).alias("object"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_id").alias("seq"),
    )
    label = (F.col("e") % 4 == 0).cast("int")
    once = e.select("e").distinct()
    # a first file says otherwise of all; the last truth counts
    truths = once.select(F.col("e").cast("string").alias("enroll_id"), (1 - label).cast("string").alias("truth"), F.lit(0).alias("seq"))
    truths = truths.unionByName(once.select(F.col("e").cast("string").alias("enroll_id"), label.cast("string").alias("truth"), F.lit(1).alias("seq")))
    courses = spark.range(10).select(F.concat(F.lit("c"), "id").alias("course_id"), F.concat(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("string"), F.lit(" 08:00:00")).alias("start"), F.col("id").alias("seq"))
    # a row further up says otherwise of each course; the last counts
    courses = courses.unionByName(courses.select("course_id", F.lit("2023-01-01").alias("start"), (F.col("seq") - 100).alias("seq")))
    return logs, truths, courses


@query(f"WITH {_RAW} SELECT * FROM kept UNION ALL SELECT node_id, enroll_id, user_id, course_id, label, NULL, NULL, NULL FROM node WHERE enroll_id NOT IN (SELECT enroll_id FROM kept)")
def mooc_events(spark, sf):
    return loaders.mooc(*mooc_raw(spark, sf))[0]


_MOOC_X = MOOC.feature_names


@query(f"""WITH {_RAW} SELECT enroll_id, {", ".join(f"count(*) FILTER (d = {d} AND action IS NOT NULL) AS {n}" for d, n in enumerate(_MOOC_X[:35]))}, count(action) AS total_events,
  count(DISTINCT object_id) FILTER (lower(object_id) <> 'none') AS distinct_objects, {", ".join(f"count(*) FILTER (action = '{a}') AS {n}" for a, n in zip(MOOC.actions, _MOOC_X[37:]))}
  FROM lab LEFT JOIN (SELECT enroll_id, action, object_id, d FROM kept) USING (enroll_id) GROUP BY 1""")
def mooc_x59(spark, sf):
    """The 59 features of the public log's layout."""
    return A.counts(loaders.mooc(*mooc_raw(spark, sf))[0], MOOC)


_TYPES = ", ".join(f"'{a}'" for a in VLE_TYPES)
_VRAW = f"""info AS (SELECT 'm' || o_orderkey % 7 AS m, 'p' || o_orderkey % 3 AS p, o_custkey AS s, max(o_orderkey) AS o FROM orders GROUP BY ALL),
node AS (SELECT row_number() OVER (ORDER BY m, p, s) - 1 AS node_id, s AS user_id, m || '_' || p AS course_id, CAST(o % 4 = 1 AS INTEGER) AS label, m, p, s FROM info),
clicks AS (SELECT 'm' || o_orderkey % 7 AS m, 'p' || o_orderkey % 3 AS p, o_custkey AS s, l_partkey % 500 AS site, CAST((l_orderkey + l_linenumber * 13) % 60 - 5 AS INTEGER) AS d, CAST(l_quantity AS BIGINT) AS clicks FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
kept AS (SELECT node_id, user_id, course_id, label, [{_TYPES}][site % 18 + 1] AS action, CAST(site AS VARCHAR) AS object_id, d, clicks FROM clicks JOIN node USING (m, p, s) WHERE d >= 0 AND d < 35)"""


def vle_raw(spark, sf):
    """(studentInfo, vle, studentVle)."""
    o = tables.read_table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("m"), F.col("o_orderkey") % 7).alias("code_module"), F.concat(F.lit("p"), F.col("o_orderkey") % 3).alias("code_presentation"),
        F.col("o_custkey").cast("string").alias("id_student"),
    )
    key = ["code_module", "code_presentation", "id_student"]
    info = o.groupBy(*key).agg(F.max("o_orderkey").alias("o"))
    result = F.when(F.col("o") % 4 == 1, loaders.WITHDRAWN).when(F.col("o") % 4 == 2, "Pass").when(F.col("o") % 4 == 3, "Fail")
    site = F.col("id").cast("string").alias("id_site")
    sites = spark.range(500).select(site, F.element_at(F.array(*map(F.lit, VLE_TYPES)), (F.col("id") % 18 + 1).cast("int")).alias("activity_type"), F.col("id").alias("seq"))
    sites = sites.unionByName(sites.select("id_site", F.lit("url").alias("activity_type"), (F.col("seq") - 1000).alias("seq")))
    li = tables.read_table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    clicks = li.select(
        *key, (F.col("l_partkey") % 500).cast("string").alias("id_site"), ((F.col("l_orderkey") + F.col("l_linenumber") * 13) % 60 - 5).cast("string").alias("date"),
        F.col("l_quantity").cast("bigint").cast("string").alias("sum_click"),
    )
    return info.select(*key, result.alias("final_result")), sites, clicks


@query(f"WITH {_VRAW} SELECT node_id AS enroll_id, * FROM kept UNION ALL SELECT node_id, node_id, user_id, course_id, label, NULL, NULL, NULL, NULL FROM node WHERE node_id NOT IN (SELECT node_id FROM kept)")
def vle_events(spark, sf):
    return loaders.vle(*vle_raw(spark, sf))[0]


_VLE_X = VLE.feature_names


@query(f"""WITH {_VRAW} SELECT node_id AS enroll_id, {", ".join(f"CAST(coalesce(sum(clicks) FILTER (d = {d}), 0) AS BIGINT) AS {n}" for d, n in enumerate(_VLE_X[:35]))}, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS total_clicks,
  count(DISTINCT object_id) AS distinct_sites, {", ".join(f"CAST(coalesce(sum(clicks) FILTER (action = '{a}'), 0) AS BIGINT) AS {n}" for a, n in zip(VLE_TYPES, _VLE_X[37:]))}
  FROM node LEFT JOIN (SELECT node_id, action, object_id, d, clicks FROM kept) USING (node_id) GROUP BY 1""")
def vle_x55(spark, sf):
    """The 55 features of the click log's layout."""
    return A.counts(loaders.vle(*vle_raw(spark, sf))[0], VLE)


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer")
def csv_round_trip(spark, sf):
    """A table written as CSV and scanned again with its schema."""
    path = _path(spark, "csv")
    c = tables.read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    tables.write_csv(c, path)
    return C.rounded(tables.read_csv(spark, path, c.schema))


@query("SELECT s AS seed, run_seq, CAST(round((run_seq * 37 + s) % 1000 / 997.0::DOUBLE, 6) AS DOUBLE) AS v FROM (SELECT o_orderkey AS run_seq, unnest([1, 2]) AS s FROM orders)")
def result_log(spark, sf):
    """Result rows appended twice and read back; doubles keep six decimals."""
    path = _path(spark, "results")
    for s in (1, 2):
        rows = tables.read_table(spark, sf, "orders").select(F.lit(s).alias("seed"), F.col("o_orderkey").alias("run_seq"), ((F.col("o_orderkey") * 37 + s) % 1000 / F.lit(997.0)).alias("v"))
        tables.append_results(rows, path)
    return spark.read.parquet(path)


@query("SELECT 'm' AS model, 1 AS seed, 'test' AS split, o_orderkey AS enroll_id, CAST(o_orderkey % 2 AS INTEGER) AS label, round(1 / (1 + CAST(o_orderkey AS DOUBLE)), 8) AS prob FROM orders")
def prediction_log(spark, sf):
    """Predictions written by model and seed and read back."""
    path = _path(spark, "predictions")
    o = tables.read_table(spark, sf, "orders").select(F.lit("m").alias("model"), F.lit(1).alias("seed"), F.lit("test").alias("split"), F.col("o_orderkey").alias("enroll_id"), (F.col("o_orderkey") % 2).cast("int").alias("label"), (1 / (1 + F.col("o_orderkey").cast("double"))).alias("prob"))
    tables.write_predictions(o, path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey || '' AS n_nationkey, n_name || ' ± ✓' AS n_name FROM nation")
def marked_csv(spark, sf):
    """A summary written as CSV with a byte order mark; read back as text without it."""
    path = _path(spark, "marked")
    tables.write_csv(tables.read_table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" ± ✓")).alias("n_name")), path, mark=True)
    got = spark.read.option("header", True).csv(path)
    return got.toDF(*(c.lstrip("\ufeff") for c in got.columns))


@query("SELECT r_regionkey, r_name FROM region")
def materialised_once(spark, sf):
    """A table that is made once: the second call reads what the first wrote, and does not make its own."""
    path = _path(spark, "kept")
    r = tables.read_table(spark, sf, "region").select("r_regionkey", "r_name")
    tables.materialised(spark, path, lambda: r)
    return tables.materialised(spark, path, lambda: r.limit(0))


@query("SELECT o_orderkey AS node_id, CAST(o_custkey AS DOUBLE) AS x0, round(o_totalprice, 6) AS x1, CAST(o_orderkey % 2 AS INTEGER) AS label FROM orders")
def aligned_arrays(spark, sf):
    """Features as one array a row, aligned with their labels, written and read back."""
    path = _path(spark, "arrays")
    o = tables.read_table(spark, sf, "orders")
    o.select(F.col("o_orderkey").alias("node_id"), F.array(F.col("o_custkey").cast("double"), "o_totalprice").alias("x"), (F.col("o_orderkey") % 2).cast("int").alias("label")).write.parquet(path)
    return C.rounded(spark.read.parquet(path).select("node_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "label"))


@query("WITH c AS (SELECT o_orderkey % 5 AS day, o_custkey AS user_id, o_orderkey AS node_id FROM orders) SELECT a.node_id, count(*) AS size, CAST(sum(b.node_id) AS BIGINT) AS total FROM c a JOIN c b ON a.user_id = b.user_id AND b.day <= a.day GROUP BY 1")
def causal_sums(spark, sf):
    """Sums over each learner's enrollments begun no later, without a row for each pair."""
    n = tables.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 5).alias("start_day"), F.col("o_orderkey").alias("total"))
    return C.H.causal_sums(cut(n), ["total"])
