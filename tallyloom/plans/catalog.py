"""Queries over the test tables and the SQL that states what each returns.

The events table serves as an unweighted activity log, orders and lineitem as a weighted one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import cut
from ..operators import activity as A
from ..operators import hypergraph as H
from ..operators import metrics as M
from ..operators import report as R
from ..sources.tables import events_log, orders_log, read_table
from ..spec import EVENTS, FAMILIES, ORDERS, SCENARIOS, SEEDS, Scenario, Spec

START = "2024-01-01"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- the unweighted log -------------------------------------------------------------------------------------------


def courses(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").alias("course_id"), F.lit(START).cast("date").alias("start"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return A.course_day(events_log(spark, sf), courses(spark))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("enroll_id").agg(
        F.min("user_id").alias("user_id"), F.min("course_id").alias("course_id"), (F.max("d") < EVENTS.window).cast("int").alias("label")
    )


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return A.kept(events(spark, sf), labels(spark, sf), EVENTS)


def padded(spark: SparkSession, sf: str) -> DataFrame:
    return A.padded(kept(spark, sf), labels(spark, sf))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return A.nodes(labels(spark, sf))


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, memberships with edge ids)."""
    n = cut(nodes(spark, sf))
    allowed = events(spark, sf).where(F.col("action").isin(*EVENTS.actions) & A.in_window(EVENTS))
    members = cut(H.pairs(n, allowed, EVENTS))
    return n, H.hypergraph(members, H.edges(members))


def started(n: DataFrame) -> DataFrame:
    return n.withColumn("start_day", F.col("course_id") % 5)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


EV = f"""
ev AS (SELECT event_id, user_id * 10 + k % 10 AS enroll_id, user_id, k % 10 AS course_id, event_type AS action, CAST(k AS VARCHAR) AS object_id,
  CAST(datediff('day', DATE '{START}', CAST(ts AS DATE)) AS INTEGER) AS d FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
lab AS (SELECT enroll_id, min(user_id) AS user_id, min(course_id) AS course_id, CAST(max(d) < 21 AS INTEGER) AS label FROM ev GROUP BY 1),
kept AS (SELECT * FROM ev WHERE d >= 0 AND d < 21 AND action IN ('click','error','purchase','signup','view')),
node AS (SELECT row_number() OVER (ORDER BY enroll_id) - 1 AS node_id, * FROM lab)"""
_OBJ = "lower(trim(object_id)) NOT IN ('', 'na', 'n/a', 'none', 'null', 'no data', '-')"
GRAPH = f"""{EV},
pairs AS (SELECT 'course' AS family, CAST(course_id AS VARCHAR) AS key, NULL::BIGINT AS num, node_id FROM node
  UNION ALL SELECT DISTINCT 'object', course_id || '|' || action || '|' || trim(object_id), NULL::BIGINT, node_id FROM kept JOIN (SELECT enroll_id, node_id FROM node) USING (enroll_id)
    WHERE action IN ('view','click','purchase') AND {_OBJ}
  UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), user_id, node_id FROM node),
edge AS (SELECT row_number() OVER (ORDER BY CASE family WHEN 'course' THEN 0 WHEN 'object' THEN 1 ELSE 2 END, num, key) - 1 AS edge_id, family, key, n AS size
  FROM (SELECT family, key, num, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 2)),
h0 AS (SELECT edge_id, family, node_id, true AS receives FROM pairs JOIN edge USING (family, key)),
hg AS (SELECT * FROM h0 UNION ALL SELECT (SELECT max(edge_id) + 1 FROM h0) + node_id, 'self_loop', node_id, true FROM node)"""
HAVE = "WITH "


def _select(sql: str, base: str = EV) -> str:
    return f"WITH {base}\n{sql}"


@query(_select("SELECT event_id, enroll_id, label FROM ev JOIN lab USING (enroll_id)"))
def labelled_events(spark, sf):
    return events(spark, sf).join(labels(spark, sf).select("enroll_id", "label"), "enroll_id").select("event_id", "enroll_id", "label")


@query(_select("SELECT event_id, action FROM ev WHERE action IN ('view','click','purchase')"))
def action_filter(spark, sf):
    return events_log(spark, sf).where(F.col("action").isin(*EVENTS.object_actions)).select("event_id", "action")


@query(_select("SELECT event_id, d FROM ev"))
def course_day(spark, sf):
    return events(spark, sf).select("event_id", "d")


@query(_select("SELECT event_id, d FROM ev WHERE d >= 0 AND d < 21"))
def observation_window(spark, sf):
    return events(spark, sf).where(A.in_window(EVENTS)).select("event_id", "d")


_MISS = "CASE WHEN k % 9 = 0 THEN ' None ' WHEN k % 9 = 1 THEN 'N/A' WHEN k % 9 = 2 THEN '-' WHEN k % 9 = 3 THEN '' ELSE ' o' || k END"


@query(f"SELECT event_id, trim(o) AS object_id, lower(trim(o)) IN ('', 'na', 'n/a', 'none', 'null', 'no data', '-') AS missing FROM (SELECT event_id, {_MISS} AS o FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))")
def missing_objects(spark, sf):
    o = events_log(spark, sf).select("event_id", F.col("object_id").cast("bigint").alias("k")).select("event_id", F.expr(_MISS).alias("o"))
    return o.select("event_id", F.trim("o").alias("object_id"), A.is_missing(F.col("o")).alias("missing"))


@query("SELECT o_orderkey AS enroll_id, o_custkey || '_' || o_orderpriority AS learner_course, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders")
def label_derivation(spark, sf):
    _, o = orders_log(spark, sf)
    return o.select("enroll_id", F.concat_ws("_", "user_id", "course_id").alias("learner_course"), "label")


@query(_select(f"SELECT event_id, course_id || '|' || action || '|' || trim(object_id) AS key FROM ev WHERE action IN ('view','click','purchase') AND {_OBJ}"))
def object_keys(spark, sf):
    return events(spark, sf).select("event_id", H.object_key(EVENTS).alias("key")).where("key is not null")


@query(_select(f"SELECT event_id, course_id, DATE '{START}' AS start FROM ev"))
def event_course_join(spark, sf):
    return events(spark, sf).select("event_id", "course_id", "start")


@query("SELECT count(*) AS n_orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def orphan_clicks(spark, sf):
    clicks, o = orders_log(spark, sf)
    return clicks.join(o, "enroll_id", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))


@query(_select("SELECT l.enroll_id, f.user_id, f.course_id FROM lab l JOIN (SELECT enroll_id, arg_min(user_id, event_id) AS user_id, arg_min(course_id, event_id) AS course_id FROM ev GROUP BY 1) f USING (enroll_id) WHERE l.enroll_id NOT IN (SELECT enroll_id FROM kept)"))
def empty_enrollments(spark, sf):
    first = events(spark, sf).groupBy("enroll_id").agg(F.min_by("user_id", "event_id").alias("user_id"), F.min_by("course_id", "event_id").alias("course_id"))
    return first.join(kept(spark, sf), "enroll_id", "left_anti")


@query(_select("SELECT node_id, enroll_id, label FROM node"))
def node_ids(spark, sf):
    return nodes(spark, sf).select("node_id", "enroll_id", "label")


def _counts_sql(spec: Spec, weight: str) -> str:
    n = spec.feature_names
    cols = [f"coalesce(sum({weight}) FILTER (d = {d}), 0) AS {n[d]}" for d in range(spec.window)]
    cols.append(f"coalesce(sum({weight}) FILTER (action IS NOT NULL), 0) AS {n[spec.window]}")
    cols.append(f"count(DISTINCT object_id) {'' if spec.weighted else f'FILTER ({_OBJ})'} AS {n[spec.window + 1]}")
    cols += [f"coalesce(sum({weight}) FILTER (action = '{a}'), 0) AS {c}" for a, c in zip(spec.actions, n[spec.window + 2 :])]
    return "SELECT enroll_id, " + ", ".join(c.replace(" AS ", "::BIGINT AS ", 1) if "sum(" in c else c for c in cols) + " FROM lab LEFT JOIN kept USING (enroll_id) GROUP BY enroll_id"


X = EVENTS.feature_names
COUNTS = _counts_sql(EVENTS, "1 * (action IS NOT NULL)::INT")


@query(_select(COUNTS))
def x_counts(spark, sf):
    return A.features(events(spark, sf), labels(spark, sf), EVENTS)


def _part(columns: list[str]) -> tuple[str, Callable]:
    sql = _select(f"SELECT enroll_id, {', '.join(columns)} FROM ({COUNTS})")
    return sql, lambda spark, sf: x_counts(spark, sf).select("enroll_id", *columns)


for _name, _columns in (("daily_counts", X[:21]), ("total_events", [X[21]]), ("distinct_objects", [X[22]]), ("action_counts", X[23:])):
    SQL[_name], QUERIES[_name] = _part(_columns)

ORD = """
lab AS (SELECT o_orderkey AS enroll_id, o_custkey AS user_id, o_orderpriority AS course_id, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders),
ck AS (SELECT l_orderkey AS enroll_id, l_returnflag || l_linestatus AS action, CAST(l_partkey AS VARCHAR) AS object_id,
  datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 70 AS d, CAST(l_quantity AS BIGINT) AS clicks FROM lineitem),
kept AS (SELECT * FROM ck WHERE d >= 0 AND d < 35 AND action IN ('AF','AO','NF','NO','RF','RO'))"""


@query(_select(_counts_sql(ORDERS, "clicks"), ORD))
def x_counts_weighted(spark, sf):
    clicks, o = orders_log(spark, sf)
    return A.features(clicks, o, ORDERS)


@query("SELECT course_id, start, CAST(datediff('day', min(start) OVER (), start) AS BIGINT) AS start_day FROM (SELECT o_custkey AS course_id, CAST(min(o_orderdate) AS DATE) AS start FROM orders GROUP BY 1)")
def course_start_days(spark, sf):
    """Starts of all courses in days since the earliest."""
    c = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("course_id")).agg(F.to_date(F.min("o_orderdate")).alias("start"))
    first = c.agg(F.min("start").alias("first"))
    return c.crossJoin(F.broadcast(first)).select("course_id", "start", F.datediff("start", "first").cast("bigint").alias("start_day"))


# -- splits and scaling -------------------------------------------------------------------------------------------


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "seed int")


SPLIT = f"""{EV},
sz AS (SELECT label, count(*) AS n FROM lab GROUP BY 1),
tq AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS place FROM (SELECT label, n, ceil(0.3::DOUBLE * (SELECT sum(n) FROM sz)) * n / (SELECT sum(n) FROM sz)::DOUBLE AS x FROM sz)),
t AS (SELECT label, n, floor(x) + CAST(place <= (SELECT ceil(0.3::DOUBLE * sum(n)) FROM sz) - (SELECT sum(floor(x)) FROM tq) AS INTEGER) AS q FROM tq),
rq AS (SELECT label, q, n - q AS r FROM t),
vx AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS place FROM (SELECT label, q, ceil((0.1::DOUBLE / (0.6::DOUBLE + 0.1::DOUBLE)) * (SELECT sum(r) FROM rq)) * r / (SELECT sum(r) FROM rq) AS x FROM rq)),
v AS (SELECT label, q, floor(x) + CAST(place <= (SELECT ceil((0.1::DOUBLE / (0.6::DOUBLE + 0.1::DOUBLE)) * sum(r)) FROM rq) - (SELECT sum(floor(x)) FROM vx) AS INTEGER) AS w FROM vx),
spl AS (SELECT seed, enroll_id, label, CASE WHEN rn <= q THEN 'test' WHEN rn <= q + w THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT seed, enroll_id, label, row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || '|' || enroll_id), enroll_id) AS rn
        FROM lab, (SELECT CAST(unnest([1, 11, 111, 1111, 11111]) AS INTEGER) AS seed)) JOIN v USING (label))"""


@query(_select("SELECT seed, enroll_id, label, split FROM spl", SPLIT))
def splits(spark, sf):
    return A.splits(labels(spark, sf), seeds(spark))


@query(_select("SELECT seed, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive FROM spl GROUP BY ALL", SPLIT))
def split_counts(spark, sf):
    return splits(spark, sf).groupBy("seed", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"))


SOME = [X[0], X[5], X[21], X[22], X[23]]


def _features(spark, sf) -> tuple[DataFrame, DataFrame]:
    x = cut(x_counts(spark, sf))
    first = A.splits(labels(spark, sf), seeds(spark).where("seed = 1")).select("enroll_id", "split")
    return x.join(first, "enroll_id"), x


@query(_select("SELECT " + ", ".join(f"round(avg(ln(1 + {c})), 6) AS m_{c}, round(CASE WHEN stddev_pop(ln(1 + {c})) = 0 THEN 1 ELSE stddev_pop(ln(1 + {c})) END, 6) AS s_{c}" for c in SOME) + f" FROM ({COUNTS}) JOIN spl USING (enroll_id) WHERE seed = 1 AND split = 'train'", SPLIT))
def scaler_stats(spark, sf):
    return rounded(A.scaler(_features(spark, sf)[0].where("split = 'train'"), SOME))


_Z = ", ".join(f"round((ln(1 + {c}) - m_{c}) / s_{c}, 6) AS {c}" for c in X)
_ST = ", ".join(f"avg(ln(1 + {c})) AS m_{c}, CASE WHEN stddev_pop(ln(1 + {c})) = 0 THEN 1 ELSE stddev_pop(ln(1 + {c})) END AS s_{c}" for c in X)


@query(_select(f"SELECT enroll_id, split, {_Z} FROM xs, (SELECT {_ST} FROM xs WHERE split = 'train')", f"{SPLIT}, xs AS (SELECT x.*, split FROM ({COUNTS}) x JOIN spl USING (enroll_id) WHERE seed = 1)"))
def x_scaled(spark, sf):
    x, _ = _features(spark, sf)
    return rounded(A.scaled(x.select("enroll_id", "split", *X), A.scaler(x.where("split = 'train'"), X), X))


# -- hypergraph ---------------------------------------------------------------------------------------------------


@query(_select(f"SELECT DISTINCT node_id, course_id || '|' || action || '|' || trim(object_id) AS key FROM kept JOIN (SELECT node_id, enroll_id FROM node) USING (enroll_id) WHERE action IN ('view','click','purchase') AND {_OBJ}"))
def incidence_pairs(spark, sf):
    keyed = kept(spark, sf).select("enroll_id", H.object_key(EVENTS).alias("key")).where("key is not null")
    return keyed.join(nodes(spark, sf), "enroll_id").select("node_id", "key").distinct()


@query(_select("SELECT edge_id, family, key, size FROM edge", GRAPH))
def edge_ids(spark, sf):
    return H.edges(cut(H.memberships(nodes(spark, sf), kept(spark, sf), EVENTS)))


def _family(family: str) -> tuple[str, Query]:
    sql = _select(f"SELECT key, count(*) AS members FROM pairs WHERE family = '{family}' GROUP BY 1", GRAPH)

    def run(spark, sf):
        n = nodes(spark, sf)
        if family == "object":
            pairs = incidence_pairs(spark, sf)
        else:
            pairs = n.select(F.col(f"{family}_id").cast("string").alias("key"), "node_id")
        return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("members"))

    return sql, run


for _name in ("course", "object", "user"):
    SQL[f"{_name}_edges"], QUERIES[f"{_name}_edges"] = _family(_name)


@query(_select("SELECT family, key, size FROM edge", GRAPH))
def hyperedges(spark, sf):
    return edge_ids(spark, sf).select("family", "key", "size")


@query(_select("SELECT family, count(*) AS edges, CAST(sum(size) AS BIGINT) AS memberships FROM edge GROUP BY 1", GRAPH))
def family_stats(spark, sf):
    return edge_ids(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("edges"), F.sum("size").alias("memberships"))


@query(_select("SELECT edge_id, family, node_id, receives FROM h0", GRAPH))
def hypergraph(spark, sf):
    return graph(spark, sf)[1]


@query(_select("SELECT edge_id, family, count(*) AS size FROM hg GROUP BY ALL", GRAPH))
def edge_sizes(spark, sf):
    n, h = graph(spark, sf)
    return H.edge_sizes(H.with_self_loops(h, n))


@query(_select("SELECT edge_id, node_id FROM hg WHERE family = 'self_loop'", GRAPH))
def self_loops(spark, sf):
    n, h = graph(spark, sf)
    return H.with_self_loops(h, n).where("family = 'self_loop'").select("edge_id", "node_id")


WEIGHTS = {"course": 2.0, "object": 0.5, "user": 1.0, "self_loop": 1.5}
_W = "CASE family WHEN 'course' THEN 2.0 WHEN 'object' THEN 0.5 WHEN 'user' THEN 1.0 ELSE 1.5 END"


@query(_select(f"SELECT node_id, CAST(sum({_W}) AS DOUBLE) AS d FROM hg GROUP BY 1", GRAPH))
def node_degrees(spark, sf):
    n, h = graph(spark, sf)
    return H.degrees(H.with_self_loops(h, n), WEIGHTS)


CAUSAL = """
st AS (SELECT node_id, user_id, course_id % 5 AS s FROM node),
cp AS (SELECT v.node_id AS edge_key, u.node_id, u.node_id = v.node_id AS receives FROM st v JOIN st u ON u.user_id = v.user_id AND u.s <= v.s),
cu AS (SELECT * FROM cp WHERE edge_key IN (SELECT edge_key FROM cp GROUP BY 1 HAVING count(*) >= 2))"""


@query(_select("SELECT edge_key, 'user' AS family, node_id, receives FROM cu", f"{EV}, {CAUSAL}"))
def causal_user_edges(spark, sf):
    return H.causal_user_edges(started(nodes(spark, sf)))


SHUFFLE = """
a AS (SELECT edge_id, family, row_number() OVER (PARTITION BY family ORDER BY edge_id, node_id) AS pos FROM h0),
b AS (SELECT family, node_id, row_number() OVER (PARTITION BY family ORDER BY md5('1|' || family || '|' || edge_id || '|' || node_id), edge_id, node_id) AS pos FROM h0),
sh AS (SELECT edge_id, family, node_id FROM a JOIN b USING (family, pos))"""


@query(_select("SELECT edge_id, family, node_id, true AS receives FROM sh", f"{GRAPH}, {SHUFFLE}"))
def shuffled_incidence(spark, sf):
    return H.shuffled(cut(graph(spark, sf)[1]), 1)


@query(_select("SELECT edge_id, family, node_id, true AS receives, count(*) AS h FROM sh GROUP BY ALL", f"{GRAPH}, {SHUFFLE}"))
def incidence_coalesce(spark, sf):
    return H.coalesced(shuffled_incidence(spark, sf))


@query(_select("SELECT row_number() OVER (ORDER BY edge_id) - 1 AS edge_id, family, key, size FROM edge WHERE family <> 'course'", GRAPH))
def scenario_edges(spark, sf):
    e = edge_ids(spark, sf).where("family <> 'course'")
    from ..functions.ranking import position

    return position(e, [], ["edge_id"]).select((F.col("pos") - 1).alias("edge_id"), "family", "key", "size")


def _scenario_sql(code: str) -> str:
    s = SCENARIOS[code]
    fam = ", ".join(f"'{f}'" for f in s.families if f != "self_loop" and not (s.causal and f == "user")) or "''"
    parts = [f"SELECT family, edge_id, node_id, true AS receives FROM {'sh' if s.shuffle else 'h0'} WHERE family IN ({fam})"]
    if s.causal:
        parts.append("SELECT 'user', 1000000000 + edge_key, node_id, receives FROM cu")
    if "self_loop" in s.families:
        parts.append("SELECT 'self_loop', 2000000000 + node_id, node_id, true FROM node")
    return f"SELECT '{code}' AS code, family, count(DISTINCT edge_id) AS edges, count(*) AS memberships, count(*) FILTER (receives) AS receiving FROM ({' UNION ALL '.join(parts)}) GROUP BY family"


@query(_select(" UNION ALL ".join(_scenario_sql(c) for c in SCENARIOS), f"{GRAPH}, {SHUFFLE}, {CAUSAL}"))
def scenario_graphs(spark, sf):
    """A family is counted once for all scenarios in which its memberships are the same: as they stand, dealt anew, causal."""
    n, h = graph(spark, sf)
    n, h, out = cut(started(n)), cut(h), None
    for shuffle, causal in sorted({(s.shuffle, s.causal) for s in SCENARIOS.values()}):
        of = [s for s in SCENARIOS.values() if (s.shuffle, s.causal) == (shuffle, causal)]
        codes = F.create_map(*(x for f in FAMILIES for x in (F.lit(f), F.array(*(F.lit(s.code) for s in of if f in s.families)).cast("array<string>"))))
        stats = H.scenario_graph(h, n, Scenario("", shuffle=shuffle, causal=causal), dense=False).groupBy("family").agg(
            F.countDistinct("edge_id").alias("edges"), F.count(F.lit(1)).alias("memberships"), F.count_if("receives").alias("receiving")
        )
        stats = stats.select(F.explode(codes[F.col("family")]).alias("code"), "family", "edges", "memberships", "receiving")
        out = stats if out is None else out.unionByName(stats)
    return out


def _propagate_sql(h: str, x: str, w: str, out: str = "p") -> str:
    return f"""
{out}_h AS (SELECT edge_id, family, node_id, receives, count(*) AS h FROM {h} GROUP BY ALL),
{out}_e AS (SELECT edge_id, family, any_value({w}) / count(*) AS a FROM {h} GROUP BY edge_id, family),
{out}_d AS (SELECT node_id, sqrt(greatest(sum({w}), 1e-6)) AS r, sqrt(greatest(sum({w}) FILTER (receives), 1e-6)) AS r_in FROM {h} GROUP BY 1),
{out}_y AS (SELECT edge_id, a * sum(h * x / r) AS y FROM {out}_h JOIN {x} USING (node_id) JOIN {out}_d USING (node_id) JOIN {out}_e USING (edge_id) GROUP BY edge_id, a),
{out} AS (SELECT n.node_id, coalesce(z.x, 0) AS x FROM node n LEFT JOIN (SELECT node_id, sum(h * y) / r_in AS x FROM {out}_h JOIN {out}_y USING (edge_id) JOIN {out}_d USING (node_id) WHERE receives GROUP BY node_id, r_in) z USING (node_id))"""


TOTAL = "x0 AS (SELECT node_id, CAST(count(kept.event_id) AS DOUBLE) AS x FROM node LEFT JOIN kept USING (enroll_id) GROUP BY 1)"


def _total(spark, sf, n: DataFrame) -> DataFrame:
    allowed = events(spark, sf).where(F.col("action").isin(*EVENTS.actions) & A.in_window(EVENTS))
    t = allowed.groupBy("enroll_id").agg(F.count(F.lit(1)).cast("double").alias("x"))
    return n.join(t, "enroll_id", "left").select("node_id", F.coalesce("x", F.lit(0.0)).alias("x"))


def _propagation(code: str, hops: int, weights: dict | None, back: bool = False) -> Query:
    def run(spark, sf):
        n, h = graph(spark, sf)
        n = started(n)
        x = _total(spark, sf, n)
        graph_of = H.scenario_propagator(h, n, SCENARIOS[code], weights=weights)
        for _ in range(hops):
            x = graph_of.back(x, ["x"]) if back else graph_of.hop(x, ["x"])
        return rounded(x)

    return run


_BASES = {"M": "hg", "S1": "(SELECT edge_id, family, node_id, true AS receives FROM sh UNION ALL SELECT 1000000000 + node_id, 'self_loop', node_id, true FROM node)",
          "A4": "h0", "X1": "(SELECT * FROM hg WHERE family = 'self_loop')",
          "UC": "(SELECT edge_id, family, node_id, receives FROM h0 WHERE family <> 'user' UNION ALL SELECT 1000000000 + edge_key, 'user', node_id, receives FROM cu UNION ALL SELECT 2000000000 + node_id, 'self_loop', node_id, true FROM node)"}
for _name, _code, _hops, _weights in (
    ("propagate_1hop", "M", 1, None), ("propagate_weighted", "M", 1, WEIGHTS), ("propagate_2hop", "M", 2, None), ("propagate_without_self_loops", "A4", 1, None),
    ("propagate_shuffled", "S1", 1, None), ("propagate_causal", "UC", 1, None), ("propagate_identity", "X1", 1, None),
):
    QUERIES[_name] = _propagation(_code, _hops, _weights)
    _w = _W if _weights else "1.0"
    _steps = ",".join(_propagate_sql(f"{_BASES[_code]} g", f"{'x0' if i == 0 else f'p{i - 1}'}", _w, f"p{i}") for i in range(_hops))
    SQL[_name] = _select(f"SELECT node_id, round(CAST(x AS DOUBLE), 6) AS x FROM p{_hops - 1}", f"{GRAPH}, {SHUFFLE}, {CAUSAL}, {TOTAL}, {_steps}")

#: The transpose of a hop over causal edges, as training sends gradients back; here applied to the activity counts.
QUERIES["propagate_causal_back"] = _propagation("UC", 1, WEIGHTS, back=True)
SQL["propagate_causal_back"] = _select(f"""SELECT n.node_id, round(coalesce(z.x, 0), 6) AS x FROM node n LEFT JOIN (
  SELECT node_id, sum(h * y) / r AS x FROM b_h JOIN b_y USING (edge_id) JOIN b_d USING (node_id) GROUP BY node_id, r) z USING (node_id)""", f"""{GRAPH}, {SHUFFLE}, {CAUSAL}, {TOTAL},
b_h AS (SELECT edge_id, family, node_id, receives, count(*) AS h FROM {_BASES["UC"]} GROUP BY ALL),
b_e AS (SELECT edge_id, family, any_value({_W}) / count(*) AS a FROM {_BASES["UC"]} GROUP BY edge_id, family),
b_d AS (SELECT node_id, sqrt(greatest(sum({_W}), 1e-6)) AS r, sqrt(greatest(sum({_W}) FILTER (receives), 1e-6)) AS r_in FROM {_BASES["UC"]} GROUP BY 1),
b_y AS (SELECT edge_id, a * sum(h * x / r_in) AS y FROM b_h JOIN x0 USING (node_id) JOIN b_d USING (node_id) JOIN b_e USING (edge_id) WHERE receives GROUP BY edge_id, a)""")


# -- metrics ------------------------------------------------------------------------------------------------------

SCORE = f"{SPLIT}, sc AS (SELECT seed, enroll_id, label, split, (enroll_id * 7919 + seed) % 100 / 100.0::DOUBLE AS prob FROM spl)"


def scored(spark, sf) -> DataFrame:
    return splits(spark, sf).withColumn("prob", ((F.col("enroll_id") * 7919 + F.col("seed")) % 100) / F.lit(100.0))


_CURVE = """c AS (SELECT seed, split, prob, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT seed, split, prob, sum(label) AS p, sum(1 - label) AS n FROM sc GROUP BY ALL)
  WINDOW w AS (PARTITION BY seed, split ORDER BY prob DESC))"""


@query(_select("SELECT seed, split, round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6)::DOUBLE AS auc FROM c GROUP BY ALL", f"{SCORE}, {_CURVE}"))
def metric_auc(spark, sf):
    return rounded(M.ranking_metrics(scored(spark, sf), ["seed", "split"]).drop("auprc"))


@query(_select("SELECT seed, split, round(sum(p * tp / (tp + fp)) / sum(p), 6)::DOUBLE AS auprc FROM c GROUP BY ALL", f"{SCORE}, {_CURVE}"))
def metric_auprc(spark, sf):
    return rounded(M.ranking_metrics(scored(spark, sf), ["seed", "split"]).drop("auc"))


def _threshold_sql(source: str, t: str) -> str:
    return f"""SELECT seed, split, round(avg(CAST((prob >= {t}) = (label = 1) AS INTEGER)), 6) AS accuracy, round(coalesce(sum(label) FILTER (prob >= {t}) / nullif(count(*) FILTER (prob >= {t}), 0), 0), 6)::DOUBLE AS precision,
  round(coalesce(sum(label) FILTER (prob >= {t}) / nullif(sum(label), 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * sum(label) FILTER (prob >= {t}) / nullif(sum(label) + count(*) FILTER (prob >= {t}), 0), 0), 6)::DOUBLE AS f1 FROM {source} GROUP BY ALL"""


@query(_select(_threshold_sql("sc", "0.5"), SCORE))
def metric_threshold(spark, sf):
    return rounded(M.threshold_metrics(scored(spark, sf), ["seed", "split"]))


_BEST = f"""{_CURVE}, f AS (SELECT seed, split, prob, round(2.0 * tp / (tp + fp + sum(p) OVER (PARTITION BY seed, split)), 12)::DOUBLE AS f1 FROM c),
best AS (SELECT seed, split, prob AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY seed, split ORDER BY f1 DESC, prob) AS rn FROM f) WHERE rn = 1)"""


@query(_select("SELECT seed, split, threshold, round(f1, 6) AS f1 FROM best", f"{SCORE}, {_BEST}"))
def best_threshold(spark, sf):
    return rounded(M.best_threshold(scored(spark, sf), ["seed", "split"]))


@query(_select(_threshold_sql("(SELECT sc.*, threshold FROM sc JOIN (SELECT seed, threshold FROM best WHERE split = 'validation') USING (seed) WHERE split = 'test')", "threshold"), f"{SCORE}, {_BEST}"))
def metric_val_threshold(spark, sf):
    s = cut(scored(spark, sf))
    best = M.best_threshold(s.where("split = 'validation'"), ["seed"]).select("seed", "threshold")
    return rounded(M.threshold_metrics(s.where("split = 'test'").join(best, "seed"), ["seed", "split"], F.col("threshold")))


@query(_select("""SELECT (SELECT count(*) FROM e WHERE enroll_id NOT IN (SELECT enroll_id FROM p)) AS n_missing, (SELECT count(*) FROM p WHERE enroll_id NOT IN (SELECT enroll_id FROM e)) AS n_surplus,
  (SELECT count(*) - count(DISTINCT enroll_id) FROM p) AS n_repeated, (SELECT count(*) FROM p WHERE isnan(prob)) AS n_nan, false AS ok""", f"""{SCORE}, e AS (SELECT enroll_id FROM sc WHERE seed = 1 AND split = 'test'),
  p AS (SELECT CASE WHEN enroll_id % 7 = 0 THEN -enroll_id ELSE enroll_id END AS enroll_id, CASE WHEN enroll_id % 5 = 0 THEN 'nan'::DOUBLE ELSE prob END AS prob FROM sc WHERE seed = 1 AND split = 'test')"""))
def prediction_check(spark, sf):
    test = cut(scored(spark, sf).where("seed = 1 AND split = 'test'"))
    predicted = test.select(F.when(F.col("enroll_id") % 7 == 0, -F.col("enroll_id")).otherwise(F.col("enroll_id")).alias("enroll_id"), F.when(F.col("enroll_id") % 5 == 0, float("nan")).otherwise(F.col("prob")).alias("prob"))
    return M.prediction_check(predicted, test)


# -- report -------------------------------------------------------------------------------------------------------

# result rows that grow with the events: a run for each event, so that most scenarios and seeds ran many times
RUNS = """runs AS (SELECT run_seq, scenario, CAST(CASE WHEN scenario = 'old' THEN 0 ELSE run_seq // 7 % 5 END AS INTEGER) AS seed, CAST(1 + run_seq % 3 AS INTEGER) AS layers,
  0.8::DOUBLE + (run_seq * 37 % 101)::DOUBLE / 1000 AS test_auc, 0.6::DOUBLE + (run_seq * 53 % 97)::DOUBLE / 1000 AS test_f1,
  CAST(20 + run_seq * 11 % 180 AS INTEGER) AS best_epoch, (run_seq * 7 % 300)::DOUBLE / 10 AS minutes,
  CASE WHEN scenario NOT IN ('P0', 'old') THEN 1 + (run_seq % 11)::DOUBLE / 10 END AS w_course, CASE WHEN scenario NOT IN ('P0', 'old') THEN 0.5::DOUBLE + (run_seq % 5)::DOUBLE / 10 END AS w_object,
  CASE WHEN scenario NOT IN ('A1', 'P0', 'old') THEN 1.5::DOUBLE END AS w_user, CASE WHEN scenario NOT IN ('P0', 'old') THEN 2.0::DOUBLE END AS w_self_loop
  FROM (SELECT event_id AS run_seq, ['M', 'A1', 'W1', 'P0', 'S1', 'L3', 'old'][(event_id + user_id) % 7 + 1] AS scenario FROM events)),
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY scenario, seed ORDER BY run_seq DESC) = 1)"""


def runs(spark, sf) -> DataFrame:
    e = events_log(spark, sf)
    r, code = F.col("event_id"), F.element_at(F.array(*map(F.lit, ("M", "A1", "W1", "P0", "S1", "L3", "old"))), ((F.col("event_id") + F.col("user_id")) % 7 + 1).cast("int"))
    e = e.select(r.alias("run_seq"), code.alias("scenario"))
    r, code = F.col("run_seq"), F.col("scenario")
    part = lambda n, m, of: (r * n % m).cast("double") / of
    graph = ~code.isin("P0", "old")
    return e.select(
        "run_seq", "scenario", F.when(code == "old", 0).otherwise(F.floor(r / 7) % 5).cast("int").alias("seed"), (r % 3 + 1).cast("int").alias("layers"),
        (part(37, 101, 1000) + 0.8).alias("test_auc"), (part(53, 97, 1000) + 0.6).alias("test_f1"), (r * 11 % 180 + 20).cast("int").alias("best_epoch"),
        part(7, 300, 10).alias("minutes"), F.when(graph, part(1, 11, 10) + 1).alias("w_course"), F.when(graph, part(1, 5, 10) + 0.5).alias("w_object"),
        F.when(graph & (code != "A1"), 1.5).alias("w_user"), F.when(graph, 2.0).alias("w_self_loop"),
    )


@query(_select("SELECT scenario, seed, run_seq FROM last", RUNS))
def latest_runs(spark, sf):
    return R.latest(runs(spark, sf)).select("scenario", "seed", "run_seq")


_SUM = "s AS (SELECT scenario, count(*) AS n_seeds, avg(test_auc) AS test_auc_mean, coalesce(stddev_samp(test_auc), 0) AS test_auc_std, avg(test_f1) AS test_f1_mean, coalesce(stddev_samp(test_f1), 0) AS test_f1_std FROM last GROUP BY 1)"


@query(_select("SELECT scenario, n_seeds, round(test_auc_mean, 6) AS test_auc_mean, round(test_auc_std, 6) AS test_auc_std, round(test_f1_mean, 6) AS test_f1_mean, round(test_f1_std, 6) AS test_f1_std FROM s", f"{RUNS}, {_SUM}"))
def seed_summary(spark, sf):
    return rounded(R.seed_summary(runs(spark, sf)))


@query(_select("SELECT scenario, arg_max(layers, run_seq) AS layers, arg_max(seed, run_seq) AS last_seed FROM runs GROUP BY 1", RUNS))
def last_values(spark, sf):
    return R.last_values(runs(spark, sf))


_SHARE = ", ".join(f"round(avg({c} / nullif(coalesce(w_course, 0) + coalesce(w_object, 0) + coalesce(w_user, 0) + coalesce(w_self_loop, 0), 0)), 6) AS {c.replace('w_', 'share_')}" for c in R.SHARES)


@query(_select(f"SELECT scenario, {_SHARE} FROM last GROUP BY 1", RUNS))
def weight_shares(spark, sf):
    return rounded(R.weight_shares(runs(spark, sf)))


@query(_select("SELECT scenario, round(test_auc_mean - (SELECT test_auc_mean FROM s WHERE scenario = 'M'), 6) AS delta_vs_m FROM s", f"{RUNS}, {_SUM}"))
def delta_vs_m(spark, sf):
    return rounded(R.delta_vs_main(R.seed_summary(runs(spark, sf))).select("scenario", "delta_vs_m"))


_CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{'+'.join(s.families)}', '{'✓' if s.mlp else '✗'}', '{'✓' if s.hgnn else '✗'}')" for i, (c, s) in enumerate(SCENARIOS.items())) + ") v(position, scenario, families, mlp, hgnn))"


@query(_select("""SELECT CAST(coalesce(position, 999) AS INTEGER) AS position, scenario, coalesce(families, '') AS families, coalesce(mlp, '✗') AS mlp, coalesce(hgnn, '✗') AS hgnn, n_seeds,
  printf('%.4f ± %.4f', round_even(test_auc_mean, 4), round_even(test_auc_std, 4)) AS auc, round_even(test_auc_mean - (SELECT test_auc_mean FROM s WHERE scenario = 'M'), 4) AS delta_vs_m FROM s LEFT JOIN cat USING (scenario)""", f"{RUNS}, {_SUM}, {_CAT}"))
def report_format(spark, sf):
    return R.formatted(spark, runs(spark, sf))


@query(_select("SELECT scenario, CAST(position AS INTEGER) AS position, families FROM cat", _CAT))
def scenario_order(spark, sf):
    return R.scenario_order(spark).select("scenario", "position", "families")


@query(_select(" UNION ALL ".join(f"SELECT '{a}-{b}' AS contrast, count(*) AS n_seeds, round(avg(x.test_auc - y.test_auc), 6) AS mean, round(coalesce(stddev_samp(x.test_auc - y.test_auc), 0), 6) AS std FROM last x JOIN last y USING (seed) WHERE x.scenario = '{a}' AND y.scenario = '{b}'" for a, b in (("M", "P0"), ("M", "S1"), ("S1", "P0"))), RUNS))
def paired_contrast(spark, sf):
    r = runs(spark, sf)
    return rounded(R.paired_contrast(r, "M", "P0").unionByName(R.paired_contrast(r, "M", "S1")).unionByName(R.paired_contrast(r, "S1", "P0")))


@query(_select(f"""SELECT CAST(coalesce(position, 999) AS INTEGER) AS position, scenario, seeds, n, best_epoch, minutes, {", ".join(f"round_even({c.replace('w_', 'share_')}, 4) AS {c.replace('w_', 'share_')}" for c in R.SHARES)} FROM
  (SELECT scenario, string_agg(seed, ' ' ORDER BY seed) AS seeds, count(*) AS n, CAST(round_even(avg(best_epoch), 0) AS INTEGER) AS best_epoch, round_even(avg(minutes), 1) AS minutes, {_SHARE.replace("round(avg(", "(avg(").replace(", 6) AS", ") AS")} FROM last GROUP BY 1)
  LEFT JOIN cat USING (scenario)""", f"{RUNS}, {_CAT}"))
def report_summary(spark, sf):
    """The rest of the report's columns: seeds, runs, mean best epoch and minutes, mean shares of the family weights."""
    return R.summarised(spark, runs(spark, sf))


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + exp(x)), 6) AS softplus, round(1 / (1 + exp(-x)), 6) AS sigmoid, CAST(1 / (1 + exp(-x)) >= 0.5 AS INTEGER) AS called FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x FROM lineitem)")
def activation_functions(spark, sf):
    x = F.col("l_quantity") - 25
    p = 1 / (1 + F.exp(-x))
    li = read_table(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", F.log1p(F.exp(x)).alias("softplus"), p.alias("sigmoid"), (p >= 0.5).cast("int").alias("called")))
