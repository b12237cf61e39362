"""Queries on relational parts of the baselines and on fitted models."""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut, position, shared_folder
from ..operators import activity as A
from ..operators import blocks, models
from ..spec import EVENTS, SCENARIOS, SEEDS
from . import catalog as C
from .catalog import COUNTS, EV, GRAPH, X, _select, query

_XC = f"xc AS (SELECT x.*, user_id, course_id FROM ({COUNTS}) x JOIN (SELECT enroll_id, user_id, course_id FROM lab) USING (enroll_id))"


@query(_select("SELECT enroll_id, round(avg(total_events) OVER u, 6) AS user_mean, max(total_events) OVER u AS user_max, round(avg(total_events) OVER c, 6) AS course_mean, max(total_events) OVER c AS course_max FROM xc WINDOW u AS (PARTITION BY user_id), c AS (PARTITION BY course_id)", f"{EV}, {_XC}"))
def context_augment(spark, sf):
    """Means and maxima of a feature by user and course, joined back; groups are summed before the join, so none is gathered."""
    x = C.x_counts(spark, sf).join(C.labels(spark, sf), "enroll_id")
    out = x
    for k in ("user", "course"):
        out = out.join(x.groupBy(f"{k}_id").agg(F.avg("total_events").alias(f"{k}_mean"), F.max("total_events").alias(f"{k}_max")), f"{k}_id")
    return C.rounded(out.select("enroll_id", "user_mean", "user_max", "course_mean", "course_max"))


@query(_select("SELECT enroll_id, " + ", ".join(f"CAST({' + '.join(X[w * 7 : w * 7 + 7])} AS BIGINT) AS week_{w}" for w in range(3)) + " FROM xc", f"{EV}, {_XC}"))
def weekly_activity(spark, sf):
    days = F.array(*X[:21])
    x = C.x_counts(spark, sf).select("enroll_id", days.alias("days"))
    week = lambda w: F.aggregate(F.slice("days", w * 7 + 1, 7), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return x.select("enroll_id", *(week(w).alias(f"week_{w}") for w in range(3)))


@query(_select("SELECT course_id, count(*) AS n_actions, count(DISTINCT enroll_id) AS n_enrollments, count(DISTINCT user_id) AS n_users, round(count(*) / count(DISTINCT enroll_id)::DOUBLE, 6) AS density, min(greatest(d, 0)) AS first_day FROM ev GROUP BY 1"))
def course_stats(spark, sf):
    by = C.events(spark, sf).groupBy("course_id", "enroll_id", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.greatest("d", F.lit(0))).alias("d"))
    out = by.groupBy("course_id").agg(F.sum("n").alias("n_actions"), F.countDistinct("enroll_id").alias("n_enrollments"), F.countDistinct("user_id").alias("n_users"), F.min("d").alias("first_day"))
    return C.rounded(out.withColumn("density", F.col("n_actions") / F.col("n_enrollments")))


@query(_select("SELECT object_id, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in EVENTS.actions) + " FROM ev GROUP BY 1"))
def object_action_crosstab(spark, sf):
    return C.events(spark, sf).groupBy("object_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in EVENTS.actions))


@query(_select("SELECT enroll_id, CAST(len(f) AS INTEGER) AS n_fields, CAST(list_sum(f) AS BIGINT) AS total FROM (SELECT enroll_id, flatten([" + ", ".join(f"[{c}, 0, 0, 0, 0]" for c in X) + "]) AS f FROM xc)", f"{EV}, {_XC}"))
def five_field_groups(spark, sf):
    zero = F.lit(0).cast("bigint")
    x = C.x_counts(spark, sf).select("enroll_id", F.flatten(F.array(*(F.array(F.col(c), zero, zero, zero, zero) for c in X))).alias("f"))
    return x.select("enroll_id", F.size("f").alias("n_fields"), F.aggregate("f", zero, lambda a, b: a + b).alias("total"))


_KINDS = (("user", "user_id"), ("course", "course_id"), ("record", "enroll_id"))


@query(_select(" UNION ALL ".join(
    f"SELECT '{kind}' AS kind, key, row_number() OVER (ORDER BY part, first, key) - 1 AS no FROM (SELECT {c} AS key, min_by(part, (part, event_id)) AS part, min_by(event_id, (part, event_id)) AS first FROM sx GROUP BY 1)"
    for kind, c in _KINDS), f"{C.SPLIT}, sx AS (SELECT ev.*, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS part FROM ev JOIN spl USING (enroll_id) WHERE seed = 1)"))
def first_appearance_ids(spark, sf):
    """Users, courses and records numbered from 0 by their first event in train, then validation, then test."""
    split = C.splits(spark, sf).where("seed = 1")
    part = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    e = C.events(spark, sf).join(split.select("enroll_id", part.alias("part")), "enroll_id")
    out = None
    for kind, c in _KINDS:
        first = e.groupBy(F.col(c).alias("key")).agg(F.min(F.struct("part", "event_id")).alias("f")).select("key", "f.part", "f.event_id")
        own = position(first, [], ["part", "event_id", "key"]).select(F.lit(kind).alias("kind"), "key", (F.col("pos") - 1).alias("no"))
        out = own if out is None else out.unionByName(own)
    return out


@query(_select("SELECT enroll_id, CAST(dense_rank() OVER (ORDER BY top) - 1 AS INTEGER) AS action_no, " + ", ".join(f"CAST(top = '{a}' AS INTEGER) AS is_{a}" for a in sorted(EVENTS.actions)) + " FROM (SELECT enroll_id, min(action) AS top FROM ev GROUP BY 1)"))
def categorical_index(spark, sf):
    """The first action, by name, of each enrollment as a dense number over all enrollments and as one-hot columns."""
    top = C.events(spark, sf).groupBy("enroll_id").agg(F.min("action").alias("top"))
    # as many rows as there are different actions, which the specification lists
    number = position(top.select("top").distinct(), [], ["top"]).select("top", (F.col("pos") - 1).cast("int").alias("action_no"))
    return top.join(number, "top").select("enroll_id", "action_no", *((F.col("top") == a).cast("int").alias(f"is_{a}") for a in sorted(EVENTS.actions)))


@query(_select("SELECT enroll_id, user_id, course_id, label FROM (SELECT * FROM lab ORDER BY enroll_id LIMIT 100)"))
def smoke_subset(spark, sf):
    """The first hundred enrollments: a small run's input; the limit is the feature."""
    return C.labels(spark, sf).orderBy("enroll_id").limit(100)


@query(_select("SELECT DISTINCT enroll_id, label FROM lab JOIN ev USING (enroll_id)"))
def enrollment_truth(spark, sf):
    return C.events(spark, sf).select("enroll_id").dropDuplicates().join(C.labels(spark, sf), "enroll_id").select("enroll_id", "label")


@query(_select("""SELECT kind, source, object_id, n_events, count(*) OVER (PARTITION BY kind, source) AS n_objects FROM (
  SELECT 'enrollment-object' AS kind, enroll_id AS source, object_id, count(*) AS n_events FROM ev GROUP BY ALL
  UNION ALL SELECT 'course-object', course_id, object_id, count(*) FROM ev GROUP BY ALL)"""))
def heterograph_edges(spark, sf):
    """Edges from enrollments and from courses to objects, with the events on each and the objects of its source."""
    e = C.events(spark, sf)
    parts = [e.groupBy(F.lit(k).alias("kind"), F.col(a).alias("source"), "object_id").agg(F.count(F.lit(1)).alias("n_events")) for a, k in (("enroll_id", "enrollment-object"), ("course_id", "course-object"))]
    edges = parts[0].unionByName(parts[1])
    return edges.join(edges.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n_objects")), ["kind", "source"])


@query(_select("""SELECT 'enrollment' AS kind, count(DISTINCT enroll_id) AS n FROM ev UNION ALL SELECT 'course', count(DISTINCT course_id) FROM ev UNION ALL SELECT 'object', count(DISTINCT object_id) FROM ev"""))
def heterograph_nodes(spark, sf):
    e = C.events(spark, sf)
    parts = [e.select(a).distinct().agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for a, k in (("enroll_id", "enrollment"), ("course_id", "course"), ("object_id", "object"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _scaled(spark, sf):
    x, _ = C._features(spark, sf)
    x = x.select("enroll_id", "split", *X)
    z = A.scaled(x, A.scaler(x.where("split = 'train'"), X), X)
    return cut(z.join(C.labels(spark, sf).select("enroll_id", "label"), "enroll_id"))


@query()
def baseline_logistic(spark, sf):
    return models.grid(_scaled(spark, sf), X, "logistic")


@query()
def baseline_svm(spark, sf):
    return models.grid(_scaled(spark, sf), X, "svm")


@query()
def baseline_boosting(spark, sf):
    return models.grid(_scaled(spark, sf), X, "boosting")


#: Epochs of the registered runs; ``blocks.train`` alone has 1000 and stops 200 after the best.
EPOCHS = 40
GRID_EPOCHS = 3


def _inputs(spark, sf, codes: tuple[str, ...], seeds: tuple[int, ...]):
    """(features scaled by each seed's training rows; what makes the graph of each scenario and seed)."""
    n, h = C.graph(spark, sf)
    n = cut(C.started(n))
    h = cut(h)
    x = cut(C.x_counts(spark, sf).join(n.select("enroll_id", "node_id"), "enroll_id"))
    split = cut(C.splits(spark, sf).where(F.col("seed").isin(*seeds)))
    z = None
    for s in seeds:
        own = x.join(split.where(F.col("seed") == s).select("enroll_id", "label", "split"), "enroll_id")
        own = A.scaled(own, A.scaler(own.where("split = 'train'"), X), X).withColumn("seed", F.lit(s))
        z = own if z is None else z.unionByName(own)
    graphs = {}
    for s in seeds:
        for c in codes:
            # without dealing anew a graph is the same for all seeds, and but for causal edges a part of the main model's
            named = c if SCENARIOS[c].causal or SCENARIOS[c].shuffle else "M"
            make = partial(C.H.scenario_graph, h, n, SCENARIOS[named], s, dense=False)
            graphs[c, s] = make if SCENARIOS[c].shuffle else blocks.Common(named, make)
    return z, graphs


_HOW = {"hidden": 32, "rate": 1e-2, "eval_every": 5}


def _runs(spark, sf, codes: tuple[str, ...], seeds: tuple[int, ...], what: int = 0):
    """``blocks.train`` over the events: result rows, or with what = 1 the predictions."""
    z, graphs = _inputs(spark, sf, codes, seeds)
    only = ("rows", "predictions")[what]
    return reduce(DataFrame.unionByName, [out[what] for out in blocks.train(z, X, graphs, SCENARIOS, epochs=EPOCHS, only=only, **_HOW)])


@query()
def hypergraph_model(spark, sf):
    """Result rows of all scenarios for the first seed."""
    return _runs(spark, sf, tuple(SCENARIOS), SEEDS[:1])


@query()
def hypergraph_seeds(spark, sf):
    """Result rows of the main model, without the graph, and with dealt memberships, for all seeds."""
    return _runs(spark, sf, ("M", "P0", "S1"), SEEDS)


@query()
def hypergraph_grid(spark, sf):
    """Result rows of all scenarios for all seeds, batch by batch through a results log; few epochs."""
    z, graphs = _inputs(spark, sf, tuple(SCENARIOS), SEEDS)
    log = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    return blocks.train_logged(z, X, graphs, SCENARIOS, log, epochs=GRID_EPOCHS, **(_HOW | {"eval_every": GRID_EPOCHS}))


@query()
def hypergraph_predictions(spark, sf):
    """What the main model of each seed predicts of every enrollment."""
    out = _runs(spark, sf, ("M",), SEEDS, 1)
    return out.select(F.col("scenario").alias("model"), "seed", "split", "enroll_id", "label", "prob")


@query()
def model_predictions(spark, sf):
    """What the logistic regression of each seed, chosen by the grid, predicts of every enrollment."""
    x = cut(C.x_counts(spark, sf))
    split = cut(C.splits(spark, sf))
    out = None
    for s in SEEDS:
        own = x.join(split.where(F.col("seed") == s).select("enroll_id", "label", "split"), "enroll_id")
        z = cut(A.scaled(own, A.scaler(own.where("split = 'train'"), X), X))
        found = models.predictions(z, X, "logistic", s)[1]
        out = found if out is None else out.unionByName(found)
    return out


_PRED = f"""{C.SPLIT}, pr AS (SELECT model, seed, split, enroll_id, label, CAST((enroll_id * k + seed) % 97 AS DOUBLE) / 97 AS prob FROM spl, (VALUES ('logistic', 7919), ('svm', 104729), ('boosting', 1299709)) m(model, k)
  WHERE NOT (model = 'svm' AND seed = 11) AND NOT (model = 'boosting' AND seed = 1 AND enroll_id % 50 = 3))"""


def _predictions(spark, sf):
    """Predictions that SQL can make too: a seed is missing of one model, enrollments of one seed of another."""
    k = F.create_map(*(F.lit(v) for m, k in (("logistic", 7919), ("svm", 104729), ("boosting", 1299709)) for v in (m, k)))
    of = C.splits(spark, sf).select("seed", "split", "enroll_id", "label", F.explode(F.array(*map(F.lit, ("logistic", "svm", "boosting")))).alias("model"))
    of = of.withColumn("prob", ((F.col("enroll_id") * k[F.col("model")] + F.col("seed")) % 97).cast("double") / 97)
    return of.where("NOT (model = 'svm' AND seed = 11) AND NOT (model = 'boosting' AND seed = 1 AND enroll_id % 50 = 3)")


def _comparison_sql(threshold: str) -> str:
    return _select(f"""SELECT model, count(*) AS seeds, {", ".join(f"round(avg({m}), 6) AS test_{m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS test_{m}_std" for m in models.M.METRICS)},
  CASE WHEN sum(bad) = 0 THEN 'ok' ELSE sum(bad) || ' seeds with other test enrollments or without a probability' END AS "check" FROM per GROUP BY model""",
    f"""{_PRED}, f AS (SELECT model, seed, prob, 2.0 * tp / (tp + fp + pos) AS f1 FROM (SELECT model, seed, prob, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model, seed) AS pos
  FROM (SELECT model, seed, prob, sum(label) AS p, sum(1 - label) AS n FROM pr WHERE split = 'validation' GROUP BY ALL) WINDOW w AS (PARTITION BY model, seed ORDER BY prob DESC))),
th AS (SELECT model, seed, {threshold} AS threshold FROM (SELECT model, seed, prob FROM f QUALIFY row_number() OVER (PARTITION BY model, seed ORDER BY round(f1, 12) DESC, prob) = 1)),
tt AS (SELECT * FROM pr JOIN th USING (model, seed) WHERE split = 'test'),
au AS (SELECT a.model, a.seed, sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END * a.c * b.c) / sum(a.c * b.c) AS auc
  FROM (SELECT model, seed, prob, count(*) AS c FROM tt WHERE label = 1 GROUP BY ALL) a JOIN (SELECT model, seed, prob, count(*) AS c FROM tt WHERE label = 0 GROUP BY ALL) b USING (model, seed) GROUP BY ALL),
pm AS (SELECT model, seed, coalesce(tp / nullif(called, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(2 * tp / nullif(called + pos, 0), 0) AS f1, n
  FROM (SELECT model, seed, CAST(sum(label) FILTER (prob >= threshold) AS DOUBLE) AS tp, count(*) FILTER (prob >= threshold) AS called, sum(label) AS pos, count(*) AS n FROM tt GROUP BY ALL)),
per AS (SELECT model, seed, auc, precision, recall, f1, CAST(n <> e.c AS BIGINT) AS bad FROM au JOIN pm USING (model, seed) JOIN (SELECT seed, count(*) AS c FROM spl WHERE split = 'test' GROUP BY 1) e USING (seed))""")


@query(_comparison_sql("0.5"))
def model_comparison(spark, sf):
    expected = C.splits(spark, sf).where("split = 'test'")
    return C.rounded(models.M.model_comparison(cut(_predictions(spark, sf)), expected))


@query(_comparison_sql("prob"))
def model_comparison_val_threshold(spark, sf):
    expected = C.splits(spark, sf).where("split = 'test'")
    return C.rounded(models.M.model_comparison(cut(_predictions(spark, sf)), expected, None))


@query(_select("SELECT (SELECT count(*) FROM node) AS n_features, (SELECT count(DISTINCT node_id) FROM h0) AS n_nodes, 0::BIGINT AS n_unknown, true AS aligned", GRAPH))
def graph_alignment(spark, sf):
    n, h = C.graph(spark, sf)
    return A.alignment(n, h)
