import math
import tarfile
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.ranking import position, running_sums
from tallyloom.operators import activity as A
from tallyloom.operators import distributed
from tallyloom.operators import hypergraph as H
from tallyloom.operators import metrics as M
from tallyloom.operators import models
from tallyloom.operators import report as R
from tallyloom.plans import catalog
from tallyloom.sources import tables
from tallyloom.spec import SCENARIOS, Spec, scenario_codes

VIDEO, ASSIGN, FORUM, PAGE = ("play_video",), ("problem_get", "problem_check"), ("create_thread",), ("click_info", "click_courseware")
SPEC = Spec("hand", 35, VIDEO + ASSIGN + FORUM + PAGE, {**dict.fromkeys(VIDEO, "video"), **dict.fromkeys(ASSIGN, "assignment"), **dict.fromkeys(FORUM, "forum")})


@pytest.fixture(scope="module")
def hand(spark):
    """Five enrollments worked out by hand."""
    courses = spark.createDataFrame([("A", "2024-01-01"), ("B", "2024-01-11"), ("C", "2024-01-01")], "course_id string, start string").withColumn("start", F.to_date("start"))
    labels = spark.createDataFrame([(10, 1, "A", 1), (11, 1, "B", 0), (12, 2, "A", 1), (13, 3, "B", 0), (14, 4, "C", 0)], "enroll_id bigint, user_id bigint, course_id string, label int")
    log = [
        (10, "A", "play_video", "v1", 0), (10, "A", "play_video", "v1", 1), (10, "A", "problem_check", "p1", 1), (10, "A", "click_info", "", 2), (11, "B", "play_video", "v1", 0),
        (12, "A", "problem_get", "p1", 3), (12, "A", "create_thread", "None", 5), (12, "A", "play_video", "v9", -1), (12, "A", "play_video", "v9", 35), (12, "A", "unknown_action", "v9", 4),
        (13, "B", "play_video", "v1", 34), (13, "B", "click_courseware", "pg9", 34), (14, "C", "play_video", "v1", 40), (99, "A", "play_video", "v1", 0),
    ]
    raw = spark.createDataFrame(log, "enroll_id bigint, course_id string, action string, object_id string, off int").join(courses, "course_id")
    raw = raw.withColumn("event_date", F.date_add("start", F.col("off"))).drop("start", "off").withColumn("clicks", F.lit(1).cast("bigint"))
    events = A.kept(A.course_day(raw, courses), labels, SPEC)
    nodes = A.nodes(labels)
    members = H.memberships(nodes, events, SPEC)
    edges = H.edges(members)
    return labels, events, nodes, edges, H.hypergraph(members, edges)


def test_counts(hand):
    labels, events, *_ = hand
    x = {r.enroll_id: r for r in A.counts(A.padded(events, labels), SPEC).collect()}
    assert [x[e].total_events for e in range(10, 15)] == [4, 1, 2, 2, 0]
    assert [x[e].distinct_objects for e in range(10, 15)] == [2, 1, 1, 2, 0]
    assert (x[10].activity_day_0, x[10].activity_day_1, x[10].activity_day_2, x[13].activity_day_34) == (1, 2, 1, 2)
    assert x[10].action_play_video == 2 and len(SPEC.feature_names) == 35 + 2 + 6


def test_features_are_the_counts_of_padded_events(hand, spark):
    labels, events, *_ = hand
    more = events.unionByName(events.where("enroll_id = 10").withColumn("enroll_id", F.lit(77).cast("bigint")))
    want = A.counts(A.padded(events, labels), SPEC)
    got = A.features(more, labels, SPEC)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hyperedges(hand):
    *_, edges, graph = hand
    got = {r.edge_id: (r.family, r.key, r.size) for r in edges.collect()}
    assert got == {0: ("course", "A", 2), 1: ("course", "B", 2), 2: ("object", "A|assignment|p1", 2), 3: ("object", "B|video|v1", 2), 4: ("user", "1", 2)}
    members = {}
    for r in graph.collect():
        members.setdefault(r.edge_id, set()).add(r.node_id)
    assert members == {0: {0, 2}, 1: {1, 3}, 2: {0, 2}, 3: {1, 3}, 4: {0, 1}}


def propagate(graph, nodes, weights=None):
    x = nodes.withColumn("x", F.element_at(F.array(*map(F.lit, (4.0, 1.0, 2.0, 2.0, 0.0))), (F.col("node_id") + 1).cast("int"))).select("node_id", "x")
    return [round(r.x, 6) for r in H.propagate(x, graph, ["x"], weights).orderBy("node_id").collect()]


def test_propagation(hand):
    _, _, nodes, _, graph = hand
    loops = H.with_self_loops(graph, nodes)
    assert [r.d for r in H.degrees(loops).orderBy("node_id").collect()] == [4, 4, 3, 3, 1]
    assert propagate(loops, nodes) == [3.20235, 1.70235, 2.488034, 1.622008, 0]
    assert propagate(loops, nodes, {"course": 2, "object": 0.5, "user": 1, "self_loop": 1.5}) == [3.259017, 1.609017, 2.493034, 1.654508, 0]
    assert propagate(graph, nodes) == [2.983163, 1.983163, 2.632993, 1.408248, 0]
    days = nodes.withColumn("start_day", F.when(F.col("course_id") == "B", 10).otherwise(0))
    causal = H.scenario_graph(graph, days, SCENARIOS["UC"])
    assert propagate(causal, nodes) == [2.976068, 1.70235, 2.488034, 1.622008, 0]
    assert propagate(H.scenario_graph(graph, days, SCENARIOS["X1"]), nodes) == [4, 1, 2, 2, 0]


def test_root_of_degree_is_a_fixed_point(hand):
    _, _, nodes, _, graph = hand
    loops = H.with_self_loops(graph, nodes)
    d = H.degrees(loops).select("node_id", F.sqrt("d").alias("x"))
    for a, b in zip(d.orderBy("node_id").collect(), H.propagate(d, loops, ["x"]).orderBy("node_id").collect()):
        assert abs(a.x - b.x) < 1e-12


def test_shuffle_keeps_sizes_and_degrees(hand):
    *_, graph = hand
    out = H.shuffled(graph, 11)
    for count in (lambda g: g.groupBy("edge_id").count(), lambda g: g.groupBy("node_id", "family").count()):
        assert sorted(map(tuple, count(out).collect())) == sorted(map(tuple, count(graph).collect()))


def test_scaling(hand, spark):
    labels, events, *_ = hand
    x = A.counts(A.padded(events, labels), SPEC).select("enroll_id", "total_events")
    z = A.scaled(x, A.scaler(x.where("enroll_id < 13"), ["total_events"]), ["total_events"]).orderBy("enroll_id").collect()
    assert [round(r.total_events, 6) for r in z] == [1.268895, -1.175215, -0.093679, -0.093679, -3.024113]


def test_metrics_with_ties(spark):
    rows = spark.createDataFrame(list(zip([1, 0, 1, 1, 0, 0], [0.9, 0.5, 0.5, 0.3, 0.3, 0.1])), "label int, prob double")
    r = M.ranking_metrics(rows, []).first()
    assert (round(r.auc, 6), round(r.auprc, 6)) == (0.777778, 0.755556)
    t = M.threshold_metrics(rows, []).first()
    assert {round(v, 6) for v in (t.accuracy, t.precision, t.recall, t.f1)} == {0.666667}
    none = M.threshold_metrics(rows.where("label = 0"), [], 2.0).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
    assert M.best_threshold(rows, []).first().threshold == 0.3


def test_split_sizes(spark):
    assert sum(A.quotas({0: 1306, 1: 193}, 0.3).values()) == 450
    assert sum(A.quotas({0: 7}, 0.1 / (0.6 + 0.1)).values()) == 2  # the double is a bit over one seventh
    labels = spark.range(1499).select(F.col("id").alias("enroll_id"), (F.col("id") % 8 == 0).cast("int").alias("label"))
    out = A.splits(labels, spark.createDataFrame([(1,), (11,)], "seed int"))
    sizes = {(r.seed, r.split): r["count"] for r in out.groupBy("seed", "split").count().collect()}
    assert sizes == {(s, k): n for s in (1, 11) for k, n in (("test", 450), ("validation", 150), ("train", 899))}
    share = {r.split: r.s for r in out.groupBy("split").agg(F.avg("label").alias("s")).collect()}
    assert max(share.values()) - min(share.values()) < 0.01
    assert out.select("seed", "enroll_id").distinct().count() == 2 * 1499


def test_position_matches_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    rows = position(df, ["g"], ["x"]).collect()
    for g in range(3):
        assert [r.x for r in sorted((r for r in rows if r.g == g), key=lambda r: r.pos)] == sorted(r.x for r in rows if r.g == g)


def test_scenarios():
    assert scenario_codes(["all"]) == ["M", "A1", "A2", "A3", "A4", "W1", "L1", "H"]
    with pytest.raises(ValueError):
        scenario_codes(["M", "nope"])


@pytest.mark.parametrize("directed", [False, True])
def test_gradients_and_training(directed):
    rng = np.random.default_rng(0)
    n = 12
    node, edge = rng.integers(0, n, 30), rng.integers(0, 9, 30)
    family = np.array([0, 1, 2])[edge % 3]
    g = models.Graph(node, edge, family, n, rng.random(30) < 0.6 if directed else None)
    assert g.directed == directed
    x, w, up = rng.normal(size=(n, 3)), rng.random(len(g.size)) + 0.5, rng.normal(size=(n, 3))
    _, kept = g.propagate(x, w)
    gx, gw = g.backward(up, kept)
    f = lambda x, w: float((g.propagate(x, w)[0] * up).sum())
    for i in range(len(w)):
        e = np.zeros_like(w)
        e[i] = 1e-6
        assert abs((f(x, w + e) - f(x, w - e)) / 2e-6 - gw[i]) < 1e-6
    for i in range(n):
        e = np.zeros_like(x)
        e[i, 1] = 1e-6
        assert abs((f(x + e, w) - f(x - e, w)) / 2e-6 - gx[i, 1]) < 1e-6
    y = (x[:, 0] > 0).astype(float)
    out = models.fit(x, y, np.array(["train", "validation", "test"] * 4), g, SCENARIOS["M"], 1, epochs=40, hidden=32, rate=1e-2)
    assert 1 <= out["best_epoch"] <= out["epochs_run"] <= 40 and out["val_auc"] >= 0.5 and out["w_user"] > 0
    with pytest.raises(ValueError):
        models.fit(x, y, np.array(["train"] * n), None, type(SCENARIOS["M"])("none", (), 0, mlp=False, hgnn=False), 1)


def test_dead_models_start_again(monkeypatch):
    seen = []

    def once(x, y, split, graph, scenario, seed, **how):
        seen.append(seed)
        return {"prob": np.full(4, 0.5) if len(seen) < 3 else np.arange(4) / 4}

    monkeypatch.setattr(models, "fit_once", once)
    split = np.array(["train", "validation", "validation", "test"])
    assert models.fit(None, None, split, None, None, 7)["prob"][1] == 0.25 and seen == [7, 1007, 2007]
    seen[:] = range(-99, 0)
    monkeypatch.setattr(models, "fit_once", lambda *a, **how: seen.append(a[5]) or {"prob": np.full(4, 0.5)})
    models.fit(None, None, split, None, None, 7)
    assert seen[99:] == [7, 1007, 2007, 3007, 4007, 5007]


def test_scores_in_a_task_match_the_metrics(spark):
    rng = np.random.default_rng(2)
    prob, y = rng.integers(0, 12, 80) / 11, rng.integers(0, 2, 80).astype(float)
    rows = spark.createDataFrame([(float(p), int(t)) for p, t in zip(prob, y)], "prob double, label int")
    want = {**M.ranking_metrics(rows, []).first().asDict(), **M.threshold_metrics(rows, []).first().asDict()}
    got = models._scores(prob, y)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.fixture(scope="module")
def small(spark):
    """Thirty enrollments with features that tell the label and a graph over courses, objects and learners."""
    rng = np.random.default_rng(4)
    rows = [(i, i, i % 9, i % 4, ("train", "train", "validation", "test")[i % 4], int(rng.random() < 0.4 + 0.3 * (i % 4 == 1)), float(rng.normal()), float(rng.normal()), i % 5) for i in range(30)]
    z = spark.createDataFrame(rows, "node_id bigint, enroll_id bigint, user_id bigint, course_id bigint, split string, label int, a double, b double, start_day int")
    held = [(int(rng.integers(0, 30)), f"o{rng.integers(0, 7)}") for _ in range(60)]
    thing = spark.createDataFrame(held, "node_id bigint, key string").distinct().selectExpr("'object' AS family", "key", "CAST(NULL AS BIGINT) AS sort_number", "node_id")
    members = thing.unionByName(z.selectExpr("'course' AS family", "CAST(course_id AS STRING) AS key", "CAST(NULL AS BIGINT) AS sort_number", "node_id"))
    members = members.unionByName(z.selectExpr("'user' AS family", "CAST(user_id AS STRING) AS key", "user_id AS sort_number", "node_id"))
    return z, H.hypergraph(members, H.edges(members))


def test_scenarios_train_on_their_own_graphs(small):
    z, graph = small
    codes = ("M", "S1", "UC", "P0", "X1")
    graphs = {(c, s): H.scenario_graph(graph, z, SCENARIOS[c], s) for c in codes for s in (1, 11)}
    seeds = z.selectExpr("*", "1 AS seed").unionByName(z.selectExpr("*", "11 AS seed"))
    how = {"epochs": 12, "hidden": 6, "rate": 0.02, "dropout": 0.0}
    got = {(r.scenario, r.seed): r for r in models.train_grid(seeds, ["a", "b"], graphs, SCENARIOS, **how).collect()}
    assert set(got) == set(graphs) and set(got["M", 1].asDict()) == set(models.RESULT)
    assert len({round(got[c, 1].w_user or 0, 9) for c in ("M", "S1", "UC")}) == 3
    assert got["P0", 1].w_course is None and got["X1", 1].w_user is None and got["M", 1].families == "course+object+user+self_loop"
    assert got["S1", 1].w_object != got["S1", 11].w_object
    prob = models.train_grid(seeds, ["a", "b"], graphs, SCENARIOS, predict=True, **how)
    assert prob.count() == 30 * len(graphs) and prob.where("model = 'M' AND seed = 1").select("prob").distinct().count() > 10
    with pytest.raises(Exception, match="do not fit one task"):
        models.train_grid(seeds, ["a", "b"], graphs, SCENARIOS, max_nodes=29, **how).collect()
    with pytest.raises(Exception, match="do not align"):
        models.train_grid(seeds.where("node_id < 29"), ["a", "b"], graphs, SCENARIOS, **how).collect()


@pytest.mark.parametrize("code", ["M", "UC", "W1", "P0"])
def test_distributed_training_matches_the_task(small, code):
    z, graph = small
    own = H.scenario_graph(graph, z, SCENARIOS[code])
    how = {"epochs": 2, "hidden": 5, "rate": 0.02, "dropout": 0.0}
    seeds = z.selectExpr("*", "1 AS seed")
    want = {r.enroll_id: r.prob for r in models.train_grid(seeds, ["a", "b"], {(code, 1): own}, SCENARIOS, predict=True, **how).collect()}
    out, rows = distributed.fit(z, ["a", "b"], own, SCENARIOS[code], 1, eval_every=1, **how)
    got = {r.enroll_id: r.prob for r in rows.collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert out["epochs_run"] == 2 and (out["w_user"] is None) == (code in ("P0", "W1"))


def test_dropout_is_the_same_whenever_it_is_asked_for():
    u = distributed._uniform(np.arange(2000), 16, 7)
    assert abs(u.mean() - 0.5) < 0.01 and (u == distributed._uniform(np.arange(2000), 16, 7)).all() and (u != distributed._uniform(np.arange(2000), 16, 8)).all()


def test_large_edges_are_sent_by_broadcast(hand, monkeypatch):
    _, _, nodes, _, graph = hand
    monkeypatch.setattr(H, "LARGE", 2)
    assert H.Propagator(H.with_self_loops(graph, nodes)).broadcast
    assert propagate(H.with_self_loops(graph, nodes), nodes) == [3.20235, 1.70235, 2.488034, 1.622008, 0]


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("v"))
    for by in ([], ["g"]):
        rows = running_sums(df, by, [F.desc("x")], {"s": "v"}).collect()
        assert len(rows) == 500
        for r in rows:
            assert r.s == sum(o.v for o in rows if o.x >= r.x and (not by or o.g == r.g))


def test_failing_joins(spark):
    courses = spark.createDataFrame([("A", "2024-01-01")], "course_id string, start string").withColumn("start", F.to_date("start"))
    e = spark.createDataFrame([("A", "2024-01-03"), ("B", "2024-01-03")], "course_id string, event_date string").withColumn("event_date", F.to_date("event_date"))
    assert A.course_day(e.where("course_id = 'A'"), courses).first().d == 2
    with pytest.raises(Exception, match="no start of course B"):
        A.course_day(e, courses).collect()
    spec = Spec("w", 2, ("a",), {"a": "a"}, weighted=True)
    rows = spark.createDataFrame([(1, "a", "o", 0, 5), (1, "zz", "o", 1, 3)], "enroll_id bigint, action string, object_id string, d int, clicks bigint")
    assert A.counts(rows.where("action = 'a'"), spec).first().total_clicks == 5
    with pytest.raises(Exception, match="unknown activity zz"):
        A.counts(rows, spec).collect()


def test_report(spark):
    rows = [(0, "M", 1, 0.9), (1, "M", 1, 0.8), (2, "M", 11, 0.7), (3, "A1", 1, 0.75)]
    runs = spark.createDataFrame(rows, "run_seq bigint, scenario string, seed int, test_auc double").withColumn("test_f1", F.lit(0.5))
    s = {r.scenario: r for r in R.delta_vs_main(R.seed_summary(runs)).collect()}
    assert s["M"].n_seeds == 2 and abs(s["M"].test_auc_mean - 0.75) < 1e-12 and abs(s["M"].test_auc_std - math.sqrt(0.005)) < 1e-12
    assert s["A1"].test_auc_std == 0 and abs(s["A1"].delta_vs_m) < 1e-12


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1, x \n2,?\n3,\n")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "id bigint, name string", ("", "?")).orderBy("id").collect()
    assert [r.name for r in got] == ["x", None, None]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/a.csv", "h\n1\n")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.csv", "a.csv")
    for name, n in (("b.zip", 2), ("c.tar.gz", 4)):
        assert tables.read_archive(spark, str(tmp_path / name), ("a.csv",)).count() == n
    with pytest.raises(Exception, match="lacks"):
        tables.read_archive(spark, str(tmp_path / "b.zip"), ("z.csv",)).collect()
    df = spark.createDataFrame([(0, 1.23456789)], "run_seq bigint, v double")
    for _ in range(2):
        tables.append_results(df, str(tmp_path / "r"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [1.234568] * 2
    p = spark.createDataFrame([("m", 1, "test", 5, 1, 0.123456789)], "model string, seed int, split string, enroll_id bigint, label int, prob double")
    tables.write_predictions(p, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().prob == 0.12345679
    tables.write_csv(df, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 1


def test_causal_edges_without_rows_propagate_as_with(small):
    """Forward and back, with weights, ties of days and nodes outside every other edge."""
    z, graph = small
    weights = {"course": 0.5, "object": 2.0, "user": 1.5, "self_loop": 0.7}
    for families in (SCENARIOS["UC"].families, ("user",), ("object", "user")):
        scenario = replace(SCENARIOS["UC"], families=families)
        explicit = H.Propagator(H.scenario_graph(graph, z, scenario, dense=False), weights)
        implicit = H.scenario_propagator(graph, z, scenario, weights=weights)
        for move in ("hop", "back"):
            want, got = ({r.node_id: (r.a, r.b) for r in getattr(p, move)(z, ["a", "b"]).collect()} for p in (explicit, implicit))
            assert set(got) == set(want) and max(abs(x - y) for i in want for x, y in zip(want[i], got[i])) < 1e-9


def test_a_hop_and_its_transpose_agree(small):
    """<hop(x), y> = <x, back(y)>."""
    z, graph = small
    p = H.scenario_propagator(graph, z, SCENARIOS["UC"])
    x, y = ({r.node_id: r[c] for r in z.collect()} for c in ("a", "b"))
    hop = {r.node_id: r.a for r in p.hop(z, ["a"]).collect()}
    back = {r.node_id: r.b for r in p.back(z, ["b"]).collect()}
    assert abs(sum(hop[i] * y[i] for i in y) - sum(x[i] * back[i] for i in x)) < 1e-9


def test_a_learner_with_a_third_of_all_enrollments_writes_no_pairs(spark):
    """20,000 enrollments of one learner: 200 million pairs would be written out. Against running sums in NumPy."""
    n = 60_000
    nodes = spark.range(n).selectExpr("id AS node_id", "IF(id % 3 = 0, -1, id % 25000) AS user_id", "CAST(id * 7919 % 365 AS INT) AS start_day", "CAST(id % 11 AS DOUBLE) AS x")
    none = spark.createDataFrame([], "edge_id bigint, family string, node_id bigint, receives boolean")
    p = H.scenario_propagator(none, nodes, SCENARIOS["UC"])
    got = {r.node_id: r.x for r in p.hop(nodes, ["x"]).where("node_id % 3 = 0").collect()}
    i = np.arange(0, n, 3)
    day, x = i * 7919 % 365, (i % 11).astype(float)
    size = np.array([(day <= t).sum() for t in range(365)])
    sends = np.array([(day >= t).sum() for t in range(365)])  # every edge has a second member: days repeat
    total = np.array([(x / np.sqrt(sends[day] + 1.0))[day <= t].sum() for t in range(365)])
    want = (total[day] / size[day] + x / np.sqrt(sends[day] + 1.0)) / np.sqrt(2.0)
    assert max(abs(got[k] - v) for k, v in zip(i.tolist(), want)) < 1e-9


def test_scenarios_with_one_graph_are_counted_once(spark, sf_dir, monkeypatch):
    """Sixteen scenarios of three graphs: as it stands, dealt anew, causal."""
    made, real = [], H.scenario_graph
    monkeypatch.setattr(H, "scenario_graph", lambda g, n, s, *a, **how: (made.append((s.shuffle, s.causal)), real(g, n, s, *a, **how))[1])
    found = catalog.QUERIES["scenario_graphs"](spark, sf_dir)
    assert sorted(made) == [(False, False), (False, True), (True, False)]
    assert {r.code for r in found.collect()} == {c for c, s in SCENARIOS.items() if s.families}
