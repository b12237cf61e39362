"""The hypergraph: memberships, ids, scenarios, causal edges, propagation.

Edges stay exploded as (edge, node) rows; no edge's members are ever gathered in one row."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cut, position, running_sums
from ..spec import Scenario, Spec
from .activity import is_missing

ORDER = {"course": 0, "object": 1, "user": 2, "self_loop": 3}


def _family_number(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in ORDER.items() for x in (k, v)))[c]


def object_key(spec: Spec) -> Column:
    """course|family|object of an object-bearing event, else null."""
    family = F.create_map(*(F.lit(x) for k, v in spec.object_actions.items() for x in (k, v)))[F.col("action")]
    fine = F.col("action").isin(*spec.object_actions) & ~is_missing(F.col("object_id"))
    return F.when(fine, F.concat_ws("|", F.col("course_id").cast("string"), family, F.trim("object_id")))


def pairs(nodes: DataFrame, events: DataFrame, spec: Spec) -> DataFrame:
    """Distinct (family, key, sort_number, node_id) of course, object and user edges; of ``events`` those of the nodes count."""
    none = F.lit(None).cast("bigint")
    course = nodes.select(F.lit("course").alias("family"), F.col("course_id").cast("string").alias("key"), none.alias("sort_number"), "node_id")
    user = nodes.select(F.lit("user").alias("family"), F.col("user_id").cast("string").alias("key"), F.col("user_id").cast("bigint").alias("sort_number"), "node_id")
    keyed = events.select("enroll_id", object_key(spec).alias("key")).where("key is not null").distinct()
    thing = keyed.join(nodes.select("enroll_id", "node_id"), "enroll_id").select(F.lit("object").alias("family"), "key", none.alias("sort_number"), "node_id")
    return course.unionByName(thing).unionByName(user)


def memberships(nodes: DataFrame, events: DataFrame, spec: Spec) -> DataFrame:
    """``pairs`` of edges with two members or more."""
    out = pairs(nodes, events, spec)
    large = out.groupBy("family", "key").count().where("count >= 2").select("family", "key")
    return out.join(large, ["family", "key"])


def edges(members: DataFrame) -> DataFrame:
    """edge_id, family, key, size of edges with two members or more: dense ids by family, then key (text by code point, users by number)."""
    sized = members.groupBy("family", "key", "sort_number").agg(F.count(F.lit(1)).alias("size")).where("size >= 2").withColumn("_f", _family_number(F.col("family")))
    return position(sized, [], ["_f", "sort_number", "key"]).select((F.col("pos") - 1).alias("edge_id"), "family", "key", "size")


def hypergraph(members: DataFrame, edge: DataFrame) -> DataFrame:
    """edge_id, family, node_id, receives; members: ``pairs`` or ``memberships``."""
    return members.join(edge.select("family", "key", "edge_id"), ["family", "key"]).select("edge_id", "family", "node_id", F.lit(True).alias("receives"))


def with_self_loops(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per node, numbered after the largest id."""
    top = graph.agg((F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).alias("top"))
    own = nodes.select("node_id").crossJoin(F.broadcast(top)).select(
        (F.col("top") + F.col("node_id")).alias("edge_id"), F.lit("self_loop").alias("family"), "node_id", F.lit(True).alias("receives")
    )
    return graph.unionByName(own)


def causal_user_edges(nodes: DataFrame) -> DataFrame:
    """For each node v with another enrollment of its user begun no later: an edge of v and those; only v receives.

    nodes: node_id, user_id, start_day. The edge is named by v. The edges hold as many rows as there are such pairs,
    which for one learner grows with the square of the enrollments; ``causal_sums`` gives their sums without the rows."""
    v, u = nodes.select(F.col("node_id").alias("v"), "user_id", F.col("start_day").alias("sv")), nodes.select(F.col("node_id").alias("u"), "user_id", F.col("start_day").alias("su"))
    pairs = v.join(u, "user_id").where("su <= sv")
    several = pairs.groupBy("v").count().where("count >= 2").select("v")
    return pairs.join(several, "v").select(F.col("v").alias("edge_key"), F.lit("user").alias("family"), F.col("u").alias("node_id"), (F.col("u") == F.col("v")).alias("receives"))


def causal_sums(nodes: DataFrame, columns: list[str], later: bool = False) -> DataFrame:
    """node_id, size and, for each column, its sum over the learner's enrollments begun no later, itself among them.

    nodes: node_id, user_id, start_day and the columns; later: over those begun no earlier instead. Running sums by
    learner and day: no pair is written out, and a learner's rows are summed by all tasks."""
    day = nodes.groupBy("user_id", "start_day").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_{c}") for c in columns))
    order = F.desc("start_day") if later else F.asc("start_day")
    upto = running_sums(day, ["user_id"], [order], {"size": "_n", **{c: f"_{c}" for c in columns}}).select("user_id", "start_day", "size", *columns)
    return nodes.select("node_id", "user_id", "start_day").join(upto, ["user_id", "start_day"]).select("node_id", "size", *columns)


def shuffled(graph: DataFrame, seed: int) -> DataFrame:
    """The nodes of each family's memberships dealt anew: edges keep their sizes, nodes their numbers of edges."""
    places = position(graph.select("edge_id", "family", "node_id", "receives"), ["family"], ["edge_id", "node_id"]).drop("node_id")
    dealt = graph.select("edge_id", "family", "node_id").withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "family", "edge_id", "node_id").cast("binary")))
    dealt = position(dealt, ["family"], ["_h", "edge_id", "node_id"]).select("family", "pos", "node_id")
    return places.join(dealt, ["family", "pos"]).select("edge_id", "family", "node_id", "receives")


def scenario_graph(graph: DataFrame, nodes: DataFrame, scenario: Scenario, seed: int = 1, dense: bool = True) -> DataFrame:
    """The scenario's memberships, in order: families, dealing anew, causal users, dense ids, self-loops.

    nodes needs start_day where the scenario is causal. Sums over the graph need no dense ids: without, causal edges and
    self-loops have ids below zero and a sort is saved."""
    out = graph.where(F.col("family").isin(*scenario.families) if scenario.families else F.lit(False))
    if scenario.shuffle:
        out = shuffled(out, seed)
    if scenario.causal:
        causal = causal_user_edges(nodes).select((-2 - 2 * F.col("edge_key")).alias("edge_id"), "family", "node_id", "receives")
        out = out.where("family <> 'user'").unionByName(causal)
    if not dense:
        own = nodes.select((-1 - 2 * F.col("node_id")).alias("edge_id"), F.lit("self_loop").alias("family"), "node_id", F.lit(True).alias("receives"))
        return out.unionByName(own) if "self_loop" in scenario.families else out
    # causal edges, with ids below zero, come after the others
    kept = out.select("edge_id").distinct().withColumns({"_new": (F.col("edge_id") < 0).cast("int"), "_k": F.abs("edge_id")})
    ids = position(kept, [], ["_new", "_k"]).select("edge_id", (F.col("pos") - 1).alias("new_id"))
    out = out.join(ids, "edge_id").select(F.col("new_id").alias("edge_id"), "family", "node_id", "receives")
    return with_self_loops(out, nodes) if "self_loop" in scenario.families else out


def coalesced(graph: DataFrame) -> DataFrame:
    """edge_id, family, node_id, receives, h: repeated memberships counted."""
    return graph.groupBy("edge_id", "family", "node_id", "receives").agg(F.count(F.lit(1)).alias("h"))


def edge_sizes(graph: DataFrame) -> DataFrame:
    return graph.groupBy("edge_id", "family").agg(F.count(F.lit(1)).alias("size"))


def _weight(weights: dict[str, float] | None) -> Column:
    w = weights or {}
    return F.create_map(*(F.lit(x) for f in ORDER for x in (f, float(w.get(f, 1.0)))))[F.col("family")]


def degrees(graph: DataFrame, weights: dict[str, float] | None = None, receiving: bool = False) -> DataFrame:
    """node_id and d, the sum of its edges' weights (with repeats)."""
    source = graph.where("receives") if receiving else graph
    return source.groupBy("node_id").agg(F.sum(_weight(weights)).alias("d"))


#: Memberships from which an edge's sum is sent to its members by a broadcast and not by a shuffle on the edge. There
#: are at most as many such edges as this many times fewer than memberships; a broadcast takes ``MOST_LARGE`` of them.
LARGE, MOST_LARGE = 1_000_000, 100_000


class Propagator:
    """Degree-normalised propagation over one graph, whose sizes and degrees are summed once for any number of hops.

    Two sums a hop: node to edge, then edge to receiving node. Nodes and edges are never multiplied out; sums are
    combined before the shuffle, so that an edge of all nodes costs a row per task.

    causal: nodes (node_id, user_id, start_day) whose causal edges, as of ``causal_user_edges``, are added without a row of
    them: what such an edge gathers is a running sum over its learner's days, forward from senders to the receiver and,
    in ``back``, from the last day to the first."""

    def __init__(self, graph: DataFrame, weights: dict[str, float] | None = None, causal: DataFrame | None = None):
        root = lambda c: F.sqrt(F.greatest(c, F.lit(1e-6)))
        w, one = _weight(weights), F.lit(1)
        h = coalesced(graph)
        size = cut(h.groupBy("edge_id").agg(F.sum("h").alias("size")))
        large = size.where(F.col("size") >= LARGE)
        self.broadcast = 0 < large.count() <= MOST_LARGE
        # rows of large edges never meet by the edge: their sizes are sent to them
        sized = h.join(size, "edge_id")
        if self.broadcast:
            few = F.broadcast(large)
            sized = h.join(few, "edge_id").unionByName(h.join(few, "edge_id", "left_anti").join(size, "edge_id"))
        # repeats count in the degree; receiving edges give the receiver's degree
        d = h.groupBy("node_id").agg(F.sum(F.col("h") * w).alias("d"), F.sum(F.when(F.col("receives"), F.col("h") * w)).alias("d_in"))
        self.causal = None
        if causal is not None:
            user = float((weights or {}).get("user", 1.0))
            own = causal.select("node_id", "user_id", "start_day")
            # an edge has its receiver's number, and is one if it has another member
            edge = causal_sums(own, []).select("node_id", "size", (F.col("size") >= 2).cast("double").alias("is_edge"))
            edge = cut(own.join(edge, "node_id"))
            sends = causal_sums(edge, ["is_edge"], later=True).select("node_id", F.col("is_edge").alias("edges"))
            d = edge.join(sends, "node_id").join(d, "node_id", "left").select(
                "node_id", "user_id", "start_day", "size", "is_edge", (F.coalesce("d", F.lit(0.0)) + user * F.col("edges")).alias("d"),
                (F.coalesce("d_in", F.lit(0.0)) + user * F.col("is_edge")).alias("d_in"),
            )
            d = cut(d)
            down = F.col("is_edge") * user / F.col("size") / root(F.col("d_in"))
            self.causal = cut(d.select("node_id", "user_id", "start_day", (one / root(F.col("d"))).alias("up"), down.alias("down")))
        d = d.select("node_id", (one / root(F.col("d"))).alias("out_root"), (one / root(F.col("d_in"))).alias("in_root"))
        self.members = cut(sized.join(d, "node_id").select(
            "edge_id", "node_id", "receives", (F.col("h") * F.col("out_root")).alias("up"),
            (F.col("h") * w / F.col("size") * F.col("in_root")).alias("down"), (F.col("size") >= LARGE).alias("large"),
        ))

    def hop(self, x: DataFrame, columns: list[str]) -> DataFrame:
        """The columns of x (node_id, ...) after one hop; 0 for nodes that receive nothing."""
        return self._moved(x, columns, False)

    def back(self, g: DataFrame, columns: list[str]) -> DataFrame:
        """The transpose of ``hop``: from gradients by what a hop returns to gradients by what it was given."""
        return self._moved(g, columns, True)

    def _moved(self, x: DataFrame, columns: list[str], back: bool) -> DataFrame:
        first, last = ("down", "up") if back else ("up", "down")
        sums = lambda factor: [F.sum(F.col(factor) * F.col(c)).alias(c) for c in columns]
        receivers = self.members.where("receives")
        start, sent = (receivers, self.members) if back else (self.members, receivers)
        up = start.join(x.select("node_id", *columns), "node_id").groupBy("edge_id", "large").agg(*sums(first))
        if self.broadcast:
            few, own = F.broadcast(up.where("large").drop("large")), up.where("not large").drop("large")
            reached = sent.where("not large").join(own, "edge_id").unionByName(sent.where("large").join(few, "edge_id"))
        else:
            reached = sent.join(up.drop("large"), "edge_id")
        got = reached.groupBy("node_id").agg(*sums(last))
        if self.causal is not None:
            own = self.causal.join(x.select("node_id", *columns), "node_id").select("node_id", "user_id", "start_day", *((F.col(first) * F.col(c)).alias(c) for c in columns))
            gathered = causal_sums(own, columns, later=back).join(self.causal.select("node_id", last), "node_id")
            got = got.unionByName(gathered.select("node_id", *((F.col(last) * F.col(c)).alias(c) for c in columns)))
            got = got.groupBy("node_id").agg(*(F.sum(c).alias(c) for c in columns))
        return x.select("node_id").join(got, "node_id", "left").select("node_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def scenario_propagator(graph: DataFrame, nodes: DataFrame, scenario: Scenario, seed: int = 1, weights: dict[str, float] | None = None) -> Propagator:
    """Of the scenario's graph; causal edges are never written out. nodes needs user_id and start_day where it is causal."""
    if not scenario.causal:
        return Propagator(scenario_graph(graph, nodes, scenario, seed, dense=False), weights)
    rest = replace(scenario, causal=False, families=tuple(f for f in scenario.families if f != "user"))
    return Propagator(scenario_graph(graph, nodes, rest, seed, dense=False), weights, nodes)


def propagate(x: DataFrame, graph: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """One hop of ``Propagator``."""
    return Propagator(graph, weights).hop(x, columns)
