"""From raw activity to counts: filters, joins, nodes, features, splits, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import position
from ..spec import MISSING, TEST_SHARE, VALIDATION_SHARE, Spec


def is_missing(c: Column) -> Column:
    """Null, or a sentinel in any case after trimming."""
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def demanded(df: DataFrame, c: str, *said: str | Column) -> DataFrame:
    """The rows; the job fails where the column is null, whichever columns are read later.

    The filter is never pruned. The column fails too where it is asked for, else a later test of it that is false for null
    would let Spark drop the rows before the filter."""
    fails = F.raise_error(F.concat(*(F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null")) for x in said)))
    checked = df.where(F.when(F.col(c).isNull(), fails.cast("boolean")).otherwise(True))
    return checked.withColumn(c, F.coalesce(c, fails.cast(df.schema[c].dataType)))


def course_day(df: DataFrame, courses: DataFrame) -> DataFrame:
    """Adds start and d, days since the course's start. An event of an unknown course makes the job fail."""
    both = demanded(df.join(courses.select("course_id", "start"), "course_id", "left"), "start", "no start of course ", F.col("course_id"))
    return both.withColumn("d", F.datediff("event_date", "start"))


def in_window(spec: Spec) -> Column:
    return (F.col("d") >= 0) & (F.col("d") < spec.window)


def kept(df: DataFrame, labels: DataFrame, spec: Spec) -> DataFrame:
    """Rows of labelled enrollments with an allowed action inside the window. The cheap tests go to the scan."""
    return df.where(F.col("action").isin(*spec.actions) & in_window(spec)).join(labels.select("enroll_id"), "enroll_id", "left_semi")


def nodes(labels: DataFrame) -> DataFrame:
    """Adds node_id, the rank of enroll_id from 0."""
    return position(labels, [], ["enroll_id"]).select((F.col("pos") - 1).alias("node_id"), *labels.columns)


def padded(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Kept events and, for every enrollment without any, one row without action."""
    empty = labels.join(events.select("enroll_id"), "enroll_id", "left_anti")
    return events.unionByName(empty, allowMissingColumns=True)


def counts(events: DataFrame, spec: Spec) -> DataFrame:
    """One row per enrollment and one column per feature of padded events; another action in a weighted log makes the job fail.

    All sums are combined before one shuffle by enrollment; distinct objects are counted apart, from pairs of an
    enrollment and an object alone."""
    on = F.col("action").isNotNull()
    weight = F.lit(1)
    if spec.weighted:
        other = F.raise_error(F.concat(F.lit("unknown activity "), F.col("action"))).cast("bigint")
        weight = F.when(F.col("action").isin(*spec.actions), F.col("clicks")).otherwise(other)
    days, total, objects, actions = spec.feature_names[: spec.window], *spec.feature_names[spec.window : spec.window + 2], spec.feature_names[spec.window + 2 :]
    whole = lambda test, name: F.coalesce(F.sum(F.when(test, weight)), F.lit(0)).cast("bigint").alias(name)
    sums = events.groupBy("enroll_id").agg(
        *(whole(on & (F.col("d") == d), n) for d, n in enumerate(days)), whole(on, total), *(whole(F.col("action") == a, n) for a, n in zip(spec.actions, actions))
    )
    # without the missing test an absent object of a weighted log counts as one
    pairs = events.where(on if spec.weighted else on & ~is_missing(F.col("object_id"))).select("enroll_id", "object_id").distinct()
    held = pairs.groupBy("enroll_id").agg(F.count(F.lit(1)).alias(objects))
    both = sums.join(held, "enroll_id", "left")
    return both.select("enroll_id", *days, total, F.coalesce(objects, F.lit(0).cast("bigint")).alias(objects), *actions)


def features(events: DataFrame, labels: DataFrame, spec: Spec) -> DataFrame:
    """``counts`` of the labelled enrollments from raw events (with d): what ``kept`` and ``padded`` lead to, in one join.

    Enrollments without kept events get zeros from the outer join, so that no row is made for them and events are not
    joined with the labels before they are summed."""
    # in a weighted log another action is left for ``counts`` to fail on
    allowed = F.col("action").isNotNull() if spec.weighted else F.col("action").isin(*spec.actions)
    x = counts(events.where(allowed & in_window(spec)), spec)
    zero = F.lit(0).cast("bigint")
    return labels.select("enroll_id").join(x, "enroll_id", "left").select("enroll_id", *(F.coalesce(n, zero).alias(n) for n in spec.feature_names))


def alignment(x: DataFrame, graph: DataFrame) -> DataFrame:
    """One row: n_features, n_nodes, n_unknown (nodes of the graph without features) and aligned; node_id has to be dense from 0."""
    of = x.agg(F.count(F.lit(1)).alias("n_features"), F.countDistinct("node_id").alias("_d"), F.min("node_id").alias("_a"), F.max("node_id").alias("_z"))
    own = graph.select("node_id").distinct()
    lone = own.join(x.select("node_id"), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    n = own.agg(F.count(F.lit(1)).alias("n_nodes"))
    dense = (F.col("_d") == F.col("n_features")) & ((F.col("n_features") == 0) | ((F.col("_a") == 0) & (F.col("_z") == F.col("n_features") - 1)))
    return of.crossJoin(n).crossJoin(lone).select("n_features", "n_nodes", "n_unknown", (dense & (F.col("n_unknown") == 0)).alias("aligned"))


def splits(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, enroll_id, label, split: stratified 60/10/30, test first, then validation from the rest.

    Class quotas are floors plus the largest remainders, the lower label first; ranks follow a hash of seed and id."""
    label_sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    test = quotas(label_sizes, TEST_SHARE)
    validation = quotas({y: n - test[y] for y, n in label_sizes.items()}, VALIDATION_SHARE)
    order = F.md5(F.concat_ws("|", "seed", "enroll_id").cast("binary"))
    drawn = labels.select("enroll_id", "label").crossJoin(F.broadcast(seeds)).withColumn("_h", order)
    ranked = position(drawn, ["seed", "label"], ["_h", "enroll_id"]).withColumnRenamed("pos", "r")
    pick = lambda q: F.create_map(*(F.lit(x).cast("bigint") for y, n in q.items() for x in (y, n)))[F.col("label").cast("bigint")] if q else F.lit(0)
    split = F.when(F.col("r") <= pick(test), "test").when(F.col("r") <= pick(test) + pick(validation), "validation").otherwise("train")
    return ranked.select("seed", "enroll_id", "label", split.alias("split"))


def quotas(sizes: dict[int, int], share: float) -> dict[int, int]:
    """How many of each class a stratified draw of ``ceil(share * n)`` takes."""
    import math

    n = sum(sizes.values())
    total = math.ceil(share * n)
    exact = {y: total * s / n for y, s in sorted(sizes.items())} if n else {}
    out = {y: math.floor(x) for y, x in exact.items()}
    for y in sorted(exact, key=lambda y: (-(exact[y] - out[y]), y))[: total - sum(out.values())]:
        out[y] += 1
    return out


def scaler(train: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation of log1p of each feature: one row, columns m_ and s_ (0 becomes 1)."""
    return train.agg(
        *(F.avg(F.log1p(c)).alias(f"m_{c}") for c in names),
        *(F.when(F.stddev_pop(F.log1p(c)) == 0, 1.0).otherwise(F.stddev_pop(F.log1p(c))).alias(f"s_{c}") for c in names),
    )


def scaled(x: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """The features as train-scaled z-scores of log1p; the statistics are one row."""
    rest = [c for c in x.columns if c not in names]
    return x.crossJoin(F.broadcast(stats)).select(*rest, *(((F.log1p(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in names))
