"""The report over result rows (run_seq, scenario, seed, metrics, family weights)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import SCENARIOS

SHARES = ("w_course", "w_object", "w_user", "w_self_loop")


def latest(runs: DataFrame) -> DataFrame:
    """The last run of each scenario and seed."""
    last = runs.groupBy("scenario", "seed").agg(F.max("run_seq").alias("run_seq"))
    return runs.join(last, ["scenario", "seed", "run_seq"], "left_semi")


def scenario_order(spark: SparkSession) -> DataFrame:
    rows = [(i, c, "+".join(s.families), s.layers, s.mlp, s.hgnn, s.learn_w) for i, (c, s) in enumerate(SCENARIOS.items())]
    return spark.createDataFrame(rows, "position int, scenario string, families string, layers int, mlp boolean, hgnn boolean, learn_w boolean")


def weight_shares(runs: DataFrame) -> DataFrame:
    """Each family's share of the sum of the weights that are there, null without any, averaged over the seeds."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in map(F.col, SHARES)), F.lit(0.0))
    share = {c: F.col(c) / F.when(total != 0, total) for c in SHARES}
    return latest(runs).groupBy("scenario").agg(*(F.avg(e).alias(c.replace("w_", "share_")) for c, e in share.items()))


def seed_summary(runs: DataFrame, metrics: tuple[str, ...] = ("test_auc", "test_f1")) -> DataFrame:
    """Mean and sample deviation (0 for one seed) over the seeds of each scenario, and the number of seeds."""
    return latest(runs).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        *(e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))),
    )


def last_values(runs: DataFrame) -> DataFrame:
    return runs.groupBy("scenario").agg(F.max_by("layers", "run_seq").alias("layers"), F.max_by("seed", "run_seq").alias("last_seed"))


def delta_vs_main(summary: DataFrame, metric: str = "test_auc_mean") -> DataFrame:
    """Adds the difference to scenario M; null without M. M is one row."""
    main = summary.where("scenario = 'M'").agg(F.max(metric).alias("_m"))
    return summary.crossJoin(F.broadcast(main)).withColumn("delta_vs_m", F.col(metric) - F.col("_m")).drop("_m")


def formatted(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """The report: text cells in catalogue order, unknown scenarios last."""
    s = delta_vs_main(seed_summary(runs)).join(F.broadcast(scenario_order(spark)), "scenario", "left")
    mark = lambda c: F.when(F.col(c), "✓").otherwise("✗")
    cell = F.format_string("%.4f ± %.4f", F.bround("test_auc_mean", 4), F.bround("test_auc_std", 4))
    return s.select(
        F.coalesce("position", F.lit(999)).alias("position"), "scenario", F.coalesce("families", F.lit("")).alias("families"), mark("mlp").alias("mlp"),
        mark("hgnn").alias("hgnn"), "n_seeds", cell.alias("auc"), F.bround("delta_vs_m", 4).alias("delta_vs_m"),
    )


def summarised(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """Per scenario, in catalogue order: the seeds as text, n, the mean best epoch and minutes, and the families' mean shares."""
    last = latest(runs)
    # a scenario has a row for each seed of the specification
    seeds = F.array_join(F.transform(F.array_sort(F.collect_list("seed")), lambda x: x.cast("string")), " ")
    s = last.groupBy("scenario").agg(
        seeds.alias("seeds"), F.count(F.lit(1)).alias("n"), F.bround(F.avg("best_epoch"), 0).cast("int").alias("best_epoch"), F.bround(F.avg("minutes"), 1).alias("minutes")
    )
    shares = weight_shares(runs)
    s = s.join(shares, "scenario").join(F.broadcast(scenario_order(spark)).select("scenario", "position"), "scenario", "left")
    return s.select(F.coalesce("position", F.lit(999)).alias("position"), "scenario", "seeds", "n", "best_epoch", "minutes", *(F.bround(c, 4).alias(c) for c in shares.columns if c != "scenario"))


def paired_contrast(runs: DataFrame, left: str, right: str, metric: str = "test_auc") -> DataFrame:
    """Mean and deviation over seeds of the difference of two scenarios on the same seed."""
    r = latest(runs).select("scenario", "seed", metric)
    a, b = (r.where(F.col("scenario") == c).select("seed", F.col(metric).alias(n)) for c, n in ((left, "x"), (right, "y")))
    d = F.col("x") - F.col("y")
    return a.join(b, "seed").agg(
        F.lit(f"{left}-{right}").alias("contrast"), F.count(F.lit(1)).alias("n_seeds"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std")
    )
