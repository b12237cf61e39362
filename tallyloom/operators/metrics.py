"""Binary-classification metrics from (label, prob), grouped by any keys.

Running sums over distinct scores go by ranges of scores, so a group need not fit a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b == 0, None).otherwise(b), F.lit(0.0))


def _curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score the positives and negatives there and at or above."""
    at = scored.groupBy(*keys, "prob").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    return running_sums(at, keys, [F.desc("prob")], {"tp": "p", "fp": "n"})


def ranking_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """auc (ties count half) and auprc (step-wise average precision) per group."""
    c = _curve(scored, keys)
    sums = c.groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("s"), F.sum("p").alias("pos"), F.sum("n").alias("neg"),
        F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    return sums.select(*keys, _ratio(F.col("s"), F.col("pos") * F.col("neg")).alias("auc"), _ratio(F.col("ap"), F.col("pos")).alias("auprc"))


def threshold_metrics(scored: DataFrame, keys: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """accuracy, precision, recall and f1 of label 1 at prob >= threshold; 0 where undefined."""
    on = (F.col("prob") >= threshold).cast("int")
    s = scored.groupBy(*keys).agg(
        F.sum(on * F.col("label")).alias("tp"), F.sum(on).alias("called"), F.sum("label").alias("pos"), F.avg((on == F.col("label")).cast("double")).alias("accuracy")
    )
    p, r = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("pos"))
    return s.select(*keys, "accuracy", p.alias("precision"), r.alias("recall"), _ratio(2 * F.col("tp"), F.col("called") + F.col("pos")).alias("f1"))


def best_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The score that gives the best f1 as threshold, per group; the lowest of equals."""
    c = _curve(scored, keys)
    total = c.groupBy(*keys).agg(F.sum("p").alias("pos"))
    f1 = F.round(_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), 12)
    joined = c.join(total, keys) if keys else c.crossJoin(total)
    best = joined.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), (-F.col("prob")).alias("m"))).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("threshold"), F.col("b.f1").alias("f1"))


def prediction_check(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: counts of missing, surplus, repeated and NaN predictions, and whether all is well."""
    missing = expected.select("enroll_id").join(predicted, "enroll_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    surplus = predicted.select("enroll_id").join(expected, "enroll_id", "left_anti").agg(F.count(F.lit(1)).alias("n_surplus"))
    own = predicted.agg((F.count(F.lit(1)) - F.countDistinct("enroll_id")).alias("n_repeated"), F.count(F.when(F.isnan("prob") | F.col("prob").isNull(), 1)).alias("n_nan"))
    all_of = missing.crossJoin(surplus).crossJoin(own)
    return all_of.withColumn("ok", (F.col("n_missing") + F.col("n_surplus") + F.col("n_repeated") + F.col("n_nan")) == 0)


METRICS = ("auc", "precision", "recall", "f1")


def model_scores(predictions: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """model, seed, threshold and the test metrics. predictions: model, seed, split, enroll_id, label, prob.

    Without a number the threshold is that of the best validation f1 of the model and seed."""
    keys = ["model", "seed"]
    test = predictions.where("split = 'test'").where(F.col("prob").isNotNull() & ~F.isnan("prob"))
    if threshold is None:
        chosen = best_threshold(predictions.where("split = 'validation'"), keys).select(*keys, "threshold")
    else:
        chosen = predictions.select(*keys).distinct().withColumn("threshold", F.lit(float(threshold)))
    cut_at = threshold_metrics(test.join(chosen, keys), [*keys, "threshold"], F.col("threshold"))
    return ranking_metrics(test, keys).join(cut_at, keys).select(*keys, "threshold", *METRICS)


def model_problems(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """model, seed and n_missing, n_surplus, n_repeated, n_nan of its test predictions. expected: seed, enroll_id."""
    test = predictions.where("split = 'test'").groupBy("model", "seed", "enroll_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob").isNull() | F.isnan("prob")).alias("nan")
    )
    wanted = predictions.select("model", "seed").distinct().join(expected.select("seed", "enroll_id").distinct(), "seed").withColumn("_w", F.lit(1))
    both = test.join(wanted, ["model", "seed", "enroll_id"], "full")
    return both.groupBy("model", "seed").agg(
        F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("_w").isNull()).alias("n_surplus"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.coalesce(F.sum("nan"), F.lit(0)).alias("n_nan"),
    )


def model_comparison(predictions: DataFrame, expected: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """model, seeds, mean and sample deviation of each test metric over the seeds, and check: ok or how many seeds are not whole."""
    of_seed = model_scores(predictions, threshold).join(model_problems(predictions, expected), ["model", "seed"])
    whole = (F.col("n_missing") + F.col("n_surplus") + F.col("n_repeated") + F.col("n_nan")) == 0
    bad = F.count_if(~whole)
    return of_seed.groupBy("model").agg(
        F.count(F.lit(1)).alias("seeds"),
        *(e for m in METRICS for e in (F.avg(m).alias(f"test_{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"test_{m}_std"))),
        F.when(bad == 0, "ok").otherwise(F.format_string("%d seeds with other test enrollments or without a probability", bad)).alias("check"),
    )
