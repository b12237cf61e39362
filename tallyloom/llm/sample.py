"""A bounded labelled sample of documents, for the fits of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, seed: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(rows with the columns of docs and label, labelled documents by class, sampled share by class).

    Of each class about ``per_class`` documents are drawn by a hash of their id, of both at most ``4 * per_class``; a
    document with several labels has label 1 if one says so. One row stands for each drawn id, whatever rows share it: that
    with the smallest hash of its text. So there are never more rows than ids, and the ids can be broadcast."""
    known = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(column).cast("int").alias("label"))
    )
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.where(draw < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    drawn = drawn.orderBy(draw, "doc_id").limit(4 * per_class)
    own = [c for c in docs.columns if c != "doc_id"]
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(*own).alias("row")).join(F.broadcast(drawn), "doc_id")
    first = found.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.first("label").alias("label"))
    return first.select("row.*", "label"), counts, share
