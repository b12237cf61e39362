"""Neighbour sampling and negative draws on a link table, by hash order: the same sample whenever and wherever it is drawn.

A node keeps the first of its links by the hash of seed, hop and both ends. Spark cuts each task's rows to that many a node
before they are shuffled, so a node with a third of all links costs a few rows a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import cut


def _hash(*parts: Column | int | str) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"))


def fan_out(links: DataFrame, source: str, target: str, most: int, seed: int, hop: int) -> DataFrame:
    """node, neighbour: of each source the first ``most`` different targets by hash."""
    pairs = links.select(F.col(source).alias("node"), F.col(target).alias("neighbour")).where("node IS NOT NULL AND neighbour IS NOT NULL").distinct()
    order = Window.partitionBy("node").orderBy(_hash(seed, hop, F.col("node"), F.col("neighbour")), "neighbour")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("node", "neighbour")


def neighbourhoods(links: DataFrame, fans: tuple[int, ...] = (3, 90), seed: int = 1) -> DataFrame:
    """root, hop, parent, node of the sampled neighbourhoods of all sources of links (src, dst).

    Hops alternate from sources to targets and back; a node that is reached twice stands there twice, as each parent's."""
    out = last = None
    for hop, most in enumerate(fans, 1):
        ends = ("src", "dst") if hop % 2 else ("dst", "src")
        near = fan_out(links, *ends, most, seed, hop)
        if last is None:
            found = near.select(F.col("node").alias("root"), F.col("node").alias("parent"), F.col("neighbour").alias("node"))
        else:
            here = last.select("root", F.col("node").alias("parent"))
            found = here.join(near.withColumnRenamed("node", "parent"), "parent").select("root", "parent", F.col("neighbour").alias("node"))
        last = found
        found = found.select("root", F.lit(hop).alias("hop"), "parent", "node")
        out = found if out is None else out.unionByName(found)
    return out


def _drawn(n: int, seed: int, draw: Column) -> Column:
    """The target, of 1 to n, of a draw for a link (src, dst)."""
    return F.conv(F.substring(_hash(seed, F.col("src"), F.col("dst"), draw), 1, 8), 16, 10).cast("bigint") % n + 1


def negatives(links: DataFrame, n: int, each: int = 3, seed: int = 1, draws: int = 16) -> DataFrame:
    """src, dst, nth, negative: for each link the first ``each`` different targets, of 1 to n, that its source has no link with.

    Targets are drawn by hash and rejected by a join with the links; of ``draws`` draws a source that is linked with nearly
    all targets may get fewer. Where the first ``each`` draws differ and none is a link, they are the result; only for the
    other links, few unless sources are linked with many targets, all ``draws`` are made and shuffled."""
    known = cut(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    linked = known.select("src", F.col("dst").alias("negative"))
    few = [_drawn(n, seed, F.lit(k)) for k in range(1, min(each, draws) + 1)]
    tried = known.select("src", "dst", F.posexplode(F.array(*few)).alias("at", "negative"))
    hit = tried.join(linked, ["src", "negative"], "left_semi").select("src", "dst")
    repeated = known.where(F.size(F.array_distinct(F.array(*few))) < len(few))
    rest = cut(hit.unionByName(repeated).distinct())
    good = known.join(rest, ["src", "dst"], "left_anti")
    whole = good.select("src", "dst", F.posexplode(F.array(*few)).alias("at", "negative"))
    whole = whole.select("src", "dst", (F.col("at") + 1).alias("nth"), "negative")
    drawn = rest.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("negative", _drawn(n, seed, F.col("draw")))
    first = drawn.groupBy("src", "dst", "negative").agg(F.min("draw").alias("draw"))
    free = first.join(linked, ["src", "negative"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("draw"))
    more = free.withColumn("nth", nth).where(F.col("nth") <= each).select("src", "dst", "nth", "negative")
    return whole.unionByName(more)
