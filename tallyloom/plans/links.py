"""Queries over links: customers and the parts they ordered, as learners and courses of a link predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import cut
from ..operators import sampling
from ..sources.tables import read_table
from .catalog import query

_LINKS = "l AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def links(spark, sf):
    o, li = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query(f"""WITH {_LINKS},
a AS (SELECT src, dst FROM l QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5('1|1|' || src || '|' || dst), dst) <= 3),
b AS (SELECT dst, src FROM l QUALIFY row_number() OVER (PARTITION BY dst ORDER BY md5('1|2|' || dst || '|' || src), src) <= 90),
h AS (SELECT src AS root, 1 AS hop, src AS parent, dst AS node FROM a UNION ALL SELECT a.src, 2, a.dst, b.src FROM a JOIN b USING (dst))
SELECT root, hop, count(*) AS n, CAST(sum(node) AS BIGINT) AS nodes, CAST(sum(parent * (node % 1009)) AS BIGINT) AS mixed FROM h GROUP BY root, hop""")
def neighbour_sample(spark, sf):
    """Neighbourhoods of all customers, three parts wide and then ninety customers, summed by root and hop."""
    found = sampling.neighbourhoods(cut(links(spark, sf)))
    mixed = F.sum(F.col("parent") * (F.col("node") % 1009))
    return found.groupBy("root", "hop").agg(F.count(F.lit(1)).alias("n"), F.sum("node").alias("nodes"), mixed.alias("mixed"))


@query(f"""WITH {_LINKS}, n AS (SELECT max(p_partkey) AS n FROM part),
d AS (SELECT src, dst, draw, CAST('0x' || substr(md5('1|' || src || '|' || dst || '|' || draw), 1, 8) AS BIGINT) % n + 1 AS negative FROM l, n, range(1, 17) AS r(draw)),
f AS (SELECT src, dst, negative, min(draw) AS draw FROM d GROUP BY ALL),
k AS (SELECT f.*, row_number() OVER (PARTITION BY f.src, f.dst ORDER BY f.draw) AS nth FROM f ANTI JOIN l ON l.src = f.src AND l.dst = f.negative)
SELECT src, dst, nth, negative FROM k WHERE nth <= 3""")
def negative_links(spark, sf):
    """Three parts that the customer never ordered for each ordered one."""
    n = read_table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] or 0
    return sampling.negatives(cut(links(spark, sf)), max(1, n)).select("src", "dst", F.col("nth").cast("bigint").alias("nth"), "negative")
