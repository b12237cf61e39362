"""Interaction of text filters, over every order in which they can be applied.

Rows are routed by a 64-bit hash of their text. Each task first settles what its
own rows decide: of rows with one text, all but those with its smallest doc_id
repeat a smaller id. Only those that are left move, once a task and text, to the
text's partition, where they stand sorted by hash. There, a chain holds the full
texts of a hash and each one's smallest doc_id; rows above it repeat it too. So
a text that a third of all rows hold moves once a task, and no task holds more
than one hash's texts. A row's failures are a mask of five bits; masks are
counted as vectors by part, combined before they are shuffled, and all 120
orders follow from a part's 32 counts.

Filters: A: under 100 words; B: under 80 distinct words of 100; C: over 10
capitals A-Z of 100 code points; D: one of ``#$%&*|``; E: a smaller doc_id has
the same text. Words are maximal runs without the bytes 09-0D and 20.

Defined results: null text is empty, null lang the empty string; a row without
doc_id never fails E, nor does another because of it; rows that share doc_id and
text do not fail E by each other; repeated rows count as often as they stand
there; a document with several labels has those that one of them says; an empty
table has no parts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Fixed value: the characters of filter D.
SPECIAL = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
#: Bytes of different texts that a task holds before it sends them on.
HELD = 32 << 20
#: Bytes of text for each partition of the routed rows.
ROUTED = 16 << 20
REPEATED = 1 << FILTERS.index("E")


def failures(text: str) -> int:
    """The mask of filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    fails = (
        n < 100,
        100 * len(set(words)) < 80 * n,
        100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * len(text),
        len(raw.translate(None, SPECIAL)) < len(raw),
    )
    return sum(1 << i for i, x in enumerate(fails) if x)


def settle(rows: Iterator, most: int = HELD) -> Iterator:
    """(hash, entry) of one task's rows (doc_id, text, part, hash).

    An entry (None, doc_id, mask, {part: rows}) is settled; (text, doc_id, mask, {part: rows}) is the smallest doc_id of a text here.
    Rows without doc_id are settled, and counted by mask."""
    held, size, without = {}, 0, {}
    for doc_id, text, part, h in rows:
        chain = held.setdefault(h, [])
        own = next((x for x in chain if x[0] == text), None)
        if doc_id is None:
            counts = without.setdefault(own[2] if own else failures(text), {})
            counts[part] = counts.get(part, 0) + 1
        elif own is None:
            chain.append([text, doc_id, failures(text), {part: 1}])
            size += len(text) + 200
        elif doc_id == own[1]:
            own[3][part] = own[3].get(part, 0) + 1
        else:
            i, found = own[1], own[3]
            if doc_id < i:
                own[1], own[3] = doc_id, {part: 1}
            else:
                i, found = doc_id, {part: 1}
            yield i * 0x9E3779B1, (None, i, own[2] | REPEATED, found)
        if size > most:
            yield from ((k, tuple(x)) for k, chain in held.items() for x in chain)
            held, size = {}, 0
    yield from ((k, tuple(x)) for k, chain in held.items() for x in chain)
    yield from ((mask, (None, None, mask, found)) for mask, found in without.items())


def resolve(rows: Iterator) -> Iterator:
    """(doc_id, part, mask, rows) from a partition's entries in the order of their hashes."""
    for _, entries in groupby(rows, key=lambda x: x[0]):
        chain: list[list] = []  # text, smallest doc_id, mask, entries without their text
        for _, (text, doc_id, mask, parts) in entries:
            if text is None:
                yield from ((doc_id, part, mask, times) for part, times in parts.items())
                continue
            own = next((x for x in chain if x[0] == text), None)
            if own is None:
                chain.append(own := [text, doc_id, mask, []])
            own[1] = min(own[1], doc_id)
            own[3].append((doc_id, parts))
        for _, least, mask, found in chain:
            for doc_id, parts in found:
                for part, times in parts.items():
                    yield doc_id, part, mask | (REPEATED if doc_id > least else 0), times


def masks(docs: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """doc_id, part, mask and n (rows): the filters that each row fails. fingerprint: of the text; its xxhash unless given."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint"), text, F.coalesce("lang", F.lit("")).alias("part"))
    rows = rows.withColumn("fingerprint", F.xxhash64("text") if fingerprint is None else fingerprint).rdd
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(rows.context.defaultParallelism, size // ROUTED)
    routed = rows.mapPartitions(settle).repartitionAndSortWithinPartitions(parts, partitionFunc=lambda h: h ^ h >> 32)
    out = routed.mapPartitions(resolve)
    return docs.sparkSession.createDataFrame(out, "doc_id bigint, part string, mask int, n bigint", verifySchema=False)


def counts(found: DataFrame, labels: DataFrame) -> RDD:
    """part and its counts by mask: rows, of label quality, of label toxic."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = known.agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic"))).where("quality = 1 or toxic = 1")
    rows = found.join(known, "doc_id", "left")
    rows = rows.select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))

    def add(vector: np.ndarray, row) -> np.ndarray:
        vector[row[0]] += row[1]
        return vector

    start = lambda row: add(np.zeros((1 << len(FILTERS), 3), np.int64), row)
    keyed = rows.rdd.map(lambda r: (r.part, (r.mask, np.array([r.n, r.n * r.quality, r.n * r.toxic], np.int64))))
    return keyed.combineByKey(start, add, lambda a, b: a + b)


REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint,"
    " good_lost bigint, toxic_lost bigint, shapley bigint"
)


def orders(part: str, vector: np.ndarray) -> list[tuple]:
    """The report's rows of one part."""
    mask = np.arange(len(vector))
    fails = [mask >> i & 1 > 0 for i in range(len(FILTERS))]
    out, shapley = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        left = np.ones(len(vector), bool)
        for step, f in enumerate(order, 1):
            here = vector[left & fails[f]].sum(0)
            redundant = vector[~left & fails[f], 0].sum()
            left &= ~fails[f]
            shapley[f] += int(here[0])
            out.append(("".join(FILTERS[x] for x in order), step, f, int(vector[left, 0].sum()), *map(int, (here[0], redundant, vector[1 << f, 0], here[1], here[2]))))
    return [(part, name, step, kept, removed, redundant, unique, good, toxic, shapley[f]) for name, step, f, kept, removed, redundant, unique, good, toxic in out]


def audit(docs: DataFrame, labels: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """A row for each part, order of the filters and step."""
    found = counts(masks(docs, fingerprint), labels).flatMap(lambda x: orders(*x))
    return docs.sparkSession.createDataFrame(found, REPORT, verifySchema=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of whole ``documents``, by language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
m AS (SELECT doc_id, part, {'A': len(w) < 100, 'B': 100 * list_unique(w) < 80 * len(w),
        'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f FROM w),
g AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, bad,
        list_transform(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails
      FROM g, s),
q AS (SELECT *, fails[ascii(letter) - 64] AS here,
        list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < step AND fails[ascii(filter_order[i]) - 64] THEN 1 ELSE 0 END)) AS before,
        list_sum(list_transform(fails, lambda b: CAST(b AS INT))) AS total FROM r),
a AS (SELECT part, filter_order, step, letter,
        CAST(sum(n) FILTER (before = 0 AND NOT here) AS BIGINT) AS kept, CAST(sum(n) FILTER (before = 0 AND here) AS BIGINT) AS removed,
        CAST(sum(n) FILTER (before > 0 AND here) AS BIGINT) AS redundant, CAST(sum(n) FILTER (here AND total = 1) AS BIGINT) AS unique_fails,
        CAST(sum(good) FILTER (before = 0 AND here) AS BIGINT) AS good_lost, CAST(sum(bad) FILTER (before = 0 AND here) AS BIGINT) AS toxic_lost
      FROM q GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
  coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM a
"""
