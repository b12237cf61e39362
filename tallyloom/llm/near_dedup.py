"""Near-duplicate classes by BagMinHash signatures over word 5-gram multisets.

A text is the multiset of its runs of ``k`` words. Per element and dyadic range
of its multiplicity (0-1, 1-2, 2-4, ...) a Poisson process of points (time,
signature component, level) is generated from the element's hash, in order of
time; a point counts if its level does not exceed the multiplicity. Each
component keeps its earliest point, so two texts agree in one with probability
equal to their weighted Jaccard similarity. An element stops as soon as its time
passes the latest kept point of its text, so most give only a point or two.

``bands`` groups of ``rows`` components are hashed; texts that share a band are
candidates, and a pair is a link if the exact multiset similarity is at least
``threshold``. At 0.8, 24 bands of 4 miss a pair with probability 3e-6.

Classes are the connected components of all such links, found without listing a
group's pairs: equal texts are merged first; then each band's texts are compared
with one text of the band (``rounds`` times, with different ones), and what is
linked becomes one component. Only texts of one band that are still in different
components are then compared with each other, so that no link between them is
lost. Joins on bands and ids are plain equi-joins that Spark can split.

Defined results: texts without words are near duplicates of equal texts alone;
null counts as empty; texts of under ``k`` words have one element; every row
gets the class of its own text, rows without doc_id too; where no row of a text
or class has a doc_id, its number is above all ids; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import position
from .checkpoint import cut, release
from .text import buffers, mix, shingles, slices

#: Counts are whole; products with a threshold such as 0.8 may lie this little above one.
SLACK = 1e-6
#: Bytes of text that a task takes at a time.
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multisets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, multiplicity, first element of each text)."""
    h, text = shingles(raw, at, k)
    cut_at = np.searchsorted(text, np.arange(len(at)))
    element, count = [], []
    for a, b in zip(cut_at[:-1].tolist(), cut_at[1:].tolist()):
        e, c = np.unique(h[a:b], return_counts=True)
        element.append(e)
        count.append(c)
    ends = np.cumsum([0, *map(len, element)])
    return np.concatenate([*element, np.zeros(0, np.uint64)]), np.concatenate([*count, np.zeros(0, np.int64)]).astype(np.int64), ends


def signatures(element: np.ndarray, weight: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash signatures, texts by m times; infinite for a text without elements."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    parts = [(text, element, weight, np.zeros(len(text), np.int64), np.ones(len(text), np.int64))]
    low = 1
    while (weight > low).any():
        up = weight > low
        parts.append((text[up], mix(element[up] ^ np.uint64(low * 0xC2B2AE3D27D4EB4F % 2**64)), weight[up], np.full(up.sum(), low), np.full(up.sum(), low)))
        low *= 2
    text, seed, weight, low, width = (np.concatenate(x) for x in zip(*parts))
    out = np.full((n, m), np.inf)
    flat = out.reshape(-1)
    time = np.zeros(len(text))
    latest = np.full(n, np.inf)
    step = 0
    while len(text):
        step += 1
        seed = mix(seed + _STEP)
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
        on = time < latest[text]
        text, seed, weight, low, width, time = (x[on] for x in (text, seed, weight, low, width, time))
        draw = mix(seed ^ np.uint64(0xD6E8FEB86659FD93))
        component = ((draw >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        level = low + 1 + ((draw & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = level <= weight
        np.minimum.at(flat, text[counts] * m + component[counts], time[counts])
        live = np.unique(text)
        latest[live] = out[live].max(1)
        on = time < latest[text]
        if not on.all():
            text, seed, weight, low, width, time = (x[on] for x in (text, seed, weight, low, width, time))
    return out


def band_keys(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of the text) and bands (hashes; empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            e, w, first = multisets(*buffers(batch.column("text")), k)
            sig = signatures(e, w, first, bands * rows).view(np.uint64).reshape(-1, bands, rows)
            h = np.zeros(sig.shape[:2], np.uint64)
            for r in range(rows):
                h = mix(h * _STEP + sig[:, :, r])
            h = mix(h + np.arange(bands, dtype=np.uint64)).view(np.int64)
            size = np.where(np.diff(first) > 0, bands, 0)
            found = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(h[np.diff(first) > 0].reshape(-1))
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), found], ["doc_id", "key", "bands"])

    text = F.coalesce("text", F.lit(""))
    known = docs.select(
        F.col("doc_id").cast("bigint"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key")
    )
    return known.mapInArrow(run, "doc_id bigint, key binary, bands array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) have multiset similarity of threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta", PIECE), "tb", PIECE):
            ea, wa, fa = multisets(*buffers(batch.column("ta")), k)
            eb, wb, fb = multisets(*buffers(batch.column("tb")), k)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, u = ea[fa[i] : fa[i + 1]], wa[fa[i] : fa[i + 1]]
                y, v = eb[fb[i] : fb[i + 1]], wb[fb[i] : fb[i + 1]]
                if not len(x) or not len(y):
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                same = x[at] == y
                both = int(np.minimum(u[at[same]], v[same]).sum())
                keep[i] = both >= threshold * (int(u.sum()) + int(v.sum()) - both) - SLACK
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and class (smallest id of its component) of every id in the edges (a, b).

    Each round every node takes the name that comes first, in a new random order, within two steps of it, and the
    edges follow. A star is one name after a round and a path a fraction of its names, so rounds grow as the logarithm."""
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    out = cut(ends.select("id", F.col("id").alias("class")))
    edges = edges.select("a", "b").where("a <> b")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("o"), F.col(c).alias("to"))  # noqa: B023,E731
        near = both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).alias("n"))
        name = cut(both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("n")["to"].alias("to")))
        out = cut(out.join(name, out["class"] == name["a"], "left").select("id", F.coalesce("to", "class").alias("class")))
        x, y = name.select("a", F.col("to").alias("na")), name.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        edges = cut(both.where("a < b").join(x, "a").join(y, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    return cut(out.join(out.groupBy("class").agg(F.min("id").alias("low")), "class").select("id", F.col("low").alias("class")))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (id, class) after more links (a, b), which join whole classes."""
    name = classes.select(F.col("id").alias("_id"), "class")
    x, y = name.select(F.col("_id").alias("a"), F.col("class").alias("ca")), name.select(F.col("_id").alias("b"), F.col("class").alias("cb"))
    named = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(cut(named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    lone = joined.join(classes.select("id"), "id", "left_anti").select("id", F.col("id").alias("class"))
    new = joined.select(F.col("id").alias("class"), F.col("class").alias("to"))
    return cut(classes.unionByName(lone).join(new, "class", "left").select("id", F.coalesce("to", "class").alias("class")))


def linkable(ids: DataFrame, texts: DataFrame, k: int, threshold: float, passes: int = 2) -> DataFrame:
    """id, n (elements) and common (those that another of the texts has too) of the texts (id) that may have a link.

    An overlap is at most ``common`` and a link's at least ``threshold * n``, so the others have none among the texts.
    What only they shared with the rest no longer counts in the next pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            e, w, first = multisets(*buffers(batch.column("text")), k)
            owner = np.repeat(batch.column("id").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(e.view(np.int64)), pa.array(w)], ["id", "element", "w"])

    held = cut(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id bigint, element bigint, w bigint"))
    for _ in range(passes):
        # elements of one text alone, by the smallest and largest id: counts are combined before the shuffle
        alone = held.groupBy("element").agg(F.min("id").alias("id"), F.max("id").alias("top"), F.sum("w").alias("w")).where("id = top")
        size = held.groupBy("id").agg(F.sum("w").alias("n"))
        able = size.join(alone.groupBy("id").agg(F.sum("w").alias("own")), "id", "left")
        able = cut(able.select("id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")).where(F.col("common") >= threshold * F.col("n") - SLACK))
        held = held.join(able.select("id"), "id", "left_semi")
    return able


def plain(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.where("doc_id is null or n > 1").isEmpty()


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def text_classes(docs: DataFrame, **how) -> DataFrame:
    """key, low (smallest doc_id, or null), number and class (a number) of every text; numbers from 1 in order of low, nulls last."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))
    texts = texts.groupBy("key").agg(F.min("doc_id").alias("low"), F.first("text").alias("text")).withColumn("none", F.col("low").isNull())
    texts = cut(position(texts, [], ["none", "low", "key"]))
    classes = _classes(texts.select(F.col("pos").cast("bigint").alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("pos"), "class_id")
    return cut(texts.join(classes, "pos").select("key", "low", F.col("pos").alias("number"), F.col("class_id").alias("class")))


def first_texts(docs: DataFrame, **how) -> DataFrame:
    """key and low of the first text of each class."""
    return text_classes(docs, **how).where("number = class").select("key", "low")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_id (smallest id with that text) and class_id (smallest id of the class) of every row.

    how: as in ``_classes``. Repeated, shared and missing ids are taken by their texts, which get numbers instead."""
    if plain(docs):
        return _classes(docs, **how)
    found = text_classes(docs, **how)
    top = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("bigint")), F.lit(0)).alias("top"))
    names = cut(found.crossJoin(F.broadcast(top)).select("key", "number", "class", F.coalesce("low", F.col("top") + F.col("number")).alias("text_id")))
    of_class = names.select(F.col("number").alias("class"), F.col("text_id").alias("class_id"))
    named = names.join(of_class, "class").select("key", "text_id", "class_id")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key")).join(named, "key").select("doc_id", "text_id", "class_id")


def _classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, rounds: int = 1) -> DataFrame:
    """``near_duplicates`` of rows that each have a doc_id of their own."""
    keyed = cut(band_keys(docs, k, bands, rows))
    texts = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands")))
    banded = texts.select("id", F.explode("bands").alias("band"))
    # bands of one text alone go at once
    shared = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = cut(banded.join(shared.select("band"), "band"))
    # the texts that share a band; later joins move only these. They are written under another key, so that each join
    # shuffles both of its sides and Spark can split a partition that the pairs of one text make large
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    source = source.join(members.select("id").distinct(), "id", "left_semi")
    one = F.lit(1).cast("bigint")
    source = cut(source.select(F.col("id").bitwiseXOR(one).alias("key"), "text")).select(F.col("key").bitwiseXOR(one).alias("id"), "text")
    release(docs.sparkSession)
    tried = classes = None
    for turn in range(rounds + 1):
        if classes is None:
            rest = members.withColumn("class", F.col("id"))
        else:
            mixed = members.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
            several = mixed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
            rest = cut(mixed.join(several.select("band"), "band"))
        if turn < rounds:
            order = F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.col("id")).alias("o"), F.col("id"), F.col("class"))
            hub = rest.groupBy("band").agg(F.min(order).alias("hub")).select("band", F.col("hub.id").alias("h"), F.col("hub.class").alias("c"))
            pairs = rest.join(hub, "band").where("class <> c").select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b"))
        else:
            able = linkable(rest.select("id").distinct(), source, k, threshold)
            rest = cut(rest.join(able, "id").join(texts.select("id", "bands"), "id"))
            other = rest.select(F.col("band").alias("same"), F.col("id").alias("h"), F.col("class").alias("c"), F.col("n").alias("m"), F.col("common").alias("shared"), F.col("bands").alias("others"))
            # no overlap exceeds what either text has in common with any other
            enough = F.least("common", "shared") * (1 + threshold) >= threshold * (F.col("n") + F.col("m")) - SLACK
            first = F.element_at(F.array_intersect("bands", "others"), 1) == F.col("band")  # a pair meets in one of its bands
            pairs = rest.join(other, (F.col("band") == F.col("same")) & (F.col("class") < F.col("c")) & enough & first)
            pairs = pairs.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b"))
        pairs = pairs.distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        own = source
        if turn == rounds:  # in rounds before, nearly all texts are in a pair
            own = source.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi")
        found = cut(verify(pairs, own, k, threshold))
        classes = components(found) if classes is None else _merged(classes, found)
        release(docs.sparkSession)
    if classes is None:
        classes = texts.select("id", F.col("id").alias("class")).limit(0)
    return (
        keyed.select("doc_id", "key")
        .join(texts.select("key", F.col("id").alias("text_id")), "key")
        .join(classes.select(F.col("id").alias("text_id"), F.col("class").alias("class_id")), "text_id", "left")
        .select("doc_id", "text_id", F.coalesce("class_id", "text_id").alias("class_id"))
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
