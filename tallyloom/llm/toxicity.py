"""Toxicity with a factorization machine over hashed terms.

Terms are a text's distinct words and their leading 5, 6 and 7 bytes, hashed,
and that a lead stands in at least 2 or 4 distinct words of the text.
The score is logistic of ``bias + sum w + sum over pairs <v_i, v_j>``; the pair
part is computed in linear time and raises texts in which, say, an insult and a
mention of a group come together beyond what each word adds.

The fit sees about ``per_class`` labelled documents a class and ``4 * per_class``
at most (the documented bound of the sample, drawn by a hash of the id, a row an
id; weights undo the drawing). Term counts
by class over that sample choose the ``n_terms`` hashed terms that tell most.
All rows are scored over whole texts.

Defined results: null and empty texts get the bias alone; without labels of both
classes every score is the share of toxic rows (0 without any); documents with
several labels count as toxic if one says so; repeated rows each get a row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import held_out
from .sample import labelled
from .text import buffers, slices, WORD_TABLE

BITS = 22
LEVELS = (1, 2, 4)
MEMO = 100_000
#: Bytes of text that a task takes at a time.
PIECE = 2 << 20


def terms_of(word: bytes) -> list[int]:
    """Hashed terms of one word."""
    mask = (1 << BITS) - 1
    out = [zlib.crc32(word) & mask]
    for n in (5, 6, 7):
        if len(word) >= n:
            out.append(zlib.crc32(word[:n], n) & mask)
    return out


def levelled(found: set[bytes]) -> list[int]:
    """The terms of a text, each with every level that its number of distinct words reaches."""
    count = Counter(t for w in found for t in terms_of(w))
    return [t * len(LEVELS) + i for t, n in count.items() for i, least in enumerate(LEVELS) if n >= least]


def _word_sets(batch: pa.RecordBatch) -> Iterator[set[bytes]]:
    """The distinct words of each text, one text after the other."""
    raw, at = buffers(batch.column("text"))
    low = raw.tobytes().translate(WORD_TABLE)
    return (set(low[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))


def term_counts(rows: DataFrame) -> DataFrame:
    """term, documents with it by class, from rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            count = Counter(), Counter()
            for toxic, found in zip(batch.column("toxic").to_pylist(), _word_sets(batch)):
                count[toxic].update(levelled(found))
            keys = sorted(count[0].keys() | count[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), *(pa.array([c[k] for k in keys], pa.int64()) for c in count)], ["term", "n0", "n1"]
            )

    return rows.mapInArrow(run, "term int, n0 bigint, n1 bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Model:
    """terms: levelled term to feature number."""

    def __init__(self, bias: float, terms: dict[int, int], w: np.ndarray, v: np.ndarray):
        self.bias, self.terms, self.w, self.v = bias, terms, w, v
        self.plain = {t // len(LEVELS) for t in terms}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def features(self, found: set[bytes]) -> list[int]:
        memo, count = self.memo, {}
        if len(memo) > MEMO:
            memo.clear()
        for word in found:
            own = memo.get(word)
            if own is None:
                own = memo[word] = tuple(t for t in terms_of(word) if t in self.plain)
            for t in own:
                count[t] = count.get(t, 0) + 1
        keys = (t * len(LEVELS) + i for t, n in count.items() for i, least in enumerate(LEVELS) if n >= least)
        return sorted(self.terms[k] for k in keys if k in self.terms)

    def score(self, features: list[list[int]]) -> np.ndarray:
        """Probabilities of a batch of texts, given as their features."""
        size = np.array([len(x) for x in features], np.int64)
        flat = np.fromiter(chain.from_iterable(features), np.int64, int(size.sum()))
        ends = np.cumsum(size)
        run = lambda x: np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)))
        part = lambda x: (r := run(x))[ends] - r[ends - size]
        v = self.v[flat]
        margin = self.bias + part(self.w[flat]) + 0.5 * (part(v) ** 2 - part(v * v)).sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def train(rows: list[tuple[list[int], int]], weight: tuple[float, float], n: int, rank: int = 4, epochs: int = 15,
          rate: float = 0.15, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad on the logistic loss."""
    rng = np.random.default_rng(3)
    w, v, b = np.zeros(n), rng.normal(0, 0.01, (n, rank)), 0.0
    gw, gv, gb = np.full(n, 1e-2), np.full((n, rank), 1e-2), 1e-2
    data = [(np.array(f, np.int64), y) for f, y in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, y = data[i]
            own = v[at]
            total = own.sum(0)
            m = b + w[at].sum() + 0.5 * float((total * total).sum() - (own * own).sum())
            g = (1 / (1 + math.exp(-max(-40.0, min(40.0, m)))) - y) * weight[y]
            gb += g * g
            b -= rate * g / math.sqrt(gb)
            if len(at):
                d = g + decay * w[at]
                gw[at] += d * d
                w[at] -= rate * d / np.sqrt(gw[at])
                d = g * (total - own) + decay * own
                gv[at] += d * d
                v[at] = own - 0.3 * rate * d / np.sqrt(gv[at])
    return b, w, v


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, n_terms: int = 2048, least: int = 3,
        significant: float = 3.5) -> Model:
    """labels: doc_id, toxic (0 or 1). per_class: the bound of the labelled sample.

    significant: standard errors by which a term's shares in both classes must differ."""
    rows, counts, share = labelled(docs.select("doc_id", "text"), labels, "toxic", per_class, 5)
    rows = rows.withColumnRenamed("label", "toxic")
    if len(counts) < 2:
        return Model(-40.0 if 1 not in counts else 40.0, {}, np.zeros(0), np.zeros((0, 1)))
    size = {y: max(1.0, counts[y] * share[y]) for y in counts}
    p0, p1 = F.col("n0") / size[0], F.col("n1") / size[1]
    share_all = (F.col("n0") + F.col("n1") + 1.0) / (size[0] + size[1] + 2.0)
    tells = F.abs(p1 - p0) / F.sqrt(share_all * (1.0 - share_all) * (1.0 / size[0] + 1.0 / size[1]))
    found = term_counts(rows).where((F.col("n0") + F.col("n1") >= least) & (tells >= significant))
    top = found.orderBy(tells.desc(), "term").limit(n_terms).collect()
    terms = {r[0]: i for i, r in enumerate(top)}
    model = Model(0.0, terms, np.zeros(len(terms)), np.zeros((len(terms), 1)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            found = [sent.value.features(x) for x in _word_sets(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], ["f", "toxic"])

    sample = sorted((tuple(r[0]), r[1]) for r in rows.mapInArrow(run, "f array<int>, toxic int").collect())
    scale = (counts[0] + counts[1]) / (size[0] + size[1])
    weight = tuple(counts[y] / size[y] / scale for y in (0, 1))
    model.bias, model.w, model.v = train([(list(f), y) for f, y in sample], weight, len(terms))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", PIECE):
            p = m.score([m.features(x) for x in _word_sets(batch)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold: one scan, without join or shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", PIECE):
            yield batch.filter(pa.array(m.score([m.features(x) for x in _word_sets(batch)]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: labels of rows that are not held out, all ``documents`` scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
