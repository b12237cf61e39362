"""Quality with a factorisation machine over hashed words, structure statistics and metadata.

A text's features are numbered and have values: its distinct hashed words, each
with one over the root of how many of them the model knows; the structure
statistics, each spread over the nearest two of ``KNOTS`` levels; and metadata
columns, numbers by the size of their logarithm, other values hashed. The margin
is ``bias + sum w x + sum over pairs <v_i, v_j> x_i x_j``; the pairs take linear
time, as half of the squared sums less the sums of squares.

The fit sees at most ``4 * per_class`` labelled documents (see ``sample``). Word
counts by class over them choose the ``n_words`` hashed words that tell most; the
weights are learned by AdaGrad. All rows are scored over whole texts.

Defined results: null and empty texts have the structure of an empty text; null
metadata is a value of its own; without labels of both classes every score is
the share of label 1 (0 without any); documents with several labels count as
good if one says so; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sample import labelled
from .text import buffers, hashed_words, mix, slices

BITS = 22
KNOTS = 9
META = 64
RANK = 8
PIECE = 2 << 20
_BYTE = np.arange(256)
#: Byte classes whose shares are structure statistics.
CLASSES = {
    "capitals": (_BYTE >= 65) & (_BYTE <= 90),
    "symbols": np.isin(_BYTE, list(b"#$%&*@^~<>{}[]\\/=+_")),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "bars": _BYTE == ord("|"),
    "marks": np.isin(_BYTE, list(b"!?")),
    "spaces": np.isin(_BYTE, list(b" \t")),
    "line_ends": np.isin(_BYTE, list(b"\n\r")),
    "beyond_ascii": _BYTE >= 128,
}
STATISTICS = (*CLASSES, "distinct_words", "repeated_words", "word_length", "sentence_length", "line_length", "words")
_ENDS = np.isin(_BYTE, list(b".!?\n"))


def statistics(raw: np.ndarray, at: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` a text, each between 0 and 1, from its bytes and its words' hashes."""

    def count(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(marked)))[at])

    size, n = np.maximum(1, np.diff(at)), np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    _, some = np.unique(mix(words + mix(text)), return_index=True)
    again = np.append(False, (words[1:] == words[:-1]) & (text[1:] == text[:-1]))[: len(words)]
    most = np.maximum(1, n)
    columns = [np.sqrt(count(c[raw], at) / size) for c in CLASSES.values()]
    columns += [
        np.bincount(text[some], minlength=len(n)) / most,
        count(again, first) / most,
        np.diff(at) / most / 16,
        np.log1p(n / (1 + count(_ENDS[raw], at))) / 6,
        np.log1p(n / (1 + count(raw == 10, at))) / 8,
        np.log1p(n) / 12,
    ]
    return np.minimum(1, np.stack(columns, 1))


def buckets(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed word) of the distinct hashed words of each text."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    both = np.unique(text << np.uint64(BITS) | mix(words) >> np.uint64(64 - BITS))
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def meta_values(column: pa.Array) -> np.ndarray:
    """Numbers below META: 0 for null."""
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    value = lambda x: 1 + min(META - 2, int(2 * math.log2(1 + max(0, x)))) if x < math.inf else 1
    named = lambda x: 1 + zlib.crc32(str(x).encode("utf-8", "surrogatepass")) % (META - 1)
    return np.array([0 if x is None or x != x else value(x) if number else named(x) for x in column.to_pylist()], np.int64)


class Model:
    """words: sorted hashed words; metadata: columns; w and v: weights by feature."""

    def __init__(self, bias: float, words: np.ndarray, metadata: tuple[str, ...] = (), w=None, v=None):
        self.bias, self.words, self.metadata = bias, words, metadata
        self.start = len(STATISTICS) * KNOTS
        size = self.start + len(metadata) * META + len(words)
        self.w = np.zeros(size) if w is None else w
        self.v = np.zeros((size, RANK)) if v is None else v

    def features(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of a batch, ordered by text."""
        raw, at = buffers(batch.column("text"))
        words, _, first = hashed_words(raw, at)
        n = len(at) - 1
        place = statistics(raw, at, words, first) * (KNOTS - 1)
        low = np.minimum(place.astype(np.int64), KNOTS - 2)
        base = low + np.arange(len(STATISTICS)) * KNOTS
        text = [np.repeat(np.arange(n), 2 * len(STATISTICS))]
        index, value = [np.stack((base, base + 1), 2).ravel()], [np.stack((1 - place + low, place - low), 2).ravel()]
        for i, c in enumerate(self.metadata):
            text.append(np.arange(n))
            index.append(self.start + i * META + meta_values(batch.column(c)))
            value.append(np.ones(n))
        if len(self.words):
            of, bucket = buckets(words, first)
            found = np.minimum(np.searchsorted(self.words, bucket), len(self.words) - 1)
            known = self.words[found] == bucket
            of, found = of[known], found[known]
            text.append(of)
            index.append(self.start + len(self.metadata) * META + found)
            value.append(1 / np.sqrt(np.bincount(of, minlength=n)[of]))
        text = np.concatenate(text)
        order = np.argsort(text, kind="stable")
        return text[order], np.concatenate(index)[order], np.concatenate(value)[order]

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        text, index, value = self.features(batch)
        n = batch.num_rows
        total = lambda x: np.bincount(text, x, n)
        margin = self.bias + total(self.w[index] * value)
        for f in range(self.v.shape[1]):
            x = self.v[index, f] * value
            margin += 0.5 * (total(x) ** 2 - total(x * x))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def train(data: list[tuple[np.ndarray, np.ndarray, int]], weight: tuple[float, float], model: Model, epochs: int = 10, rate: float = 0.2, decay: float = 1e-4) -> None:
    """Fits bias, w and v to (features, values, label) rows by AdaGrad. weight: of an example, by label."""
    rng = np.random.default_rng(17)
    w, v, b = model.w, rng.normal(0, 0.05, model.v.shape), model.bias
    gw, gv, gb = np.full(len(w), 1e-2), np.full(len(w), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, y = data[i]
            own = v[at] * x[:, None]
            total = own.sum(0)
            m = b + w[at] @ x + 0.5 * float(total @ total - (own * own).sum())
            g = (1 / (1 + math.exp(-max(-40.0, min(40.0, m)))) - y) * weight[y]
            gb += g * g
            b -= rate * g / math.sqrt(gb)
            d = g * x + decay * w[at]
            gw[at] += d * d
            w[at] -= rate * d / np.sqrt(gw[at])
            d = g * x[:, None] * (total - own) + decay * v[at]
            gv[at] += (d * d).mean(1)
            v[at] -= 0.3 * rate * d / np.sqrt(gv[at])[:, None]
    model.bias, model.w, model.v = b, w, v


def fit(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), per_class: int = 3000, n_words: int = 2048, least: int = 5,
        significant: float = 4.0) -> Model:
    """labels: doc_id, quality (0 or 1). per_class: bounds the labelled sample; significant: standard errors between a word's
    shares in both classes."""
    rows, counts, share = labelled(docs.select("doc_id", "text", *metadata), labels, "quality", per_class, 29)
    if len(counts) < 2:
        return Model(-40.0 if 1 not in counts else 40.0, np.zeros(0, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            words, _, first = hashed_words(*buffers(batch.column("text")))
            of, bucket = buckets(words, first)
            both, n = np.unique(bucket * 2 + np.array(batch.column("label").to_pylist())[of], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(both & 1), pa.array(n)], ["word", "label", "n"])

    size = {y: max(1.0, counts[y] * share[y]) for y in counts}
    of = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    found = rows.select("text", "label").mapInArrow(count, "word bigint, label bigint, n bigint").groupBy("word").agg(of(0).alias("n0"), of(1).alias("n1"))
    mean = (F.col("n0") + F.col("n1") + 1.0) / (size[0] + size[1] + 2.0)
    tells = F.abs(F.col("n1") / size[1] - F.col("n0") / size[0]) / F.sqrt(mean * F.abs(1.0 - mean) * (1.0 / size[0] + 1.0 / size[1]) + 1e-12)
    found = found.where((F.col("n0") + F.col("n1") >= least) & (tells >= significant))
    top = [r[0] for r in found.orderBy(tells.desc(), "word").limit(n_words).select("word").collect()]
    model = Model(0.0, np.array(sorted(top), np.int64), metadata)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            text, index, value = sent.value.features(batch)
            cut = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (index, value)]
            yield pa.RecordBatch.from_arrays([*lists, batch.column("label")], ["f", "x", "label"])

    sample = sorted(map(tuple, rows.mapInArrow(known, "f array<bigint>, x array<double>, label int").collect()))
    scale = (counts[0] + counts[1]) / (size[0] + size[1])
    train([(np.array(f), np.array(x), y) for f, x, y in sample], tuple(counts[y] / size[y] / scale for y in (0, 1)), model)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row, from its text and the model's metadata columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            p = sent.value.score(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", *model.metadata).mapInArrow(run, "doc_id bigint, score double, predicted int")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: labels of rows that are not held out, all ``documents`` scored; the metadata is n_chars."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return score(docs, fit(docs, labels, ("n_chars",))).select("doc_id", held_out.alias("held_out"), "score", "predicted")
