"""Language identification in two steps: the family first, then the language in it.

Both steps use one-versus-one linear support vector machines over hashed byte
2- and 3-grams of the lower-cased words. A machine's margin is a sum of one
weight per n-gram over the number of n-grams, so a batch of texts is scored with
table lookups and running sums; the model is a fixed-size table per machine.

The fit uses a sample of about ``per_language`` labelled rows a language (a
documented bound; at most twice that). Everything else covers all rows.

Defined results: ``und`` with score 0 if the text is null or has no letter;
rows with null language are not learned from; with no labelled row at all every
text is ``und``; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WORD_TABLE, buffers, slices

#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "gu", "pa"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
}
BITS = 16
ORDERS = (2, 3)


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _codes(low: np.ndarray, order: int) -> np.ndarray:
    """The hashed n-gram that begins at each byte."""
    out = low[: max(0, len(low) - order + 1)].astype(np.uint32) + np.uint32(order * 977)
    for j in range(1, order):
        out = out * np.uint32(0x9E3779B1) + low[j : len(low) - order + 1 + j]
    return (out * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _bounds(at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return at[:-1], np.maximum(at[:-1], at[1:] - order + 1)


def grams(docs: DataFrame, label: str) -> DataFrame:
    """label, n-gram numbers and their shares, as packed arrays: a bounded sample's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, at = buffers(batch.column("text"))
            low = np.frombuffer(raw.tobytes().translate(WORD_TABLE), np.uint8)
            codes = [_codes(low, k) for k in ORDERS]
            index, value = [], []
            for i in range(batch.num_rows):
                own = np.concatenate([c[slice(*(int(b[i]) for b in _bounds(at, k)))] for c, k in zip(codes, ORDERS)])
                number, count = np.unique(own, return_counts=True)
                index.append(number.astype("<u4").tobytes())
                value.append((count / max(1, len(own))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(label), pa.array(index, pa.binary()), pa.array(value, pa.binary())], [label, "index", "value"]
            )

    return docs.select(label, "text").mapInArrow(run, f"{label} string, index binary, value binary")


def svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 10.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine, by dual coordinate descent."""
    w, b = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = sign[i] * (w[at] @ v + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


class Model:
    """groups: for each decision its classes and machines (first class, second class, weights, bias)."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], scale: float = 30.0):
        self.scale = scale
        self.languages = sorted({r[0] for r in rows})
        self.families = sorted({family(x) for x in self.languages})
        data = [(at.astype(np.int64), v.astype(np.float64) * scale) for _, at, v in rows]
        lang = np.array([r[0] for r in rows])
        fam = np.array([family(x) for x in lang])
        self.groups = {"": self._fit(data, fam, self.families)}
        for f in self.families:
            self.groups[f] = self._fit(data, lang, [x for x in self.languages if family(x) == f])

    def _fit(self, data, label, classes):
        out = []
        for a, b in combinations(range(len(classes)), 2):
            use = np.flatnonzero((label == classes[a]) | (label == classes[b]))
            w, bias = svm([data[i] for i in use], np.where(label[use] == classes[a], 1.0, -1.0))
            out.append((a, b, (w * self.scale).astype(np.float32), bias))
        return classes, out

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.frombuffer(raw.tobytes().translate(WORD_TABLE), np.uint8)
        codes = [_codes(low, k) for k in ORDERS]
        bounds = [_bounds(at, k) for k in ORDERS]
        n = np.maximum(1, sum(e - s for s, e in bounds))
        docs = len(at) - 1

        def decide(classes, machines) -> tuple[np.ndarray, np.ndarray]:
            votes = np.zeros((docs, len(classes)))
            sure = np.full((docs, len(classes)), np.inf)
            for a, b, w, bias in machines:
                margin = np.full(docs, bias)
                for code, (s, e) in zip(codes, bounds):
                    run = np.concatenate(([0.0], np.cumsum(w[code], dtype=np.float64)))
                    margin += (run[np.minimum(e, len(code))] - run[np.minimum(s, len(code))]) / n
                votes[:, a] += (margin > 0) + 0.001 * np.tanh(margin)
                votes[:, b] += (margin <= 0) - 0.001 * np.tanh(margin)
                sure[:, a] = np.minimum(sure[:, a], margin)
                sure[:, b] = np.minimum(sure[:, b], -margin)
            best = votes.argmax(1)
            return best, 1 / (1 + np.exp(-np.clip(3 * sure[np.arange(docs), best], -50, 50)))

        fam, score = decide(*self.groups[""])
        lang = np.empty(docs, object)
        for i, f in enumerate(self.families):
            here = fam == i
            if here.any():
                classes, machines = self.groups[f]
                best, sure = decide(classes, machines)
                lang[here] = np.array(classes, object)[best[here]]
                score[here] *= sure[here]
        return lang, score


def fit(docs: DataFrame, per_language: int = 500) -> Model | None:
    """A model from rows with text and lang. per_language: the sample's bound; twice as many are taken at most."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, min(1.0, per_language / v))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < share[F.col("lang")])
    most = 2 * per_language * len(counts)
    rows = grams(sample, "lang").limit(most).collect()
    rows = [(r[0], np.frombuffer(r[1], "<u4"), np.frombuffer(r[2], "<f4")) for r in rows]
    return Model(sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", 4 << 20):
            raw, at = buffers(batch.column("text"))
            lang, score = m.predict(raw, at) if m else (np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows))
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            lang, score = np.where(letter, lang, "und"), np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col("doc_id").cast("bigint"), "text", letter).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: fitted on rows that are not held out, applied to whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.drop("lang"), fit(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
