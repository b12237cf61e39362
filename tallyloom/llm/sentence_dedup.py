"""Substring deduplication over sliding sentence spans.

A sentence ends after a run of ``.``, ``!``, ``?`` and line breaks; sentences
partition the text. From each sentence the span is the shortest run of at least
``sentences`` sentences that has at least ``least_words`` words; a text too
short for any is one span, if it has a word. Spans are hashed by their words
(see ``text``), counted over the whole corpus, and every sentence covered by an
occurrence that is not the first, by doc_id and place, is removed.

Only hashes and places are shuffled: first as counts, combined before the
shuffle, then in a join that can split a hot span.

With ``reach`` sentences are parted further, after words whose hash with the
next word's is the smallest within ``reach`` words (runs of one word: after each
4 * ``reach`` words), so that a passage has the
same parts wherever it stands, except near its ends, whether or not it holds
whole sentences. All of the above then goes by parts.

Defined results: null and empty texts have no sentences; spans may overlap
themselves (of a word repeated as many sentences the first stays); rows that
share doc_id and text count as the same place, other texts of a doc_id as places of
their own, in the order of a hash of the text; rows without doc_id are kept as they
are; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .checkpoint import cut
from .text import buffers, hashed_words, mix, slices

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
#: Of ``op3_passage_dedup``: words of a span, and within how many a part ends where its hash is the smallest.
PASSAGE_WORDS, PASSAGE_REACH = 16, 4
SPAN = "hash bigint, doc_id bigint, text_key int, start int, stop int"


def sentence_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where sentences begin, in bytes of the whole buffer; each text begins one, if it is not empty."""
    end = _END[raw]
    first = np.zeros(len(raw), bool)
    first[1:] = end[:-1] & ~end[1:]
    first[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(first)


def part_starts(raw: np.ndarray, at: np.ndarray, reach: int | None) -> np.ndarray:
    """``sentence_starts``, and with ``reach`` the places inside long sentences where they are parted."""
    begin = sentence_starts(raw, at)
    if reach is None:
        return begin
    w, ws, _ = hashed_words(raw, at)
    if not len(ws):
        return begin
    w = mix(w)
    first = np.searchsorted(ws, begin)  # of each sentence; the word before ends one
    r = np.zeros(len(w) + 2 * reach, np.uint64)
    r[reach : reach + len(w) - 1] = mix(w[:-1] + mix(w[1:])) | np.uint64(1)
    r[reach + first[first > 0] - 1] = 0
    least = r[reach : reach + len(w)] > 0
    for d in range(1, reach + 1):
        least &= (r[reach : reach + len(w)] < r[reach - d : reach - d + len(w)]) & (r[reach : reach + len(w)] < r[reach + d : reach + d + len(w)])
    # a run of one word has no smallest: it is parted by count
    i = np.arange(len(w))
    fresh = np.append(True, w[1:] != w[:-1])
    fresh[first[first < len(w)]] = True
    nth = i - np.maximum.accumulate(np.where(fresh, i, 0))
    return np.unique(np.concatenate((begin, ws[np.flatnonzero(least) + 1], ws[(nth > 0) & (nth % (4 * reach) == 0)])))


def spans_of(raw: np.ndarray, at: np.ndarray, sentences: int, least_words: int, reach: int | None = None):
    """(hash, text, start, stop) of all spans, in sentences of their text."""
    begin = part_starts(raw, at, reach)
    w, ws, _ = hashed_words(raw, at)
    w = mix(w)
    first_word = np.append(np.searchsorted(ws, begin), len(ws))  # of each sentence
    of_text = np.searchsorted(begin, at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(of_text))
    s = np.arange(len(begin))
    last = of_text[1:][text]  # the end of its text, in sentences
    stop = np.maximum(s + sentences, np.searchsorted(first_word, first_word[:-1] + least_words, "left"))
    whole = (s == of_text[:-1][text]) & (stop > last)
    keep = (stop <= last) | (whole & (first_word[last] > first_word[:-1]))
    s, text, stop = s[keep], text[keep], np.minimum(stop, last)[keep]
    # a polynomial over the words' hashes: any run's hash from two running sums
    up = np.full(len(w) + 1, np.uint64(0x9E3779B97F4A7C15))
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    run = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[:-1], out=run[1:])
    down = np.full(len(w) + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64)))
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    a, b = first_word[s], first_word[stop]
    h = mix((run[b] - run[a]) * down[a] ^ mix((b - a).astype(np.uint64)))
    base = of_text[:-1][text]
    return h.view(np.int64), text, (s - base).astype(np.int32), (stop - base).astype(np.int32)


def text_key() -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 32).cast("int")


def spans(docs: DataFrame, sentences: int = 3, least_words: int = 8, reach: int | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            h, text, start, stop = spans_of(*buffers(batch.column("text")), sentences, least_words, reach)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(ids[text]), batch.column("text_key").take(pa.array(text)), pa.array(start), pa.array(stop)],
                ["hash", "doc_id", "text_key", "start", "stop"],
            )

    known = docs.select(F.col("doc_id").cast("bigint"), "text", text_key().alias("text_key")).where(F.col("doc_id").isNotNull())
    return known.mapInArrow(run, SPAN)


def repeated(docs: DataFrame, sentences: int = 3, least_words: int = 8, reach: int | None = None) -> DataFrame:
    """doc_id, text_key and runs: the sentence ranges of that text's spans that stand at an earlier place too."""
    found = spans(docs, sentences, least_words, reach)
    first = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "start")).alias("first")).where("n > 1")
    # the repeated hashes are written under another key, so that both sides of the join are shuffled for it and Spark
    # can split a partition that a hot hash makes large
    one = F.lit(1).cast("bigint")
    first = cut(first.select(F.col("hash").bitwiseXOR(one).alias("key"), "first")).select(F.col("key").bitwiseXOR(one).alias("hash"), "first")
    again = found.join(first, "hash").where(F.struct("doc_id", "text_key", "start") > F.col("first"))
    return again.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))


def deduplicate(docs: DataFrame, sentences: int = 3, least_words: int = 8, reach: int | None = None) -> DataFrame:
    """The documents with text cut, and n_sentences and n_removed."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_sentences", "n_removed")]
    free = lambda name: name if name not in docs.columns else free(f"_{name}")
    own, key, runs = free("own_id"), free("own_key"), free("runs")
    found = repeated(docs, sentences, least_words, reach).toDF(own, key, runs)
    same = (F.col("doc_id").cast("bigint") == F.col(own)) & (text_key() == F.col(key))
    both = docs.select(*(f"`{f.name}`" for f in kept)).join(found, same, "left").drop(own, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            raw, at = buffers(batch.column("text"))
            begin = part_starts(raw, at, reach)
            of_text = np.searchsorted(begin, at)
            texts = batch.column("text").to_pylist()
            n, gone = np.diff(of_text), []
            for i, ranges in enumerate(batch.column(runs).to_pylist()):
                drop = np.zeros(n[i] + 1, np.int32)
                for r in ranges or ():
                    drop[r["start"]] += 1
                    drop[r["stop"]] -= 1
                out = np.flatnonzero(np.cumsum(drop)[:-1] > 0)
                gone.append(len(out))
                if len(out):
                    edge = np.append(begin[of_text[i] : of_text[i + 1]], at[i + 1])
                    keep = np.ones(at[i + 1] - at[i], bool)
                    for k in out:
                        keep[edge[k] - at[i] : edge[k + 1] - at[i]] = False
                    texts[i] = raw[at[i] : at[i + 1]][keep].tobytes().decode("utf-8")
            new = {"text": pa.array(texts, pa.string()), "n_sentences": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    schema = StructType([*kept, StructField("n_sentences", LongType()), StructField("n_removed", LongType())])
    names = schema.names
    return both.mapInArrow(run, schema)


def op3_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ``deduplicate`` over whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicate(docs)
    return out.select(
        "doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op3_sentence_dedup``, by parts of sentences: passages of over 50 words go whatever sentences they hold.

    The SQL of ``op3_sentence_dedup`` fixes its spans of three whole sentences, so this is a query of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicate(docs, sentences=1, least_words=PASSAGE_WORDS, reach=PASSAGE_REACH)
    return out.select(
        "doc_id", F.col("n_sentences").alias("n_parts"), "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS s FROM documents),
s AS (SELECT doc_id, i, s[i] AS x, regexp_extract_all({_LOW.format("s[i]")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, len(s) AS n
      FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM d)),
c AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(len(w)) OVER (PARTITION BY doc_id) AS total FROM s),
e AS (SELECT a.doc_id, a.i, a.n, a.total, min(b.i) AS e FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i + 2
      AND b.upto - a.upto + len(a.w) >= 8 GROUP BY ALL),
r AS (SELECT doc_id, i, e FROM e WHERE e IS NOT NULL UNION ALL
      SELECT doc_id, i, n FROM e WHERE e IS NULL AND i = 1 AND total > 0),
k AS (SELECT r.doc_id, r.i, r.e, string_agg(array_to_string(c.w, ' '), ' ' ORDER BY c.i) FILTER (len(c.w) > 0) AS g
      FROM r JOIN c ON r.doc_id = c.doc_id AND c.i BETWEEN r.i AND r.e GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS place FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM f WHERE place > 1),
kept AS (SELECT s.doc_id, count(gone.i) AS n_removed, string_agg(x, '' ORDER BY s.i) FILTER (gone.i IS NULL) AS t
         FROM s LEFT JOIN gone ON s.doc_id = gone.doc_id AND s.i = gone.i GROUP BY s.doc_id)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
