"""Benchmark decontamination with a document-partitioned positional inverted index.

``index`` turns each few MB of training documents into one index segment: for
every word that stands there, as a 64-bit hash, the sorted list of the word
positions at which it stands. Segments are written once to the shared folder.
``search`` looks up a set of test windows in each segment: it takes the posting
list of each window's rarest term, subtracts the term's offset, and keeps the
places that the offset-adjusted lists of the other terms hold too, rarest first.
What is left are exact phrase matches. With ``slop`` it also returns proximity
matches, where all terms stand within the window's length plus ``slop`` words.

Segments hold whole documents, so postings never leave their task: there is no
shuffle, and no key can be hot. The test side is broadcast in chunks of at most
``chunk_bytes`` of text, or one item; each chunk is a pass over the written
index, and what the passes find in a row is put together by its number.
``without_hits`` filters documents with segments that are made and searched in
one scan and not written.

Defined results: null or wordless documents have no words and no hits; null or
wordless items, and items without id, have no windows; repeated rows each get a
row; repeated items count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoint import cut
from .text import buffers, hashed_words, slices

#: Words that may stand between those of a window in a proximity match.
SLOP = 2
#: Pairs of a window and a place that are looked at together.
PAIRS = 1 << 20
SEGMENT = "doc_ids array<bigint>, row_ids array<bigint>, first_word array<bigint>, terms binary, ends binary, postings binary"
MATCHES = "doc_id bigint, row_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<bigint>, near_items array<bigint>"


class Windows(NamedTuple):
    """Distinct windows as rows of term numbers, -1 after their end.

    times: how often a window holds the term of a column, 0 where an earlier column has the same. Items of window i
    are items[first_item[i]:first_item[i + 1]]."""

    terms: np.ndarray
    matrix: np.ndarray
    times: np.ndarray
    first_item: np.ndarray
    items: np.ndarray


class Segment(NamedTuple):
    """terms: sorted hashes; term i stands at the words postings[ends[i - 1]:ends[i]]; first_word: of each document."""

    first_word: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    postings: np.ndarray


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of size[0] entries, then the next range."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)


def _hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text)."""
    h, _, first = hashed_words(*buffers(texts))
    return h, first.astype(np.int64)


def windows_of(items: list[tuple[int, str]], size: int) -> Windows:
    """The distinct windows of the items."""
    h, first = _hashed_words(pa.array([t for _, t in items], pa.string()))
    terms, number = np.unique(h, return_inverse=True)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    start = _ranges(first[:-1], count)
    length = np.minimum(n[owner], size)
    matrix = np.full((len(start), size), -1, np.int32)
    for j in range(size):
        on = length > j
        matrix[on, j] = number[start[on] + j]
    matrix, which = np.unique(matrix, axis=0, return_inverse=True)
    times = np.zeros(matrix.shape, np.int8)
    for j in range(size):
        same = (matrix == matrix[:, j : j + 1]) & (matrix[:, j : j + 1] >= 0)
        times[:, j] = np.where(same[:, :j].any(1), 0, same.sum(1))
    item = np.array([i for i, _ in items], np.int64)[owner]
    held = np.unique(np.stack((which.reshape(-1), item), 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    return Windows(terms, matrix, times, np.searchsorted(held[:, 0], np.arange(len(matrix) + 1)), held[:, 1])


def segment_of(texts: pa.Array) -> Segment:
    """The positional index of whole documents."""
    h, first = _hashed_words(texts)
    order = np.argsort(h, kind="stable").astype(np.int32)
    h = h[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return Segment(first, h[head], np.append(head[1:], len(h))[: len(head)].astype(np.int32), order)


def index(docs: DataFrame, segment_bytes: int = 3 << 20) -> DataFrame:
    """One row per segment: its documents and the positional postings of all their words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", segment_bytes):
            s = segment_of(batch.column("text"))
            whole = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(whole, batch.column("doc_id")), pa.ListArray.from_arrays(whole, batch.column("row_id")),
                    pa.array([s.first_word], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in s[1:]),
                ],
                ["doc_ids", "row_ids", "first_word", "terms", "ends", "postings"],
            )

    row = F.col("row_id") if "row_id" in docs.columns else F.monotonically_increasing_id().alias("row_id")
    return docs.select(F.col("doc_id").cast("bigint"), row, F.col("text")).mapInArrow(build, SEGMENT)


def _lookup(s: Segment, win: Windows):
    """(windows whose terms all stand in the segment, frequency and first posting of each test term, test term at each word)."""
    at = np.minimum(np.searchsorted(s.terms, win.terms), max(0, len(s.terms) - 1))
    here = s.terms[at] == win.terms if len(s.terms) else np.zeros(len(win.terms), bool)
    begin = np.zeros(len(win.terms), np.int64)
    size = np.zeros(len(win.terms), np.int64)
    size[here] = np.diff(s.ends, prepend=0)[at[here]]
    begin[here] = s.ends[at[here]] - size[here]
    word_term = np.full(int(s.first_word[-1]), -1, np.int32)
    word_term[s.postings[_ranges(begin, size)]] = np.repeat(np.arange(len(win.terms), dtype=np.int32), size)
    present = np.append(here, True)  # the entry -1, after a window's end, is always there
    alive = np.flatnonzero(present[win.matrix].all(1)) if len(win.matrix) else np.zeros(0, np.int64)
    return alive, size, begin, word_term


def _blocks(size: np.ndarray) -> Iterator[slice]:
    """Consecutive entries of about ``PAIRS`` in sum."""
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        yield slice(first, last)
        first = last


def _exact(s: Segment, win: Windows, alive, size, begin, word_term) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every phrase match."""
    frequency = np.append(size, np.iinfo(np.int64).max)[win.matrix[alive]]
    order = np.argsort(frequency, axis=1, kind="stable")
    rare = win.matrix[alive, order[:, 0]]
    length = (win.matrix[alive] >= 0).sum(1)
    out = []
    for block in _blocks(size[rare]):
        count = size[rare[block]]
        w = np.repeat(np.arange(block.start, block.stop), count)
        start = s.postings[_ranges(begin[rare[block]], count)].astype(np.int64) - order[w, 0]
        on = (start >= 0) & (start + length[w] <= len(word_term))
        w, start = w[on], start[on]
        for k in range(1, win.matrix.shape[1]):
            j = order[w, k]
            term = win.matrix[alive[w], j]
            on = (term < 0) | (word_term[np.minimum(start + j, len(word_term) - 1)] == term)
            w, start = w[on], start[on]
        doc = np.searchsorted(s.first_word, start, "right") - 1
        on = start + length[w] <= s.first_word[doc + 1]
        out.append((alive[w[on]], start[on]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _near(s: Segment, win: Windows, alive, size, begin, word_term, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, document): all terms, as often as the window holds them, stand within its length and slop words, in any order."""
    frequency = np.where(win.times[alive] > 0, np.append(size, 0)[win.matrix[alive]], np.iinfo(np.int64).max)
    order = np.argsort(frequency, axis=1, kind="stable")
    length = (win.matrix[alive] >= 0).sum(1)
    column = lambda k: np.where(np.take_along_axis(win.times[alive], order[:, k : k + 1], 1)[:, 0] > 0, win.matrix[alive, order[:, k]], -1)
    reach = win.matrix.shape[1] + slop - 1
    around = np.arange(-reach, reach + 1)
    # windows that follow each other mostly have the same two rarest terms: those are looked for once
    second = column(1) if win.matrix.shape[1] > 1 else np.full(len(alive), -1)
    two, of_two = np.unique(np.stack((column(0), second), 1), axis=0, return_inverse=True) if len(alive) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    by_two = np.argsort(of_two.reshape(-1), kind="stable")
    edge = np.searchsorted(of_two.reshape(-1)[by_two], np.arange(len(two) + 1))
    found = []
    for block in _blocks(size[two[:, 0]]):
        count = size[two[block, 0]]
        t = np.repeat(np.arange(block.start, block.stop), count)
        p = s.postings[_ranges(begin[two[block, 0]], count)].astype(np.int64)
        on = two[t, 1] < 0
        for o in around:
            on |= word_term[np.clip(p + o, 0, len(word_term) - 1)] == two[t, 1]
        t, p = t[on], p[on]
        many = edge[t + 1] - edge[t]
        for part in _blocks(many * len(around)):
            w = by_two[_ranges(edge[t[part]], many[part])]
            at = np.repeat(p[part], many[part])
            doc = np.searchsorted(s.first_word, at, "right") - 1
            span = length[w] + slop
            ok = np.ones((len(w), reach + 1), bool)
            for k in range(win.matrix.shape[1]):
                live = np.flatnonzero(ok.any(1))
                if len(live) < len(w):
                    w, at, doc, span, ok = w[live], at[live], doc[live], span[live], ok[live]
                term, n = win.matrix[alive[w], order[w, k]], win.times[alive[w], order[w, k]]
                place = at[:, None] + around
                inside = (place >= s.first_word[doc][:, None]) & (place < s.first_word[doc + 1][:, None])
                held = inside & (word_term[np.clip(place, 0, len(word_term) - 1)] == term[:, None])
                upto = np.concatenate((np.zeros((len(w), 1), np.int16), np.cumsum(held, 1, dtype=np.int16)), 1)
                low = np.arange(reach + 1)  # words of the span before the rarest term
                last = np.minimum(reach - low + span[:, None], len(around))
                ok &= (np.take_along_axis(upto, last, 1) - upto[:, reach - low] >= n[:, None]) & (low < span[:, None])
            on = ok.any(1)
            found.append((alive[w[on]], doc[on]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _item_lists(window: np.ndarray, doc: np.ndarray, win: Windows, n: int) -> pa.ListArray:
    """Per document the distinct items of its windows, sorted."""
    key = np.unique(window * n + doc)
    window, doc = key // max(1, n), key % max(1, n)
    size = np.diff(win.first_item)[window]
    both = np.unique(np.stack((np.repeat(doc, size), win.items[_ranges(win.first_item[window], size)]), 1), axis=0)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(both[:, 0], np.arange(n + 1)), pa.int32()), pa.array(both[:, 1], pa.int64()))


def _match(s: Segment, win: Windows, slop: int | None):
    """(matches' windows, their first words, windows and documents of proximity matches)."""
    none = (np.zeros(0, np.int64),) * 2
    if not len(win.matrix) or not s.first_word[-1]:
        return *none, *none
    found = _lookup(s, win)
    return *_exact(s, win, *found), *(none if slop is None else _near(s, win, *found, slop))


def search(segments: DataFrame, windows, slop: int | None = None) -> DataFrame:
    """Per document its words, the covered word ranges and the matching items. windows: a broadcast of ``Windows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = windows.value
        for batch in batches:
            for r in range(batch.num_rows):
                first = batch.column("first_word")[r].values.to_numpy(zero_copy_only=False)
                raw = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023,E731
                s = Segment(first, raw("terms", np.uint64), raw("ends", np.int32), raw("postings", np.int32))
                window, start, near, near_doc = _match(s, win, slop)
                n, length = len(first) - 1, (win.matrix[window] >= 0).sum(1)
                cover = np.zeros(int(first[-1]) + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length, -1)
                on = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
                # a range ends where its document does, even if the next one begins with a hit
                edge = np.zeros(len(cover), bool)
                edge[first] = True
                begins = np.flatnonzero(on[1:] & (~on[:-1] | edge))
                stops = np.flatnonzero(on[:-1] & (~on[1:] | edge))
                at = np.searchsorted(begins, first)
                local = np.repeat(first[:-1], np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - local, pa.int64())) for x in (begins, stops)]
                doc = np.searchsorted(first, start, "right") - 1
                items = [_item_lists(window, doc, win, n), _item_lists(near, near_doc, win, n)]
                columns = [batch.column("doc_ids")[r].values, batch.column("row_ids")[r].values, pa.array(np.diff(first)), *lists, *items]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MATCHES.split(", ")])

    return segments.mapInArrow(run, MATCHES)


def _chunks(benchmark: DataFrame, size: int, chunk_bytes: int) -> Iterator:
    """Broadcasts of the windows of some items each; at least one, which may be empty."""
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text")).where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )
    volume = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-int(volume) // chunk_bytes))
    for c in range(chunks):
        part = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).collect()  # about chunk_bytes
        yield benchmark.sparkSession.sparkContext.broadcast(windows_of([(r[0], r[1]) for r in part], size))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = None, chunk_bytes: int = 4 << 20
) -> DataFrame:
    """Per document: doc_id, n_words, starts/ends of the covered word ranges, items, near_items.

    ``size``: words of a window. The benchmark is taken in chunks of about ``chunk_bytes``, each a pass over the index."""
    segments = cut(index(docs.select("doc_id", "text")))
    passes = [search(segments, sent, slop) for sent in _chunks(benchmark, size, chunk_bytes)]
    if len(passes) == 1:
        return passes[0].drop("row_id")
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))),
        F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= x["starts"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["starts"].alias("starts"),
                        F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    # every pass has each row once
    return (
        out.groupBy("row_id", "doc_id", "n_words")
        .agg(
            merged.alias("m"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
        .select("doc_id", "n_words", F.col("m.starts").alias("starts"), F.col("m.ends").alias("ends"), "items", "near_items")
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, chunk_bytes: int = 4 << 20, segment_bytes: int = 3 << 20) -> DataFrame:
    """The rows, with all their columns, that hold no window of the benchmark: one scan, without join or shuffle."""
    schema = docs.schema

    def clean(docs: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", segment_bytes):
                s = segment_of(batch.column("text"))
                _, start, _, _ = _match(s, sent.value, None)
                keep = np.ones(batch.num_rows, bool)
                keep[np.searchsorted(s.first_word, start, "right") - 1] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, schema)

    for sent in _chunks(benchmark, size, chunk_bytes):
        docs = clean(docs, sent)
    return docs


def _digest(out: DataFrame, *more: str | Column) -> DataFrame:
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        *more,
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of ``decontaminate`` over whole ``documents`` and ``benchmark``.

    n_near and near_sha256 are those of the items of proximity matches within ``SLOP`` more words, as n_items and items_sha256."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = F.array_join(F.array_sort(F.transform("near_items", lambda x: x.cast("string"))), ",")
    return _digest(decontaminate(docs, bench, slop=SLOP), F.size("near_items").cast("bigint").alias("n_near"), F.sha2(names, 256).alias("near_sha256"))


def op4_decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and near_items: the items of proximity matches within ``SLOP`` more words, as a list."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _digest(decontaminate(docs, bench, slop=SLOP), "near_items")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i+9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1),
-- proximity: a window's words, as often as it holds them, within its length and {SLOP} more consecutive words
iw AS (SELECT DISTINCT item_id, w[i:i+9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
wt AS (SELECT DISTINCT win, unnest(win) AS t FROM iw),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
rare AS (SELECT win, arg_min(t, (f, t)) AS t FROM wt JOIN (SELECT t, count(*) AS f FROM dt GROUP BY 1) USING (t) GROUP BY win),
around AS (SELECT win, doc_id, p, len(win) + {SLOP} AS n, w FROM rare JOIN dt USING (t) JOIN d USING (doc_id)
           WHERE list_has_all(w[greatest(1, p - len(win) - {SLOP - 1}):p + len(win) + {SLOP - 1}], win)),
spans AS (SELECT win, doc_id, w[greatest(1, s):s + n - 1] AS span FROM (SELECT *, unnest(range(p - n + 1, p + 1)) AS s FROM around)),
near AS (SELECT DISTINCT win, doc_id FROM spans WHERE list_bool_and(list_transform(list_distinct(win),
         lambda x: len(list_filter(span, lambda y: y = x)) >= len(list_filter(win, lambda y: y = x))))),
ni AS (SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS near_names
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM near JOIN iw USING (win)) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_names, '')) AS near_sha256
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""
