"""Phrase collocation mining over word-id suffix arrays.

A-Z is lower-cased; texts are split at ``.,;:!?`` and the bytes 0A-0D into
pieces, and those at spaces and tabs into words. Each task writes its words as
shards: a vocabulary and word ids of one language, pieces parted by id 0. A
shard's suffixes are ordered by NumPy prefix doubling (ranks of one word, of two,
of four), and every interval of suffixes that share ``n`` words is an n-gram
with its count. Counts are merged by language and phrase.

Longer phrases are counted only where they can be frequent: a phrase is no more
frequent than its words and its pairs. Shards are cut at words, then at pairs,
that a Bloom filter of the frequent ones does not hold; of what is left, hashes
are counted first, and only phrases whose hash is frequent are then counted by
their text. Filters are sized by what they hold, at most ``MOST_BITS`` bits,
whatever the input; one that would tell little is filled, so that more infrequent
phrases are counted and shuffled, none is lost. Counts, scores and the phrases dropped are exact.

Defined results: null text is empty; null language is ``und``; repeated rows
count as often as they stand there; a language without a candidate has no rows;
other columns are ignored. Long texts are taken in parts that end at pieces.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checkpoint import remove, shared_folder
from .text import buffers, mix, pieces, slices

#: Lower-cases A-Z; bytes that end a piece become line feeds, tabs spaces.
PIECE_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_INSIDE = np.frombuffer(PIECE_TABLE, np.uint8) != 10
#: Stands between pieces in the list of words; no word has the byte.
STOP = b"!"
#: Words of a shard, in all its languages, and hashes of phrases that a task holds before it packs them: both with their
#: temporary arrays take some 100 bytes each in a Python worker.
SHARD_WORDS = 500_000
PACK_HASHES = 1_000_000
PART = 4 << 20
MOST_BITS = 1 << 30
ROWS = 100_000
#: Rows of an Arrow batch of texts and of shards, which are some 3 MB each at most: Spark's own 10,000 would hold all shards
#: of a task at once, in the executor's direct memory and again in the Python worker.
TEXT_BATCH, SHARD_BATCH = 1000, 4
#: Shards are written in pages by size, not by a hundred rows, and without a dictionary of values that never repeat.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks of jobs that run meanwhile get batches of at most ``rows`` rows; then the session's own number counts again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def shards(docs: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """lang, n (words), vocabulary (joined by spaces, from id 1) and ids (int32, 0 ends a piece), as each task packs its rows."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, (vocabulary, parts) in sorted(held.items()):
            ids = np.concatenate(parts)
            words = b" ".join(list(vocabulary)[1:])
            row = [[lang], [int(np.count_nonzero(ids))], [words], [ids.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["lang", "n", "vocabulary", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in slices(batches, "text", PART):
            raw, at = buffers(batch.column("text"))
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                if lang not in held:
                    vocabulary = defaultdict(count().__next__)
                    vocabulary[STOP]
                    held[lang] = vocabulary, []
                vocabulary, parts = held[lang]
                text = raw[at[i] : at[i + 1]]
                for a, b in pieces(text, _INSIDE, PART):
                    words = text[a:b].tobytes().translate(PIECE_TABLE).replace(b"\n", b" ! ").split()
                    words.append(STOP)
                    parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                if size >= most:
                    yield from flush({k: v for k, v in held.items() if v[1]})
                    held, size = {}, 0
        yield from flush({k: v for k, v in held.items() if v[1]})

    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, n bigint, vocabulary binary, ids binary")


def suffixes(ids: np.ndarray, words: int) -> np.ndarray:
    """Places in the order of the ``words`` ids from there on (0 after the end), by prefix doubling."""
    rank, have = ids.astype(np.int64), 1
    order = np.argsort(rank) if words == 1 else None
    while have < words:
        key = rank * (rank.max(initial=0) + 1)
        key[:-have] += rank[have:]
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)])
        have *= 2
    return order


def intervals(ids: np.ndarray, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each different n-gram, how often it stands there), from the suffixes' common prefixes."""
    if not len(ids):
        return
    if sizes[-1] == 1:  # words alone need no order
        times = np.bincount(ids)
        times[0] = 0
        word, place = np.unique(ids, return_index=True)
        yield 1, place[word > 0], times[word[word > 0]]
        return
    order = suffixes(ids, sizes[-1])
    ends = np.flatnonzero(np.append(ids, 0) == 0)
    room = ends[np.searchsorted(ends, order)] - order  # words up to the end of the piece
    padded = np.append(ids, np.zeros(sizes[-1], ids.dtype))
    same = np.ones(len(order) - 1, bool)
    for n in range(1, sizes[-1] + 1):
        x = padded[order + n - 1]
        same &= x[1:] == x[:-1]
        if n in sizes:
            first = np.append(0, np.flatnonzero(~same) + 1)
            size = np.diff(np.append(first, len(order)))
            full = room[first] >= n
            yield n, order[first[full]], size[full]


def linked(ids: np.ndarray, link: np.ndarray, least: int) -> np.ndarray:
    """The runs of at least ``least`` ids whose neighbours are linked (link[i]: ids[i] with ids[i + 1]), each ended by 0."""
    run = np.cumsum(np.append(True, ~link))[: len(ids)]
    keep = (np.bincount(run)[run] >= least) & (ids > 0)
    run, ids = run[keep], ids[keep]
    nth = np.cumsum(np.append(False, run[1:] != run[:-1])[: len(run)])
    out = np.zeros(len(ids) + (nth[-1] + 1 if len(nth) else 0), np.int32)
    out[np.arange(len(ids)) + nth] = ids
    return out


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def folded(h: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words, below 2 ** 40."""
    out = h[0]
    for x in h[1:]:
        out = mix(out + mix(x))
    return mix(out) >> np.uint64(24)


class Filter:
    """A Bloom filter of hashes, with three bits each."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [mix(h + np.uint64(k)) & np.uint64(self.bits - 1) for k in range(3)]

    def has(self, h: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0 for p in self.places(h)))


def bloom(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], most_bits: int = MOST_BITS) -> Filter:
    """A filter of the hashes of df's rows; some 16 bits a row, ``most_bits`` at most. The driver gets the bits, not the rows.

    With fewer than two bits a row it would hold nearly half of all others, and holds everything instead."""
    n = df.count()
    out = Filter(min(most_bits, 1 << max(10, math.ceil(math.log2(16 * n + 1)))))
    if out.bits < 2 * n:
        out.words[:] = ~np.uint64(0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(out.places(of(batch))))
            slot, first = np.unique(place >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(place) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])

    table = df.mapInArrow(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.words[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Of rows (lang, phrase), in any order."""
    found, langs = [np.zeros(0, np.uint64)], np.array(batch.column("lang").to_pylist(), object)
    words = [p.encode("utf-8", "surrogatepass").split(b" ") for p in batch.column("phrase").to_pylist()]
    for lang in sorted(set(langs)):
        own = [words[i] for i in np.flatnonzero(langs == lang)]
        for size in {len(w) for w in own}:
            found.append(folded([hashes(lang, [w[k] for w in own if len(w) == size]) for k in range(size)]))
    return np.concatenate(found)


def _read(batches: Iterator[pa.RecordBatch], sizes: range, known: Filter | None, seen: Filter | None = None) -> Iterator[tuple]:
    """(lang, words, their hashes, ids cut where no frequent phrase can be) of each shard. seen: as in ``counted``."""
    n = sizes[0]
    for batch in batches:
        for row in range(batch.num_rows):
            lang, blob, ids = batch.column("lang")[row].as_py(), *(batch.column(c)[row].as_buffer() for c in ("vocabulary", "ids"))
            words, ids = [b"", *blob.to_pybytes().split(b" ")] if blob.size else [b""], np.frombuffer(ids, np.int32)
            if n == 1:
                yield lang, words, None, ids
                continue
            h = hashes(lang, words)
            if n == 2:
                good = known.has(folded([h]))
                good[0] = False
                good = good[ids]
                link = good[:-1] & good[1:]
            else:
                link = (ids[:-1] > 0) & (ids[1:] > 0)
                at = np.flatnonzero(link)
                link[at] = known.has(folded([h[ids[at]], h[ids[at + 1]]]))
            ids = linked(ids, link, n)
            if seen is not None and len(ids) > n:  # cut to what the frequent n-grams cover
                ends = np.append(np.flatnonzero(ids == 0), len(ids))
                at = np.flatnonzero(ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids)) >= n)
                at = at[seen.has(folded([h[ids[at + k]] for k in range(n)]))]
                link = np.zeros(len(ids) - 1, bool)
                for k in range(n - 1):
                    link[at + k] = True
                ids = linked(ids, link, n)
            yield lang, words, h, ids


def packed(keys: np.ndarray, times: np.ndarray, low: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts) of hashes: the bits above ``low`` name the bucket; the sorted rest is kept as differences, byte
    by byte of all, and counts go up to 255, since more rows can follow."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    keys, times = keys[cut], np.add.reduceat(times, cut) if len(cut) else times
    while len(keys):
        bucket = keys >> np.uint64(low)
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rest = (keys & np.uint64((1 << low) - 1)).astype(np.uint32)
        step = np.diff(rest, prepend=np.uint32(0))
        step[start] = rest[start]
        count = np.minimum(times, 255).astype(np.uint8)
        for x, y in zip(start, np.append(start[1:], len(keys))):
            yield int(bucket[x]), step[x:y].view(np.uint8).reshape(-1, 4).T.tobytes(), count[x:y].tobytes()
        more = times > 255
        keys, times = keys[more], times[more] - 255


def unpacked(bucket: int, steps: bytes, counts: bytes, low: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.uint64) | np.uint64(int(bucket) << low), np.frombuffer(counts, np.uint8).astype(np.int64)


def likely(shard: DataFrame, sizes: range, known: Filter, least: int, total: int) -> DataFrame:
    """hash of the n-grams whose hash stands at least ``least`` times: the frequent ones, and others by chance.

    Hashes of 40 bits are added up in each task and packed by buckets, of which there are more the more words (``total``)
    there are, so that what is shuffled is a few bytes a hash and what meets in one group is some million of them."""
    sent = shard.sparkSession.sparkContext.broadcast(known)
    low = 40 - min(20, max(8, math.ceil(math.log2(max(1, total / (1 << 20))))))

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        rows = packed(*(np.concatenate(x) for x in zip(*held)), low) if held else iter(())
        while part := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "steps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, h, ids in _read(batches, sizes, sent.value):
            for n, place, times in intervals(ids, sizes):
                held.append((folded([h[ids[place + k]] for k in range(n)]), times))
                size += len(times)
            if size > PACK_HASHES:
                yield from pack(held)
                held, size = [], 0
        yield from pack(held)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [unpacked(key[0], s, c, low) for s, c in zip(rows["steps"], rows["counts"])]
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return pd.DataFrame({"hash": keys[np.bincount(at, np.concatenate([c for _, c in found])) >= least].view(np.int64)})

    rows = shard.select("lang", "vocabulary", "ids").mapInArrow(run, "bucket int, steps binary, counts binary")
    return rows.groupBy("bucket").applyInPandas(add, "hash bigint")


def counted(shard: DataFrame, sizes: range, known: Filter | None, seen: Filter | None, least: int) -> DataFrame:
    """lang, phrase, a: the n-grams of ``sizes`` that stand at least ``least`` times, if ``known`` holds all that are frequent
    of the words (for pairs) or of the pairs (for longer ones), and ``seen`` the hashes of all that are."""
    sent = shard.sparkSession.sparkContext.broadcast((known, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value
        for lang, words, h, ids in _read(batches, sizes, known, seen):
            vocabulary = pa.array(words, pa.binary())
            for n, place, times in intervals(ids, sizes):
                if seen is not None:
                    some = seen.has(folded([h[ids[place + k]] for k in range(n)]))
                    place, times = place[some], times[some]
                for a in range(0, len(place), ROWS):
                    p = place[a : a + ROWS]
                    parts = [vocabulary.take(pa.array(ids[p + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0]
                    langs = pa.array([lang]).take(pa.array(np.zeros(len(p), np.int64)))
                    yield pa.RecordBatch.from_arrays([langs, phrase.cast(pa.string()), pa.array(times[a : a + ROWS].astype(np.int64))], ["lang", "phrase", "a"])

    found = shard.select("lang", "vocabulary", "ids").mapInArrow(run, "lang string, phrase string, a bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, max_words: int = 4, covered: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates among frequent phrases (lang, phrase, a) that no longer candidate covers
    by ``covered`` hundredths. Parts are looked up by joins on language and phrase, which Spark can split."""
    phrases = phrases.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w"))
    many = phrases.where("size > 1")
    w, size = F.col("w"), F.col("size")
    cut = lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), _joined(w, 1, k).alias("part")),
                            F.struct(k.alias("k"), F.lit(1).alias("side"), _joined(w, k + 1, size - k).alias("part")))
    parts = many.select("lang", "phrase", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size - 1), cut))).alias("c"))
    parts = parts.select("lang", "phrase", "a", "c.k", "c.side", "c.part")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    got = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(
        *(F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"f{k}_{s}") for k in range(1, max_words) for s in (0, 1))
    )
    whole = lambda name: F.col(name).cast("decimal(19,0)")
    options = [
        F.when(F.col(f"f{k}_0").isNotNull(), F.struct(
            F.call_function("div", F.lit(2_000_000).cast("decimal(19,0)") * whole("a"), whole(f"f{k}_0") + whole(f"f{k}_1")).alias("score"),
            F.lit(k).alias("k"), F.col(f"f{k}_0").alias("l"), F.col(f"f{k}_1").alias("r"))) for k in range(1, max_words)
    ]
    best = got.withColumn("best", F.least(*options) if len(options) > 1 else options[0]).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = [F.when(F.lit(s + n - 1) <= size, _joined(w, s, n)) for n in range(2, max_words) for s in range(1, max_words - n + 2)]
    if not inner:
        return best
    inside = many.where("size > 2").select("lang", "phrase", "a", F.explode(F.array_distinct(F.array_compact(F.array(*inner)))).alias("part"))
    longest = inside.where("part <> phrase").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(longest, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * covered)).drop("longer")


def collocations(docs: DataFrame, max_words: int = 4, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    with small_batches(spark, TEXT_BATCH):
        shard = written(shards(docs), "shards", **PAGES)
    total = written(shard.groupBy("lang").agg(F.sum("n").alias("n")), "total")
    with small_batches(spark, SHARD_BATCH):
        phrases = written(counted(shard, range(1, 2), None, None, least), "words")
    known, words = phrases, total.agg(F.sum("n")).first()[0] or 0
    for name, sizes in (("pairs", range(2, 3)), ("longer", range(3, max_words + 1))):
        if len(sizes) and max_words >= sizes[0]:
            frequent = bloom(known, phrase_hashes)
            with small_batches(spark, SHARD_BATCH):
                hashed = written(likely(shard, sizes, frequent, least, words), f"{name}_hashes")
            seen = bloom(hashed, lambda batch: batch.column("hash").to_numpy().view(np.uint64))
            with small_batches(spark, SHARD_BATCH):
                known = written(counted(shard, sizes, frequent, seen, least), name)
            phrases = phrases.unionByName(known)
    remove(spark, f"{folder}/shards")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    # the first of every share, then of those: no task gets more than top rows of each share
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored(phrases, max_words, covered).withColumn("share", share).withColumn("rank", rank("share")).where(F.col("rank") <= top)
    first = first.withColumn("rank", rank()).where(F.col("rank") <= top).join(total, "lang")
    return first.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 4 words that stand 30 times or more, the first 2000 of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, piece, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
e AS (SELECT lang, x, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4 FROM s WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, [x] AS g, count(*) AS a FROM e GROUP BY lang, x HAVING count(*) >= 30 UNION ALL
      SELECT lang, [x, x2], count(*) FROM e WHERE x2 IS NOT NULL GROUP BY lang, x, x2 HAVING count(*) >= 30 UNION ALL
      SELECT lang, [x, x2, x3], count(*) FROM e WHERE x3 IS NOT NULL GROUP BY lang, x, x2, x3 HAVING count(*) >= 30 UNION ALL
      SELECT lang, [x, x2, x3, x4], count(*) FROM e WHERE x4 IS NOT NULL GROUP BY lang, x, x2, x3, x4 HAVING count(*) >= 30),
c AS (SELECT *, len(g) AS size FROM g WHERE len(g) > 1),
k AS MATERIALIZED (SELECT *, array_to_string(g[1:k], ' ') AS lg, array_to_string(g[k + 1:], ' ') AS rg FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS part, a FROM g),
cuts AS (SELECT k.lang, k.g, k.a, k.k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * k.a // (x.a::HUGEINT + y.a) AS BIGINT) AS score
         FROM k JOIN f AS x ON x.lang = k.lang AND x.part = lg JOIN f AS y ON y.lang = k.lang AND y.part = rg),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT c.lang, c.g[s:s + m - 1] AS g, max(c.a) AS longer FROM c, range(2, 4) AS u(m), range(1, 4) AS v(s)
           WHERE m < c.size AND s + m - 1 <= c.size GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM named)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
