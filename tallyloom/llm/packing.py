"""Cost-balanced sequence packing.

Each document is tokenised once. Only its length and the running CRC-32 of its
ids at every ``grain`` tokens go on: a few bytes per hundred tokens, from which
the checksum of any piece that is cut at a multiple of ``grain`` follows.
Documents are dealt by a hash of their id and ids into shards of about
``shard_docs`` documents and ``shard_bytes`` of text; equal rows are counted in
their partition and dealt by that number too, so that no shard grows with the
copies of a row. Each shard packs on its own, so no task grows with the corpus.

In a shard, whole multiples of ``capacity`` fill sequences of their own. The
remainders go in descending order to the sequence with the lowest estimated
cost (``linear * tokens + quadratic * sum of squared piece lengths``) among
those with room, over as many sequences as the tokens need. What no longer fits
whole is cut, and fills the sequences' room from the cheapest on, so that a
shard pads fewer than ``grain`` tokens a sequence, and one sequence more.

Defined results: null is the empty text, which has the end token alone; repeated
rows are packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import buffers, pieces, slices

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Distinct stretches whose ids a task remembers at most.
CACHE = 600_000
#: 0: white space; 1: ASCII letters; 2: ASCII punctuation but the apostrophe, which may begin a contraction; 3: others.
_KIND = np.array(
    [0 if b in b" \t\n\r\x0b\x0c" else 1 if chr(b).isalpha() and b < 128 else 2 if 33 <= b < 127 and not chr(b).isalnum() and b != 39 else 3
     for b in range(256)], np.uint8,
)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class WordTokenizer:
    """Ids of whole texts by way of their distinct stretches.

    The tokenizer ignores case and never joins pieces across white space, nor
    across an ASCII letter beside ASCII punctuation (apostrophes apart), so each
    stretch between two such places has ids of its own. They are kept for recent
    stretches; the others go through the tokenizer in one batch. A tokenizer
    with other rules is refused. Texts that hold the string of a special token
    go through the tokenizer whole, which gives that token's id."""

    PROBES = ("It's A-b c!d  \t\u00e9.x\u00c9 12a3 'RE don't", "x\u00a0y\u3000z <|a b|> ...!?a'll", "Stra\u00dfe e\u0301e \u0130I {a}[b]_c", "")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.clear()
        ids, ends = self.encode(*buffers(pa.array(self.PROBES)))
        if [x.tolist() for x in np.split(ids, ends)[:-1]] != [self._whole(t) for t in self.PROBES]:
            raise ValueError(f"{path} does not part texts as WordTokenizer does")

    def _whole(self, text: str) -> list[int]:
        self.model.encode_special_tokens = False
        return self.model.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.begin, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _learn(self, new: list[bytes]) -> None:
        self.model.encode_special_tokens = True
        got = [e.ids for e in self.model.encode_batch_fast([w.decode("utf-8") for w in new], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        n = len(self.number)
        while n + len(new) + 1 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[n + 1 : n + 1 + len(new)] = self.used + np.cumsum(size)
        self.number.update(zip(new, range(n, n + len(new))))
        self.used += len(flat)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the end of each text in them), from the texts' bytes and offsets."""
        data = raw.tobytes()
        if not any(s in data for s in self.special):
            return self._pieces(raw, at)
        out, ends, total = [], [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            held = any(data.find(s, a, b) >= 0 for s in self.special)
            ids = np.array(self._whole(data[a:b].decode("utf-8")), np.uint32) if held else self._pieces(raw[a:b], np.array([0, b - a]))[0]
            total += len(ids)
            out.append(ids)
            ends.append(total)
        return np.concatenate(out), np.array(ends)

    def _pieces(self, raw: np.ndarray, at: np.ndarray, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """``_parted`` of parts that end at white space: what is held besides the ids does not grow with a text."""
        if len(raw) <= most:
            return self._parted(raw, at)
        out, ends, total = [], np.zeros(len(at) - 1, np.int64), 0
        for a, b in pieces(raw, _KIND > 0, most):
            first, last = np.searchsorted(at, a, "right"), np.searchsorted(at, b)
            ids, own = self._parted(raw[a:b], np.concatenate(([a], at[first:last], [b])) - a)
            # texts that end in this part, the last one perhaps with it, and all behind it
            ends[first - 1 : last] = total + own
            out.append(ids)
            total += len(ids)
            ends[last:] = total
        return np.concatenate(out), ends

    def _parted(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (kind[:-1] + kind[1:] == 3) & (kind[:-1] > 0) & (kind[1:] > 0)
        cut[at] = True
        cut[-1] = False
        first = (kind > 0) & cut[:-1]
        first[1:] |= (kind[1:] > 0) & (kind[:-1] == 0)
        in_text = np.diff(np.concatenate(([0], np.cumsum(first)))[at])
        where = np.flatnonzero(cut)
        split = np.insert(_LOWER[raw], where, 32).tobytes().split()
        if len(self.number) > CACHE:
            self.clear()
        word = np.fromiter(map(self.number.get, split, repeat(-1)), np.int64, len(split))
        missing = np.flatnonzero(word < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(split[i] for i in missing)))
            word[missing] = [self.number[split[i]] for i in missing]
        count = self.begin[word + 1] - self.begin[word]
        ends = np.cumsum(count)
        out = self.ids[np.arange(ends[-1]) - np.repeat(ends - count - self.begin[word], count)] if len(word) else self.ids[:0]
        return out, np.concatenate(([0], ends))[np.cumsum(in_text)]


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo that of CRC-32."""
    out = 0
    for i in range(31, -1, -1):
        if b >> i & 1:
            out ^= a
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


@lru_cache(65536)
def _shift(n: int) -> int:
    """x to the power 8 n modulo the polynomial of CRC-32."""
    out, base = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, base)
        base = _times(base, base)
        n >>= 1
    return out


def crc_between(before: int, until: int, n: int) -> int:
    """CRC-32 of the last n bytes, given that of all before them and that of both together."""
    return until ^ _times(before, _shift(n)) if before else until


def lengths(docs: DataFrame, path: str, end_id: int = 2, grain: int = 16) -> DataFrame:
    """doc_id, doc_tokens (with the end token), checks (CRC-32 of the first grain, 2 * grain, ... and all ids) and turn,
    the number of equal rows before it in its partition, in whatever order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, seen = zlib.crc32, {}
        for batch in slices(batches, "text", 2 << 20):
            model = tokenizer(path)
            ids, ends = model.encode(*buffers(batch.column("text")))
            sizes, checks, turns, begin = [], [], [], 0
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                data = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4").tobytes()
                begin, c, own = end, 0, []
                view, step = memoryview(data), 4 * grain
                for i in range(0, len(data), step):
                    c = crc(view[i : i + step], c)
                    own.append(c)
                sizes.append(len(data) // 4)
                checks.append(np.array(own, "<u4").tobytes())
                turns.append(seen.get(row := (doc, sizes[-1], c), 0))
                seen[row] = turns[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(checks, pa.binary()), pa.array(turns, pa.int64())],
                ["doc_id", "doc_tokens", "checks", "turn"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(
        run, "doc_id bigint, doc_tokens bigint, checks binary, turn bigint"
    )


def assign(sizes: np.ndarray, capacity: int, grain: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard; sizes in tokens, in a fixed order."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for d in np.flatnonzero(sizes >= capacity).tolist():
        for k in range(int(sizes[d]) // capacity):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
    rest = sizes % capacity
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    n = -(-int(rest.sum()) // capacity)
    used, cost = [0] * n, [0.0] * n
    classes = 64
    width = -(-(capacity + 1) // classes)
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(classes)]  # heaps of (cost, sequence), stale entries too
    by_room[capacity // width] = [(0.0, s) for s in range(n)]
    top = np.full(classes, np.inf)
    top[capacity // width] = 0.0 if n else np.inf
    live = [capacity // width] * n

    def settle(c: int) -> None:
        heap = by_room[c]
        while heap and (live[heap[0][1]] != c or cost[heap[0][1]] != heap[0][0]):
            heapq.heappop(heap)
        top[c] = heap[0][0] if heap else np.inf

    def put(d: int, start: int, length: int, s: int) -> None:
        out.append((d, start, length, sequence + s, used[s]))
        old = live[s]
        used[s] += length
        cost[s] += linear * length + quadratic * length * length
        live[s] = (capacity - used[s]) // width
        heapq.heappush(by_room[live[s]], (cost[s], s))
        settle(old)
        settle(live[s])

    left = []
    for d in order.tolist():
        length = int(rest[d])
        edge = length // width
        best = None
        if edge + 1 < classes:
            c = int(np.argmin(top[edge + 1 :])) + edge + 1
            if top[c] < np.inf:
                best = by_room[c][0]
        if top[edge] < (best[0] if best else np.inf):  # in this class some have room and some do not
            best = min((x for x in by_room[edge] if live[x[1]] == edge and cost[x[1]] == x[0] and capacity - used[x[1]] >= length and (best is None or x < best)), default=best)
        if best is None:
            left.append((d, int(sizes[d]) - length, length))
        else:
            put(d, int(sizes[d]) - length, length, best[1])
    room = sorted((s for s in range(n) if used[s] < capacity), key=lambda s: (cost[s], s))
    i = 0
    for d, start, length in left:
        while length:
            if i == len(room):
                room.append(n)
                used.append(0)
                cost.append(0.0)
                live.append(-1)
                n += 1
            s = room[i]
            free = capacity - used[s]
            take = length if length <= free else free // grain * grain
            if take:
                out.append((d, start, take, sequence + s, used[s]))
                used[s] += take
                start, length = start + take, length - take
            if length:
                i += 1
    return out


def pack(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, grain: int = 16, linear: float = 1.0,
    quadratic: float = 1.0 / 4096, shard_docs: int = 20_000, shard_bytes: int = 32 << 20,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens; ``capacity`` is a multiple of ``grain``."""
    n, volume = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n // shard_docs), -(-volume // shard_bytes))
    shard = F.pmod(F.xxhash64("doc_id", "doc_tokens", "checks", "turn"), F.lit(shards))
    sized = lengths(docs, path, end_id, grain).withColumn("shard", shard).drop("turn")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_tokens", "checks"], ignore_index=True)
        sizes = pdf["doc_tokens"].to_numpy()
        pieces = assign(sizes, capacity, grain, linear, quadratic)
        crcs, checks = [], [np.frombuffer(x, "<u4") for x in pdf["checks"]]
        for d, start, length, _, _ in pieces:
            own = checks[d]
            before = int(own[start // grain - 1]) if start else 0
            crcs.append(crc_between(before, int(own[-(-(start + length) // grain) - 1]), 4 * length))
        p = np.array(pieces, np.int64).reshape(-1, 5)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].iloc[p[:, 0]].reset_index(drop=True), "start": p[:, 1], "length": p[:, 2],
                "ids_crc32": np.array(crcs, np.int64), "doc_tokens": sizes[p[:, 0]],
                "sequence_id": (int(key[0]) << 32) + p[:, 3], "offset": p[:, 4],
            }
        )

    return sized.groupBy("shard").applyInPandas(run, PIECE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: the pieces of all ``documents``."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
