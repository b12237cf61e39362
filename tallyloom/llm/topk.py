"""Exact top-k inner products by dual-tree search with cover trees.

The queries, a stated set, are taken in chunks of at most ``query_bytes``; each
chunk is sent to all tasks, and rows of data never move. A task builds one cover
tree over the chunk and one over each few thousand rows it reads, and walks both
together: for a pair of nodes with centres q, r and covering radii a, b no inner
product below them exceeds ``<q, r> + a |r| + b |q| + a b``; the pair is dropped
when that is less than the worst k-th score of the queries below. A task keeps
the best k rows a query over all that it has read.

A first round over one row in ``first_round`` gives each query a k-th score that
its best rows must reach. It is sent with the queries, so that the second round,
over all rows, drops most node pairs at once and passes on some
``k * first_round`` rows a query, however many tasks there are.

Scores are exact: rows and queries whose products could pass 2**53 are compared
by doubles with a bound on their error, and those that may count in Python
integers; a score outside 64 bits saturates.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors of different lengths are never compared; empty vectors
score 0; ties go to the smaller id; rows that share an id are a query's own, and
a query given several times counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checkpoint import cut

LEAF, SMALL = 128, 32


class CoverTree:
    """A node of level i covers its descendants within 2**i; its children's centres, itself among them, are over
    2**(i - 1) apart and cover within 2**(i - 1). A node of up to ``LEAF`` descendants keeps them as a list, and
    children of under ``SMALL`` descendants share one such list under their parent's centre, so that data without
    clusters cost block products and not steps of a walk. The radius kept is the one reached, at most 2**i."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt((x * x).sum(1))
        n = len(x)
        square = self.norm**2
        far = np.sqrt(np.maximum(square + square[0] - 2 * x @ x[0], 0)).max(initial=0)
        level = int(np.ceil(np.log2(far))) if far > 0 else 0
        self.centre, self.radius, self.members, self.children = [], [], [], []
        self.root = self._node(0, np.arange(n), level, square)

    def _node(self, centre: int, own: np.ndarray, level: int, square: np.ndarray) -> int:
        x = self.x
        away = np.sqrt(np.maximum(square[own] + square[centre] - 2 * x[own] @ x[centre], 0))
        # rounding of the squares leaves an error that grows with the norms, not with the distance
        slack = 1e-7 * (1 + self.norm[own].max() + self.norm[centre])
        k = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(away.max()) + slack)
        self.members.append(own)
        self.children.append([])
        if len(own) <= LEAF or away.max() <= 2 * slack:
            return k
        while float(away.max()) <= 2.0 ** (level - 1):
            level -= 1
        left, children, first = own, [], centre
        reach = 2.0 ** (level - 1)
        while len(left):
            d = np.sqrt(np.maximum(square[left] + square[first] - 2 * x[left] @ x[first], 0))
            near = (d <= reach) | (left == first)
            children.append((first, left[near]))
            left = left[~near]
            if len(left):
                first = int(left[0])
        small = [m for _, m in children if len(m) < SMALL]
        self.children[k] = [self._node(c, m, level - 1, square) for c, m in children if len(m) >= SMALL]
        if small and not self.children[k]:
            return k
        if small:
            rest = np.concatenate(small)
            away = np.sqrt(np.maximum(square[rest] + square[centre] - 2 * x[rest] @ x[centre], 0))
            self.children[k].append(len(self.centre))
            self.centre.append(centre)
            self.radius.append(float(away.max()) + slack)
            self.members.append(rest)
            self.children.append([])
        return k


class Search:
    """The best k rows so far of each query of one chunk (rows of x, with ids); floor: scores that they must reach."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int):
        self.x, self.ids, self.k, self.floor = x, ids, k, floor
        self.best = np.full((len(x), k), -np.inf)
        self.which = np.full((len(x), k), -1, np.int64)
        self.least = floor.copy()
        self.tree = _tree(x)

    def _compare(self, a: int, b: int, data: CoverTree, data_ids: np.ndarray) -> None:
        qi, ri, k = self.tree.members[a], data.members[b], self.k
        s = self.x[qi] @ data.x[ri].T
        s[self.ids[qi][:, None] == data_ids[ri][None, :]] = -np.inf
        worst = self.least[qi]
        if s.shape[1] > k:
            worst = np.maximum(worst, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        row, col = np.nonzero((s >= worst[:, None]) & (s > -np.inf))
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        own = qi[touched]
        old = self.best[own] > -np.inf
        r = np.concatenate((np.nonzero(old)[0], row))
        v = np.concatenate((self.best[own][old], s[touched[row], col]))
        i = np.concatenate((self.which[own][old], data_ids[ri[col]]))
        order = np.lexsort((i, -v, r))
        r, v, i = r[order], v[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        self.best[own], self.which[own] = -np.inf, -1
        self.best[own[r[keep]], rank[keep]] = v[keep]
        self.which[own[r[keep]], rank[keep]] = i[keep]
        self.least[own] = np.maximum(self.floor[own], self.best[own, -1])

    def _bound(self, a: int, b: int, data: CoverTree) -> float:
        q = self.tree
        c, d = q.centre[a], data.centre[b]
        top = float(self.x[c] @ data.x[d]) + q.radius[a] * data.norm[d] + data.radius[b] * q.norm[c] + q.radius[a] * data.radius[b]
        return top + 1e-6 * (1 + abs(top))

    def walk(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Takes the rows of x into account."""
        q, data = self.tree, CoverTree(x)
        stack = [(self._bound(q.root, data.root, data), q.root, data.root)]
        while stack:
            top, a, b = stack.pop()
            if top < self.least[q.members[a]].min():
                continue
            qa, rb = q.children[a], data.children[b]
            if not qa and not rb:
                self._compare(a, b, data, ids)
                continue
            split_query = qa and (not rb or q.radius[a] > data.radius[b])
            pairs = [(c, b) for c in qa] if split_query else [(a, d) for d in rb]
            stack += sorted((self._bound(c, d, data), c, d) for c, d in pairs)  # the most promising pair is walked first

    def found(self) -> list[tuple[int, int, int]]:
        a, b = np.nonzero(self.best > -np.inf)
        return list(zip(self.ids[a].tolist(), self.which[a, b].tolist(), self.best[a, b].astype(np.int64).tolist()))


_TREES: dict[int, tuple[np.ndarray, CoverTree]] = {}


def _tree(x: np.ndarray) -> CoverTree:
    """The tree over a chunk of queries, made once by a worker: the array is the chunk's own and is the same in all its tasks."""
    if id(x) not in _TREES or _TREES[id(x)][0] is not x:
        _TREES.clear()
        _TREES[id(x)] = x, CoverTree(x)
    return _TREES[id(x)][1]


def _whole(x: np.ndarray) -> list[list[int]]:
    one = lambda v: int(np.floor(v * 256)) if abs(v) < 2.0**60 else int(v) * 256
    return [[one(v) for v in row] for row in x.tolist()]


def _clip(s: int) -> int:
    return max(-(2**63), min(2**63 - 1, s))


def large_pairs(queries: np.ndarray, ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The best k rows of each query, from components as given, some of them too large for exact doubles.

    Doubles with a bound on their error choose what is multiplied out in integers."""
    out, dim = [], queries.shape[1]
    scale = lambda x: np.exp2(np.floor(np.log2(np.maximum(np.abs(x).max(1, initial=0), 1.0))))[:, None]
    sq, sd = scale(queries), scale(data)
    q, d = queries / sq, data / sd
    with np.errstate(over="ignore", invalid="ignore"):
        unit = 65536.0 * sq * sd.T
        near = np.nan_to_num(q @ d.T * unit, nan=0.0, posinf=1e300, neginf=-1e300)
        # rounding of the doubles, and the floor, which moves a component by less than 1 / 256
        rounded = (np.abs(q) @ np.abs(d).T) * unit * (2.0**-52 * (dim + 4))
        floored = 256.0 * (sq * np.abs(q).sum(1, keepdims=True) + (sd * np.abs(d).sum(1, keepdims=True)).T) + dim + 1
        error = np.nan_to_num((rounded + floored) * 1.001, nan=np.inf, posinf=np.inf)
        low, high = np.clip(near - error, -(2.0**63), 2.0**63), np.clip(near + error, -(2.0**63), 2.0**63)
    whole: dict[int, list[int]] = {}
    for n, i in enumerate(ids.tolist()):
        own = np.flatnonzero(data_ids != i)
        worst = np.sort(low[n, own])[-k] if len(own) > k else -np.inf
        own = own[high[n, own] >= worst].tolist()
        for j in own:
            if j not in whole:
                whole[j] = _whole(data[j : j + 1])[0]
        x = _whole(queries[n : n + 1])[0]
        scored = sorted((-_clip(sum(a * b for a, b in zip(x, whole[j]))), int(data_ids[j])) for j in own)
        out += [(i, j, -s) for s, j in scored[:k]]
    return out


@lru_cache(4)
def _limit(dim: int) -> float:
    """Components below it have exact products in doubles."""
    return np.sqrt(2.0**53 / max(1, dim)) - 1


def _clean(df: DataFrame) -> DataFrame:
    value = F.col("embedding").cast("array<double>")
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("v")).where(fine & F.col("vec_id").isNotNull())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _round(data: DataFrame, chunk, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: up to k rows a query and task. chunk: a broadcast of {dim: (small x, ids, floor, large x, ids)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = chunk.value
        searches = {dim: Search(x, ids, floor, k) for dim, (x, ids, floor, _, _) in asked.items() if len(ids)}
        held: dict[int, list] = {}

        def flush(dim: int) -> list[tuple[int, int, int]]:
            x, ids = (np.concatenate(c) for c in zip(*held.pop(dim)))
            small_q, small_ids, _, large_q, large_ids = asked[dim]
            fits = np.abs(x * 256.0).max(1, initial=0) < _limit(dim)
            if fits.any() and dim in searches:
                searches[dim].walk(np.floor(x[fits] * 256.0), ids[fits])
            out = []
            if len(large_ids):
                out += large_pairs(large_q, large_ids, x, ids, k)
            if not fits.all() and len(small_ids):
                out += large_pairs(small_q / 256.0, small_ids, x[~fits], ids[~fits], k)
            return out

        def batch_of(rows) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            v = batch.column("v")
            dims = np.diff(v.offsets.to_numpy())
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                if dim not in asked:
                    continue
                on = dims == dim
                for first in range(0, int(on.sum()), block):
                    rows = np.flatnonzero(on)[first : first + block]
                    held.setdefault(dim, []).append((_matrix(v.take(pa.array(rows)), dim) if dim else np.zeros((len(rows), 0)), ids[rows]))
                    if sum(len(c) for _, c in held[dim]) >= block:
                        yield batch_of(flush(dim))
        for dim in list(held):
            yield batch_of(flush(dim))
        for s in searches.values():
            yield batch_of(s.found())

    return data.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chunk(rows: list, floor: dict[int, int]) -> dict:
    """The queries by length; the small ones in units of 1 / 256, with the score that their best rows must reach."""
    by: dict[int, list] = {}
    for i, v in rows:
        by.setdefault(len(v), []).append((i, v))
    out = {}
    for dim, own in by.items():
        ids = np.array([i for i, _ in own], np.int64)
        x = np.array([v for _, v in own], np.float64).reshape(len(own), dim)
        fits = np.abs(x * 256.0).max(1, initial=0) < _limit(dim)
        least = np.array([floor.get(int(i), -np.inf) for i in ids[fits]], np.float64)
        out[dim] = np.floor(x[fits] * 256.0), ids[fits], least, x[~fits], ids[~fits]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, data_block: int = 4_096, query_bytes: int = 32 << 20, first_round: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables have vec_id and embedding (array of numbers)."""
    data, asked = _clean(vectors), _clean(queries).distinct()
    context = vectors.sparkSession.sparkContext
    volume = asked.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    chunks = max(1, -(-volume // query_bytes))
    if chunks > 1:
        asked = cut(asked.withColumn("c", F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks))))
    found = None
    for c in range(chunks):
        # about query_bytes, the bound of what the driver holds and sends
        rows = [(r[0], r[1]) for r in (asked.where(F.col("c") == c) if chunks > 1 else asked).select("vec_id", "v").collect()]
        sample = data.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(first_round)) == 0)
        first = _best(_round(sample, context.broadcast(_chunk(rows, {})), k, data_block), k)
        # a query with k rows has a k-th score; of an id with several vectors the score may be another vector's
        known = first.where(F.col("rank") == k).select("query_id", "score").collect() if first_round > 1 else []
        shared = {i for i, n in _counts(rows).items() if n > 1}
        floor = {r[0]: r[1] for r in known if r[0] not in shared}
        own = _round(data, context.broadcast(_chunk(rows, floor)), k, data_block)
        own = cut(_best(own, k).drop("rank")) if chunks > 1 else own
        found = own if found is None else found.unionByName(own)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _counts(rows: list) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, _ in rows:
        out[i] = out.get(i, 0) + 1
    return out


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: rows whose id is divisible by 50 against all rows of ``embeddings``."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(table, table.where(F.col("vec_id") % 50 == 0))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
