"""Exact substring deduplication: bytes covered by a ``width``-byte string that an earlier document holds go.

1. Every text gives anchors: positions whose hashed ``gram``-byte string is the
   smallest of some window. Equal windows have their anchor at the same place,
   so two documents can share a window only if they share its anchor. An
   anchor's context is the stretch that holds all windows whose smallest string
   it is. Packed hashes of anchors, contexts and their middle parts are shuffled.
2. A context that no other of its anchor can share a window with, since none of
   its middle parts (``SPLITS``) is another's, gives its copies the smallest id
   that holds it. The bytes of the others are sent, once a block of documents.
3. Contexts of one anchor are suffix-sorted together. Runs of suffixes that agree
   in ``width`` bytes are equal windows; each gets the smallest id of its run.
4. Back at the documents, windows with a smaller id than their document's are cut.

The suffix array is built by grouping (``suffix_array``): suffixes are sorted
into groups of equal Lyndon prefix, from the greatest group down, each group
extending the prefixes of its suffixes' previous smaller suffixes; then the
groups' order follows from left to right. Nothing is renamed and sorted again.

Documents are dealt into blocks by id, anchors into buckets by hash; both grow
in number with the input, not in size.

Defined results: null is empty; matches within a document do not count; windows
are judged on the input; rows that share a doc_id count as one document; rows
without doc_id are kept whole and give nothing to others; texts shorter than
``width`` are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .checkpoint import cut, release
from .text import _powers, buffers, mix, prefix_hash, range_hash, slices


def suffix_array(s: Sequence) -> list[int]:
    """Start positions of all suffixes in lexicographic order.

    Each suffix is looked at once in its group and moved once for each time its prefix grows. Groups form a linked list in order of their Lyndon prefixes, first of one symbol each."""
    n = len(s)
    symbols = sorted(set(s))
    members: list[set[int]] = [set() for _ in symbols]
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in s]
    for i, g in enumerate(group):
        members[g].add(i)
    before = list(range(-1, len(symbols) - 1))
    after = [*range(1, len(symbols)), -1]
    done = [False] * len(symbols)
    previous = [-1] * n
    g = len(symbols) - 1
    while g >= 0:
        done[g] = True
        if len(members[g]) == 1:
            (i,) = members[g]
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[i] = p
            if p >= 0 and len(members[h := group[p]]) > 1:  # alone in its group, it stays where it is
                new = len(members)
                members[h].discard(p)
                members.append({p})
                done.append(False)
                before.append(h)
                after.append(after[h])
                if after[h] >= 0:
                    before[after[h]] = new
                after[h] = group[p] = new
            g = before[g]
            continue
        times: dict[int, int] = {}
        for i in sorted(members[g]):  # ascending, so that pointers of the same group are there already
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moved.setdefault((group[p], k), []).append(p)
        for (h, k), own in sorted(moved.items(), key=lambda x: -x[0][1]):  # the most repetitions end up greatest
            new = len(members)
            members.append(set(own))
            members[h].difference_update(own)
            done.append(False)
            before.append(h)
            after.append(after[h])
            if after[h] >= 0:
                before[after[h]] = new
            after[h] = new
            for p in own:
                group[p] = new
        g = before[g]
    # groups in ascending order get their places; the suffix after the last symbol is the smallest
    first = g = next((x for x in range(len(before)) if before[x] < 0), -1)
    place, at = [0] * len(before), 0
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = after[g]
    out, placed = [-1] * n, [False] * n

    def settle(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = True
            out[place[group[j]]] = j
            place[group[j]] += 1
            j = previous[j]

    settle(n - 1)
    for i in range(n):
        settle(out[i] - 1)
    return out


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w consecutive entries."""
    s = 1
    while s * 2 <= w:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (w - s)], a[w - s :]) if w > s else a


def _grams(p: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes at every place; p is the buffer's prefix hash."""
    _, down = _powers(len(p) - 1)
    return mix((p[gram:] - p[:-gram]) * down[: len(p) - gram])


def anchors(p: np.ndarray, at: np.ndarray, width: int, gram: int):
    """(hash, text, first window, last window) of every anchor; windows are start positions in the buffer."""
    empty = np.zeros(0, np.int64)
    if len(p) <= width:
        return empty.astype(np.uint64), empty, empty, empty
    low = _slide(_grams(p, gram), width - gram + 1, np.minimum)  # of the window that begins at each byte
    # windows one after the other that have the same smallest string share an anchor; a text's last bytes begin none
    new = np.ones(len(low) + 1, bool)
    new[1:-1] = low[1:] != low[:-1]
    heads, stops = at[:-1], np.maximum(at[1:] - width + 1, at[:-1])
    new[heads[heads < len(low)]] = True
    new[stops[stops < len(low)]] = True
    first = np.flatnonzero(new)
    first, last = first[:-1], first[1:] - 1
    text = np.searchsorted(at, first, "right") - 1
    inside = first < stops[text]
    first, last, text = first[inside], last[inside], text[inside]
    return low[first], text, first, last


def places(p: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Where each anchor stands in its context; -1 if twice."""
    out = np.full(len(h), -1)
    if not len(h):
        return out
    grams = _grams(p, gram)
    times = np.zeros(len(h), np.int64)
    w = width - gram + 1
    times[last - first >= w] = 2  # one place lies in w windows at most
    order = np.argsort(first - last, kind="stable")
    order = order[times[order] == 0]  # the longest first
    short, begin, h = (first - last)[order], first[order], h[order]
    for i in range(2 * w - 1):
        n = int(np.searchsorted(short, w - 1 - i, "right"))
        on = order[:n][grams[begin[:n] + i] == h[:n]]
        out[on] = first[on] + i
        times[on] += 1
    out[times > 1] = -1
    return out


#: Middle parts compared before bytes are sent; windows differ in where they hold the anchor, and each part is common to
#: a quarter of them.
SPLITS = 4
#: Bytes of a packed hash of an anchor and of a part. Different ones that look alike only send more contexts to be sorted.
_ANCHOR, _PART = 3, 2
_NONE, _TWICE = 0, (1 << 8 * _PART) - 1  # no such window; the anchor stands twice


def parts(p: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Hashes of the bytes that all windows of a context with the anchor in the same quarter hold; contexts by SPLITS.

    p is the buffer's prefix hash. Contexts with an equal window have an equal part."""
    span = width - gram
    edge = np.linspace(0, span + 1, SPLITS + 1).astype(int).tolist()
    out = np.full((len(first), SPLITS), _NONE, np.int64)
    for i, (x, y) in enumerate(zip(edge[:-1], edge[1:])):  # windows with x to y - 1 bytes before the anchor
        on = np.flatnonzero((place >= 0) & (place - first >= x) & (place - last < y))
        h = range_hash(p, place[on] - x, place[on] + gram + span - (y - 1))
        out[on, i] = 1 + (h % np.uint64(_TWICE - 1)).astype(np.int64)
    out[place < 0] = _TWICE
    return out


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are minima and crowd near zero: they are mixed before they are dealt."""
    return (mix(h) >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """As ``_block_column``."""
    u = ids.astype(np.int64).view(np.uint64)
    return ((u ^ u >> np.uint64(13) ^ u >> np.uint64(29)).view(np.int64) % blocks).astype(np.int64)


def _block_column(blocks: int) -> Column:
    """The block of a document; folded, so that ids in steps of the number of blocks do not meet in one."""
    c = F.col("doc_id")
    folded = c.bitwiseXOR(F.shiftrightunsigned(c, 13)).bitwiseXOR(F.shiftrightunsigned(c, 29))
    return F.pmod(folded, F.lit(blocks)).cast("int")


def _pack(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of each."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize)[:, :n]).tobytes()


def _unpack(data: list[bytes], n: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, n)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :n] = raw
    return out.view(np.uint64).reshape(-1)


def _pack_parts(x: np.ndarray) -> bytes:
    """Which parts there are, a bit each, then the low bytes of those."""
    there = x.reshape(-1) != _NONE
    return np.packbits(there).tobytes() + _pack(x.reshape(-1)[there], _PART)


def _unpack_parts(data: bytes, n: int) -> np.ndarray:
    head = (n * SPLITS + 7) // 8
    there = np.unpackbits(np.frombuffer(data, np.uint8, head), count=n * SPLITS).astype(bool)
    out = np.full(n * SPLITS, _NONE, np.int32)
    out[there] = _unpack([data[head:]], _PART).astype(np.int32)
    return out.reshape(-1, SPLITS)


def _pack_ids(ids: np.ndarray) -> bytes:
    """The smallest, then each one's distance from it, in four bytes if that is enough for all."""
    low = ids.min()
    far = (ids - low).view(np.uint64)  # modulo 2**64, as it is added again
    return low.tobytes() + far.astype("<u4" if far.max() < 1 << 32 else "<u8").tobytes()


def _unpack_ids(data: bytes, n: int) -> np.ndarray:
    low, size = np.frombuffer(data, np.int64, 1)[0], (len(data) - 8) // n
    return np.frombuffer(data, f"<u{size}", n, 8).astype(np.uint64).view(np.int64) + low


def _counted(text: np.ndarray, most: int = (1 << 16) - 1) -> tuple[np.ndarray, np.ndarray]:
    """The different texts and how many entries each has; one with over ``most`` stands several times."""
    t, n = np.unique(text, return_counts=True)
    more = (n - 1) // most
    if more.any():
        last = np.cumsum(more + 1) - 1
        t, full = np.repeat(t, more + 1), np.full(int(last[-1]) + 1, most)
        full[last] = n - more * most
        n = full
    return t, n


def _bucketed(docs: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """bucket, packed hashes of anchors, contexts and parts, ids of the documents and how many each has: a row per bucket and batch."""

    def run(batches):
        for batch in slices(batches, "text", 3 << 20):
            ids, n, found = batch.column("doc_id").to_numpy(zero_copy_only=False), 0, []
            for piece in slices(iter([batch]), "text", 1 << 18):  # small enough for the processor's cache
                raw, at = buffers(piece.column("text"))
                p = prefix_hash(raw)
                h, text, first, last = anchors(p, at, width, gram)
                part = parts(p, first, last, places(p, h, first, last, width, gram), width, gram)
                found.append((h, text + n, _context_keys(p, h, first, last + width), part.astype(np.int32)))
                n += piece.num_rows
            if not found:
                continue
            h, text, keys, part = (np.concatenate(x) for x in zip(*found))
            bucket = _bucket_of(h, buckets)
            order = np.argsort(bucket, kind="stable")  # texts stay in order
            h, text, bucket, keys, part = h[order], text[order], bucket[order], keys[order], part[order]
            rows = []
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
            for a, b in zip(edges[:-1], edges[1:]):
                t, n = _counted(text[a:b])
                packed = _pack(h[a:b], _ANCHOR), keys[a:b].tobytes(), _pack_parts(part[a:b])
                rows.append((int(bucket[a]), *packed, _pack_ids(ids[t]), n.astype("<u2").tobytes()))
            cols = list(zip(*rows)) or [()] * 6
            names = ["bucket", "hashes", "keys", "parts", "ids", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(cols)], names)

    return docs.mapInArrow(run, "bucket int, hashes binary, keys binary, parts binary, ids binary, counts binary")


def may_share(anchor: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Contexts (sorted by anchor number) that may share a window with another of their anchor."""
    out = np.zeros(len(anchor), bool)
    size = np.bincount(anchor) if len(anchor) else np.zeros(0, np.int64)
    many = np.flatnonzero(size[anchor] > 1)
    for i in range(SPLITS):
        own = many[part[many, i] != _NONE]
        _, back, times = np.unique(anchor[own].astype(np.int64) << 8 * _PART | part[own, i], return_inverse=True, return_counts=True)
        out[own[times[back] > 1]] = True
    # windows may use either place of an anchor that stands twice: all contexts of it are sorted
    twice = np.zeros(len(size), bool)
    twice[anchor[part[:, 0] == _TWICE]] = True
    out[many] |= twice[anchor[many]]
    return out


def _split(blocks: np.ndarray):
    """(block, places) of every block."""
    order = np.argsort(blocks, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(blocks[order], prepend=-1)), len(blocks))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(blocks[order[a]]), order[a:b]


def _shared(bucketed: DataFrame, blocks: int) -> DataFrame:
    """block, wanted (contexts whose bytes are needed) and keys and lows of contexts that are settled.

    Settled contexts go only to blocks where a later document than the smallest holds them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, keys = _unpack(pdf["hashes"], _ANCHOR), np.frombuffer(b"".join(pdf["keys"]), "<u8")
        ids = np.concatenate([np.repeat(_unpack_ids(i, len(n) // 2), np.frombuffer(n, "<u2")) for i, n in zip(pdf["ids"], pdf["counts"])])
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
        size = np.diff(np.append(first, len(h)))
        many = np.minimum.reduceat(ids[order], first) != np.maximum.reduceat(ids[order], first)
        many, anchor = np.repeat(many, size), np.repeat(np.cumsum(many, dtype=np.int32) - 1, size)
        order, anchor = order[many], anchor[many]
        keys, ids = keys[order], ids[order]
        del h, first, size, many
        part = np.concatenate([_unpack_parts(x, len(a) // _ANCHOR) for x, a in zip(pdf["parts"], pdf["hashes"])])[order]
        order = np.lexsort((ids, keys, anchor))
        anchor, keys, ids, part = anchor[order], keys[order], ids[order], part[order]
        head = np.ones(len(keys), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (keys[1:] != keys[:-1])
        one, context = np.flatnonzero(head), np.cumsum(head) - 1
        may = may_share(anchor[one], part[one])[context]
        low = ids[one][context]
        rows: dict[int, list[bytes]] = {}
        for block, k in _split(_block_of(ids, blocks)[may]):
            rows.setdefault(block, [b""] * 3)[0] = np.unique(keys[may][k]).tobytes()
        later = ~may & (ids > low)
        for block, k in _split(_block_of(ids, blocks)[later]):
            own, at = np.unique(keys[later][k], return_index=True)
            rows.setdefault(block, [b""] * 3)[1:] = own.tobytes(), low[later][k][at].astype("<i8").tobytes()
        return pd.DataFrame([(b, *x) for b, x in rows.items()], columns=["block", "wanted", "keys", "lows"])

    return bucketed.groupBy("bucket").applyInPandas(run, "block int, wanted binary, keys binary, lows binary")


def _block_anchors(texts: pa.Table, width: int, gram: int):
    """(raw, offsets, prefix hash, documents, anchors) of a block, some MB at a time."""
    for batch in slices(iter(texts.combine_chunks().to_batches()), "text", 1 << 18):
        raw, at = buffers(batch.column("text"))
        p = prefix_hash(raw)
        yield raw, at, p, batch, anchors(p, at, width, gram)


def _context_keys(p: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the contexts from a to b and their anchors; p is the buffer's prefix hash."""
    _, down = _powers(len(p) - 1)
    return mix(((p[b] - p[a]) * down[a] ^ mix((b - a).astype(np.uint64))) + mix(h))


def _held(sorted_list: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which x are in sorted_list."""
    if not len(sorted_list):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_list, x)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == x


def _contexts(docs: DataFrame, wanted: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """bucket, block, anchor hash, context and its smallest document, each context once a block."""

    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "block", "anchors", "sizes", "contexts", "keys", "lows", "places"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        rows = []
        if texts.num_rows and found.num_rows:
            wanted = np.unique(np.frombuffer(b"".join(found.column("wanted").to_pylist()), "<u8"))
            pieces, base = [], 0
            for raw, _, p, batch, (h, text, a, b) in _block_anchors(texts, width, gram):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                keys = _context_keys(p, h, a, b + width)
                on = _held(wanted, keys)
                h, a, b = h[on], a[on], b[on]
                place = places(p, h, a, b, width, gram)
                pieces.append((h, ids[text[on]], a + base, b + width + base, keys[on], np.where(place < 0, -1, place - a)))
                base += len(raw)
            h, doc, a, b, keys, place = (np.concatenate(x) for x in zip(*pieces))
            raw, _ = buffers(texts.column("text"))
            order = np.lexsort((doc, keys))
            one = order[np.append(True, np.diff(keys[order]) != 0)] if len(order) else order
            h, doc, a, b, keys, place = h[one], doc[one], a[one], b[one], keys[one], place[one]
            bucket = _bucket_of(h, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(h))
            for x, y in zip(edges[:-1], edges[1:]):
                own = order[x:y]
                size = b[own] - a[own]
                ends = np.cumsum(size)
                take = np.arange(ends[-1]) - np.repeat(ends - size - a[own], size)
                rows.append((int(bucket[own[0]]), int(key[0].as_py()), h[own].tobytes(), size.astype("<i4").tobytes(), raw[take].tobytes(), keys[own].tobytes(), doc[own].astype("<i8").tobytes(), place[own].astype("<i2").tobytes()))
        cols = list(zip(*rows)) or [()] * 8
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "bucket int, block int, anchors binary, sizes binary, contexts binary, keys binary, lows binary, places binary"
    return docs.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, schema)


def window_lows(contexts: list[bytes], lows: list[int], width: int, gram: int = 1, at: list[int] | None = None) -> list[list[int]]:
    """For every context the smallest id of each of its windows, by one suffix array over all of them.

    at: where the anchor, the same ``gram`` bytes in all, stands in each. Every window holds it once, so it is sorted
    as one symbol, which leaves the windows equal that were."""
    texts = [c.decode("latin-1") for c in contexts]
    if at is not None:
        texts = [c[:i] + "\u0100" + c[i + gram :] for c, i in zip(texts, at)]
        width -= gram - 1
    data = "".join(texts)
    begin, owner, last_window = [], [], []
    for i, c in enumerate(texts):
        begin.append(len(owner))
        last_window += [len(owner) + len(c) - width] * len(c)
        owner += [i] * len(c)
    out = [[low] * (len(c) - width + 1) for c, low in zip(texts, lows)]
    run: list[tuple[int, int]] = []
    last = None

    def close() -> None:
        if len(run) > 1:
            low = min(lows[c] for c, _ in run)
            for c, i in run:
                out[c][i] = low

    for p in suffix_array(data):
        if p > last_window[p]:
            continue
        c = owner[p]
        i = p - begin[c]
        here = data[p : p + width]
        if here != last:
            close()
            run, last = [], here
        run.append((c, i))
    close()
    return out


def _resolve(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """block, context keys, windows from and to, and their smallest document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
        h, size, keys, lows = whole("anchors", "<u8"), whole("sizes", "<i4").astype(np.int64), whole("keys", "<u8"), whole("lows", "<i8")
        place = whole("places", "<i2")
        block = np.repeat(pdf["block"].to_numpy(), [len(x) // 8 for x in pdf["keys"]])
        raw = b"".join(pdf["contexts"])
        begin = np.cumsum(size) - size
        order = np.lexsort((lows, keys, h))
        hs, ks = h[order], keys[order]
        head = np.append(True, (hs[1:] != hs[:-1]) | (ks[1:] != ks[:-1]))
        one = order[head]  # each context once, with its smallest document
        context_of = np.empty(len(order), np.int64)
        context_of[order] = np.cumsum(head) - 1
        group = np.append(np.flatnonzero(np.diff(h[one], prepend=h[one][:1] + np.uint64(1))), len(one))
        context, start, stop, low = [], [], [], []
        for x, y in zip(group[:-1].tolist(), group[1:].tolist()):
            own = one[x:y]
            texts = [raw[begin[i] : begin[i] + size[i]] for i in own.tolist()]
            at = place[own].tolist() if (place[own] >= 0).all() else None
            for c, found in zip(range(x, y), window_lows(texts, lows[own].tolist(), width, gram, at)):
                edge = [0, *(i for i in range(1, len(found)) if found[i] != found[i - 1]), len(found)]
                for s, e in zip(edge[:-1], edge[1:]):
                    context.append(c)
                    start.append(s)
                    stop.append(e)
                    low.append(found[s])
        context, start, stop, low = (np.array(x, np.int64) for x in (context, start, stop, low))
        # back to every block that sent the context
        by = np.argsort(context, kind="stable")
        context, start, stop, low = context[by], start[by], stop[by], low[by]
        rows = []
        for b in np.unique(block).tolist():
            wanted = np.unique(context_of[block == b])
            a, z = np.searchsorted(context, wanted), np.searchsorted(context, wanted, "right")
            take = np.concatenate([np.arange(i, j) for i, j in zip(a.tolist(), z.tolist())])
            rows.append((b, keys[one][context[take]].tobytes(), start[take].astype("<i4").tobytes(), stop[take].astype("<i4").tobytes(), low[take].astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["block", "keys", "starts", "stops", "lows"])

    return contexts.groupBy("bucket").applyInPandas(run, "block int, keys binary, starts binary, stops binary, lows binary")


def _cut(docs: DataFrame, resolved: DataFrame, width: int, gram: int, texts_out: bool) -> DataFrame:
    """What is left of the documents (block, doc_id, text and, with ``texts_out``, row)."""

    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        if found.num_rows:
            column = lambda c, t: np.frombuffer(b"".join(found.column(c).to_pylist()), t)
            fk, fs, fe, fl = column("keys", "<u8"), column("starts", "<i4"), column("stops", "<i4"), column("lows", "<i8")
            order = np.argsort(fk, kind="stable")
            fk, fs, fe, fl = fk[order], fs[order].astype(np.int64), fe[order].astype(np.int64), fl[order]
        out = [pa.table([pa.array([], k) for k in kinds[:5]] + [texts.column(c).slice(0, 0) for c in carried], names)]
        for raw, at, p, batch, (h, text, a, b) in _block_anchors(texts, width, gram) if texts.num_rows else ():
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            gone = np.zeros(len(raw) + 1, np.int32)
            if found.num_rows:
                keys = _context_keys(p, h, a, b + width)
                x, y = np.searchsorted(fk, keys), np.searchsorted(fk, keys, "right")
                size = y - x
                ends = np.cumsum(size)
                take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - x, size)
                base, doc, whole = np.repeat(a, size), np.repeat(ids[text], size), np.repeat(b - a + 1, size)
                lost = fl[take] < doc
                np.add.at(gone, (base + fs[take])[lost], 1)
                np.add.at(gone, (base + np.where(fe[take] < 0, whole, fe[take]) - 1 + width)[lost], -1)
            drop = np.cumsum(gone)[:-1] > 0
            begins = drop.copy()
            begins[1:] &= ~drop[:-1]
            heads = at[:-1][np.diff(at) > 0]
            begins[heads] = drop[heads]
            removed, spans = (np.diff(np.concatenate(([0], np.cumsum(x)))[at]) for x in (drop, begins))
            sha, kept = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                left = raw[i:j][~drop[i:j]].tobytes()
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if texts_out else None)
            columns = [pa.array(ids, pa.int64()), pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array(sha)]
            columns += [pa.array(kept, pa.string()), batch.column("row")] if texts_out else []
            out.append(pa.table(columns, names))
        return pa.concat_tables(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    carried = ["text", "row"] if texts_out else []
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "row"] if texts_out else [])]
    schema = StructType([StructField(n, StringType() if n == "kept_sha256" else LongType()) for n in names[:5]])
    if texts_out:
        schema = schema.add("kept", StringType()).add("row", docs.schema["row"].dataType)
    columns = ["block", "doc_id", "text", *carried[1:]]
    return docs.select(*columns).groupBy("block").cogroup(resolved.groupBy("block")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 24, block_bytes: int = 8 << 20, texts_out: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, the remaining text, and row of every document.

    kept leaves out bytes that a cut inside a character makes invalid; the digest is of all remaining bytes. row has
    the table's other columns as they were and text_is_null; without ``texts_out`` kept and row are left out."""
    whole = F.coalesce("text", F.lit("")).alias("text")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.col("text").isNull().alias("text_is_null")).alias("row")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole, *([row] if texts_out else []))
    known = source.where(F.col("doc_id").isNotNull())
    volume = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, int(volume) // block_bytes) | 1
    dealt = known.withColumn("block", _block_column(blocks))
    # a bucket a block bounds what one task holds of the anchors
    shared = cut(_shared(_bucketed(known.select("doc_id", "text"), width, gram, blocks), blocks))
    release(docs.sparkSession)
    wanted = shared.where(F.octet_length("wanted") > 0).select("block", "wanted")
    resolved = cut(_resolve(_contexts(dealt.select("block", "doc_id", "text"), wanted, width, gram, blocks), width, gram))
    release(docs.sparkSession)
    # of a settled context all windows have one smallest document: stop -1
    n = (F.octet_length("keys") / 8).cast("int")
    ends = [F.unhex(F.repeat(F.lit(x), n)).alias(c) for c, x in (("starts", "0" * 8), ("stops", "F" * 8))]
    settled = shared.where(F.octet_length("keys") > 0).select("block", "keys", *ends, "lows")
    out = _cut(dealt, resolved.unionByName(settled), width, gram, texts_out)
    rest = source.where(F.col("doc_id").isNull())
    zero = F.lit(0).cast("bigint")
    return out.unionByName(
        rest.select(
            "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
            F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept"), F.col("row")] if texts_out else []),
        )
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of ``remove_repeats`` over whole ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts_out=False)
