import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyloom.llm import collocations

from .helpers import LOWER, ODD_TEXTS

PIECE = re.compile("[.,;:!?\n\x0b\x0c\r]")


def plain(rows, max_words=4, least=30, covered=80, top=2000):
    """Counts of all n-grams, all cuts, all longer phrases."""
    out = {}
    named = lambda x: "und" if x is None else x
    for lang in {named(x) for x, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if named(own) == lang:
                for piece in PIECE.split((text or "").translate(LOWER)):
                    w = [x for x in re.split("[ \t]+", piece) if x]
                    n += len(w)
                    f.update(tuple(w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
        known = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in known.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in known.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), a, f[g[:k]], f[g[k:]], n, score))
        out |= {(lang, i): (x[2].decode(), *x[3:]) for i, x in enumerate(sorted(kept)[:top], 1)}
    return out


def mined(spark, rows, parts=3, **how):
    docs = spark.createDataFrame([(i, x, t, 1, "p") for i, (x, t) in enumerate(rows)], "rank bigint, lang string, text string, n int, phrase string").repartition(parts)
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, **how).collect()}


def some_rows(seed=4, n=160):
    rng = np.random.default_rng(seed)
    vocab = ["the", "of", "New", "york", "CITY", "state", "été", "a b", "x\x00y", "\x1cz"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "!\n", "\x0b", " ? "]
    text = lambda: "".join(rng.choice(vocab, p=[0.25, 0.15, 0.2, 0.2, 0.05, 0.05, 0.03, 0.03, 0.02, 0.02]) + rng.choice(marks) for _ in range(rng.integers(0, 60)))
    rows = [(str(rng.choice(["en", "fr"])) if rng.random() < 0.9 else None, text()) for _ in range(n)]
    return [*rows, *[("en", "New York City state of the art")] * 40, *[("de", "eins zwei drei vier fünf " * 3)] * 11, *[(None, "un deux trois")] * 31, *(("en", t) for t in ODD_TEXTS), ("", "q r " * 40)]


def test_collocations_match_plain_counts(spark):
    rows = some_rows()
    expected = plain(rows)
    assert len(expected) > 30 and len({k for k, _ in expected}) == 5
    assert mined(spark, rows) == expected


def test_other_sizes_and_limits(spark):
    rows = some_rows(9, 60)
    for how in (dict(max_words=2, least=5), dict(max_words=3, least=8, covered=50, top=7), dict(max_words=6, least=6)):
        assert mined(spark, rows, **how) == plain(rows, **how), how


def test_small_shards_parts_and_full_filters(spark, monkeypatch):
    """Shards of a few words, texts taken in parts of a few bytes, a filter that holds nearly everything: the same counts."""
    rows = some_rows(5, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    whole = collocations.shards(docs)
    monkeypatch.setattr(collocations, "PART", 16)
    parted = collocations.shards(docs, 50)
    total = lambda s: {tuple(r) for r in s.groupBy("lang").sum("n").collect()}
    assert total(whole) == total(parted) and parted.count() > 20
    words = collocations.counted(parted, range(1, 2), None, None, 10)
    full = collocations.bloom(words, collocations.phrase_hashes, 64)
    assert full.bits == 64
    for n in (2, 3):
        counted = [{tuple(r) for r in collocations.counted(s, range(n, n + 1), full, seen, 10).collect()} for s, seen in ((whole, None), (parted, full), (parted, None))]
        assert counted[0] == counted[1] == counted[2] and counted[0]


def test_tasks_get_small_batches(spark, monkeypatch):
    """Texts and shards come in batches of a few rows, whatever number the session has, which is left as it was."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    own = spark.conf.get(name)
    for step in ("shards", "likely", "counted"):
        f = getattr(collocations, step)
        monkeypatch.setattr(collocations, step, lambda *a, f=f, step=step: (seen.setdefault(step, set()).add(spark.conf.get(name)), f(*a))[1])
    mined(spark, some_rows(3, 20), 1)
    assert seen == {"shards": {"1000"}, "likely": {"4"}, "counted": {"4"}} and spark.conf.get(name) == own

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    with collocations.small_batches(spark, 4):
        assert [r.n for r in spark.range(0, 10, 1, 1).mapInArrow(sizes, "n bigint").collect()] == [4, 4, 2]


def test_suffix_order_and_intervals_match_sorted_suffixes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        ids = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0).astype(np.int32)
        key = lambda i, k: tuple(np.append(ids[i : i + k], [0] * k)[:k])
        for k in (1, 2, 3, 4, 7):
            if k > 1:
                order = collocations.suffixes(ids, k).tolist()
                assert [key(i, k) for i in order] == sorted(key(i, k) for i in range(len(ids))) and sorted(order) == list(range(len(ids)))
            expected = Counter(key(i, k) for i in range(len(ids) - k + 1) if 0 not in key(i, k))
            for n, place, times in collocations.intervals(ids, range(k, k + 1)):
                assert n == k and dict(zip((key(i, k) for i in place), times.tolist())) == expected


def test_linked_runs():
    ids = np.array([1, 2, 0, 3, 4, 5, 6, 0, 0, 7, 0], np.int32)
    link = (ids[:-1] > 0) & (ids[1:] > 0)
    link[4] = False
    assert collocations.linked(ids, link, 2).tolist() == [1, 2, 0, 3, 4, 0, 5, 6, 0]
    assert collocations.linked(ids, link, 3).tolist() == []


def test_filter_holds_all_it_was_given(spark):
    rows = [("en", f"w{i}") for i in range(500)] + [("fr", f"a{i} b{i}") for i in range(500)]
    f = collocations.bloom(spark.createDataFrame(rows, "lang string, phrase string").repartition(4), collocations.phrase_hashes)
    of = lambda lang, *names: collocations.folded([collocations.hashes(lang, [f"{x}{i}".encode() for i in range(500)]) for x in names])
    assert f.has(of("en", "w")).all() and f.has(of("fr", "a", "b")).all() and f.has(of("fr", "w")).mean() < 0.2


def test_counts_beyond_a_byte(spark):
    """Packed counts: 1000 times a pair in one shard, 29 and 30 times others."""
    rows = [("en", "a b. " * 1000), ("en", "c d. " * 29), ("en", "e f. " * 30)]
    assert {v[0]: v[1] for v in mined(spark, rows).values()} == {"a b": 1000, "e f": 30}
    assert {v[0] for v in mined(spark, rows, least=600).values()} == {"a b"}


def test_nothing(spark):
    assert mined(spark, [], 1) == {} and mined(spark, [(None, None), ("en", "")], 1) == {}


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**12
    phrases = spark.createDataFrame([("en", "a", big + 1), ("en", "b", 3 * big), ("en", "a b", big)], "lang string, phrase string, a bigint")
    assert [tuple(r) for r in collocations.scored(phrases).collect()] == [("en", "a b", big, big + 1, 3 * big, 2_000_000 * big // (4 * big + 1))]


def test_packed_hashes_come_back():
    rng = np.random.default_rng(6)
    for low in (20, 32):
        keys = rng.integers(0, 1 << 40, 5000).astype(np.uint64)
        keys = np.concatenate((keys, keys[:900], np.array([0, 0, (1 << 40) - 1], np.uint64)))
        times = rng.integers(1, 700, len(keys))
        want, got = Counter(), Counter()
        for k, n in zip(keys.tolist(), times.tolist()):
            want[k] += n
        for row in collocations.packed(keys, times, low):
            for k, n in zip(*(x.tolist() for x in collocations.unpacked(*row, low))):
                got[k] += n
        assert got == want
    assert list(collocations.packed(np.zeros(0, np.uint64), np.zeros(0, np.int64), 32)) == []
