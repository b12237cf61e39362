import hashlib
import random

import numpy as np

from tallyloom.llm import suffix_dedup

from .helpers import ODD_TEXTS, docs


def test_suffix_array():
    rnd = random.Random(4)
    for n in [0, 1, 2, *(rnd.randrange(3, 60) for _ in range(400))]:
        s = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(n)]
        assert suffix_dedup.suffix_array(s) == sorted(range(n), key=lambda i: s[i:])


def brute(texts, width=50):
    first = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = []
    for d, b in enumerate(data):
        drop = [False] * len(b)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                drop[i : i + width] = [True] * width
        spans = sum(x and (i == 0 or not drop[i - 1]) for i, x in enumerate(drop))
        kept = bytes(x for x, y in zip(b, drop) if not y)
        out.append((len(b), sum(drop), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_remove_repeats_matches_brute_force(spark):
    rnd = random.Random(6)
    syllables = ["the ", "of ", "ing", "ßü", "é", "and ", "a", "b ", "\U0001f600", "\n"]
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    passages = [word(rnd.choice([14, 20, 40, 90])) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [word(rnd.randrange(0, 40)) for _ in range(rnd.randrange(0, 4))]
        parts += rnd.sample(passages, rnd.randrange(0, 3))
        rnd.shuffle(parts)
        texts.append("".join(parts))
    texts += [texts[5], texts[7], "ab" * 100, "ab" * 60 + "c", "x" * 49, "x" * 50, "x" * 51, "x" * 300, *ODD_TEXTS]
    for block in (1 << 20, 3000):
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts), block_bytes=block).collect()}
        for i, want in enumerate(brute(texts)):
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
    assert suffix_dedup.remove_repeats(docs(spark, [])).collect() == []


def test_ids_are_packed():
    for ids in ([5], [0, 2**32 - 1, 7], [0, 2**32], [-3, 4], [-(2**63), 2**63 - 1, 0], [2**63 - 1]):
        a = np.array(ids, np.int64)
        assert suffix_dedup._unpack_ids(suffix_dedup._pack_ids(a), len(a)).tolist() == ids


def test_counts_are_split():
    text = np.repeat([3, 5, 9], [4, 11, 1])
    for most in (1, 3, 4, 100):
        t, n = suffix_dedup._counted(text, most)
        assert n.max() <= most and np.array_equal(np.repeat(t, n), text)


def test_long_runs_of_one_byte(spark):
    texts = ["y" + "x" * 70_000, "x" * 69_000 + "z", "ab" * 40_000]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept) for i in (0, 1, 2)] == [(0, 0, texts[0]), (69_000, 1, "z"), (0, 0, texts[2])]


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in suffix_dedup.op7_suffix_dedup(spark, sf_dir).collect()}
    for row, want in zip(table, brute([r.text for r in table])):
        r = got[row.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
