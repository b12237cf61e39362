import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from tallyloom.llm import near_dedup, sentence_dedup

from .helpers import ODD_TEXTS, docs, words


def bag(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1) if w else 0))


def brute_classes(texts, threshold=0.8):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            union = sum(bags[i].values()) + sum(bags[j].values()) - both
            if (texts[i] or "") == (texts[j] or "") or union and 1000 * both >= round(1000 * threshold) * union and both:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicate_classes_match_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 40, 150]))]
        for n in range(10):
            own = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 12))):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            texts.append(" ".join(own))
    chain = [f"c{i}" for i in range(200)]  # each step is a link, the ends are not
    texts += [" ".join(chain[i * 12 : i * 12 + 130]) for i in range(6)]
    texts += [" ".join(f"e{i}" for i in range(4 + n)) for n in (28, 35)]  # 28 of 35: exactly at the threshold
    texts += ["a b c d e f g " * 30, "a b c d e f g " * 26, "a b c d e f g " * 10, *ODD_TEXTS]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    none = near_dedup.near_duplicates(docs(spark, []))
    assert none.collect() == []


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = np.arange(1, 400, dtype=np.uint64) * np.uint64(7919)
    u, v = rng.integers(0, 9, len(e)), rng.integers(0, 9, len(e))
    element, weight = np.concatenate((e[u > 0], e[v > 0])), np.concatenate((u[u > 0], v[v > 0]))
    sig = near_dedup.signatures(element, weight, np.array([0, (u > 0).sum(), len(element)]), 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(u, v).sum() / np.maximum(u, v).sum()) < 0.03


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n)], "a bigint, b bigint")
    got = {r.id: r["class"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 if i < n else i for i in range(n + 1)}


def brute_sentences(texts, k=3, least=8):
    import re

    split = [re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", t or "") for t in texts]
    spans = defaultdict(list)
    for d, s in enumerate(split):
        w = [words(x) for x in s]
        for i in range(len(s)):
            stop = next((e for e in range(i + k, len(s) + 1) if sum(map(len, w[i:e])) >= least), None)
            if stop is None and i == 0 and any(w):
                stop = len(s)
            if stop is not None:
                spans[tuple(x for y in w[i:stop] for x in y)].append((d, i, stop))
    gone = [set() for _ in texts]
    for places in spans.values():
        for d, i, stop in sorted(places)[1:]:
            gone[d] |= set(range(i, stop))
    return [(len(s), len(g), "".join(x for i, x in enumerate(s) if i not in g)) for s, g in zip(split, gone)]


def test_sentence_dedup_matches_brute_force(spark):
    rnd = random.Random(8)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7))) + rnd.choice([".", "!\n", "?! "]) for _ in range(25)]
    passage = "".join(f"one{i} two{i} three{i} four{i}. " for i in range(9))
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14))) for _ in range(80)]
    texts += ["Start here. " + passage, passage + "End.", "a. b. " * 40, *ODD_TEXTS, "\n\n...", "é! ü? " * 9]
    table = docs(spark, texts)
    got = {r.doc_id: r for r in sentence_dedup.deduplicate(table).collect()}
    for i, (n, gone, kept) in enumerate(brute_sentences(texts)):
        assert (got[i].n_sentences, got[i].n_removed, got[i].text or "") == (n, gone, kept), i
    assert got[0].source == "s0" and "checks" in got[0].asDict()
    assert sentence_dedup.deduplicate(docs(spark, [])).collect() == []


def test_sentence_query_digest(spark, sf_dir):
    rows = sentence_dedup.op3_sentence_dedup(spark, sf_dir).where("n_removed = 0").limit(20).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows and all(r.kept_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in rows)
