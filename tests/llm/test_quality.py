import itertools
import zlib

import numpy as np
import pyarrow as pa

from tallyloom.llm import quality, sample

from .helpers import ODD_TEXTS, docs, words


def test_quality_held_out(spark, sf_dir):
    got = {r.doc_id: r for r in quality.op11_quality(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(got[i].score, y) for i, y in labels.items() if i in got and got[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.8


def plain_margin(model, text, meta):
    """All pairs one by one, from plain Python features."""
    raw, found = (text or "").encode(), words(text)
    n, size = len(found), max(1, len((text or "").encode()))
    share = [np.sqrt(sum(bool(c[b]) for b in raw) / size) for c in quality.CLASSES.values()]
    again, some = sum(a == b for a, b in zip(found, found[1:])), max(1, n)
    ends, lines = sum(b in b".!?\n" for b in raw), raw.count(b"\n")
    stats = [*share, len(set(found)) / some, again / some, len(raw) / some / 16, np.log1p(n / (1 + ends)) / 6, np.log1p(n / (1 + lines)) / 8, np.log1p(n) / 12]
    x = {}
    for i, s in enumerate(min(1, s) for s in stats):
        low = min(int(s * (quality.KNOTS - 1)), quality.KNOTS - 2)
        x[i * quality.KNOTS + low] = 1 + low - s * (quality.KNOTS - 1)
        x[i * quality.KNOTS + low + 1] = s * (quality.KNOTS - 1) - low
    for i, c in enumerate(model.metadata):
        x[model.start + i * quality.META + int(quality.meta_values(pa.array([meta[c]], pa.int64() if c == "n_chars" else pa.string()))[0])] = 1.0
    from tallyloom.llm.text import hashed_words

    own = set()
    for w in set(found):
        h, _, _ = hashed_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        own |= {int(b) for b in quality.buckets(h, np.array([0, 1]))[1]} & set(model.words.tolist())
    for b in own:
        x[model.start + len(model.metadata) * quality.META + int(np.searchsorted(model.words, b))] = 1 / np.sqrt(len(own))
    return model.bias + sum(model.w[a] * v for a, v in x.items()) + sum(float(model.v[a] @ model.v[b]) * x[a] * x[b] for a, b in itertools.combinations(x, 2))


def test_scores_match_the_explicit_pair_sum(spark):
    from tallyloom.llm.text import hashed_words

    rng = np.random.default_rng(8)
    vocab = ["good", "words", "house", "MENU", "|", "$$$", "12", "water."]
    raw = " ".join(vocab).encode()
    known = np.unique(quality.buckets(*(lambda h: (h, np.array([0, len(h)])))(hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]))[1])
    model = quality.Model(0.1, known, ("n_chars", "source"))
    model.w, model.v = rng.normal(size=model.w.shape), rng.normal(size=model.v.shape) * 0.3
    texts = [*ODD_TEXTS, *(" ".join(rng.choice(vocab + ["other"], rng.integers(0, 12))) for _ in range(40))]
    got = {r.doc_id: r for r in quality.score(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        p = 1 / (1 + np.exp(-np.clip(plain_margin(model, t, {"n_chars": len(t or ""), "source": f"s{i % 3}"}), -40, 40)))
        assert abs(got[i].score - p) < 1e-9, t


def test_training_follows_the_gradient():
    """One step on one example moves each weight against its numeric gradient."""
    model = quality.Model(0.0, np.zeros(0, np.int64))
    at, x = np.array([1, 5, 9]), np.array([0.5, 1.0, 0.25])
    start = np.random.default_rng(17).normal(0, 0.05, model.v.shape)
    quality.train([(at, x, 1)], (1.0, 1.0), model, epochs=1, decay=0.0)

    def loss(w, v):
        own = v[at] * x[:, None]
        return np.log1p(np.exp(-(w[at] @ x + 0.5 * float((own.sum(0) ** 2).sum() - (own * own).sum()))))

    zero, e = np.zeros(len(model.w)), 1e-6
    for i in at:
        step = zero.copy()
        step[i] = e
        assert np.sign(model.w[i]) == -np.sign((loss(step, start) - loss(-step, start)) / 2 / e)
        for f in range(quality.RANK):
            up, down = start.copy(), start.copy()
            up[i, f] += e
            down[i, f] -= e
            assert np.sign(model.v[i, f] - start[i, f]) == -np.sign((loss(zero, up) - loss(zero, down)) / 2 / e)


def test_quality_without_both_classes(spark):
    table = docs(spark, ODD_TEXTS)
    for rows, expected in (([], 0), ([(0, 1), (0, None), (None, 0)], 1), ([(1, 0)], 0)):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        assert {r.predicted for r in quality.score(table, quality.fit(table, labels)).collect()} == {expected}
    assert quality.score(docs(spark, []), quality.fit(docs(spark, []), labels)).collect() == []


def test_odd_metadata(spark):
    assert quality.meta_values(pa.array([None, 0.0, -3.0, float("nan"), float("inf"), 1e300])).tolist()[:2] == [0, 1]
    assert all(0 <= x < quality.META for x in quality.meta_values(pa.array([None, -5, 0, 2**62])))
    assert all(0 <= x < quality.META for x in quality.meta_values(pa.array([None, "", "x" * 9999])))


def test_sample_has_one_row_an_id(spark):
    """A thousand rows an id, shared ids and several labels: never more rows than drawn ids."""
    rows = [(i % 40, f"text {i}" if i % 40 % 3 else "same", "x") for i in range(8000)] + [(None, "none", "x")] * 50
    table = spark.createDataFrame(rows, "doc_id bigint, text string, row string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1), (None, 1), (99, 0)], "doc_id bigint, quality int")
    found, counts, share = sample.labelled(table, labels, "quality", 5, 1)
    found = found.collect()
    assert counts == {0: 20, 1: 21} and 0 < len(found) <= 20
    everyone, _, _ = sample.labelled(table, labels, "quality", 100, 1)
    first = sorted(map(tuple, everyone.collect()))
    assert len(first) == 40 and sum(r[-1] for r in first) == 21
    again, _, _ = sample.labelled(table.repartition(3), labels, "quality", 100, 1)
    assert sorted(map(tuple, again.collect())) == first
