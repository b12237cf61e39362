"""The whole pipeline against plain versions of its stages, on the smallest tables and on odd rows."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyloom.llm import toxicity

from .helpers import ODD_TEXTS, words
from .test_dedup import brute_classes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def cut_brute(texts, width=50):
    """What is left of texts in order of their ids."""
    first, out = {}, []
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    for d, (t, b) in enumerate(zip(texts, data)):
        drop = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                drop[i : i + width] = True
        left = np.frombuffer(b, np.uint8)[~drop].tobytes()
        out.append(left.decode("utf-8", "ignore") if drop.any() else t)
    return out


def windows(text, size=10):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)}


def hit(text, wins):
    w = words(text)
    return any(tuple(w[i : i + n]) in wins for n in {len(x) for x in wins} for i in range(len(w) - n + 1))


def check(spark, table, folder):
    """Runs the stages one after the other and holds each against a plain version on what the last one kept."""
    rows = {r.doc_id: r for r in table.collect()}
    bench = set().union(*(windows(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()))
    stage = dict(corpus_pipeline.STAGES)

    got = stage["toxicity"](spark, table, folder)
    model = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = []
    for i, r in sorted(rows.items()):
        f = model.features({w.encode() for w in words(r.text)})
        pairs = sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(f) for b in f[k + 1 :])
        if 1 / (1 + np.exp(-(model.bias + sum(model.w[a] for a in f) + pairs))) < 0.3:
            kept.append(i)
    assert sorted(r.doc_id for r in got.collect()) == kept and got.columns == list(corpus_pipeline.COLUMNS)

    table = spark.createDataFrame([tuple(rows[i]) for i in kept], SCHEMA)
    got = stage["near_dedup"](spark, table, folder)
    classes = brute_classes([rows[i].text for i in kept])
    kept = [i for k, i in enumerate(kept) if classes[k] == k]
    assert sorted(r.doc_id for r in got.collect()) == kept and got.columns == list(corpus_pipeline.COLUMNS)

    table = spark.createDataFrame([tuple(rows[i]) for i in kept], SCHEMA)
    got = stage["suffix_dedup"](spark, table, folder)
    left = cut_brute([rows[i].text for i in kept])
    assert got.columns == list(corpus_pipeline.COLUMNS)
    cut = {r.doc_id: r for r in got.collect()}
    assert [(cut[i].text, cut[i].lang) for i in kept] == [(t, rows[i].lang) for i, t in zip(kept, left)]
    assert all(cut[i].n_chars == len(cut[i].text or "") for i in kept if cut[i].text != rows[i].text)

    got = stage["decontamination"](spark, got, folder)
    clean = [i for i in kept if not hit(cut[i].text, bench)]
    assert sorted(r.doc_id for r in got.collect()) == clean and got.columns == list(corpus_pipeline.COLUMNS)

    pieces = {}
    for r in stage["packing"](spark, got, folder).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(pieces) == clean
    for i in clean:
        ids, at = model.encode(cut[i].text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return pieces


def test_whole_pipeline_matches_plain_stages(spark):
    pieces = check(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert {i: sum(r.length for r in p) for i, p in pieces.items()} == {i: sum(r[1] for r in p) for i, p in got.items()}


def test_pipeline_on_odd_rows(spark, tmp_path):
    benchmark = " ".join(f"q{i}" for i in range(14))
    said = " ".join(f"s{i}" for i in range(40))
    texts = [*ODD_TEXTS, said, said, f"x y {said} z", benchmark, f"a {benchmark} b", "idiot " * 3, "good words here", None]
    rows = [(i, t, None if i % 3 else "en", None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame([(1, benchmark), (2, None), (3, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int("idiot" in (t or ""))) for i, t, *_ in rows], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.createDataFrame(rows, SCHEMA)
    check(spark, table, str(tmp_path))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {13}


def test_pipeline_on_empty_tables_and_more_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none = spark.createDataFrame([], SCHEMA + ", row bigint, kept string, block int, key string, class_id bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
    more = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11, 5, "k", 6, "z", 7), (None, None, None, None, None, None, None, None, None, None)], none.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, str(tmp_path))
        assert out.count() == 2 and (name == "packing" or out.columns == list(corpus_pipeline.COLUMNS))
