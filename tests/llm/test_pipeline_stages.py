"""Stages 2 and 3 of the pipeline on repeated rows, shared ids and rows without id."""

import random
from collections import Counter

import corpus_pipeline

from tallyloom.llm import near_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def got(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicates_keep_one_row_and_all_clean_ones(spark):
    a, near, b, c, d, e = prose(1, 60), prose(1, 60) + " more", prose(2, 60), prose(3, 60), prose(4, 60), prose(5, 60)
    rows = [(1, a), (1, a), (1, a), (2, near), (2, b), (3, c), (None, d), (None, d), (None, d + " x"), (None, e), (None, near), (None, None)]
    out = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "")
    left = got(out)
    assert [left[x] for x in ((1, a), (2, near), (2, b), (3, c), (None, e), (None, near), (None, None))] == [1, 0, 1, 1, 1, 0, 1]
    assert left[(None, d)] + left[(None, d + " x")] == 1 and sum(left.values()) == 6
    classes = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(table(spark, rows)).collect()]
    assert len(classes) == len(rows)
    assert Counter(i for i, _ in classes) == Counter(i for i, _ in rows)
    assert sum(x == (None, 1) for x in classes) == 1  # near, without id, is of the class of 1
    assert all(x is not None for _, x in classes) and len({x for i, x in classes if i is None}) == 4


def test_unique_ids_give_the_same_classes_either_way(spark):
    rows = [(i, prose(i % 7, 40) + (" end" if i % 3 else "")) for i in range(1, 30)]
    want = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    have = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(table(spark, rows + [(None, "z")])).collect() if r.doc_id}
    assert have == want


def test_cut_repeats_keeps_rows_apart(spark):
    said, x, y = prose(7, 30), prose(8, 20), prose(9, 20)
    rows = [(1, said), (2, f"{x} {said}"), (2, f"{x} {said}"), (2, f"{x} {said}"), (2, y), (3, f"{said} {y}"), (3, x), (None, said), (4, None)]
    out = corpus_pipeline.cut_repeats(spark, table(spark, rows), "").collect()
    assert len(out) == len(rows)
    text = {}
    for r in out:
        text.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == len(r.text or "")
    assert text[1] == [said] and text[None] == [said] and text[4] == [None]
    cut = [t for t in text[2] if t != y]
    assert len(cut) == 3 and len(set(cut)) == 1 and cut[0].strip() == x and y in text[2]
    assert len(text[3]) == 2 and all(len(t) < 5 for t in text[3])
