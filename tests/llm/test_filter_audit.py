import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import filter_audit

from .helpers import ODD_TEXTS


def plain(rows, labels):
    """Every order by filtering lists."""
    good, toxic = ({i for i, *y in labels if y[k] == 1 and i is not None} for k in (0, 1))

    def fails(row):
        i, text, _ = row
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        return {
            f
            for f, x in zip(
                "ABCDE",
                (
                    len(words) < 100,
                    100 * len(set(words)) < 80 * len(words),
                    100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                    any(c in "#$%&*|" for c in text),
                    i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
                ),
            )
            if x
        }

    judged = [(r, fails(r)) for r in rows]
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in judged if (r[2] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left, before = [x for x in left if f in x[1]], [x for x in left if f not in x[1]], left
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - sum(f in x[1] for x in before), sum(x[1] == {f} for x in own),
                    sum(x[0][0] in good for x in gone), sum(x[0][0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    *((i, t, "en" if i % 2 else None) for i, t in enumerate(ODD_TEXTS)),
    (50, LONG, "en"), (40, LONG, "de"), (40, LONG, "en"), (40, LONG, "en"), (60, LONG + " |", "en"), (None, LONG, "en"), (None, LONG, "en"), (None, None, None),
    (70, "A " * 130, "fr"), (71, LONG.upper(), "fr"), (72, LONG.upper(), ""), (72, "other text", "fr"), (72, "", "fr"), (-5, "", "fr"),
    *((100 + i, LONG, "en") for i in range(30)), (90, "a\x0bb\x1cc d " * 60, "de"),
]
LABELS = [(40, 1, 0), (40, 0, 1), (50, 1, 1), (60, 0, 1), (72, 1, None), (None, 1, 1), (101, 1, 0), (999, 1, 1), (70, 0, 1)]


@pytest.mark.parametrize("collide", [False, True])
def test_audit_matches_plain_lists(spark, collide):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id bigint, text string, lang string, part string, n int").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, labels, F.lit(7).cast("bigint") if collide else None).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == plain(ROWS, LABELS) and len(got) == 600 * 4


def test_few_bytes_held_at_a_time():
    """A task that sends its texts on again and again settles less by itself; the masks stay."""
    rows = [(i, t or "", p or "", hash(t or "") % 5) for i, t, p in ROWS]
    for most in (0, 300, 1 << 30):
        routed = sorted((x for a in (rows[::2], rows[1::2]) for x in filter_audit.settle(iter(a), most)), key=lambda x: x[0])
        got = Counter()
        for i, part, mask, n in filter_audit.resolve(iter(routed)):
            got[i, part, mask] += n
        least = {}
        for i, t, _, _ in rows:
            if i is not None:
                least[t] = min(least.get(t, i), i)
        assert got == Counter((i, p, filter_audit.failures(t) | (filter_audit.REPEATED if i is not None and i > least[t] else 0)) for i, t, p, _ in rows)


def test_copies_move_once_a_task():
    rows = [(i, LONG, "en", 3) for i in range(1000)]
    assert sum(x[1][0] is not None for x in filter_audit.settle(iter(rows))) == 1


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []
