"""Repeated passages of over 50 words that hold few whole sentences or none."""

import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import sentence_dedup
from tallyloom.llm.text import buffers

from .helpers import ODD_TEXTS, docs, words


WHOLE = {"sentences": 1, "least_words": sentence_dedup.PASSAGE_WORDS, "reach": sentence_dedup.PASSAGE_REACH}


def prose(rnd, n, ends=()):
    w = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]
    return " ".join(x + ("." if i + 1 in ends else "") for i, x in enumerate(w))


def test_passages_of_few_sentences_go(spark):
    rnd = random.Random(11)
    texts, planted = [], []
    for n in (51, 60, 80):
        for ends in ((), (n,), (n // 2, n), (n // 3, 2 * n // 3, n), (20,), (n - 9,)):
            passage = prose(rnd, n, ends)
            for where in ("{0} {1} {2}", "{0}. {1} {2}", "{0} {1}. {2}."):
                planted.append((len(texts), passage))
                texts.append(where.format(prose(rnd, 30, (7, 19)), passage, prose(rnd, 25, (11,))))
    planted.append((len(texts), "the " * 60))
    texts.append("Said once: " + "the " * 60 + "and on.")
    copies = len(texts)
    texts += [f"{prose(rnd, 33, (5,))} {passage} {prose(rnd, 20)}" for _, passage in planted]
    clean = len(texts)
    texts += [prose(rnd, 200, (30, 60, 90, 150)) for _ in range(20)]
    got = {r.doc_id: r for r in sentence_dedup.deduplicate(docs(spark, texts), **WHOLE).collect()}
    for i in range(clean, len(texts)):
        assert got[i].n_removed == 0 and got[i].text == texts[i]
    for k, (_, passage) in enumerate(planted):
        r, own = got[copies + k], words(passage)
        lost = len(words(texts[copies + k])) - len(words(r.text))
        assert r.n_removed > 0 and lost >= len(own) // 2, (k, lost, passage)
        assert lost <= len(own) + 2, (k, lost)
    # the three places of a passage: the first stays whole
    assert all(got[i].text == texts[i] for i in range(0, copies - 1, 3))


def test_parts_do_not_depend_on_the_neighbours():
    rnd = random.Random(12)
    texts = [prose(rnd, rnd.randrange(0, 120), (9, 50)) for _ in range(30)] + [t or "" for t in ODD_TEXTS] + ["word " * 60]
    starts = lambda t: sentence_dedup.part_starts(*buffers(pa.array(t)), 4)
    raw, at = buffers(pa.array(texts))
    apart = [starts([t]) + a for t, a in zip(texts, at[:-1])]
    assert np.array_equal(starts(texts), np.concatenate(apart))
    assert set(sentence_dedup.sentence_starts(raw, at)) <= set(starts(texts))


def test_passage_dedup_matches_brute_force(spark):
    """Parts as ``part_starts`` gives them; spans as tuples of words, counted in a dictionary."""
    rnd = random.Random(13)
    shared = [prose(rnd, n, ends) for n, ends in ((60, ()), (25, (9, 25)), (17, ()), (120, (40,)))]
    texts = [" ".join([prose(rnd, rnd.randrange(0, 40), (7,)), *rnd.sample(shared, rnd.randrange(0, 3)), prose(rnd, rnd.randrange(0, 30))]) for _ in range(60)]
    texts += [*ODD_TEXTS, "the " * 70]
    parts, places = [], {}
    for d, t in enumerate(texts):
        raw, at = buffers(pa.array([t or ""]))
        cut = [*sentence_dedup.part_starts(raw, at, sentence_dedup.PASSAGE_REACH).tolist(), len(raw)]
        parts.append([raw[a:b].tobytes().decode() for a, b in zip(cut, cut[1:])])
        w = [words(x) for x in parts[-1]]
        for i in range(len(w)):
            stop = next((j for j in range(i + 1, len(w) + 1) if sum(map(len, w[i:j])) >= sentence_dedup.PASSAGE_WORDS), None)
            stop = len(w) if stop is None and i == 0 and any(w) else stop
            if stop is not None:
                places.setdefault(tuple(x for y in w[i:stop] for x in y), []).append((d, i, stop))
    gone = [set() for _ in texts]
    for found in places.values():
        for d, i, stop in sorted(found)[1:]:
            gone[d] |= set(range(i, stop))
    got = {r.doc_id: r for r in sentence_dedup.deduplicate(docs(spark, texts), **WHOLE).collect()}
    assert sum(map(len, gone)) > 100
    for d, own in enumerate(parts):
        assert (got[d].n_sentences, got[d].n_removed, got[d].text or "") == (len(own), len(gone[d]), "".join(x for i, x in enumerate(own) if i not in gone[d])), d


def test_texts_of_one_id_are_places_of_their_own(spark):
    """A repeat in one text of an id cuts nothing of the id's other texts, short or long; repeated rows stay alike."""
    sentence = "alpha beta gamma {}. delta epsilon zeta {}. eta theta iota {}. "
    first, short = "".join(sentence.format(i, i, i) for i in range(4)), "Only two. Sentences here."
    long = "".join(f"word{i} other{i} third{i} fourth{i}. " for i in range(12))
    rows = [(1, first), (5, "New start here. " + first), (5, short), (6, "Another start. " + first), (6, long), (7, long + "Its end."), (7, long + "Its end."), (None, first)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text.strip()) for r in sentence_dedup.deduplicate(table).collect() if r.doc_id), key=str)
    assert got == sorted([(1, first.strip()), (5, "New start here."), (5, short), (6, "Another start."), (6, long.strip()), (7, "Its end."), (7, "Its end.")], key=str)
    # two texts of one id that hold the same: one of them keeps it
    twice = spark.createDataFrame([(3, "a first one. " + first), (3, "b second one. " + first)], "doc_id bigint, text string")
    left = [r.text for r in sentence_dedup.deduplicate(twice).collect()]
    assert sum(first.strip() in t for t in left) == 1
