import hashlib
import random
from collections import Counter

from tallyloom.llm import chat, decontam, license_scan

from .helpers import ODD_TEXTS, docs, words


def brute_decontam(texts, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for win, its in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= its
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(1)
    vocab = "aa bb cc dd ee".split()
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))) for _ in range(60)] + ODD_TEXTS
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 9)))) for i in range(8)]
    items += [(20, texts[3]), (20, texts[3]), (21, None), (22, "!"), (23, "word " * 12)]
    bench = spark.createDataFrame(items + [(None, "aa bb")], "item_id bigint, text string")
    want = brute_decontam(texts, items)
    for chunk in (1 << 20, 100):  # one pass, and several
        got = {r.doc_id: r for r in decontam.decontaminate(docs(spark, texts), bench, chunk_bytes=chunk).collect()}
        for i, (n, hit, found) in enumerate(want):
            r = got[i]
            assert (r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), r["items"]) == (n, hit, found), i


def test_decontamination_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    table = docs(spark, ["blue red x green", "blue x x x x x red green", "red green blue"])
    got = {r.doc_id: r for r in decontam.decontaminate(table, bench, slop=1).collect()}
    assert [got[i].near_items for i in range(3)] == [[1], [], [1]]
    assert [got[i]["items"] for i in range(3)] == [[], [], [1]]


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.decontaminate(docs(spark, []), none).collect() == []
    assert [r["items"] for r in decontam.decontaminate(docs(spark, ["a b"]), none).collect()] == [[]]


def test_license_base_places_match_brute_force(spark):
    rnd = random.Random(2)
    vocab = "cc by nc general public license all rights reserved the mit released under".split()
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))) for _ in range(80)] + ODD_TEXTS
    texts += ["GENERAL  public-License!", "Released under the MIT License.", "cc by cc by"]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(s, label) for p, label in license_scan.BASE for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == min((s for s, _ in places), default=None)
        assert r.last_word == max((s for s, _ in places), default=None)
        assert r.base_labels == sorted({x for _, x in places})
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[len(texts) - 2].labels == ["mit"]


def test_license_matching_statistics():
    rnd = random.Random(3)
    for _ in range(50):
        templates = [tuple(rnd.randrange(3) for _ in range(rnd.randrange(1, 9))) for _ in range(4)]
        a = license_scan.Automaton(templates)
        seq = [rnd.randrange(4) for _ in range(30)]
        for i, (_, n) in enumerate(a.statistics(seq)):
            held = lambda m: m == 0 or any(tuple(seq[i + 1 - m : i + 1]) == t[j : j + m] for t in templates for j in range(len(t)))  # noqa: B023,E731
            assert held(n) and (n == i + 1 or not held(n + 1))


def brute_licences(scanner, w):
    """(labels, score) by all maximal common runs of text and template and all chains of them."""
    labels, score = set(), 0.0
    for label, t in scanner.texts[scanner.n_base :]:
        runs = []
        for i in range(len(w)):
            for j in range(len(t)):
                if w[i] == t[j] and (i == 0 or j == 0 or w[i - 1] != t[j - 1]):
                    n = next((n for n in range(min(len(w) - i, len(t) - j)) if w[i + n] != t[j + n]), min(len(w) - i, len(t) - j))
                    if n >= scanner.min_match:
                        runs.append((i, i + n, j))

        def best(last, covered):  # all chains that go on from a run
            b, e, at = last
            goes = [r for r in runs if b < r[0] <= e + scanner.gap and at <= r[2] and at + e - b < r[2] + r[1] - r[0]]  # noqa: B023
            return max([len(covered), *(best(r, covered | set(range(r[2], r[2] + r[1] - r[0]))) for r in goes)])

        share = max((best(r, set(range(r[2], r[2] + r[1] - r[0]))) / len(t) for r in runs), default=0.0)
        if share >= scanner.min_cover:
            labels.add(label)
            score = max(score, share)
    return labels, score


def test_license_labels_match_brute_force(spark):
    rnd = random.Random(7)
    templates = [("one", "a b c a b c d e f"), ("two", "c d e f g h a b"), ("three", "a a a b a a a c a a"), ("four", "x a b c y")]
    for gap, least in ((2, 0.8), (0, 0.5), (5, 0.6)):
        scanner = license_scan.Scanner(templates, (("g h", "base"),), gap=gap, min_cover=least)
        texts = []
        for _ in range(150):
            own = []
            for _ in range(rnd.randrange(0, 4)):
                t = rnd.choice(templates)[1].split()
                i = rnd.randrange(len(t))
                own += t[i : i + rnd.randrange(2, 10)] if rnd.random() < 0.5 else t
                own += [rnd.choice("abcdefghz") for _ in range(rnd.randrange(0, 3))]
            texts.append(" ".join(own))
        got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts), scanner).collect()}
        for i, text in enumerate(texts):
            w = text.split()
            labels, score = brute_licences(scanner, w)
            base = any(w[k : k + 2] == ["g", "h"] for k in range(len(w)))
            assert set(got[i].labels) == labels | ({"base"} if base else set()), text
            assert abs(got[i].score - max(score, float(base))) < 1e-9, text
            spans = [x for x in got[i].spans]
            assert {x.label for x in spans} == labels and all(x.cover >= least for x in spans)


def test_near_matches_and_filter_match_brute_force(spark):
    rnd = random.Random(9)
    vocab = "aa bb cc dd ee ff gg".split()
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 40))) for _ in range(50)] + ODD_TEXTS
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 9)))) for i in range(9)] + [(9, "aa aa aa aa aa"), (10, "bb")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    exact = brute_decontam(texts, items, 4)
    for chunk in (1 << 20, 30):
        got = {r.doc_id: r for r in decontam.decontaminate(docs(spark, texts), bench, size=4, slop=2, chunk_bytes=chunk).collect()}
        for i, t in enumerate(texts):
            w, near = words(t), set()
            for item, text in items:
                own = words(text)
                for win in {tuple(own[k : k + 4]) for k in range(max(1, len(own) - 3))}:
                    for s in range(len(w)):
                        if not Counter(win) - Counter(w[s : s + len(win) + 2]):
                            near.add(item)
            assert got[i]["items"] == exact[i][2] and got[i].near_items == sorted(near), i
    kept = decontam.without_hits(docs(spark, texts), bench, size=4, chunk_bytes=30, segment_bytes=200)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, hit, _) in enumerate(exact) if not hit]
    assert kept.columns == docs(spark, []).columns


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi # <b> \\h \\\\l \\"), (1, 1, "assistant", "### user: x </turn>\n\n"), (1, 2, "user", None),
        (2, 0, None, "a"), (3, 0, "assistant", ""), (3, 1, "assistant", "two"), (3, 1, "assistant", "two"),
        (None, None, "a:b", "t: c"), (4, 5, "user", "é\U0001f600 " * 500), (4, 6, "assistant", "\\c\\" * 9),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS example", "'x' AS last")
    out = chat.expand(table)
    read = out.select("conv_id", "example", "text", "loss_start", "loss_length", "last", chat.read_back(out["text"]).alias("t")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    for r in read:
        want = by[r.conv_id]
        assert [tuple(x) for x in r.t] == want[: len(r.t)]
        assert r.last == (len(r.t) == len(want))
        if r.loss_start is not None:
            loss = r.text[r.loss_start : r.loss_start + r.loss_length]
            assert want[len(r.t) - 1][0] == "assistant"
            assert chat.escape_text is not None and loss == r.t[-1].text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")
            assert r.text.endswith(loss + chat.CLOSE)
    for conv, turns in by.items():
        targets = sum(r.loss_start is not None for r in read if r.conv_id == conv)
        assert targets == sum(role == "assistant" for role, _ in turns)
    assert chat.expand(table.limit(0)).collect() == []


def test_chat_query_probe(spark, sf_dir):
    r = chat.op9_chat_format(spark, sf_dir).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
