import hashlib

from tallyloom.operators import sampling


def rank(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def rows(spark, links):
    return spark.createDataFrame(links, "src bigint, dst bigint").repartition(5)


LINKS = [(i % 17, i * i % 23 + 1) for i in range(200)] + [(99, j + 1) for j in range(23)] + [(5, 3)] * 40 + [(i, 7) for i in range(100, 400)] + [(None, 3), (4, None)]


def test_neighbourhoods_match_sorted_lists(spark):
    near, back = {}, {}
    for s, d in {(s, d) for s, d in LINKS if s is not None and d is not None}:
        near.setdefault(s, []).append(d)
        back.setdefault(d, []).append(s)
    want = []
    for s, found in near.items():
        for d in sorted(found, key=lambda d: (rank(8, 1, s, d), d))[:3]:
            want.append((s, 1, s, d))
            want += [(s, 2, d, x) for x in sorted(back[d], key=lambda x: (rank(8, 2, d, x), x))[:90]]
    got = sorted(tuple(r) for r in sampling.neighbourhoods(rows(spark, LINKS), seed=8).collect())
    assert got == sorted(want) and sum(r[:3] == (100, 2, 7) for r in got) == 90
    assert sampling.neighbourhoods(rows(spark, [])).collect() == []


def test_negatives_are_drawn_by_hash_and_never_links(spark):
    known = {(s, d) for s, d in LINKS if s is not None and d is not None}
    want = []
    for s, d in known:
        seen = []
        for draw in range(1, 17):
            x = int(rank(2, s, d, draw)[:8], 16) % 23 + 1
            if (s, x) not in known and x not in seen:
                seen.append(x)
        want += [(s, d, i, x) for i, x in enumerate(seen[:3], 1)]
    got = sorted(tuple(r) for r in sampling.negatives(rows(spark, LINKS), 23, seed=2).collect())
    assert got == sorted(want) and not any(s == 99 for s, *_ in got)


def test_a_hot_node_is_cut_before_the_shuffle(spark):
    plan = sampling.fan_out(rows(spark, LINKS), "dst", "src", 90, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_only_links_with_rejected_draws_are_drawn_further(spark):
    """With many targets nearly no link needs more than its first three draws, so that few rows are shuffled; the rest gets all 16."""
    links = [(s, d) for s in range(40) for d in range(1 + s % 5, 2000, 97)]
    known, want = set(links), []
    for s, d in links:
        seen = []
        for draw in range(1, 17):
            x = int(rank(3, s, d, draw)[:8], 16) % 2000 + 1
            if (s, x) not in known and x not in seen:
                seen.append(x)
        want += [(s, d, i, x) for i, x in enumerate(seen[:3], 1)]
    out = sampling.negatives(rows(spark, links), 2000, seed=3)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    drawn = [len(set(int(rank(3, s, d, k)[:8], 16) % 2000 + 1 for k in (1, 2, 3)) - {x for y, x in known if y == s}) for s, d in links]
    plan = out._jdf.queryExecution().toString()
    assert 0 < sum(x < 3 for x in drawn) < len(links) / 10 and plan.count("sequence(1, 16") >= 1 and "posexplode" in plan.lower()
