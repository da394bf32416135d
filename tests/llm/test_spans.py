import random

import pytest
from pyspark.sql import functions as F

from glyphmill.llm.spans import align, chain, crossed, kmer_hashes, shared_spans, text_seeds, code_points

SCHEMA = "id string, text string, rid long, place string"


def brute(rows, length):
    out = set()
    texts = {i: t for i, t in rows if i is not None and t is not None}
    where = {}
    for i, t in texts.items():
        for k in range(len(t) - length + 1):
            where.setdefault(t[k : k + length], set()).add(i)
    for i, t in texts.items():
        at = None
        for k in range(len(t) - length + 1):
            if len(where[t[k : k + length]]) > 1:
                if at and k <= at[1]:
                    at[1] = k + length
                else:
                    if at:
                        out.add((i, *at))
                    at = [k, k + length]
        if at:
            out.add((i, *at))
    return out


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_same_stretches_as_brute_force(spark, hot):
    rng = random.Random(hot)
    make = lambda n: "".join(rng.choice("ab é🙂漢\n") for _ in range(n))
    pool = [make(rng.randint(20, 90)) for _ in range(6)]
    rows = []
    for k in range(40):
        rows.append((f"r{k}", "".join(make(rng.randint(0, 30)) if rng.random() < 0.5 else rng.choice(pool)[rng.randint(0, 8) :] for _ in range(rng.randint(1, 5)))))
    rows += [("same1", rows[0][1] * 2), ("same2", rows[0][1] * 2), ("same2", rows[0][1] * 2), ("period1", "a" * 400), ("period2", "b" + "a" * 90), ("nil", None), ("none", ""), (None, "a" * 50)]
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], SCHEMA).repartition(3)
    spans = shared_spans(df, "id", "text", length=25, k=8, hot=hot)
    got = [tuple(r) for r in spans.stretches().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 25)
    covered = {r.id: r.shared_chars for r in spans.coverage().collect()}
    for i, n in covered.items():
        assert n == sum(b - a for j, a, b in got if j == i)


def test_chains_hold_every_anchor_once_and_prefer_order():
    anchors = sorted([(0, 0), (10, 10), (20, 21), (30, 5), (5, 30)])
    chains = chain(anchors, 8, 0.05)
    assert sorted(x for c in chains for x in c) == list(range(5))
    assert [anchors[x] for x in chains[0]] == [(0, 0), (10, 10), (20, 21)]


def test_fuzzy_passage_spans_an_edit():
    rng = random.Random(5)
    left, right = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (120, 150))
    a, b = "q" * 10 + left + "X" + right, left + "Yz" + right + "p" * 9
    anchors = {(x, y) for x, g in zip(*map(list, text_seeds(a, 16, 40))) for y, h in zip(*map(list, text_seeds(b, 16, 40))) if g == h}
    found = align(a, b, sorted((int(x), int(y)) for x, y in anchors), 16, 0.05, 40)
    assert any(not e and j - i >= 230 for i, j, _, _, e in found)
    assert {(10, 130, 0, 120, True), (131, 281, 122, 272, True)} <= set(found)


def test_two_spans_on_one_diagonal_the_later_longer():
    rng = random.Random(6)
    p, x, y, q = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (250, 3000, 3000, 1000))
    a, b = p + "x" + x + "x" + q, p + "y" + y + "y" + q
    anchors = {(int(i), int(j)) for i, g in zip(*map(list, text_seeds(a, 64, 200))) for j, h in zip(*map(list, text_seeds(b, 64, 200))) if g == h}
    found = align(a, b, sorted(anchors), 64, 0.05, 200)
    assert {r for r in found if r[4]} == {(0, 250, 0, 250, True), (3252, 4252, 3252, 4252, True)}


@pytest.mark.parametrize("n", [64, 65, 500])
def test_any_two_texts_with_a_passage_are_linked(spark, n):
    """Directly, or by one text with which both have the passage: exact on either side of an edit, and fuzzy over it."""
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    left, right = make(260), make(270)
    rows = [(f"r{k}", make(30) + left + chr(0x4E00 + k) + right + make(20)) for k in range(n)]
    spans = shared_spans(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    found = spans.passages.collect()
    assert len(found) < 70 * n * 3
    for exact, start, end in ((True, 30, 290), (True, 291, 561), (False, 30, 561)):
        pairs = {(r.rid_a, r.rid_b) for r in found if r.exact == exact and r.a_start <= start and r.a_end >= end}
        beside = {}
        for a, b in pairs:
            beside.setdefault(a, {a}).add(b)
            beside.setdefault(b, {b}).add(a)
        assert len(beside) == n and (len(pairs) == n * (n - 1) // 2 if n <= 64 else any(len(x) == n for x in beside.values()))
    if n > 64:
        classes = {(r.n, r.one) for r in spans.classes.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("representative").alias("one")).collect()}
        assert (n, 1) in classes and {one for _, one in classes} == {1}
    assert {tuple(r)[1:] for r in spans.stretches().collect()} <= {(a, b) for a in range(24, 31) for b in range(561, 568)} | {(a, b) for a in range(24, 31) for b in range(290, 291)} | {(a, b) for a in range(291, 292) for b in range(561, 568)}


def test_spans_of_frequent_seeds_that_their_representative_lacks(spark):
    """All texts hold the same 64 letters, some of them longer spans around these: pairs come from the spans."""
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, wide = make(64), [make(150) for _ in range(4)]
    rows = [(f"r{k}", make(200) + (wide[k % 4] if k % 5 else make(150)) + core + make(200)) for k in range(90)]
    got = {tuple(r) for hot in (3, 1000) for r in shared_spans(spark.createDataFrame(rows, "id string, text string"), "id", "text", hot=hot).stretches().collect()}
    assert got == brute(rows, 200) and len(got) == 72


@pytest.mark.parametrize("unit", ["=", "ab", "-+--="])
def test_few_anchors_find_all_exact_runs_of_repetitive_texts(unit):
    a, b = "x" * 30 + unit * 150 + "y", "zz" + unit * 90 + "w" + unit * 60
    places = [{int(h): [int(p) for p, g in zip(*text_seeds(t, 8, 25)) if g == h] for h in set(text_seeds(t, 8, 25)[1])} for t in (a, b)]
    whole = {(i, j) for h, x in places[0].items() for i in x for j in places[1].get(h, [])}
    few = {p: n for h, x in places[0].items() if h in places[1] for p, n in crossed(x, places[1][h], 8, 20).items()}
    exact = lambda found: {r for r in found if r[4]}
    assert len(few) < len(whole) / 5 and few.keys() <= whole
    assert exact(align(a, b, sorted(few), 8, 0.05, 25, few)) == exact(align(a, b, sorted(whole), 8, 0.05, 25)) != set()


def test_hashes_depend_on_each_place():
    points = code_points("abcabcabd")
    h = kmer_hashes(points, 3)
    assert h[0] == h[3] != h[6] and len(h) == 7 and len(kmer_hashes(points, 10)) == 0


def test_empty_table(spark):
    spans = shared_spans(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert spans.stretches().count() == spans.coverage().count() == 0
