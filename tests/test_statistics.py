import math
import os
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import stats, text
from glyphmill.operators import ledger, lexical, ordered, resample, sequence
from glyphmill.operators.ordered import running_total
from glyphmill.plans import catalogue


def one(spark, *columns, rows=None, schema="x double"):
    df = spark.createDataFrame(rows or [(0.0,)], schema)
    return df.select(*columns).first()


def test_intervals(spark):
    n = F.lit(0).cast("long")
    lo, hi = stats.wilson(n, n)
    assert tuple(one(spark, lo, hi)) == (0.0, 0.0)
    assert one(spark, stats.wilson_upper(n, n))[0] is None
    got = one(spark, *stats.wilson(F.lit(3), F.lit(10)), stats.wilson_upper(F.lit(0), F.lit(457045)) * 1000)
    assert got[0] == pytest.approx(0.10779, abs=1e-5) and got[1] == pytest.approx(0.60322, abs=1e-5) and round(got[2], 4) == 0.0084
    z = stats.two_proportion_z
    row = one(spark, z(F.lit(0), F.lit(5), F.lit(0), F.lit(5)), z(F.lit(1), F.lit(0), F.lit(1), F.lit(2)), z(F.lit(5), F.lit(10), F.lit(2), F.lit(10)))
    assert row[0] == 0 and row[1] is None and row[2] == pytest.approx(1.4064, abs=1e-4)
    p = one(spark, stats.normal_p(F.lit(1.959963984540054)))[0]
    assert p == pytest.approx(0.05)


def test_moments(spark):
    for x in ([1.0, 2.0, 7.0, 2.0], [3.0, 3.0, 3.0], [1.0, 2.0]):
        r = spark.createDataFrame([(v,) for v in x], "x double").agg(*stats.describe(F.col("x"))).first()
        sd = statistics.pstdev(x)
        want = None if len(x) < 3 else 0.0 if sd == 0 else sum(((v - statistics.fmean(x)) / sd) ** 3 for v in x) / len(x)
        assert r.median == statistics.median(x) and r.sd == pytest.approx(sd, abs=1e-6)
        assert r.skewness == (None if want is None else pytest.approx(want, abs=1e-6))


def test_words_sentences_and_normal_form(spark):
    rows = [("It's x² no_1 'quoted' don''t. Next? \"Yes.\" 3 cats. lower. Ünder. 1. 2!", 0), ("", 0), (" \t\x1c", 0)]
    got = spark.createDataFrame(rows, "t string, k int").select(text.words(F.col("t")), text.sentences(F.col("t")), text.normal(F.col("t"))).collect()
    assert got[0][0][:6] == ["It's", "x²", "no", "quoted", "don", "t"]
    assert got[0][1] == ["It's x² no_1 'quoted' don''t.", "Next?", '"Yes.', "3 cats. lower. Ünder."]
    assert got[1][0] == got[1][1] == got[2][1] == [] and got[2][2] == ""


def test_escapes_context_places(spark):
    r = one(spark, text.escaped(F.lit("a\\b\n\u200b\U0001f642")), text.context(F.lit("ab\u200bcd"), F.lit(2)), text.marker_places(F.lit("a.b!!c"), ".!"), text.tag_payloads(F.lit("x\U000e0041\U000e0001")))
    assert r[0] == "a\\\\b\\u000A\\u200B\\U0001F642" and r[1] == "ab[[U+200B]]cd" and r[2] == [1, 3, 4] and r[3] == ["A[TAG-LANG]"]


def test_running_total_over_many_stretches(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.randint(0, 9)) for g in "ab" for k in range(500 if g == "a" else 7)]
    got = {(r.g, r.k): r.before for r in running_total(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), ["g"], ["k"], F.col("v"), "before", 6).collect()}
    for g in "ab":
        total = 0
        for gg, k, v in rows:
            if gg == g:
                assert got[g, k] == total
                total += v


def test_ngrams_cross_documents(spark):
    docs = spark.createDataFrame([("g", 1, " One two "), ("g", 2, None), ("g", 3, " "), ("g", 4, "\nTHREE"), ("g", 5, ""), ("h", 1, "One")], "grp string, doc int, text string")
    words = {(r.grp, r.gram): r.n for r in lexical.word_ngrams(docs, F.col("grp"), "doc", 2).collect()}
    assert words == {("g", "one two"): 1, ("g", "two three"): 1}
    joined = "one two three"
    grams = {r.gram: r.n for r in lexical.char_ngrams(docs, F.col("grp"), "doc", 3).where("grp = 'g'").collect()}
    assert grams == {joined[k : k + 3]: [joined[j : j + 3] for j in range(len(joined) - 2)].count(joined[k : k + 3]) for k in range(len(joined) - 2)}


def test_lags_and_gaps(spark):
    x = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    got = {r.lag: r.r for r in sequence.lag_correlation(spark.createDataFrame([(1, x), (2, [7] * 9), (3, [])], "id int, x array<int>")).where("id = 1").collect()}
    assert got == {lag: pytest.approx(resample.lag_statistic(lag)(x), abs=1e-6) for lag in (1, 2, 3, 5)}
    const = sequence.lag_correlation(spark.createDataFrame([(2, [7] * 9)], "id int, x array<int>")).collect()
    assert const and all(r.r is None for r in const)
    docs = spark.createDataFrame([("g", 1, "a.b."), ("g", 2, "none"), ("g", 3, "..x")], "grp string, doc int, text string")
    assert sorted(tuple(r)[1:] for r in sequence.marker_gaps(docs, F.col("grp"), "doc", {"period": "."}).drop("marker").collect()) == [(3, 2), (8, 5), (9, 1)]
    gaps = spark.createDataFrame([("g", k, k % 3 + 1) for k in range(40)], "grp string, place long, gap long")
    chi = {r.k: r.chi2 for r in sequence.gap_chi2(gaps).collect()}
    assert chi[2] == pytest.approx(resample.faces_test(resample.residues([k % 3 + 1 for k in range(40)], 2), 5)["chi2"]) and chi[10] is None


def test_lags_over_joined_texts(spark):
    """Words at seams run together, through texts that are one run; apostrophes at seams join too."""
    rng = random.Random(8)
    docs = [(k, " ".join("a" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 1, 2, 5, 300]))) + rng.choice(["", " ", ".", "'"])) for k in range(200)] + [(200, "'"), (201, "b"), (202, "")]
    x = [len(w) for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", "".join(t for _, t in docs))]
    df = spark.createDataFrame([("g", k, t) for k, t in docs] + [("h", 1, "solid")], "grp string, doc int, text string").repartition(3)
    words = sorted((r.before, list(r.x)) for r in sequence.group_words(df, F.col("grp"), "doc").where("grp = 'g'").collect())
    assert [v for _, piece in words for v in piece] == x
    got = {r.lag: (r.n, r.r) for r in sequence.word_lag_correlation(df, F.col("grp"), "doc").collect()}
    assert got == {lag: (len(x), pytest.approx(resample.lag_statistic(lag)(x), abs=1e-6)) for lag in sequence.LAGS}
    seqs = spark.createDataFrame([(1, x[:9000])], "id int, x array<int>")
    for r in (*sequence.lag_correlation(seqs).collect(), *resample.lag_battery(seqs, sequence.LAGS).withColumnRenamed("observed_r", "r").collect()):
        assert r.n == min(len(x), 9000) and r.r == pytest.approx(resample.lag_statistic(r.lag)(x[:9000]), abs=1e-6)


def test_exact_mode_follows_the_published_order_of_draws():
    x = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    rng, s, hits = random.Random(resample.SEED), list(x), 0
    for _ in range(50):
        rng.shuffle(s)
        hits += abs(resample.lag_statistic(1)(s)) >= abs(resample.lag_statistic(1)(x))
    assert resample.shuffle_test(x, resample.lag_statistic(1), 50)["p_value"] == (hits + 1) / 51
    rng = random.Random(resample.SEED)
    means = sorted(statistics.fmean([x[rng.randrange(8)] for _ in range(8)]) for _ in range(40))
    got = resample.interval(x, reps=40)
    assert (got["lo"], got["hi"]) == (means[1], means[38])


def test_modes_agree_roughly():
    rng = random.Random(4)
    a, b = [rng.gauss(0, 1) for _ in range(60)], [rng.gauss(0.3, 1) for _ in range(50)]
    tests = (lambda mode: resample.interval(a, b, reps=400, mode=mode), lambda mode: resample.shuffle_test(a + b, resample.split_statistic(len(a)), 400, mode=mode))
    for f in tests:
        e, s = f("exact"), f("scale")
        for k in e:
            assert s[k] == pytest.approx(e[k], abs=0.12)
    e, s = resample.shuffle_test(a, resample.lag_statistic(2), 400)["p_value"], resample.shuffled_lags(a, (2,), 400)[0]["p_value"]
    assert s == pytest.approx(e, abs=0.1)
    gaps = resample.residues([rng.randint(1, 30) for _ in range(300)], 4)
    assert resample.faces_test(gaps, 300)["p_value"] == pytest.approx(resample.faces_test(gaps, 300, mode="scale")["p_value"], abs=0.1)
    assert resample.faces_test([4, 5])["status"] == resample.TOO_FEW and resample.interval([])["estimate"] is None


def test_pairs_dealt_anew_agree_with_shuffles():
    rng = random.Random(2)
    x = [rng.randint(1, 6) for _ in range(400)]
    for k in range(40, 400):  # some order
        if rng.random() < 0.06:
            x[k] = x[k - 1]
    pairs = Counter(zip(x[:-1], x[1:]))
    a, b, c = (np.array(v) for v in zip(*((a, b, n) for (a, b), n in pairs.items())))
    r, p = resample.paired_test(a.astype(float), b.astype(float), c, 600)
    want = resample.shuffle_test([float(v) for v in x], resample.lag_statistic(1), 600)
    assert r == pytest.approx(want["observed"]) and p == pytest.approx(want["p_value"], abs=0.06)
    assert resample.paired_test(np.ones(1), np.ones(1), np.array([9]), 5) == (None, None)


def test_exact_mode_takes_values_in_their_order(spark):
    x = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "grp string, at int, x double").repartition(3)
    want, got = resample.interval(x, reps=500), resample.bootstrap_groups(df, mode="exact").first()
    assert (got.ci_lo, got.ci_hi) == (want["lo"], want["hi"])


def test_group_tests_use_all_values(spark):
    n = 60_000
    x = spark.range(n).select(F.lit("a").alias("grp"), F.col("id").alias("at"), (F.col("id") * 7919 % 11).alias("x"))
    y = spark.range(n).select(F.lit("c").alias("grp"), F.col("id").alias("at"), (F.col("id") * 104729 % 13).alias("x"))
    both, want = x.unionByName(y), [statistics.fmean(k * m % d for k in range(n)) for m, d in ((7919, 11), (104729, 13))]
    d = resample.difference_tests(both, "c", reps=99).first()
    assert d.diff == pytest.approx(want[0] - want[1], abs=1e-9) and d.p_value == 0.01
    spread = math.sqrt((11**2 - 1) / 12 / n + (13**2 - 1) / 12 / n)
    assert d.ci_hi - d.ci_lo == pytest.approx(2 * 1.96 * spread, rel=0.35)
    m = {r.grp: r for r in resample.bootstrap_groups(both, reps=99).collect()}
    assert m["a"].n == m["a"].n_used == n and m["a"].mean == pytest.approx(want[0]) and m["a"].ci_lo < want[0] < m["a"].ci_hi
    gaps = both.select("grp", "at", (F.col("x") + 1).alias("gap"))
    chi = {(r.grp, r.k): r.chi2 for r in sequence.gap_chi2(gaps).collect()}
    got = resample.gap_battery(gaps, sequence.PERIODS).collect()
    assert len(got) == 18 and all(r.n_used == n and r.chi2 == pytest.approx(chi[r.grp, r.k], rel=1e-6) for r in got)


def test_counts_are_dealt_without_replacement():
    rng, counts = np.random.default_rng(1), np.array([1, 0, 5, 30])
    draws = np.array([resample.dealt(counts, 9, rng) for _ in range(4000)])
    assert (draws.sum(axis=1) == 9).all() and (draws >= 0).all() and (draws <= counts).all()
    assert draws.mean(axis=0) == pytest.approx(counts / 4, abs=0.1)
    assert draws[:, 2].var() == pytest.approx(9 * 5 / 36 * 31 / 36 * 27 / 35, rel=0.1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_all_batteries_are_logged(spark):
    q, folder = catalogue.queries(), "/root/testdata/sf0.001"
    gaps = q["gap_periodicity"](spark, folder).cache()
    assert {r.marker for r in gaps.select("marker").distinct().collect()} == set(sequence.MARKERS)
    chi = {(r.marker, r.grp, r.k): r.chi2 for r in q["gap_chi2"](spark, folder).collect()}
    assert chi == {(r.marker, r.grp, r.k): r.chi2 if r.chi2 is None else pytest.approx(r.chi2, abs=1e-5) for r in gaps.collect()}
    tests = sum(q[name](spark, folder).where("p_value is not null").count() for name in ("permutation_autocorr", "permutation_words", "punct_p", "dialogue_tests")) + gaps.where("p_value is not null").count()
    assert q["battery_ledger"](spark, folder).first().n_tests == tests


def test_ledger(spark):
    rows = [("a:x:1", 0.001, 0.0001), ("a:x:2", 0.04, 0.02), ("a:y:3", 0.5, None), ("b:z", None, None)]
    df = spark.createDataFrame(rows, "name string, p_value double, min_attainable_p double")
    s = ledger.summary(df).first()
    assert (s.n_tests, s.nominal, s.survivors, s.unresolvable) == (3, 2, 1, 1) and s.expected_false_positives == pytest.approx(0.15)
    assert {r.prefix: r.n for r in ledger.by_prefix(df).collect()} == {"a:x": 2, "a:y": 1}
    assert ledger.summary(df.limit(0)).first().n_tests == 0
    assert math.isclose(ledger.corrected(df).first().bonferroni_alpha, 0.05 / 3)


def test_character_grams_equal_those_of_the_joined_text(spark, monkeypatch):
    """Blanks that meet, blank and empty texts, texts shorter than a gram, blocks of few rows and characters."""
    rng = random.Random(5)
    rows = [("g", k, None if k == 7 else "".join(rng.choice(" \n\tabÉ漢🙂") for _ in range(rng.choice([0, 1, 1, 2, 3, 9, 60])))) for k in range(60)] + [("h", 1, " \n"), ("h", 2, "")]
    df = spark.createDataFrame(rows, "grp string, doc int, text string").repartition(3)
    text_of = " ".join("".join(t or "" for _, _, t in sorted(rows[:60], key=lambda r: r[1])).lower().split())
    monkeypatch.setattr(ordered, "BLOCK", 6)
    monkeypatch.setattr(lexical, "OWN", "_block = at div 6")
    for n in (1, 2, 3, 4):
        got = lexical.char_ngrams(df, F.col("grp"), "doc", n).collect()
        grams = [text_of[k : k + n] for k in range(len(text_of) - n + 1)]
        assert {r.gram: r.n for r in got} == {g: grams.count(g) for g in grams} and {r.grp for r in got} == {"g"}
        assert [r.gram for r in sorted(got, key=lambda r: r.first)] == list(dict.fromkeys(grams))
