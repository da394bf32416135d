import pytest

from glyphmill.llm.mixing import mix_sources

TARGETS = [("m", "big", 0.5, 1), ("m", "small", 0.3, 4), ("m", "mid", 0.2, 2), ("gap", "big", 5.0, 1), ("gap", "absent", 1.0, 3), ("gap", "mid", 0.0, 1), ("never", "big", 1.0, 0)]


@pytest.fixture(scope="module")
def mix(spark):
    rows = [(k, "big" if k % 10 < 7 else "mid" if k % 10 < 9 else "small", "word " * (1 + k % 40), 3) for k in range(3000)]
    rows += [(9001, "big", None, 0), (9002, "big", "", 0), (9003, None, "lost", 0), (None, "big", "lost", 0), (5, "big", "word " * 6, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    return mix_sources(docs, spark.createDataFrame(TARGETS, "mix_id string, source string, target_share double, max_repeats int"))


def test_shares_caps_and_report(mix):
    rows = {(r.mix_id, r.source): r for r in mix.shares().collect()}
    assert len(rows) == len(TARGETS)
    for (m, s), r in rows.items():
        assert r.most_copies <= r.max_repeats
        if m == "m":
            assert abs(r.actual_share - r.target_share) < 0.003 and r.in_reach
    assert rows["m", "small"].most_copies > 1
    assert rows["gap", "big"].actual_share == 1 and not rows["gap", "absent"].in_reach and rows["gap", "mid"].tokens == 0
    assert rows["never", "big"].tokens == 0 and not rows["never", "big"].in_reach


def test_the_cut_is_that_of_one_sorted_list(mix, spark):
    plan = {(r.mix_id, r.source): r for r in mix.plan.collect()}
    chosen = mix.chosen.where("mix_id = 'm' and source = 'small'").collect()
    assert len({r.id for r in chosen}) == len(chosen)
    due = plan["m", "small"]
    assert abs(sum(r.tokens * r.copies for r in chosen) - due.budget) <= 25
    whole = int(due.copies_due)
    assert {r.copies for r in chosen} <= {whole, whole + 1}


def test_same_seed_same_choice_and_weights(spark):
    docs = spark.createDataFrame([(k, "s", "word " * 5, 1.0 + 9 * (k % 2)) for k in range(2000)], "doc_id long, source string, text string, w double")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    one, two = (mix_sources(docs, targets, total_tokens=2000, weight_col="w").chosen.collect() for _ in range(2))
    assert {r.id for r in one} == {r.id for r in two}
    heavy = sum(r.id % 2 for r in one)
    assert abs(sum(r.tokens for r in one) - 2000) <= 5 and heavy > 5 * (len(one) - heavy)


def test_empty_tables(spark):
    docs, targets = spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame(TARGETS, "mix_id string, source string, target_share double, max_repeats int")
    assert mix_sources(docs, targets).chosen.count() == 0
    assert mix_sources(docs, targets.limit(0)).shares().count() == 0


def test_inclusion_follows_the_weights(spark):
    docs = spark.createDataFrame([(k, "s", "word " * 5, 1.0 + k % 3) for k in range(6000)], "doc_id long, source string, text string, w double")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    taken = [r.id % 3 for r in mix_sources(docs, targets, total_tokens=6000, weight_col="w").chosen.collect()]
    whole = len(taken) / 6000
    for k in range(3):
        assert taken.count(k) / 2000 == pytest.approx(whole * (k + 1) / 2, abs=0.03)


def test_a_repeated_id_counts_once_with_its_least_source(spark):
    docs = spark.createDataFrame([(1, "b", "one two"), (1, "a", "one"), (1, "a", ""), (2, "b", "x y z")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "a", 0.5, 9), ("m", "b", 0.5, 9)], "mix_id string, source string, target_share double, max_repeats int")
    assert {(r.id, r.source) for r in mix_sources(docs, targets).chosen.collect()} == {(1, "a"), (2, "b")}
