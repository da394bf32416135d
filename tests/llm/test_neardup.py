import itertools
import random

import pytest

from glyphmill.llm.neardup import near_duplicates
from glyphmill.llm.words import WORD

SCHEMA = "id string, text string, digest string, x int"


def brute(rows, size, t, least):
    sets = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        words = [w.lower() for w in WORD.findall(text)]
        if len(words) >= max(size, least):
            sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        what = rng.random()
        if what < 0.4:
            words[k] = rng.choice("alpha beta gamma delta".split())
        elif what < 0.7:
            words.insert(k, "extra")
        elif len(words) > 5:
            del words[k]
    return words


@pytest.mark.parametrize("size, t, least", [(3, 0.6, 40), (5, 0.8, 0), (1, 1.0, 0), (2, 0.35, 0)])
def test_same_pairs_as_brute_force(spark, size, t, least):
    rng = random.Random(size)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for v in range(rng.randint(1, 5)):
            rows.append((f"r{g:02}-{v}", " ".join(edited(rng, base, v * 2))))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("copy2", rows[0][1]), (None, "a b c d e f"), ("nil", None), ("empty", ""), ("twice", "it's so so so " * 30)]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], SCHEMA).repartition(3)
    found = near_duplicates(df, "id", "text", shingle=size, threshold=str(t), min_words=least, bits=10)
    got = [tuple(r) for r in found.record_pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, size, t, least)


def test_long_text_and_many_copies(spark):
    text = " ".join(f"word{chr(97 + k % 26)}{'x' * (k % 7)}{chr(97 + k // 26 % 26)}" for k in range(30_000))
    rows = [(f"c{k}", "one two three four five six seven") for k in range(40)] + [("long1", text), ("long2", text + " end")]
    found = near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    assert {tuple(r) for r in found.class_pairs().select("size_a").collect()} != set()
    links = {r.id: (r.class_id, r.links) for r in found.links().collect()}
    assert len({links[f"c{k}"][0] for k in range(40)}) == 1 and links["c0"][1] == 0
    assert links["long1"][1] == 1 and links["long1"][0] != links["long2"][0]


def test_empty_table(spark):
    found = near_duplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert found.record_pairs().count() == found.links().count() == 0


def test_a_frequent_passage_makes_no_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(f"r{k}", " ".join(word() for _ in range(25)) + " " + passage + " " + " ".join(word() for _ in range(25))) for k in range(300)]
    rows += [(f"t{k}", passage + f" x{chr(97 + k)}") for k in range(3)]
    found = near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", shingle=3, threshold="0.6")
    assert {tuple(r) for r in found.record_pairs().collect()} == {("t0", "t1"), ("t0", "t2"), ("t1", "t2")} == brute(rows, 3, 0.6, 0)
