import itertools
import random
import unicodedata

from glyphmill.llm.lookalike import Rewriter, _image, hidden_pairs, look_classes, lookalikes, mapping, uniform_texts

POOL = "abeoAO аеоё\u0327\u0323\u0301\u0300\u0308\u0302\u200bｆｗﬁﬃ가각\u00a0éÅǖṩְ֑क़क़ཱིུい゙か\t\n"


def plain(text):
    alike, table = lookalikes(), {}
    for cp in mapping()["source"].tolist():
        table[cp] = _image(chr(cp), alike)
    return unicodedata.normalize("NFC", text.translate(table))


def test_equals_translation_and_canonical_composition():
    rng, rewriter, alike = random.Random(2), Rewriter(mapping()), lookalikes()
    table = {cp: _image(chr(cp), alike) for cp in mapping()["source"].tolist()}
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert rewriter(texts) == [unicodedata.normalize("NFC", t.translate(table)) for t in texts]
    assert rewriter(rewriter(texts)) == rewriter(texts)


def test_what_looks_the_same_and_what_does_not(spark):
    base = "The quick brown fox café jumps"
    same = [base.replace("e", "е"), base.replace(" ", "\u2003"), unicodedata.normalize("NFD", base), base.replace("qu", "q\u200bu"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in base)]
    differ = [base.upper(), base.replace("é", "e"), base.replace(" ", "  "), base + "-", base.replace("fox", "f0x"), base + "\n", base.replace("a", "–")]
    rows = [(k, t, "clash") for k, t in enumerate([base, *same, *differ, base])] + [(90, None, ""), (91, "", ""), (92, "shоrt", ""), (93, "short", ""), (None, same[0], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = {tuple(r) for r in hidden_pairs(df, "doc_id", "text").collect()}
    group = [0, *range(1, len(same) + 1), len(rows) - 6]
    want = {(a, b) for a, b in itertools.combinations(group, 2) if rows[a][1] != rows[b][1]}
    assert got == want
    forms = uniform_texts(df, "doc_id", "text")
    assert forms.count() == len(rows) and forms.where("text is null and form is null").count() == 1
    assert hidden_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_long_texts_are_whole(spark):
    text = ("ａ\u0301 " * 700_000)[:-1]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert uniform_texts(df, "doc_id", "text").first().form == ("á " * 700_000)[:-1]


def test_classes_hold_what_pairs_hold(spark):
    base = "The quick brown fox jumps over"
    rows = [(k, base.replace("o", "о") if k % 3 == 1 else base) for k in range(40)] + [(50, "short"), (51, None), (None, base), (0, base), (52, base.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in look_classes(df, "doc_id", "text").collect()}
    assert set(got) == {*range(40), 52} and {(r.spellings, r.records) for k, r in got.items() if k < 40} == {(2, 40)} and got[52].spellings == 1
    pairs = {(a, b) for a in got for b in got if a < b and got[a].class_id == got[b].class_id and got[a].stored_id != got[b].stored_id}
    assert pairs == {tuple(r) for r in hidden_pairs(df, "doc_id", "text").collect()}
    assert look_classes(df.limit(0), "doc_id", "text").count() == 0
