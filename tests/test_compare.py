from glyphmill.operators import compare, records, routes
from glyphmill.operators.compare import kind_of

BASE = "It's the same line.\nAnd a second one, too.\n"


def kinds(spark, a, b):
    df = spark.createDataFrame([(1, a.encode(), b.encode())], "id int, a binary, b binary")
    return compare.comparison(df).first()


def test_kinds_of_differences(spark):
    cases = {
        "identical": (BASE, BASE, []),
        "zwsp": (BASE, BASE.replace("same", "sa\u200bme"), ["invisible-character"]),
        "crlf": (BASE, BASE.replace("\n", "\r\n"), ["line-ending"]),
        "curly": (BASE, BASE.replace("'", "’"), ["typographic-substitution"]),
        "nfd": ("caf\u00e9 au lait", "cafe\u0301 au lait", ["normalization"]),
        "blank": ("one\ntwo", "one  \ntwo", ["trailing-whitespace"]),
        "other": (BASE, BASE.replace("second", "third"), ["other"]),
    }
    rows = [(k, a.encode(), b.encode()) for k, (a, b, _) in cases.items()] + [("nil", None, b"x")]
    got = {r.id: r for r in compare.comparison(spark.createDataFrame(rows, "id string, a binary, b binary")).collect()}
    for k, (a, b, want) in cases.items():
        assert list(got[k].classifications) == want, k
        assert got[k].byte_identical == (a == b)
    assert got["nil"].byte_identical is None


def test_byte_differences_and_cap(spark):
    df = spark.createDataFrame([(1, b"abc", "a\u200bbc".encode()), (2, b"ab" * 700, b"xb" * 700)], "id int, a binary, b binary")
    rows = compare.differences(df, "byte").collect()
    one = [r for r in rows if r.id == 1]
    assert (one[0].op, one[0].b_hex, one[0].b_decoded) == ("insert", "E2 80 8B", "\\u200B")
    many = [r for r in rows if r.id == 2]
    assert len(many) == 501 and many[-1].op == "truncated"


def test_kind_needs_line_end():
    assert kind_of("", " ", "a", "a", False, False) == "other"


def test_similarity(spark):
    docs = spark.createDataFrame([("m", "S01", "The cat sat"), ("m", "S10", "the CAT ran"), ("n", "S01", "x")], "slug string, item string, text string")
    pairs = compare.repeat_pairs(docs, spark.createDataFrame([("S01", "S10")], "item_a string, item_b string"), ["slug"], "item")
    got = {r.slug: r for r in compare.repeat_similarity(pairs, ["slug"]).collect()}
    assert got["m"].word_jaccard == 0.5 and got["m"].status == "complete"
    assert got["n"].status == "incomplete" and got["n"].word_jaccard == 0.0
    assert pairs.where("slug = 'm'").select(compare.similarity_ratio("text_a", "text_b").alias("r")).first().r > 0.3


def test_routes(spark):
    p = routes.probes(spark)
    got = {(r.id, r.route): r for r in routes.evaluate(routes.run_routes(p, "id", "content"), p.withColumnRenamed("content", "source")).collect()}
    assert len(got) == 14
    for (probe, route), r in got.items():
        if route == "clipboard":
            assert r.identical_to_source is None
        elif route == "pty":
            assert not r.identical_to_source and r.byte_delta == (routes.ascii_control() if probe == "ascii_control" else routes.unicode_probe()).count(b"\n")
        else:
            assert r.identical_to_source and r.byte_delta == 0
    bad = spark.createDataFrame([("x", b"\xff")], "id string, content binary")
    made = {r.route: r.content for r in routes.run_routes(bad, "id", "content").collect()}
    assert made["json_raw"] is None and made["json_escaped"] is None and made["text_rewrite"] is None


def test_records_verify(spark, tmp_path):
    import pytest

    from glyphmill.sources.sinks import write_manifest

    df = spark.createDataFrame([("a", "text é\n".encode()), ("b", b"\xff\xfe"), ("c", b"")], "id string, content binary")
    made = records.make_records(df, "id", "content", "control")
    assert made.where("sample_id = 'b'").first().text is None
    assert records.violations(made).first().asDict() == {"records": 3, "bad_sha": 0, "bad_length": 0, "bad_text": 0}
    assert write_manifest(made, f"file://{tmp_path}/m") == 3
    broken = made.withColumn("bytes_len", made.bytes_len + 1)
    assert records.violations(broken).first().bad_length == 3
    with pytest.raises(Exception, match="does not reproduce"):
        records.verified(broken).collect()
    both = records.union_kinds(made, made.withColumn("more", made.kind))
    assert both.count() == 6 and both.where("more is null").count() == 3


def test_long_stretches_are_cut_at_lines(monkeypatch):
    import random

    rng = random.Random(3)
    lines = [f"line {k} " + "".join(rng.choice("abcdef ") for _ in range(30)) for k in range(120)]
    a = "\n".join(lines)
    edited = [x.replace("line", "LINE") if k % 17 == 3 else x for k, x in enumerate(lines) if k % 29]
    b = "\n".join(edited[:60] + ["new"] + edited[60:])
    for most in (1 << 24, 500):
        monkeypatch.setattr(compare, "MATCHED", most)
        for x, y in ((a, b), (a.encode(), b.encode()), ("abc", "abXc"), ("", "x"), ("same", "same")):
            at_a = at_b = 0
            for op, i, j, k, m in compare._opcodes(x, y):
                assert x[at_a:i] == y[at_b:k] and op != "equal" and (x[i:j] or y[k:m])
                at_a, at_b = j, m
            assert x[at_a:] == y[at_b:]
