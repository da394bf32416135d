import json

from glyphmill.__main__ import main


def test_scan_and_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("a bridge\u200b of stone\n")
    (tmp_path / "b.txt").write_text("a bridge of stone\n")
    a, b = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    assert main(["scan", a, b]) == 0
    shown = capsys.readouterr().out
    assert shown.isascii() and "U+200B" in shown
    assert main(["scan", "--json", a]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["has_invisible_characters"]
    assert main(["scan", str(tmp_path / "none")]) == main(["compare", a, str(tmp_path / "none")]) == 2
    assert main(["compare", b, b]) == 0 and main(["compare", a, b]) == 1
    capsys.readouterr()
    assert main(["compare", "--json", a, b]) == 1
    found = json.loads(capsys.readouterr().out)
    assert not found["byte_identical"] and found["char_differences"][0]["a_codepoints"] == [["U+200B", "ZERO WIDTH SPACE"]] and found["char_differences"][0]["classification"] == "invisible-character"
