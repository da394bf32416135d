import pytest

from glyphmill.llm.sentences import sentence_units, units

CASES = [
    ("Dr. Ames left at 5 p.m. Some tools, e.g. saws, cost 3.5 kg. Done!", ["Dr. Ames left at 5 p.m.", "Some tools, e.g. saws, cost 3.5 kg.", "Done!"]),
    ('"Where is it?" Ann asked twice. He said, "It broke. It fell." No one came.', ['"Where is it?" Ann asked twice.', 'He said, "It broke. It fell."', "No one came."]),
    ('The sign said "Closed. No lids." and Bo left. (In short, it ran.) 12 men sat.', ['The sign said "Closed. No lids." and Bo left.', "(In short, it ran.)", "12 men sat."]),
    ("THE OLD HEADING\n\nIt was\nwrapped here. next begins low?!So does this… Yes", ["THE OLD HEADING", "It was\nwrapped here.", "next begins low?!", "So does this…", "Yes"]),
    ("Good! \U0001f642 Then T. P. Maro (see Fig. 3 and pp. 4-9) waited ... and left.", ["Good! \U0001f642", "Then T. P. Maro (see Fig. 3 and pp. 4-9) waited ... and left."]),
    ("Am 27. Oktober misst Dr. Ulm, z. B. bei Kelen, ca. 2,5 m usw. „Halt!“, rief er. Ende.", ["Am 27. Oktober misst Dr. Ulm, z. B. bei Kelen, ca. 2,5 m usw.", "„Halt!“, rief er.", "Ende."]),
    ("«\xa0Non\xa0!\xa0», s'écrie Luc. Il répond : « Oui. » Fin.", ["«\xa0Non\xa0!\xa0», s'écrie Luc.", "Il répond : « Oui. »", "Fin."]),
    ("¿Dónde está? «Aquí», dijo Ana. Miden aprox. 3 m. ¡Sí!", ["¿Dónde está?", "«Aquí», dijo Ana.", "Miden aprox. 3 m.", "¡Sí!"]),
    ("В 1743 г. Павко спит, т. е. молчит. «Стой!» — сказал он. Да.", ["В 1743 г. Павко спит, т. е. молчит.", "«Стой!» — сказал он.", "Да."]),
    ("水深2.5米。有人说：“好。”“谁来？”渔夫问道。完了！", ["水深2.5米。", "有人说：“好。”", "“谁来？”渔夫问道。", "完了！"]),
    ("「昔だ。」と先生は言った。次だ。", ["「昔だ。」と先生は言った。", "次だ。"]),
    ("नदी है। डॉ. कल 3.2 मीटर आए। क्या?", ["नदी है।", "डॉ. कल 3.2 मीटर आए।", "क्या?"]),
    ("ครูพบเรือ ครูวัด 24 ครั้ง ตลาดปิด", ["ครูพบเรือ", "ครูวัด 24 ครั้ง", "ตลาดปิด"]),
    ("هل يفتح؟ يرسم 18.8 متر. نعم.", ["هل يفتح؟", "يرسم 18.8 متر.", "نعم."]),
    ("It was 8 a\u200b.m. wh\u00aden he le\u2060ft. Bye.", ["It was 8 a\u200b.m. wh\u00aden he le\u2060ft.", "Bye."]),
    ('An open "mark never closes. Still two.', ['An open "mark never closes.', "Still two."]),
    ("a.\n \n\u3000b", ["a.", "b"]),
    ("Take:\n1. the saw. It cuts.\n2. the lid\n   of tin\n   - red\n   - blue\n3. all of it", ["Take:", "1. the saw.", "It cuts.", "2. the lid\n   of tin", "- red", "- blue", "3. all of it"]),
    ("It fell in\n12. A dash\n- is no list, and\n- nor is this.", ["It fell in\n12.", "A dash\n- is no list, and\n- nor is this."]),
    ("- Only one mark. Not a list.", ["- Only one mark.", "Not a list."]),
    ('"Go!" the tall and patient keeper of the long grey bridge that ran across the river beside the mill where Ann and all of her many friends used to walk each single evening in most years said. Bo left.', ['"Go!" the tall and patient keeper of the long grey bridge that ran across the river beside the mill where Ann and all of her many friends used to walk each single evening in most years said.', "Bo left."]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_units(text, want):
    assert [text[a:b] for a, b in units(text)] == want


def test_lines_blanks_and_long_texts():
    assert units(None) == units("") == units(" \n\u3000\t") == units("\u200b \ufeff") == []
    text = "- one. two\n\n  - three  \r\nfour"
    assert [text[a:b] for a, b in units(text, True)] == ["- one. two", "- three", "four"]
    assert len(units("It ran. " * 50_000)) == 50_000
    assert len(units("(" * 60_000 + "]" * 60_000)) == 1


def test_rows(spark):
    rows = [(1, "One. Two.", None, 1), (2, "One. Two.", "list", 1), (3, None, None, 1), (1, "One. Two.", None, 1), (None, "X.", "prose", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt_category string, start int")
    got = sorted(map(tuple, sentence_units(df, "doc_id", "text", "prompt_category").collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (1, 5, 9), (2, 0, 9), (None, 0, 2)], key=str)
    assert sentence_units(df.limit(0), "doc_id", "text").count() == 0
