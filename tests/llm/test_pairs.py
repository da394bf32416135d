import os

import numpy as np
import pytest

from glyphmill.llm.pairs import Vocabulary, ending_keys, expected_language, is_copy, is_empty, is_other_language, is_refusal, judged, language_shares, open_code, pair_defects, start_keys, unquoted

FOLDER = "/root/testdata/sf0.001"

PROMPT = "Explain to a colleague why the pump at Kelen behaves that way. Keep it plain."


@pytest.mark.parametrize("text", [None, "", " \n\u3000", "\u200b", "...", "—", "N/A", "[empty]", "(no output)", "null", '""', "<no answer>", "Keine Antwort."])
def test_empty(text):
    assert is_empty(text)


@pytest.mark.parametrize("text", ["No.", "7", "\U0001f642", "Nothing moved the pump."])
def test_not_empty(text):
    assert not is_empty(text)


def test_copies():
    for x in (PROMPT, PROMPT.upper(), "Prompt: " + PROMPT, "> " + PROMPT, "  " + PROMPT.replace(" ", "  ") + "\n", PROMPT.replace("colleague ", ""), PROMPT[:-1] + "?", f'"{PROMPT}"', "You asked: " + PROMPT):
        assert is_copy(x, PROMPT), x
    for x in (f"> {PROMPT}\n\nThe pump is old, so its valve sticks after each flood.", "The pump at Kelen is old.", "Explain to a colleague", "The pump behaves that way because the valve at its base is worn."):
        assert not is_copy(x, PROMPT), x


@pytest.mark.parametrize("text", ["I'm sorry, but I can’t help with that.", "Hello! As a text model I cannot produce this kind of content. I hope you understand.", "Dazu möchte ich nichts schreiben.", "Il m'est impossible d'écrire ce texte.", "Lo siento, no puedo ayudar con eso.", "К сожалению, я вынужден отказаться от этой задачи.", "申し訳ありませんが、この依頼にはお答えできません。", "No answer can be given to this request about the coin; it falls outside what I may write."])
def test_refusals(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", ["Sorry for the wait; the pump is old.", 'Ann wrote to me: "I\'m sorry, I can\'t help with the pump." The valve broke before noon. No one came.', "I can't write verse, but here is the story. " + "The pump moved the cart in good order. " * 8])
def test_no_refusals(text):
    assert not is_refusal(text)


def test_languages():
    assert expected_language(PROMPT) == "en" and expected_language(PROMPT + " Reply entirely in German.") == "de"
    assert expected_language("漁師と職人について短い文章を書いてください。") == "ja" and expected_language("Schreibe einen kurzen Text auf Englisch.") == "en"
    german = "Der Zähler misst ohne Grund das Maß, und die Höhe ist nicht von der Brücke. Das Rad öffnet im Winter die Mühle."
    english = "The pump moved the cart after the flood. Every valve in the old barn held some water."
    assert is_other_language("Here is the text you asked for.\n\n" + german, PROMPT) and is_other_language(english, PROMPT + " Answer in German.")
    assert not is_other_language(english + " " + german[:60] + ". " + english, PROMPT) and not is_other_language(german, PROMPT + " Answer in German.")


def test_open_code():
    assert open_code("f(a, [1") and open_code('{"a": "b') and not open_code("f('(', \"it's\")  # (") and not open_code('{"a": [1, "\\""]}')


def test_pairs_of_a_table(spark):
    whole = "The pump moved the cart after the flood. Every valve in the old barn held some water. People from Kelen closed the gate before noon."
    rows = [(f"w{k}", whole if k % 2 else whole[:-1], " p1 ", "model_output") for k in range(60)]
    rows += [("cut1", whole + " Every valve in the", "P1", "x"), ("cut2", whole + " People from Kelen clo", "p1", "x"), ("cut3", "- take the cart\n- close the", "l", "x"), ("item", "- take the cart\n- close the gate", "L", "x"), ("nil", None, "P1", "x"), ("nil", None, "P1", "x"), ("copy", PROMPT, "P1", "x"), ("json", '{"a": [1', "J", "x"), ("okj", '{"a": [1]}', "J", "x"), ("gone", "", "unknown", "x"), (None, "", "P1", "x"), ("rep", PROMPT.lower(), "P2", "x")]
    rows += [(f"i{k}", "- take the cart\n- close the gate\n- open the valve", "L", "x") for k in range(20)]
    answers = spark.createDataFrame(rows, "sample_id string, text string, prompt_id string, prompt string")
    prompts = spark.createDataFrame([("P1", PROMPT, "factual_prose", "x"), ("P2", PROMPT, "repeat_of_P1", "x"), ("L", "List steps. One step per line.", "list", "x"), ("J", "Give one JSON object.", "json_schema", "x"), (None, "?", None, "x")], "prompt_id string, text string, category string, pid string")
    found = pair_defects(answers, prompts)
    got = sorted(map(tuple, found.found.collect()))
    assert got == sorted([("cut1", "truncated"), ("cut2", "truncated"), ("cut3", "truncated"), ("nil", "empty"), ("copy", "copy"), ("json", "truncated"), ("rep", "copy")])
    assert pair_defects(answers.limit(0), prompts).found.count() == 0 and pair_defects(answers, prompts.limit(0)).found.count() == 0


def test_length_hides_nothing():
    assert is_empty("​" * 201) and is_empty(" .\n" * 5000) and is_empty("-" * 900 + "n/a") and not is_empty("-" * 900 + "no pump, no valve, no gate")
    assert is_copy(PROMPT + " " * 400, PROMPT) and is_copy(PROMPT.replace(" ", "​ \n"), PROMPT) and is_copy("Sum it.", "Sum it.") and not is_copy("Sum of 3", "Sum it.")
    refusal = "I'm sorry, but I can't help with that. My guidelines do not allow it. "
    assert is_refusal(refusal * 12) and is_refusal(" " * 900 + refusal) and not is_refusal(refusal + "The pump moved the cart in good order. " * 30)
    quoted = 'Ann wrote: "' + refusal * 40 + '" The valve broke.'
    assert not is_refusal(quoted) and unquoted('a "b" “c ”d "e\nf"') == 'a    d "e\nf"'


def test_languages_beyond_the_common_ones():
    polish = "Wczoraj pompa nie działała, ale po naprawie jest już dobrze i wszyscy są zadowoleni."
    estonian = "Pump seisis terve hommiku vaikselt maja taga, kuni vanaema leidis lõpuks uue kraani, avas ettevaatlikult ukse, vaatas korraks ringi, naeratas ning läks rõõmsalt tagasi tuppa sooja teed jooma."
    assert is_other_language(polish, PROMPT) and is_other_language(estonian, PROMPT) and not language_shares(estonian).get("en")
    assert language_shares("Насос не працює, але її чекають і вони їдуть").get("uk", 0) > 0.01


def test_keys_of_words_follow_their_starts():
    words = ["Pump", "pumpen", "É", "a" * 5000]
    keys, whole, owner = start_keys(words)
    assert list(np.bincount(owner)) == [4, 6, 1, 5000] and list(np.flatnonzero(whole)) == [3, 9, 10, 5010]
    assert keys[3] == keys[7] == start_keys(["PUMP"])[0][3] and len(set(keys[11:].tolist())) == 5000
    keys, whole = ending_keys(words)
    assert len(keys) == 2 + 4 + 0 + 4998 and keys[1] == keys[3] == ending_keys(["ump"])[0][0] and list(np.flatnonzero(whole)) == [1, 5, 5003]


def test_the_end_of_a_long_sentence_and_an_open_bracket():
    v = Vocabulary()
    long = "and then the pump moved the cart " * 300
    assert judged('"' + long + "to the old barn", PROMPT, "factual_prose", frozenset(), v)[0] == "truncated"
    assert judged("The valve broke. (In short, they sold lids, caps, etc.", PROMPT, "factual_prose", frozenset(), v)[0] == "truncated"
    assert judged('The valve broke. "No. Not the lid," Ann said, and the pump ran.', PROMPT, "factual_prose", frozenset(), v)[0] is None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_same_rows_under_any_layout(spark):
    answers, prompts = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("manifest", "prompts"))
    names = spark.createDataFrame([(f"n{k}", f"People from {w} closed the gate near {w}", "S01", "model_output") for k, w in enumerate(["Kelen", "Kelbar", "Kelan", "Marlen", "Torlen", "Halen", "Orlen", "Beltor"] * 9)], "sample_id string, text string, prompt_id string, kind string")
    answers = answers.where("kind = 'model_output'").select("sample_id", "text", "prompt_id").unionByName(names.drop("kind"))
    found = [sorted(map(tuple, pair_defects(answers.repartition(n), prompts).found.collect())) for n in (1, 8, 200)]
    assert found[0] == found[1] == found[2] != []
