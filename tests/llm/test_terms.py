from collections import Counter

from glyphmill.llm.terms import TermStore
from glyphmill.llm.words import WORD
from glyphmill.storage import new_path

SCHEMA = "id string, text string, model string, at int"
FIELDS = {"text": "words", "model": "value"}


def brute(records):
    occurrences, n = Counter(), Counter()
    for text, model in records.values():
        words = [w.lower() for w in WORD.findall(text)] if text is not None else []
        for w in words:
            occurrences["text", w] += 1
        for w in set(words):
            n["text", w] += 1
        if model is not None:
            occurrences["model", model] += 1
            n["model", model] += 1
    return {(f, v, occurrences[f, v], n[f, v]) for f, v in n}


def test_batches_of_added_changed_and_deleted_records(spark):
    store = TermStore(spark, new_path(spark, "t"), FIELDS, buckets=4)
    assert store.counts().count() == 0 and store.total() == 0
    first = [("a", "The cat's cat, İ x² Straße", "M-1", 1), ("b", "the dog", None, 1), ("c", None, "m-1", 1), ("d", "", "M-1", 1), (None, "lost", "x", 1), ("a", "older", "M-0", 0)]
    store.apply(spark.createDataFrame(first, SCHEMA), "id", latest_by="at")
    state = {"a": first[0][1:3], "b": first[1][1:3], "c": first[2][1:3], "d": first[3][1:3]}
    assert {tuple(r) for r in store.counts().collect()} == brute(state) and store.total() == 4
    second = [("a", "The cat's cat, İ x² Straße", "M-1", 2), ("b", "the the bird", "M-2", 2), ("e", "new cat", None, 2)]
    store.apply(spark.createDataFrame(second, SCHEMA), "id", latest_by="at", deleted=spark.createDataFrame([("c",), ("zz",)], "id string"))
    state |= {"b": second[1][1:3], "e": second[2][1:3]}
    del state["c"]
    assert {tuple(r) for r in store.counts().collect()} == brute(state) and store.total() == 4
    again = TermStore(spark, store.path, FIELDS, buckets=4)
    assert again.version == 2
    again.apply(spark.createDataFrame([("c", "back", "m", 3)], SCHEMA), "id")
    state["c"] = ("back", "m")
    assert {tuple(r) for r in again.counts().collect()} == brute(state)
    again.apply(spark.createDataFrame([], SCHEMA), "id", deleted=spark.createDataFrame([(x,) for x in state], "id string"))
    assert again.counts().count() == 0 and again.total() == 0


def test_marks(spark):
    store = TermStore(spark, new_path(spark, "t"), FIELDS)
    store.apply(spark.createDataFrame([(str(k), "all " + "some " * (k % 3 == 0) + f"{'x' * (k + 1)}", None, 0) for k in range(30)], SCHEMA), "id")
    marks = {(r.value, r.mark) for r in store.marked(rare_max=2, common_share=0.4).collect()}
    assert ("all", "common") in marks and ("some", None) in marks and ("xxx", "rare") in marks


def test_a_small_batch_writes_what_it_changes_and_layers_are_merged(spark):
    store = TermStore(spark, new_path(spark, "t"), FIELDS, buckets=4)
    state = {f"r{k}": (" ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k, k + 9)), f"M{k % 3}") for k in range(400)}
    batch = lambda rows: spark.createDataFrame([(i, t, m, 0) for i, (t, m) in rows.items()], SCHEMA)
    store.apply(batch(state), "id")
    change = {"r5": ("only this", "M9")}
    store.apply(batch(change), "id", deleted=spark.createDataFrame([("r7",)], "id string"))
    state |= change
    del state["r7"]
    layer = spark.read.parquet(f"{store.path}/counts/layer/2")
    signed = {(r.value, r.records) for r in layer.collect()}
    assert ("only", 1) in signed and ("M9", 1) in signed and min(n for _, n in signed) == -2 and layer.count() < 30
    assert store._whole("counts") == store._whole("records") == 1
    assert {tuple(r) for r in store.counts().collect()} == brute(state) and store.total() == 399
    store.compact()
    assert store._whole("counts") == store._whole("records") == 2 and TermStore(spark, store.path, FIELDS).version == 2
    assert {tuple(r) for r in store.counts().collect()} == brute(state) and store.total() == 399
    more = {f"n{k}": (f"new{'x' * (k % 9)} word", None) for k in range(300)}
    store.apply(batch(more), "id")
    assert store._whole("records") == 3 and {tuple(r) for r in store.counts().collect()} == brute(state | more)
