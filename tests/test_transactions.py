import pytest

from corvane.operators import diffs
from corvane.sources import segments

DOCS = "uri string, text string, version int, change string"
EDITS = "uri string, start int, end int, new_text string, version int"


def made(spark, path):
    diffs.store_documents(spark.createDataFrame([("a", "one two", 1, "x"), ("b", "three", 1, "x"), ("c", "four😀five", 4, "y"), ("d", "six", 1, None)], DOCS), path)


def texts(spark, path):
    return {r["uri"]: (r["text"], r["version"]) for r in diffs.stored_documents(spark, path).collect()}


OLD = {"a": ("one two", 1), "b": ("three", 1), "c": ("four😀five", 4), "d": ("six", 1)}


def test_groups_are_whole_or_untouched(spark, tmp_path):
    path = str(tmp_path / "docs")
    made(spark, path)
    edits = spark.createDataFrame([("a", 0, 3, "ONE", 1), ("a", 7, 7, "!", 1), ("b", 0, 1, "T", 9), ("c", 4, 6, "-", 4), ("d", 3, 3, "teen", None)], EDITS)
    assert diffs.commit_edits(spark, path, edits, "change")
    assert texts(spark, path) == {**OLD, "c": ("four-ive", 5), "d": ("sixteen", 2)}
    said = {r["uri"]: (r["applied"], r["problem"]) for r in diffs.outcomes(spark, path).collect()}
    assert said == {"a": (False, "stale version"), "b": (False, "stale version"), "c": (True, ""), "d": (True, "")}
    # what was read for these edits is no longer there
    assert diffs.commit_edits(spark, path, spark.createDataFrame([("c", 0, 4, "x", 4)], EDITS), "change")
    assert texts(spark, path)["c"] == ("four-ive", 5)


@pytest.mark.parametrize("dies_in", ["_publish", "size"])
def test_a_run_that_dies(spark, tmp_path, monkeypatch, dies_in):
    """Before the manifest the old state stands; after it the new one does."""
    path = str(tmp_path / "docs")
    made(spark, path)

    def die(*a, **k):
        raise RuntimeError("gone")

    monkeypatch.setattr(segments, dies_in, die)
    with pytest.raises(RuntimeError):
        diffs.commit_edits(spark, path, spark.createDataFrame([("a", 0, 3, "ONE", 1)], EDITS), "change")
    monkeypatch.undo()
    assert texts(spark, path) == (OLD if dies_in == "_publish" else {**OLD, "a": ("ONE two", 2)})


def test_the_slower_of_two_writers_changes_nothing(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "docs"), segments.commit
    made(spark, path)
    fast = spark.createDataFrame([("a", 0, 3, "FAST", 1)], EDITS)

    def other_first(*a, **k):
        monkeypatch.setattr(segments, "commit", real)
        assert diffs.commit_edits(spark, path, fast, "change")
        return real(*a, **k)

    monkeypatch.setattr(segments, "commit", other_first)
    assert not diffs.commit_edits(spark, path, spark.createDataFrame([("b", 0, 1, "SLOW", 1)], EDITS), "change")
    assert texts(spark, path) == {**OLD, "a": ("FAST two", 2)}
