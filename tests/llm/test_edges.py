"""Every operator over rows with nulls, empty and long texts, repeats, clashing and odd names, and string identifiers."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, exact_dedup, flac, lm, mixing, packing, pii, simhash, toxicity, url_filter
from tests.llm.helpers import SCHEMA, edge_rows, random_rows

#: Names that the operators use inside.
CLASHING = ("_l", "_y", "_i", "_t", "_own", "_id", "_fp", "_source", "_size", "_draw", "_c", "_last", "_q", "_bucket", "_held", "_row", "_copies", "shard", "node", "length", "_n")


def labels(spark, key="long"):
    return spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id long, toxic int").select(F.col("doc_id").cast(key).alias("doc_id"), "toxic")


def made(spark, how):
    df = spark.createDataFrame(edge_rows() + random_rows(40), SCHEMA).select("doc_id", "text", "source").repartition(3)
    if how == "names":
        odd = df.select(F.concat(F.lit("d"), "doc_id").alias("doc.id"), F.col("text").alias("te`xt"), F.col("source").alias("my source"))
        return odd.withColumns({c: F.lit(c) for c in CLASHING}), "doc.id", "te`xt", "my source"
    return df.where("false"), "doc_id", "text", "source"


#: Operators that give one row for each of the input's, and those that return the input's columns.
WHOLE = {
    "op1": lambda d, i, t, s: simhash.near_groups(d, i, t),
    "op1 similar": lambda d, i, t, s: simhash.similar_groups(d, i, t),
    "op2": lambda d, i, t, s: pii.find(d, i, t, weights=pii.start_weights(__import__("numpy").random.default_rng(1))),
    "op3": lambda d, i, t, s: toxicity.scored(d, toxicity.fit(d, labels(d.sparkSession), i, t), i, t),
    "op4": lambda d, i, t, s: exact_dedup.with_groups(d, i, t),
    "op5": lambda d, i, t, s: lm.score(d, id_col=i, text_col=t),
    "op8": lambda d, i, t, s: flac.digests(flac.store(d, i, t)),
}
ROWS = {
    "op1": lambda d, i, t, s: simhash.dedup(d, i, t),
    "op1 similar": lambda d, i, t, s: simhash.dedup_similar(d, i, t),
    "op3": lambda d, i, t, s: toxicity.clean(d, labels(d.sparkSession), i, t),
    "op4": lambda d, i, t, s: exact_dedup.dedup(d, i, t),
    "op6": lambda d, i, t, s: mixing.mix(d, i, t, s),
}


@pytest.mark.parametrize("how", ["names", "empty"])
@pytest.mark.parametrize("name", list(WHOLE))
def test_one_row_for_each(spark, name, how):
    df, i, t, s = made(spark, how)
    got = WHOLE[name](df, i, t, s)
    assert got.count() == df.count()
    if how == "names":
        assert [x for x in got.dtypes if x[0] in ("_id", "doc_id")][0][1] == "string"


@pytest.mark.parametrize("how", ["names", "empty"])
@pytest.mark.parametrize("name", list(ROWS))
def test_same_columns(spark, name, how):
    df, i, t, s = made(spark, how)
    got = ROWS[name](df, i, t, s)
    assert got.columns == df.columns
    assert (got.count() == 0) == (how == "empty")


@pytest.mark.parametrize("how", ["names", "empty"])
def test_packing(spark, how):
    df, i, t, _ = made(spark, how)
    got = packing.pack(packing.pieces(df, i, t))
    assert got.where("piece = 0").count() == df.count()


def test_packing_of_one_row_many_times(spark):
    """Copies of one row are dealt over the shards."""
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    got = packing.pack(packing.pieces(df), shard=64)
    assert got.count() == 3000 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_chat_names_by_strings(spark):
    rows = [("b", 0, "user", "hi", 1), ("b", 1, "assistant", None, 1), (None, 0, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, part int")
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.segments(df)).collect()}
    assert got == {"b": 2, None: 1}


def test_urls_null_long_and_repeated(spark):
    long_ = "http://a.net/" + "x" * 200_000
    rows = [(None, "http://b.net/"), ("u", None), ("u", None), ("v", long_), ("w", "no scheme")]
    df = spark.createDataFrame(rows, "`page.id` string, `u``rl` string")
    got = sorted(((r["_id"], len(r["path"]), r["rule"]) for r in url_filter.judge(df, url_filter.rules_table(spark), "page.id", "u`rl").collect()), key=str)
    assert got == sorted([(None, 1, "net/"), ("u", 0, None), ("u", 0, None), ("v", 200_001, "net/"), ("w", 0, None)], key=str)


def test_one_text_of_a_repeated_label(spark):
    """Which of an identifier's texts trains does not depend on the order of rows."""
    rows = [(k, f"{'bad awful' if k % 2 else 'good nice'} word{k % 7} " * 5) for k in range(1, 60)]
    lab = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, toxic int")
    twice = rows + [(k, t + " again") for k, t in rows]
    a = toxicity.fit(spark.createDataFrame(twice, "doc_id long, text string"), lab)
    b = toxicity.fit(spark.createDataFrame(twice[::-1], "doc_id long, text string").repartition(4), lab)
    assert all((a["net"][k] == b["net"][k]).all() for k in a["net"])
