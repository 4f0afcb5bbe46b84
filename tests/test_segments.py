import os

from corvane.sources import segments


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def put(spark, path, number, rows, gone, **k):
    return segments.commit(spark, path, number, {"t": spark.createDataFrame(rows, "k string, v int").coalesce(1)}, spark.createDataFrame([(g,) for g in gone], "k string").coalesce(1), **k)


def held(spark, path):
    return sorted(tuple(r) for r in segments.live(spark, path, "t", "k").select("k", "v").collect())


def test_segments(spark, tmp_path):
    path = str(tmp_path / "s")
    assert segments.manifest(spark, path) is None
    first = [(f"k{n}", n) for n in range(2000)]
    assert put(spark, path, 1, first, [k for k, _ in first], ratio=9.0)
    before = size_of(path)
    assert put(spark, path, 2, [("k1", -1), ("new", 7)], ["k1", "k2", "new"], ratio=9.0)
    assert size_of(path) - before < before / 10  # a batch writes what changed
    want = sorted([r for r in first if r[0] not in ("k1", "k2")] + [("k1", -1), ("new", 7)])
    assert held(spark, path) == want
    assert not put(spark, path, 2, [("k9", 0)], ["k9"]) and held(spark, path) == want
    # a commit that dies before its manifest leaves nothing to read
    spark.createDataFrame([("k3", 99)], "k string, v int").write.parquet(f"{path}/segment-000000000000003-dead/t")
    assert held(spark, path) == want
    old = segments.manifest(spark, path)
    assert put(spark, path, 3, [("k3", -3)], ["k3"], ratio=0.0)
    now = segments.manifest(spark, path)
    assert len(now["segments"]) == 1 and now["number"] == 3
    assert held(spark, path) == sorted([r for r in want if r[0] != "k3"] + [("k3", -3)])
    assert all(os.path.isdir(f"{path}/{s}") for s in old["segments"])  # readers of the last versions go on
    for number in range(4, 8):
        put(spark, path, number, [("k4", number)], ["k4"], ratio=0.0)
    assert not any(os.path.isdir(f"{path}/{s}") for s in old["segments"])


def test_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "s")
    put(spark, path, 1, [("a", 1)], ["a"])
    assert not segments._publish(spark, path, 1, 0, ["other"], {})
    assert held(spark, path) == [("a", 1)]
