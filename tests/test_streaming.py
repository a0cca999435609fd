import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stratagraph.sources.store import SnapshotStore, VersionedTable, apply_snapshot, read_snapshot, write_snapshot
from stratagraph.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_debounce(spark, tmp_path):
    spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(9)), ("b", at(0)), ("z", at(500))], "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    got = run(streams.debounced(stream, "k", "2 seconds", "10 seconds"), "debounced")
    assert rows(got, "k", "n") == [("a", 1), ("a", 2), ("b", 1)]


def test_breaker(spark, tmp_path):
    data = [("a", i, at(i), f) for i, f in enumerate([True, True, False, True, True, True])] + [("b", 9, at(3), True)]
    spark.createDataFrame(data, "k string, event_id long, ts timestamp, failed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, event_id long, ts timestamp, failed boolean").parquet(str(tmp_path / "in"))
    assert rows(run(streams.breaker_openings(stream, "k", 3), "opened")) == [("a", 5)]


def test_upserts_and_versions(spark, tmp_path):
    spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "k string, seq long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, seq long, v string").parquet(str(tmp_path / "in"))
    target = VersionedTable(spark, str(tmp_path / "t"))
    assert not target.exists()
    streams.upsert_into(stream, target, ["k"], "seq", str(tmp_path / "cp")).awaitTermination(120)
    assert rows(target.read(), "k", "v") == [("a", "new"), ("b", "x")]
    for i in range(3):
        target.upsert(spark.createDataFrame([("a", 10 + i, f"v{i}")], "k string, seq long, v string"), ["k"], "seq")
    target.delete(spark.createDataFrame([("b",)], "k string"), ["k"])
    assert rows(target.read(), "k", "v") == [("a", "v2")] and len(target.versions()) <= 2


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("f", 1), ("g", None)], "key string, n int")
    path = str(tmp_path / "s")
    info = write_snapshot(spark, path, {"nodes": df}, embed_model="m", embed_dim=3)
    assert info["counts"] == {"nodes": 2}
    assert write_snapshot(spark, path, {"nodes": df.orderBy("key", ascending=False)}, embed_model="m", embed_dim=3) == info
    with pytest.raises(ValueError):
        write_snapshot(spark, path, {"nodes": df.limit(1)})
    reason, _, tables = read_snapshot(spark, path, "m", 3)
    assert reason == "" and rows(tables["nodes"]) == rows(df)
    assert [read_snapshot(spark, path, *a)[0] for a in (("x", 3), ("m", 4))] == ["model", "dimension"]
    df.limit(1).write.mode("overwrite").parquet(f"{path}/nodes")
    assert read_snapshot(spark, path)[0] == "digest"
    assert read_snapshot(spark, str(tmp_path / "none"))[0] == "no manifest"


def test_upserts_touch_few_buckets(spark, tmp_path):
    """Buckets that hold no changed key stay where they are; versions can be read side by side; deleting leaves an empty table."""
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=8, keep=3)
    t.replace(spark.createDataFrame([(f"k{i}", 1, "old") for i in range(40)], "k string, seq long, v string"), ["k"])
    before = t._pointer(1)["parts"]
    t.upsert(spark.createDataFrame([("k1", 2, "new", 7), ("k1", 3, "newer", 8), ("k2", 0, "late", 9)], "k string, seq long, v string, extra int"), ["k"], "seq")
    after = t._pointer(2)["parts"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) in (1, 2)
    assert rows(t.read().where("k in ('k1', 'k2', 'k3')")) == [("k1", 3, "newer", 8), ("k2", 1, "old", None), ("k3", 1, "old", None)]
    assert rows(t.read(1).where("k = 'k1'")) == [("k1", 1, "old")] and t.read().count() == 40
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([("x", 1)], "v string, seq long"), ["v"], "seq")
    t.set_columns(spark.createDataFrame([("k3", "set"), ("none", "x")], "k string, v string"))
    assert rows(t.read().where("v = 'set'"), "k", "seq") == [("k3", 1)] and t.read().count() == 40
    t.delete_by(F.col("seq") == 1)
    assert rows(t.read(), "k") == [("k1",)]
    t.delete(spark.createDataFrame([("k1",)], "k string"), ["k"])
    assert t.read().count() == 0 and t.read().columns == ["k", "seq", "v", "extra"] and len(t.versions()) == 3
    with pytest.raises(FileExistsError):
        t.files.write(f"{t.base}/_v{t.versions()[-1]:08d}.json", "{}")
    t.drop()
    assert not t.exists()


def test_snapshot_store_and_restore(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    df = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    for i, sha in enumerate(("c1", "c2", "c3")):
        store.write("p", sha, {"nodes": df("f", sha)}, embed_model="m", embed_dim=3, created_at=float(i))
    assert [m["head_sha"] for m in store.manifests("p")] == ["c3", "c2", "c1"] and store.has("p", "c2") and not store.has("q", "c2")
    nodes, edges = VersionedTable(spark, str(tmp_path / "n")), VersionedTable(spark, str(tmp_path / "e"))
    nodes.replace(df("x"), ["key"])
    edges.replace(df("y"), ["key"])
    targets = {"nodes": (nodes, ["key"]), "edges": (edges, ["key"])}
    assert apply_snapshot(spark, store.path("p", "c2"), targets, "other") == "model" and rows(nodes.read()) == [("x",)]
    assert apply_snapshot(spark, store.path("p", "c2"), targets, "m", 3) == ""
    assert rows(nodes.read()) == [("c2",), ("f",)] and edges.read().count() == 0
    assert store.gc("p", 1) == ["c2", "c1"] and store.read("p", "c1")[0] == "no manifest" and store.read("p", "c3")[0] == ""
