import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from stratagraph.llm import queries, similar

V = "space string, id string, vector array<float>"


def exact(vectors, k, limit):
    out = set()
    for space in {v[0] for v in vectors}:
        ids = [v[1] for v in vectors if v[0] == space]
        x = np.array([v[2] for v in vectors if v[0] == space], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 7)
        for i, a in enumerate(ids):
            near = sorted((-s[i, j], b) for j, b in enumerate(ids) if j != i and s[i, j] >= limit)[:k]
            out |= {(space, min(a, b), max(a, b)) for _, b in near}
    return out


def clustered(seed, n, dim, copies):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = r.standard_normal(dim)
        for j in range(copies):
            out.append((c + r.standard_normal(dim) * 0.25 * (j > 0)) * r.uniform(0.5, 5))
    return out


def test_against_brute_force(spark):
    data = [(s, f"{s}{i:04}", [float(x) for x in v]) for s, seed in (("a", 1), ("b", 2)) for i, v in enumerate(clustered(seed, 60, 16, 6))]
    got = set(rows(similar.similar_pairs(similar.neighbours(spark.createDataFrame(data, V), k=3, dim=16))))
    want = exact(data, 3, 0.85)
    assert len(want) > 200 and len(want - got) <= 0.02 * len(want) and len(got - want) <= 0.02 * len(want)


def test_copies_and_ties(spark):
    same = [("s", f"c{i:03}", [1.0, 2.0, 0.0, 1.0]) for i in range(150)] + [("s", "near", [1.0, 2.1, 0.0, 1.0]), ("s", "far", [-1.0, 0.0, 1.0, 0.0])]
    got = rows(similar.neighbours(spark.createDataFrame(same, V), k=2, dim=4), "a", "b")
    assert [b for a, b in got if a == "c000"] == ["c001", "c002"] and [b for a, b in got if a == "c149"] == ["c000", "c001"]
    assert [b for a, b in got if a == "near"] == ["c000", "c001"] and not [1 for a, b in got if "far" in (a, b)]
    few = [("s", f"c{i}", [1.0, 0.0]) for i in range(5)]
    assert rows(similar.neighbours(spark.createDataFrame(few, V), k=2, dim=2), "a", "b", "rank")[:2] == [("c0", "c1", 1), ("c0", "c2", 2)]


def test_unusable_and_old_rows(spark):
    nan = float("nan")
    data = [
        ("x", 1.0, [1.0, 0.0]), ("x", 2.0, None), ("y", 1.0, [1.0, nan]), ("z", 1.0, [0.0, 0.0]), ("w", 1.0, [1.0]), ("v", 1.0, [1.0, None]), ("u", 1.0, [1.0, float("inf")]),
        ("ok", None, [0.0, 1.0]), ("ok", 1.0, [1.0, 0.0]), ("ok", 1.0, [1.0, 0.0]), ("ok2", None, [2.0, 0.0]), (None, 1.0, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in data], "key string, ts double, vec array<float>, space string, version string")
    now = similar.current_vectors(df, "key", F.lit("s"), "vec", "ts", 2)
    assert rows(now, "id") == [("ok",), ("ok2",)]
    assert rows(similar.similar_pairs(similar.neighbours(now, dim=2))) == [("s", "ok", "ok2")]
    assert similar.neighbours(now.limit(0), dim=2).count() == 0


def test_too_many_spaces(spark, monkeypatch):
    monkeypatch.setattr(similar, "MAX_SPACES", 1)
    with pytest.raises(ValueError):
        similar.neighbours(spark.createDataFrame([("a", "1", [1.0]), ("b", "1", [1.0])], V), dim=1)


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_ROWS", 40)
    data = [("a", f"{i:04}", [float(x) for x in v]) for i, v in enumerate(clustered(5, 50, 8, 6))]
    got, want = set(rows(similar.similar_pairs(similar.neighbours(spark.createDataFrame(data, V), k=3, dim=8)))), exact(data, 3, 0.85)
    assert len(want - got) <= 0.03 * len(want) and len(got - want) <= 0.03 * len(want)


def test_lists_within_lists(spark, monkeypatch):
    """Two centroids at the first level and lists of at most 60 rows: the second level takes over and loses nothing."""
    monkeypatch.setattr(similar, "MAX_LISTS", 2)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 60)
    data = [("a", f"{i:04}", [float(x) for x in v]) for i, v in enumerate(clustered(6, 150, 8, 6))]
    df = spark.createDataFrame(data, V)
    index = similar.build_index(df.mapInArrow(similar._units(8), "space string, id string, vec binary"), {"a": len(data)}, 8, 3)["a"]
    assert len(index.centroids) == 2 and len(index.split) == 2 and len(index.parts) >= 20
    got, want = set(rows(similar.similar_pairs(similar.neighbours(df, k=3, dim=8)))), exact(data, 3, 0.85)
    assert len(want - got) <= 0.03 * len(want) and len(got - want) <= 0.03 * len(want)


def test_a_ball_that_no_centroid_parts(spark, monkeypatch):
    """Vectors all near to each other: lists in several parts, queries in several blocks, and the distance shrinks."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", 30)
    monkeypatch.setattr(similar, "BLOCK_QUERIES", 1)
    monkeypatch.setattr(similar, "MAX_SPLIT", 1)
    r = np.random.default_rng(8)
    data = [("a", f"{i:04}", [float(x) for x in 1 + r.standard_normal(8) * 0.1]) for i in range(400)]
    df = spark.createDataFrame(data, V)
    index = similar.build_index(df.mapInArrow(similar._units(8), "space string, id string, vec binary"), {"a": len(data)}, 8, 3)["a"]
    assert index.parts.max() > 1 and index.blocks.max() > 1
    got, want = set(rows(similar.similar_pairs(similar.neighbours(df, k=3, dim=8, nprobe=100)))), exact(data, 3, 0.85)
    assert got == want


@pytest.mark.parametrize("n", [similar.HEAVY - 1, similar.HEAVY, similar.HEAVY + 1])
@pytest.mark.parametrize("groups", [0, 50_000])
def test_copies_around_the_threshold(spark, monkeypatch, n, groups):
    """Groups of copies give the same pairs below, at and above HEAVY, with joins by broadcast and by salts."""
    monkeypatch.setattr(similar, "BROADCAST_GROUPS", groups)
    data = [("s", f"c{i:03}", [1.0, 2.0, 0.0, 1.0]) for i in range(n)] + [("s", "a", [1.0, 2.1, 0.0, 1.0]), ("s", "z", [1.0, 2.2, 0.0, 1.0])]
    assert set(rows(similar.similar_pairs(similar.neighbours(spark.createDataFrame(data, V), k=2, dim=4)))) == exact(data, 2, 0.85)


def test_without_a_least_cosine_the_distance_shrinks(spark):
    """The k most similar of every vector, however far they are, and far fewer pairs than there are reach the last columns."""
    data = [("a", f"{i:04}", [float(x) for x in v]) for i, v in enumerate(clustered(9, 200, 32, 3))]
    got = set(rows(similar.similar_pairs(similar.neighbours(spark.createDataFrame(data, V), k=2, dim=32, min_cosine=-1, nprobe=100))))
    want = exact(data, 2, -1)
    assert len(want - got) <= 0.02 * len(want) and len(got - want) <= 0.02 * len(want)
    x = np.array([v[2] for v in data], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = similar.Nearest(np.arange(600), 2, 4.0)
    i, j, d = similar.scan(x, x[:256], 4.0)
    found.add(i[i != j], j[i != j], d[i != j])
    later = similar.scan(x, x[256:], found.limit)[0]
    assert len(i) == 600 * 256 and len(later) < 0.3 * 600 * 344


def test_scan_drops_nothing_within_the_limit():
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 64))
    x = np.concatenate([x, x + r.standard_normal((400, 64)) * 0.3]) @ similar.rotation(64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    i, j, d = similar.scan(x, x, 0.3)
    full = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) >= set(zip(*(a.tolist() for a in np.nonzero(full < 0.2999)), strict=True))
    assert np.allclose(d, full[i, j], atol=1e-5)


def test_recall_on_the_tables(spark):
    assert all(r["recall"] >= 0.9 for r in queries.p1_recall(spark, SF).collect())
