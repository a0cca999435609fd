import numpy as np
import pytest
from conftest import SF, rows

from stratagraph.llm import mixing, queries

D = "doc_id long, text string, source string, tokens string"
T = "source string, target_share double, max_repeats int"


def test_pivotal_keeps_tokens_and_chances():
    r = np.random.default_rng(0)
    w, ids = r.integers(10, 500, 300).astype(float), np.arange(300)
    p = r.uniform(0, 1, 300)
    total = np.zeros(300)
    for seed in range(300):
        q = mixing.pivotal(ids, w, p, seed)
        assert ((q > 0) & (q < 1)).sum() <= 1 and abs((q * w).sum() - (p * w).sum()) < 1e-6
        total += q
    assert np.abs(total / 300 - p).max() < 0.15


def test_budgets_fill_what_caps_leave(spark):
    sizes = spark.createDataFrame([(i, "big", 10) for i in range(100)] + [(1000 + i, "small", 10) for i in range(5)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("Big ", 0.5, 2), ("small", 0.3, 3), ("none", 0.2, 9), (None, 0.1, 1)], T)
    plan = {r["source"]: r for r in mixing.budgets(sizes, targets)}
    assert plan["small"]["capped"] and plan["small"]["budget"] == 150 and plan["none"]["budget"] == 0
    assert plan["big"]["budget"] == pytest.approx(900) and not plan["big"]["capped"]


@pytest.mark.parametrize("bucket", [7, 20_000])
def test_draw(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = np.random.default_rng(1)
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", int(n)) for i, n in enumerate(r.integers(5, 200, 400))], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 4)], T)
    plan = mixing.budgets(sizes, targets)
    got = mixing.draw(sizes, plan).collect()
    assert len(got) == 400 == len({x["doc_id"] for x in got})
    for p in plan:
        drawn = sum(x["tokens"] * x["copies"] for x in got if x["source"] == p["source"])
        assert abs(drawn - p["budget"]) <= 200 and all(0 <= x["copies"] <= p["max_repeats"] for x in got if x["source"] == p["source"])
    assert rows(mixing.draw(sizes.repartition(7), plan)) == rows(mixing.draw(sizes, plan))
    assert {r["source"]: r["met"] for r in mixing.shares(mixing.draw(sizes, plan), plan).collect()} == {"a": True, "b": True}


def test_dirty_rows(spark):
    docs = [(1, "some text here", "A_b "), (1, "some text here", "a-b"), (2, None, "a-b"), (3, "", "a-b"), (4, "other", None), (5, "other", "unknown"), (None, "x", "a-b"), (6, "word " * 30_000, "A-B")]
    df, targets = spark.createDataFrame([(*d, "clash") for d in docs], D), spark.createDataFrame([("a-b", 1.0, 1)], T)
    drawn, plan = mixing.mix(df, targets)
    assert rows(drawn, "doc_id", "copies") == [(1, 1), (6, 1)]
    assert mixing.shares(drawn, plan).first()["reached_share"] == 1.0
    for d, t in ((df.limit(0), targets), (df, targets.limit(0))):
        drawn, plan = mixing.mix(d, t)
        assert drawn.count() == 0 and mixing.shares(drawn, plan).count() == len(plan)


def test_on_the_tables(spark):
    shares = queries.p9_shares(spark, SF).collect()
    assert abs(sum(r["reached_share"] for r in shares) - 1) < 1e-9 and all(abs(r["drawn_tokens"] - r["budget"]) <= 2500 for r in shares)
