import numpy as np
import pytest
from conftest import SF, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare, connect
from stratagraph.llm import percentiles, queries

X = "g string, x double"


@given(st.lists(st.lists(st.sampled_from([-2.5, 0.0, 1.0, 1.5, 7.0, float("inf"), float("-inf")]), min_size=1, max_size=12), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_selecting_in_a_task(lists):
    every = np.sort(np.concatenate(lists))
    values, _ = percentiles.select_together([np.sort(np.array(x)) for x in lists], np.arange(1, len(every) + 1))
    assert values.tolist() == every.tolist()


def nearest(xs, p):
    return sorted(xs)[max(1, -(-len(xs) * p // 100)) - 1]


@pytest.mark.parametrize(("array", "fan_in", "trim", "together"), [(64, 256, 4, 0), (7, 2, 1, 1), (65_536, 3, 100, 300), (64, 256, 4, 65_536)])
def test_against_sorting(spark, monkeypatch, array, fan_in, trim, together):
    monkeypatch.setattr(percentiles, "TOGETHER", together)
    monkeypatch.setattr(percentiles, "ARRAY", array)
    monkeypatch.setattr(percentiles, "FAN_IN", fan_in)
    monkeypatch.setattr(percentiles, "TRIM", trim)
    r = np.random.default_rng(1)
    groups = {"ties": [5.0] * 300 + [1.0], "tail": list(r.pareto(1, 500)), "one": [7.0], "two": [1.0, 2.0], "modes": [*r.normal(10, 1, 200), *r.normal(99, 1, 100)]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], X).repartition(5)
    got = rows(percentiles.percentile_rows(percentiles.multi_select(df), ["g"]), "g", "percent", "value", "n")
    assert got == sorted(((g, float(p), nearest(xs, p), len(xs)) for g, xs in groups.items() for p in percentiles.PERCENTS), key=lambda t: tuple((True, str(x)) for x in t))


@pytest.mark.parametrize("n", [3, 90, 3000])
def test_groups_of_every_size_take_rounds(spark, monkeypatch, n):
    """Three values take rounds as well as thousands, in a task or as jobs, and their number grows with the logarithm."""
    parts = [np.arange(i, n, 7.0) for i in range(min(7, n))]
    values, taken = percentiles.select_together(parts, np.array([1, (n + 1) // 2, n]))
    assert values.tolist() == [0, (n + 1) // 2 - 1, n - 1] and 2 <= taken <= 2 + 2.5 * np.log2(n)
    monkeypatch.setattr(percentiles, "TOGETHER", 0)
    rounds, run = [], percentiles.round_stats
    monkeypatch.setattr(percentiles, "round_stats", lambda *a: rounds.append(1) or run(*a))
    df = spark.range(n).selectExpr("'g' as g", "cast(id as double) as x").repartition(6)
    assert rows(percentiles.multi_select(df, (50,)), "value") == [(float(nearest(range(n), 50)),)]
    assert 2 <= len(rounds) <= 2 + 2.5 * np.log2(n)


def test_ladders_combine_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "RUNGS", 20)
    r = np.random.default_rng(2)
    days = {f"2024-0{m}-{d:02}": [float(x) for x in r.exponential(10 * m, 150 + d)] for m in (1, 2) for d in range(1, 6)}
    df = spark.createDataFrame([("lat", "b", day, x) for day, xs in days.items() for x in xs], "metric string, backend string, day string, x double")
    got = percentiles.with_months(percentiles.daily(df, 20)).collect()
    assert {(x["grain"], x["period"]) for x in got} == {("month", "2024-01"), ("month", "2024-02"), ("total", "all")}
    for x in got:
        every = np.sort([v for day, xs in days.items() if x["period"] in ("all", day[:7]) for v in xs])
        rank, want = np.searchsorted(every, x["value"], "right"), percentiles.nearest_rank(len(every), x["percent"])
        assert x["n"] == len(every) and abs(rank - want) <= x["rank_error"]


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    r = spark.createDataFrame([(1, 0.0, 5.0, 1.0), (1, 86400.0, 7.0, nan), (1, 86400.0, 7.0, nan), (2, 86400.0, -1.0, inf), (3, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (4, 86401.0, 0.0, -0.0)], "id long, ts double, total_ms double, embed_ms double")
    h = spark.createDataFrame([(1, " A", 3.0, 5.0, "x"), (2, "a ", 4.0, None, "x"), (3, None, 4.0, 1.0, "x"), (4, "A", 5.0, 6.0, "x")], "id long, backend string, ts double, latency_ms double, day string")
    assert rows(percentiles.measures(r, h)) == [("embed_ms", "", "1970-01-02", 0.0), ("latency_ms", "a", "1970-01-01", 5.0), ("latency_ms", "a", "1970-01-01", 6.0), ("total_ms", "", "1970-01-02", 0.0), ("total_ms", "", "1970-01-02", 7.0)]
    assert percentiles.percentile_rows(percentiles.daily(percentiles.measures(r.limit(0), h.limit(0))), ["day"]).count() == 0


@pytest.mark.parametrize("name", list(queries.SQL))
def test_oracle(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF) == ""
