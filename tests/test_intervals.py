import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratagraph.operators import intervals

S = "subject string, valid_at double, valid_to double, slab string"


def brute(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def expected(spans):
    p = brute(spans)
    return sorted([("period", s, -1 if e == intervals.OPEN else e) for s, e in p] + [("gap", a[1], b[0]) for a, b in zip(p, p[1:], strict=False)], key=str)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=25), st.lists(st.integers(0, 24), max_size=3))
@settings(max_examples=200, deadline=None)
def test_merging_is_associative(spans, cuts):
    full = [(s, s + n) for s, n in spans]
    parts, at = [], [0, *sorted(min(c, len(full)) for c in cuts), len(full)]
    for a, b in zip(at, at[1:], strict=False):
        some = sorted(full[a:b])
        if some:
            parts.append(intervals.merge_sorted(np.array([s for s, _ in some]), np.array([e for _, e in some])))
    if parts:
        s, e = intervals.merge_lists(parts)
        assert list(zip(s.tolist(), e.tolist(), strict=True)) == brute(full)


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    claims, want = [], {}
    for subject in ("a", "b", "c"):
        spans = [(int(s), int(s + n)) for s, n in zip(r.integers(0, 5000, 120), r.integers(1, 60, 120), strict=True)]
        if subject == "c":
            spans.append((4000, intervals.OPEN))
        claims += [(subject, float(s), None if e == intervals.OPEN else float(e), "x") for s, e in spans]
        want[subject] = expected(spans)
    got = rows(intervals.claim_periods(spark.createDataFrame(claims, S), slab_seconds=100), "subject", "kind", "from_s", "to_s")
    assert got == sorted(((k, *x) for k, v in want.items() for x in v), key=lambda t: tuple((True, str(x)) for x in t))


def test_the_tree_of_many_partitions(spark, monkeypatch):
    """Three levels, and partitions that let go of what they hold more than once."""
    r = np.random.default_rng(5)
    spans = [(int(s), int(s + n)) for s, n in zip(r.integers(0, 40_000, 900), r.integers(1, 30, 900), strict=True)]
    df = spark.createDataFrame([("hot", s, e) for s, e in spans], "entity string, s long, e long").repartition(30)
    got = rows(intervals.periods_and_gaps(intervals.disjoint_lists(df, slab_seconds=10_000, fan_in=4)), "kind", "from_s", "to_s")
    assert got == expected(spans)
    monkeypatch.setattr(intervals, "HELD", 10)
    pdf = df.withColumn("slab", F.lit(0)).toPandas()
    parts = list(intervals._partial(pdf.iloc[i : i + 50] for i in range(0, 900, 50)))
    assert len(parts) > 1
    s, e = intervals.merge_lists([(np.asarray(x.starts[0]), np.asarray(x.ends[0])) for x in parts])
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == brute(spans)


def test_dirty_rows(spark):
    nan = float("nan")
    claims = [
        (" Ab ", 10.0, 20.0, "x"), ("aB", 20.0, 30.0, "x"), ("ab", 10.0, 20.0, "x"), ("ab", 1.7e12, 1.7e12 + 5000, "x"), ("ab", None, 5.0, "x"), ("ab", 50.0, 50.0, "x"), ("ab", 60.0, 40.0, "x"),
        (None, 1.0, 2.0, "x"), ("ab", nan, 5.0, "x"), ("ab", 70.0, nan, "x"), ("z", 5.0, None, "x"), ("z", 7.0, 9.0, "x"), ("\tz\n", 1.0, 2.0, "x"),
    ]
    got = rows(intervals.claim_periods(spark.createDataFrame(claims, S)), "subject", "kind", "from_s", "to_s")
    assert got == [("ab", "gap", 30, 1_700_000_000), ("ab", "period", 10, 30), ("ab", "period", 1_700_000_000, 1_700_000_005), ("z", "gap", 2, 5), ("z", "period", 1, 2), ("z", "period", 5, -1)]


def test_empty(spark):
    assert intervals.claim_periods(spark.createDataFrame([], S)).count() == 0
