from conftest import rows

from stratagraph.operators import snapshots

M = "project string, head_sha string, created_at double, extra string"
N = "project string, head_sha string, label string, node_key string, props string, loaded_at timestamp_ntz, key string"
E = "project string, head_sha string, edge_type string, src_label string, src_key string, dst_label string, dst_key string, props string, loaded_at timestamp_ntz, idx int"


def make(spark, manifest, nodes, edges):
    return (
        spark.createDataFrame([(*m, "x") for m in manifest], M),
        spark.createDataFrame([(*n, None, "clash") for n in nodes], N),
        spark.createDataFrame([(*e, None, 7) for e in edges], E),
    )


def test_order_skips_empty_builds_and_repeats(spark):
    m, n, _ = make(spark, [("p", "a", 5.0), ("p", "b", 2.0), ("p", "a", 1.0), ("p", "ghost", 3.0), ("p", None, 1.0), ("p", "b", None)], [("p", "a", "File", "f", "{}"), ("p", "b", "File", "f", "{}")], [])
    assert rows(snapshots.snapshot_order(m, n), "head_sha", "idx", "next_sha") == [("a", 1, "b"), ("b", 2, None)]


def test_diff(spark):
    m, n, e = make(
        spark,
        [("p", "s1", 1.0), ("p", "s2", 2.0), ("p", "s3", 3.0)],
        [
            ("p", "s1", "File", "gone", '{"a":1}'), ("p", "s1", "File", "kept", '{"a":1,"b":"é"}'), ("p", "s2", "File", "kept", '{ "b":"\\u00e9", "a":1}'), ("p", "s2", "File", "kept", '{"a":1,"b":"é"}'),
            ("p", "s3", "File", "kept", '{"a":2,"b":"é"}'), ("p", "s3", "File", "gone", "{}"), ("p", "s2", "File", "null", None), ("p", "s3", "File", "null", None), ("p", "s1", None, "x", "{}"), (None, "s1", "File", "x", "{}"),
        ],
        [("p", "s1", "CALLS", "File", "kept", "Symbol", "t", "{}"), ("p", "s2", "CALLS", "File", "kept", "Symbol", None, "{}"), ("p", "s3", "CALLS", "File", "kept", "Symbol", "t", "not json")],
    )
    got = rows(snapshots.snapshot_diff(snapshots.record_rows(n, e), snapshots.snapshot_order(m, n)), "head_sha", "rec", "key_a", "diff_kind")
    assert got == [
        ("s2", "edge", "kept", "removed"), ("s2", "node", "gone", "removed"), ("s2", "node", "null", "added"),
        ("s3", "edge", "kept", "added"), ("s3", "node", "gone", "added"), ("s3", "node", "kept", "changed"),
    ]


def test_orphans(spark):
    m, n, e = make(
        spark,
        [("p", "s", 86400.0)],
        [("p", "s", "File", "f", "{}"), ("p", "s", "File", "f", "{}"), ("p", "s", "Symbol", "a", "{}"), ("p", "s", "Symbol", "c", "{}"), ("p", "later", "Symbol", "b", "{}"), ("p", "s", "Symbol", None, "{}")],
        [
            ("p", "s", "CALLS", "File", "f", "Symbol", "a", "{}"), ("p", "s", "CALLS", "File", "f", "Symbol", "b", "{}"), ("p", "s", "CALLS", "File", "f", "Symbol", "b", "{}"),
            ("p", "s", "CALLS", "File", "g", "Symbol", "c", "{}"), ("p", "s", "CALLS", "File", "g", "Symbol", None, "{}"), ("p", "s", "CALLS", "File", "f", "Type", "a", "{}"),
            ("p", "s", "CALLS", "File", "f", None, "c", "{}"), ("p", "s", "CALLS", "File", "f", "Symbol", "A", "{}"), ("p", "s", "CALLS", "File", "f ", "Symbol", "zz", "{}"),
        ],
    )
    found = snapshots.orphan_references(n, e)
    assert rows(found, "src_key", "dst_key", "side") == [("f", "A", "dst"), ("f", "a", "dst"), ("f", "b", "dst"), ("f", "c", "dst"), ("f ", "zz", "dst"), ("f ", "zz", "src"), ("g", "c", "src")]
    assert rows(snapshots.orphan_report(found, e, m), "month", "side", "n_edges", "n_orphans") == [("1970-01", "dst", 6, 5), ("1970-01", "src", 6, 2)]


def test_many_keys_against_brute_force(spark):
    nodes = [("p", f"s{s}", "Symbol", f"k{i}", "{}") for s in range(3) for i in range(300) if (i * 7 + s) % 5]
    edges = [("p", f"s{s}", "CALLS", "Symbol", f"k{i}", "Symbol", f"k{(i * 13 + s) % 320}", "{}") for s in range(3) for i in range(300)]
    _, n, e = make(spark, [], nodes, edges)
    have = {(x[1], x[3]) for x in nodes}
    want = sorted((x[1], x[4], x[6], side) for x in edges for side, key in (("src", x[4]), ("dst", x[6])) if (x[1], key) not in have)
    assert rows(snapshots.orphan_references(n, e), "head_sha", "src_key", "dst_key", "side") == want


def test_runs_decide_and_slices_change_nothing(spark):
    nodes = [("p", f"s{s}", "Symbol", f"k{i:03}", "{}") for s in range(3) for i in range(300) if (i + 10 * s) % 25] + [("q", "t", "File", "a", "{}")]
    edges = [("p", f"s{s}", "CALLS", "Symbol", f"k{i:03}", "Symbol", f"k{(i * 13 + s) % 320:03}", "{}") for s in range(3) for i in range(300)]
    _, n, e = make(spark, [], nodes, edges)
    slices = snapshots.project_slices(n, e)
    assert rows(slices) == [("p", 1), ("q", 1)]
    keys = snapshots.key_occurrences(n, e, slices).cache()
    runs = snapshots.parent_runs(keys)
    # 12 of 300 keys are missing from each snapshot: 864 parents are 13 runs each, or 12 where the first key is missing.
    assert (keys.where("parent").count(), runs.where("project = 'p'").count()) == (864 + 1, 13 * 2 + 12)
    assert rows(runs.where("project = 'q'"), "run_start", "run_end", "n") == [(1, 1, 1)]
    have = {(x[1], x[3]) for x in nodes}
    want = {(x[1], key) for x in edges for key in (x[4], x[6]) if (x[1], key) not in have}
    asked = {(x[1], key) for x in edges for key in (x[4], x[6])}
    assert {(r["head_sha"], r["key"]) for r in snapshots.orphan_keys(n, e, slices).collect()} == want
    # Without nodes there are no runs, and every reference is an orphan.
    assert {(r["head_sha"], r["key"]) for r in snapshots.orphan_keys(n.limit(0), e, slices).collect()} == asked
    whole = rows(snapshots.orphan_references(n, e))
    assert len(whole) and whole == rows(snapshots.orphan_references(n, e, rows_per_slice=100))


def test_empty(spark):
    m, n, e = make(spark, [], [], [])
    assert snapshots.orphan_references(n, e).count() == 0
    assert snapshots.snapshot_diff(snapshots.record_rows(n, e), snapshots.snapshot_order(m, n)).count() == 0
