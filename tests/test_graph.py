import pytest
from conftest import SF, rows

from stratagraph.api import Memory
from stratagraph.operators import graph, resolve

NODES = "project string, label string, key string, name string, file string, start int, end int, kind string, unresolved boolean, generated boolean, params int, first_seen_sha string, first_seen_ord long, last_seen_sha string, last_seen_ord long, invalid_sha string, invalid_ord long, invalid_at double"
EDGES = "project string, type string, src_label string, src_key string, dst_label string, dst_key string, args int, receiver_type string, first_seen_sha string, first_seen_ord long, last_seen_sha string, last_seen_ord long, invalid_sha string, invalid_ord long, invalid_at double"
STAMP = ("s1", 1, "s1", 1, None, None, None)


def node(label, key, name=None, file=None, unresolved=None, params=None, stamp=STAMP):
    return ("p", label, key, name, file, 1, 2, "k", unresolved, None, params, *stamp)


def edge(kind, src, dst, dst_label="Symbol", args=None, receiver=None, stamp=STAMP):
    return ("p", kind, "File", src, dst_label, dst, args, receiver, *stamp)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [node("File", f) for f in "fgh"] + [node("Symbol", "f::a", "a", "f"), node("Symbol", "g::b", "b", "g"), node("Symbol", "h::c", "c", "h"), node("Symbol", "name::q", "q", unresolved=True)]
    edges = [edge("DEFINES", "f", "f::a"), edge("DEFINES", "g", "g::b"), edge("DEFINES", "h", "h::c"), edge("CALLS", "g", "f::a"), edge("REFERENCES", "h", "g::b"), edge("CALLS", "h", "name::q"), edge("IMPORTS", "g", "m", "Module"), edge("INJECTS", "h", "f::a")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_callers_over_hops(spark, small):
    names = spark.createDataFrame([("p", "a")], "project string, name string")
    assert rows(graph.callers_multi(*small, names, 1), "caller", "hop") == [("g", 1)]
    assert rows(graph.callers_multi(*small, names, 9), "caller", "hop") == [("g", 1), ("h", 2)]


def test_callees_and_injections(spark, small):
    names = spark.createDataFrame([("p", "c")], "project string, name string")
    assert rows(graph.callees(*small, names), "name", "resolved") == [("q", False)]
    assert rows(graph.injects(*small, names), "name") == [("a",)]
    assert rows(graph.injectors(*small), "token", "file") == [("a", "h")]
    assert rows(graph.importers(*small), "file", "module") == [("g", "m")]


DEAD = ("s1", 1, "s1", 1, "s2", 2, 9.0)


def test_tombstoned_files_and_targets_are_left_out(spark):
    nodes = [node("File", "f"), node("File", "dead", stamp=DEAD), node("Module", "gone", stamp=DEAD), node("Symbol", "f::a", "a", "f"), node("Symbol", "f::old", "old", "f", stamp=DEAD), node("Symbol", "dead::b", "b", "dead"), node("Type", "T", "T", None)]
    edges = [
        edge("DEFINES", "f", "f::a"), edge("DEFINES", "dead", "dead::b"), edge("CALLS", "dead", "f::a"), edge("CALLS", "new", "f::a"), edge("CALLS", "f", "f::old"), edge("CALLS", "f", "T", "Type"),
        edge("INJECTS", "dead", "f::a"), edge("INJECTS", "f", "f::old"), edge("INJECTS", "f", "f::a"), edge("IMPORTS", "dead", "m", "Module"), edge("IMPORTS", "f", "gone", "Module"), edge("IMPORTS", "f", "m", "Module"),
    ]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    # A file that is only an end of edges ("new") is live; an edge's own tombstone isn't looked at.
    assert rows(graph.callers(n, e), "name", "caller") == [("a", "new")]
    assert rows(graph.definitions(n, e), "name") == [("a",)]
    assert rows(graph.callees(n, e), "symbol", "name", "label") == [("a", "T", "Type")]
    assert rows(graph.injects(n, e), "name") == [("a",)] and rows(graph.injectors(n, e), "token", "file") == [("a", "f")]
    assert rows(graph.importers(n, e)) == [("p", "f", "gone"), ("p", "f", "m")] and rows(graph.dependencies(n, e)) == [("p", "f", "m")]


def test_callees_go_on_by_file(spark):
    """From a callee's file all its calls count, also those of other symbols there, and not those of other files with the name."""
    nodes = [node("File", f) for f in "fgh"] + [node("Symbol", "f::a", "a", "f"), node("Symbol", "g::b", "b", "g"), node("Symbol", "g::other", "other", "g"), node("Symbol", "h::b", "b", "h"), node("Symbol", "h::c", "c", "h"), node("Symbol", "name::q", "q", unresolved=True)]
    edges = [edge("DEFINES", "f", "f::a"), edge("DEFINES", "g", "g::b"), edge("DEFINES", "g", "g::other"), edge("DEFINES", "h", "h::b"), edge("CALLS", "f", "g::b"), edge("CALLS", "g", "name::q"), edge("CALLS", "h", "h::c")]
    names = spark.createDataFrame([("p", "a")], "project string, name string")
    got = rows(graph.callees_multi(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), names, 3), "hop", "name", "file", "resolved")
    assert got == [(1, "b", "g", True), (2, "q", None, False)]


def test_aliases_climb_packages(spark):
    files = ["a/pkg/__init__.py", "a/pkg/sub/__init__.py", "a/pkg/sub/mod.py", "a/loose/mod.py", "top.py", "a/x.test.ts", "__init__.py"]
    n = spark.createDataFrame([node("File", f) for f in files] + [node("File", "gone.py", stamp=DEAD)], NODES)
    got = {}
    for f, alias in rows(resolve.import_aliases(n), "file", "alias"):
        got.setdefault(f, set()).add(alias)
    assert got == {
        "a/pkg/__init__.py": {"a/pkg/__init__.py", "__init__", "pkg.__init__"}, "a/pkg/sub/__init__.py": {"a/pkg/sub/__init__.py", "__init__", "pkg.sub.__init__"},
        "a/pkg/sub/mod.py": {"a/pkg/sub/mod.py", "mod", "pkg.sub.mod"}, "a/loose/mod.py": {"a/loose/mod.py", "mod"}, "top.py": {"top.py", "top"}, "a/x.test.ts": {"a/x.test.ts", "x.test"}, "__init__.py": {"__init__.py", "__init__"},
    }
    imports = spark.createDataFrame([("p", "z.py", ".mod", "a/pkg/sub/mod.py"), ("p", "z.py", "mod", "a/pkg/sub/mod.py")], "project string, file string, module string, target string")
    assert rows(resolve.alias_edges(imports, resolve.import_aliases(n)), "file", "alias") == [("z.py", "a/pkg/sub/mod.py"), ("z.py", "mod"), ("z.py", "pkg.sub.mod")]


def test_types_of_assemblies_and_rewriting(spark):
    def e(kind, src_label, src, dst_label, dst):
        return ("p", kind, src_label, src, dst_label, dst, None, None, *STAMP)

    nodes = spark.createDataFrame([node("Type", "t1", "Ext"), node("Type", "t2", "Two"), node("Type", "t3", "Two"), node("Type", "t4", "Far")], NODES)
    edges = [
        e("CONTAINED_IN", "File", "f", "Project", "P"), e("USES_ASSEMBLY", "Project", "P", "Assembly", "lib"), e("USES_ASSEMBLY", "Project", "P", "Assembly", "lib2"), e("EXPOSES_TYPE", "Assembly", "lib", "Type", "t1"),
        e("EXPOSES_TYPE", "Assembly", "lib", "Type", "t2"), e("EXPOSES_TYPE", "Assembly", "lib2", "Type", "t3"), e("EXPOSES_TYPE", "Assembly", "other", "Type", "t4"),
    ]
    types = resolve.assembly_types(nodes, spark.createDataFrame(edges, EDGES))
    assert rows(types, "file", "type_name", "assembly") == [("f", "Ext", "lib"), ("f", "Two", "lib"), ("f", "Two", "lib2")]
    refs = spark.createDataFrame([("p", "CALLS", "f", f"name::{x}", x, -1, None) for x in ("Ext", "Two", "Far", "def")], "project string, type string, file string, placeholder string, name string, arity int, receiver_type string")
    defs = spark.createDataFrame([("p", "def", "g::def", "g", 1)], "project string, name string, key string, def_file string, params int")
    done = resolve.resolve(refs, defs, spark.createDataFrame([], "project string, file string, target string"), types)
    assert rows(done, "name", "tier", "target", "assembly") == [("Ext", "assembly", "t1", "lib"), ("Far", "external", None, None), ("Two", "external", None, None), ("def", "unique", "g::def", None)]
    old = spark.createDataFrame([edge("CALLS", "f", f"name::{x}", args=3) for x in ("Ext", "Two", "def")] + [edge("CALLS", "f", "g::def", args=5), edge("CALLS", "g", "name::Ext")], EDGES).selectExpr("*", "cast(null as string) as confidence", "cast(null as boolean) as resolved")
    got = rows(resolve.rewrite(old, done), "src_key", "dst_label", "dst_key", "args", "confidence", "resolved", "via_assembly", "first_seen_ord")
    assert got == [
        ("f", "Symbol", "g::def", 5, "medium", True, None, 1), ("f", "Symbol", "name::Two", 3, None, None, None, 1), ("f", "Type", "t1", None, "external", True, "lib", None), ("g", "Symbol", "name::Ext", None, None, None, None, 1),
    ]
    empty = rows(resolve.rewrite(old, done.limit(0)), "dst_key", "resolved")
    assert len(empty) == 5 and {r for _, r in empty} == {None}


def test_files_are_removed_without_a_trace(small):
    n, e = graph.remove_files(*small, small[0].sparkSession.createDataFrame([("p", "f"), ("p", "none")], "project string, file string"))
    assert rows(n.where("label = 'File'"), "key") == [("g",), ("h",)] and n.where("key = 'f::a'").count() == 1
    assert rows(e, "type", "src_key") == [("CALLS", "g"), ("CALLS", "h"), ("DEFINES", "g"), ("DEFINES", "h"), ("IMPORTS", "g"), ("INJECTS", "h"), ("REFERENCES", "h")]


def test_a_hub_name_is_no_product(spark):
    """Thousands of references to a name with thousands of definitions: one row a reference, and no plan that joins both by name."""
    refs = spark.range(3000).selectExpr("'p' as project", "'CALLS' as type", "concat('f', id) as file", "'name::hub' as placeholder", "'hub' as name", "cast(id % 3 as int) as arity", "cast(null as string) as receiver_type")
    defs = spark.range(3000).selectExpr("'p' as project", "'hub' as name", "concat('k', id) as key", "concat('d', id) as def_file", "cast(if(id = 7, 2, 1) as int) as params")
    got = resolve.resolve(refs, defs, spark.createDataFrame([], "project string, file string, target string"))
    assert rows(got.groupBy("arity", "tier", "target").count()) == [(0, "ambiguous", None, 1000), (1, "ambiguous", None, 1000), (2, "unique", "k7", 1000)]


def test_upsert_keeps_first_and_revives(spark):
    old = spark.createDataFrame([node("File", "f", "old", stamp=("s1", 1, "s1", 1, "s2", 2, 9.0))], NODES)
    new = spark.createDataFrame([("p", "File", "f", None, "new"), ("p", "File", "g", "n", None), ("p", "File", "g", "n", None)], "project string, label string, key string, name string, file string")
    got = rows(graph.upsert(old, new, graph.NODE, "s3", 3), "key", "name", "file", "first_seen_ord", "last_seen_ord", "invalid_sha")
    assert got == [("f", "old", "new", 1, 3, None), ("g", "n", None, 3, 3, None)]
    assert rows(graph.upsert(old, new, graph.NODE, None, None), "key", "first_seen_ord", "invalid_sha") == [("f", 1, "s2"), ("g", None, None)]


def test_delete_and_vacuum(small):
    spark = small[0].sparkSession
    files = spark.createDataFrame([("p", "f")], "project string, file string")
    n, e = graph.delete_files(*small, files, "s9", 9, 90.0)
    assert rows(n.where("invalid_sha is not null"), "key") == [("f",), ("f::a",)]
    assert rows(e.where("invalid_sha is not null"), "type", "src_key") == [("CALLS", "g"), ("DEFINES", "f"), ("INJECTS", "h")]
    assert rows(graph.vacuum(n, e, drop_all=True)[2]) == [("p", 1, 1, 3)]
    assert rows(graph.vacuum(n, e, before_ord=8)[2]) == []
    assert rows(graph.vacuum(n, e, before_at=90.0)[2], "edges") == [(3,)]
    with pytest.raises(ValueError):
        graph.vacuum(n, e)
    with pytest.raises(ValueError):
        graph.vacuum(n, e, drop_all=True, before_ord=1)


def test_resolver_tiers(spark):
    defs = spark.createDataFrame(
        [("p", "x", "f::x", "f", 1), ("p", "x", "f::x2", "f", 2), ("p", "y", "g::y", "g", 0), ("p", "z", "g::z", "g", 1), ("p", "z", "h::z", "h", 2), ("p", "w", "g::w", "g", 1), ("p", "w", "h::w", "h", 1), ("p", "T", "h::T", "h", 0)],
        "project string, name string, key string, def_file string, params int",
    )
    refs = [("CALLS", "f", "x", 2, None), ("CALLS", "f", "x", 7, None), ("CALLS", "a", "y", -1, None), ("CALLS", "a", "z", 2, None), ("CALLS", "a", "z", -1, None), ("CALLS", "f", "z", -1, None), ("CALLS", "b", "w", 1, "T"), ("CALLS", "b", "w", 1, None), ("CALLS", "b", "nope", 1, None), ("CALLS", "b", None, 1, None), ("INJECTS", "b", "Ext", -1, None)]
    r = spark.createDataFrame([("p", k, f, f"name::{n}", n, a, t) for k, f, n, a, t in refs], "project string, type string, file string, placeholder string, name string, arity int, receiver_type string")
    imports = spark.createDataFrame([("p", "f", "g"), ("p", "a", "g")], "project string, file string, target string")
    types = spark.createDataFrame([("p", "b", "Ext", "lib::Ext", "lib")], "project string, file string, type_name string, type_key string, assembly string")
    got = rows(resolve.resolve(r, defs, imports, types), "file", "name", "arity", "tier", "target", "confidence")
    assert got == sorted(
        [
            ("f", "x", 2, "same_file", "f::x2", "high"), ("f", "x", 7, "same_file", "f::x", "high"), ("a", "y", -1, "imported", "g::y", "high"), ("a", "z", 2, "imported", "g::z", "high"),
            ("a", "z", -1, "imported", "g::z", "high"), ("f", "z", -1, "imported", "g::z", "high"), ("b", "w", 1, "receiver", "h::w", "high"), ("b", "w", 1, "ambiguous", None, None),
            ("b", "nope", 1, "external", None, None), ("b", None, 1, "external", None, None), ("b", "Ext", -1, "assembly", "lib::Ext", "external"),
        ],
        key=lambda t: tuple((x is not None, str(x)) for x in t),
    )


def test_api_and_command_line(spark, capsys):
    m = Memory(spark, SF)
    name = m.graph[0].where("label = 'Symbol' and unresolved is null").select("name").first()[0]
    assert m.definitions(name).count() >= 1
    assert m.claims().count() <= 50
    from stratagraph.__main__ import main

    assert main([SF, "definitions", name]) == 0
    assert name in capsys.readouterr().out
