import pytest
from conftest import rows

from stratagraph.operators import extraction, graph, pipeline

TS = """import { Repo } from './repo';
// run(no, no)
export class Box extends Base<Item> {
  private readonly repo: IRepo;
  svc = inject(TokenService);
  constructor(private readonly port: app.UserPort, name: string) { super(name); }
  async load(a: string, b = [1, 2]): Promise<Out> {
    if (a) { return this.repo.find(a, { x: 1, y: g(2, 3) }); }
    this.svc.send("a, b(", `c, ${d}`);
    this.port.save();
    this.other.go(1,);
    return items.map((x) => walk(x));
  }
}
export interface Shape { area(): number; }
export enum Kind { A, B }
export type Id = string;
export const run = async (x: number, y: number) => { return stop(x, y); };
function plain() { }
"""


def test_scripts():
    got = extraction.extract_all("a.ts", TS)
    assert [(s[0], s[1], s[4]) for s in got["symbols"]] == [
        ("Box", "class_declaration", None), ("constructor", "method_definition", 2), ("load", "method_definition", 2), ("Shape", "interface_declaration", None),
        ("Kind", "enum_declaration", None), ("Id", "type_alias_declaration", None), ("run", "arrow_function", 2), ("plain", "function_declaration", 0),
    ]
    assert [s[2:4] for s in got["symbols"]][:3] == [(3, 14), (6, 6), (7, 13)]
    assert got["calls"] == [("find", 2, "IRepo"), ("g", 2, None), ("send", 2, "TokenService"), ("save", 0, "UserPort"), ("go", 1, None), ("walk", 1, None), ("stop", 2, None)]
    assert got["imports"] == ["./repo"] and got["injects"] == ["TokenService"]
    assert extraction.extract_all("a.js", "run(a, (b")["calls"] == [("run", -1, None)] and extraction.extract_all("a.js", "")["symbols"] == []


def test_namespaces_parts_and_arity():
    cs = extraction.extract_all("a.cs", "﻿using X;\nnamespace A.B;\npublic partial class Box\n{\n    public void Load(int a, Func<int, int> f)\n    {\n        Scan(a, f(1, 2), \"x, y\");\n    }\n}\npublic class Other { }\n")
    assert [(s[0], *s[4:]) for s in cs["symbols"]] == [("Box", None, "A.B", True), ("Load", 2, "A.B", False), ("Other", None, "A.B", False)]
    assert cs["calls"] == [("Scan", 3, None), ("f", 2, None)] and cs["imports"] == ["X"]
    two = extraction.extract_all("a.cs", "namespace A\n{\n    class B { }\n}\nnamespace C\n{\n    class D { }\n}\n")
    assert [(s[0], s[5]) for s in two["symbols"]] == [("B", "A"), ("D", "C")]
    php = extraction.extract_all("a.php", "<?php\nnamespace A\\B;\n# run(1)\nclass Box {\n    public function load($a, $b = [1, 2]) { return scan($a, 'x, y'); }\n}\n")
    assert [(s[0], *s[4:6]) for s in php["symbols"]] == [("Box", None, "A\\B"), ("load", 2, "A\\B")] and php["calls"] == [("scan", 2, None)]
    dart = extraction.extract_all("a.dart", "class Box {\n  void load(int a, {int b = 1}) {\n    print(a);\n    scan(a, b);\n  }\n}\n")
    assert [(s[0], s[4]) for s in dart["symbols"]] == [("Box", None), ("load", 2)] and dart["calls"] == [("scan", 2, None)]
    py = extraction.extract_all("a.py", "import os\ndef f(a):\n    print(a)\n    return g(a, b=1)\n")
    assert py["symbols"] == [("f", "function_definition", 2, 4, 1, "", False)] and py["calls"] == [("g", 2, None)]


@pytest.fixture(scope="module")
def read(spark):
    files = [
        ("p", "a.ts", TS, "typescript"), ("p", "b.py", "def f(a):\n    return f(1) + f(2, 3) + Box()\n", "python"), ("p", "empty.py", "x = 1\n", "python"), ("p", "gen/__generated__/g.py", "def made():\n    pass\n", "python"),
        ("p", "x.cs", "namespace N;\npublic partial class Part { }\n", "csharp"), ("p", "y.cs", "namespace N;\npublic partial class Part { }\n", "csharp"), ("p", "m.js", "var a=1;" * 900, "javascript"), ("p", "null.py", None, "python"), (None, "n.py", "x", "python"),
    ]
    return pipeline.read_files(spark.createDataFrame([(*f, "clash") for f in files], "project string, path string, text string, lang string, symbols string"))


def test_rows_of_the_graph(read):
    nodes, edges = pipeline.graph_rows(read)
    assert rows(nodes.where("label = 'File'"), "key", "generated") == [("a.ts", None), ("b.py", None), ("empty.py", None), ("gen/__generated__/g.py", True), ("x.cs", None), ("y.cs", None)]
    assert rows(nodes.where("label = 'Symbol' and unresolved is null and (key like 'p%' or key like 'b.py%')"), "key", "params") == [("b.py::f#1", 1), ("partial::N.Part", None)]
    assert rows(nodes.where("key = 'name::Box'"), "name", "unresolved") == [("Box", True)]
    assert nodes.groupBy("label", "key").count().where("count > 1").count() == 0
    assert rows(edges.where("type = 'CALLS' and dst_key in ('name::f', 'name::save', 'name::Box')"), "src_key", "dst_key", "args", "receiver_type") == [("a.ts", "name::save", 0, "UserPort"), ("b.py", "name::Box", 0, None), ("b.py", "name::f", 1, None)]
    assert rows(edges.where("type = 'DEFINES' and dst_key like 'partial%'"), "src_key") == [("x.cs",), ("y.cs",)]
    assert rows(edges.where("type in ('IMPORTS', 'INJECTS')"), "type", "dst_key") == [("IMPORTS", "./repo"), ("INJECTS", "name::TokenService")]


def test_chunks_and_counters(read):
    chunks = pipeline.chunk_rows(read)
    assert rows(chunks.where("path = 'empty.py'"), "kind", "text") == [("file", "FILE empty.py\nx = 1\n")]
    assert rows(chunks.where("path = 'b.py'"), "name", "start", "end", "text") == [("f", 1, 2, "FILE b.py\nKIND function_definition NAME f\nSIGNATURE\ndef f(a):\n    return f(1) + f(2, 3) + Box()\ndef f(a):\n    return f(1) + f(2, 3) + Box()")]
    assert [r[1:4] for r in rows(pipeline.counters(read, chunks), "project", "files", "files_generated", "symbols")] == [(6, 1, 12), (6, 1, 12)]


def test_a_commit_changes_tables(spark, read):
    """A changed file's symbols that are gone are tombstoned, those that are there again live on; calls into it are kept."""
    stamps = "cast(null as string) as first_seen_sha, cast(null as long) as first_seen_ord, cast(null as string) as last_seen_sha, cast(null as long) as last_seen_ord, cast(null as string) as invalid_sha, cast(null as long) as invalid_ord, cast(null as double) as invalid_at"
    n0, e0 = (df.limit(0).selectExpr("*", *stamps.split(", ")) for df in pipeline.graph_rows(read))
    gone = spark.createDataFrame([], "project string, file string")
    n1, e1 = pipeline.apply_change(n0, e0, read, gone, "c1", 1, 1.0)
    caller = [("p", "CALLS", "File", "a.ts", "Symbol", "b.py::f#1")]
    e1 = graph.upsert(e1, spark.createDataFrame(caller, "project string, type string, src_label string, src_key string, dst_label string, dst_key string"), graph.EDGE, "c1", 1)
    new = pipeline.read_files(spark.createDataFrame([("p", "b.py", "def f(a):\n    return 1\ndef g():\n    return 2\n", "python")], "project string, path string, text string, lang string"))
    n2, e2 = pipeline.apply_change(n1, e1, new, spark.createDataFrame([("p", "empty.py"), ("p", "gen/__generated__/g.py")], "project string, file string"), "c2", 2, 2.0)
    alive = lambda df: df.where("invalid_sha is null")
    assert rows(n2.where("invalid_sha = 'c2'"), "key") == [("empty.py",), ("gen/__generated__/g.py",), ("gen/__generated__/g.py::made#1",)]
    assert rows(alive(n2).where("file = 'b.py'"), "key", "first_seen_ord", "last_seen_ord") == [("b.py::f#1", 1, 2), ("b.py::g#3", 2, 2)]
    assert rows(alive(e2).where("src_key = 'b.py'"), "type", "dst_key") == [("DEFINES", "b.py::f#1"), ("DEFINES", "b.py::g#3")]
    assert rows(alive(e2).where("dst_key = 'b.py::f#1' and type = 'CALLS'"), "src_key") == [("a.ts",)]
    assert rows(e2.where("invalid_sha = 'c2' and src_key = 'b.py'"), "type", "dst_key") == [("CALLS", "name::Box"), ("CALLS", "name::f")]
