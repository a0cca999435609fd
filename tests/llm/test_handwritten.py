from conftest import SF, rows

from stratagraph.llm import handwritten, queries

C = "project string, file_path string, chunk_id string, kind string, text string, indexed_at timestamp_ntz, path string, leaf string"
N = "project string, head_sha string, label string, node_key string, hash string"
CODE = "def run(a, b):\n    for x in a.items():\n        b.append(x)\n    # Writes stub files; every stub starts with a line saying it must not be edited.\n    return b\n\ndef stop(c):\n    return c.close() if c else None\n"
LIB = "".join(f"function step{i}(a) {{\n  let value = a.take({i * 7});\n  return value + {i};\n}}\n" for i in range(12))


def judge(spark, files, packages=(), extra=()):
    chunks = spark.createDataFrame([(p, f, f"{p}/{f}", "file", None if t is None else f"FILE {f}\n{t}", None, "clash", "clash") for p, f, t in files] + list(extra), C)
    nodes = spark.createDataFrame([(p, "s1", "File", f, "x") for p, f, _ in files] + [("p1", "s1", "Package", n, "x") for n in packages], N)
    return {(r["project"], r["node_key"]): r["reason"] for r in handwritten.not_handwritten(chunks, nodes).collect()}


def test_headers(spark):
    yes = ["# Code generated by foo 1.2. DO NOT EDIT.", "// @generated by tool", "// <auto-generated> produced by x </auto-generated>", "# Diese Datei wurde automatisch erzeugt (x 1).", "// Fichier produit automatiquement par x ; ne pas modifier.", "# Archivo generado por x 1.0; no lo edite.", "# Written by machine: x --in a.proto", "// AUTOGENERATED FILE - see a.xsd"]
    no = ["# This used to be auto-generated; since the rewrite it is maintained by hand, edit it freely.", "# Do not edit the order of the steps below without asking A users.", "# Copyright the p1 authors", "# Writes stub files; every stub starts with a line saying it must not be edited."]
    got = judge(spark, [("p1", f"y{i}.py", f"# Copyright the p1 authors\n{h}\n{CODE}") for i, h in enumerate(yes)] + [("p1", f"generators/n{i}_pb2.py", f"{h}\n{CODE}") for i, h in enumerate(no)])
    assert got == {("p1", f"y{i}.py"): "generated" for i in range(len(yes))}


def test_output_paths_need_bare_code(spark):
    bare = CODE.replace("    # Writes stub files; every stub starts with a line saying it must not be edited.\n", "")
    files = [("p1", "a/__generated__/x.py", bare + "1"), ("p1", "a/b_pb2.py", bare + "2"), ("p1", "a/x.g.dart", bare + "3"), ("p1", "a/x.g.ts", CODE + "4"), ("p1", "generators/x.py", bare + "5"), ("p1", "gen/empty.py", "")]
    assert set(judge(spark, files)) == {("p1", f) for f in ("a/__generated__/x.py", "a/b_pb2.py", "a/x.g.dart")}


def test_third_party(spark):
    banners = ["/*! quill v1.2.3 | (c) quill contributors | MIT */", "// vendored from https://git.quill.example/quill at rev abc123", "/* @license quill 2.0.1\n   Copyright */", "// quill 3.1.0, unmodified upstream copy; report bugs to x", "/**\n * quill - version 1.2.3\n * Released under the BSD-3 license\n */"]
    files = [("p1", f"src/b{i}.js", f"{b}\n{CODE}x{i}") for i, b in enumerate(banners)]
    files += [("p1", "vendor/quill/a.js", CODE + "1"), ("p1", "deps/quill-1.2/a.js", CODE + "2"), ("p1", "vendor/mine/a.js", CODE + "3"), ("p1", "src/vendor_quill.js", CODE + "4"), ("p1", "own.js", "/* @license p1 1.0.0 */\n" + CODE), ("p1", "patched.js", "// quill 3.1.0, patched by us\n" + CODE)]
    assert set(judge(spark, files, ["quill"])) == {("p1", f"src/b{i}.js") for i in range(len(banners))} | {("p1", "vendor/quill/a.js"), ("p1", "deps/quill-1.2/a.js")}


def test_shared_subtrees_and_forks(spark):
    files = [(p, f"{p}/own{i}.js", CODE + f"# {p}" + "\nvalue = " + p * (i + 1)) for p in ("p1", "p2", "p3") for i in range(4)]
    files += [("p1", "a/lib.js", LIB), ("p2", "b/c/other.js", LIB.replace("\n", "\r\n")), ("p1", "a/__init__.py", ""), ("p2", "x/__init__.py", "")]
    fork = [("f1", f"k{i}.js", CODE + f"\nvalue = {'z' * (i + 1)}") for i in range(4)]
    files += fork + [("f2", f, t) for _, f, t in fork]
    assert judge(spark, files) == {("p1", "a/lib.js"): "vendored", ("p2", "b/c/other.js"): "vendored"}
    # A small file counts by the directory it is shared in.
    tree = [(p, f"{p}/kept/{f}", t) for p in ("p1", "p2") for f, t in (("lib.js", LIB), ("tiny.js", "x = 1\n"))]
    assert set(judge(spark, [f for f in files if f[1].startswith("p")] + tree)) == {(p, f"{p}/kept/{f}") for p in ("p1", "p2") for f in ("lib.js", "tiny.js")}


def test_layout(spark):
    dense = "if(a&&b)throw c(316);for(d=0;d<e.length;d++)f[d]=e[d];function g(h){return h.run(h||0)}" * 6
    files = [
        ("p1", "m.js", dense), ("p1", "w.js", "\n".join(dense.replace("a", "_0x2bc2f")[i : i + 110] for i in range(0, 700, 110))), ("p1", "d.py", "X = [\n" + "  0x78, 0x8f, 0xbb, 0x16,\n" * 20 + "]\n"),
        ("p1", "j.py", "A = [" + '{"id": 19184, "token": "collect", "w": 0.324},' * 9 + "]"), ("p1", "c.py", "A = '''\n" + "97658;score;0.74992;join\n" * 12 + "'''\n"), ("p1", "b.py", "P = (\n" + '  "hkqWiuCUL/EiqSlFmAqPR0wUEI6CS0/N8CWRsijJmUBxXwoyMHVz1RRaQdLrtXjdA+2aK501FlR4" +\n' * 6 + ")\n"),
        ("p1", "e.js", "".join(f"// field {i} of x\nget_{i:03} = {i};\n" for i in range(30))), ("p1", "sql.py", 'Q = "select ' + "a.b_1, c.d_2, " * 40 + 'x from y"\n' + CODE), ("p1", "x.min.js", CODE), ("p1", "k.py", 'SAMPLE = "' + "5b7a85540bb4112934" * 6 + '=="\n' + CODE * 3),
    ]
    assert judge(spark, files) == {("p1", "m.js"): "minified", ("p1", "w.js"): "minified", ("p1", "d.py"): "data", ("p1", "j.py"): "data", ("p1", "c.py"): "data", ("p1", "b.py"): "data", ("p1", "e.js"): "generated"}


def test_no_limits_on_headers_literals_and_holders(spark, monkeypatch):
    """A header below a long licence, literals of any length, and contents that many projects hold, compared in parts."""
    licence = "".join(f"# Line {i} of the terms of the p1 authors\n" for i in range(60))
    files = [("p1", "deep.py", licence + "# Code generated by foo 1.2.\n" + CODE), ("p1", "plain.py", licence + CODE), ("p1", "long.py", "A = [" + ", ".join('"' + c * 300 + '"' for c in "abcd") + "]\n")]
    assert judge(spark, files) == {("p1", "deep.py"): "generated", ("p1", "long.py"): "data"}
    monkeypatch.setattr(handwritten, "HOLDERS", 2)
    files = [(f"p{p}", f"p{p}/own{i}.js", CODE + f"# p{p}" + "\nvalue = " + f"p{p}" * (i + 1)) for p in range(6) for i in range(3)] + [(f"p{p}", f"a{p}/lib.js", LIB) for p in range(6)]
    assert judge(spark, files) == {(f"p{p}", f"a{p}/lib.js"): "vendored" for p in range(6)}


def test_dirty_rows(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    old = ("p1", "a.py", "p1/a.py", "file", "FILE a.py\n# @generated\n", t, "x", "x")
    new = ("p1", "a.py", "p1/a.py", "file", "FILE a.py\n" + CODE, t + datetime.timedelta(1), "x", "x")
    assert judge(spark, [("p1", "b.py", None), ("p1", "c.py", ""), (None, "d.py", CODE)], extra=[old, new, new, (None, None, None, None, None, None, None, None)]) == {}
    empty = spark.createDataFrame([], C), spark.createDataFrame([], N)
    assert handwritten.not_handwritten(*empty).count() == 0


def test_on_the_tables(spark):
    assert rows(queries.p2_found(spark, SF)) == sorted(set(rows(queries.p2_found(spark, SF))))


def test_relatedness_is_between_projects(spark):
    lib = [(f"third_party/zed/s{i}.js", LIB + f"let n = {i};\n") for i in range(6)]
    files = [(p, f"{p}/own{i}.js", CODE + f"# {p}\nvalue = " + p * (i + 1)) for p in ("p1", "p2") for i in range(4)]
    # More than half of both projects is the same third-party code.
    assert judge(spark, files + [(p, f, t) for p in ("p1", "p2") for f, t in lib]) == {(p, f): "vendored" for p in ("p1", "p2") for f, _ in lib}
    # A project, its forks and one that is unrelated: only what they all hold is vendored.
    forks = [(p, f"k{i}.js", CODE + f"\nvalue = {'z' * (i + 1)}") for p in ("f1", "f2", "f3") for i in range(4)]
    assert judge(spark, files + forks + [(p, "util/lib.js", LIB) for p in ("p1", "f1", "f2")]) == {(p, "util/lib.js"): "vendored" for p in ("p1", "f1", "f2")}


def test_forks_far_apart_by_name(spark):
    """A fork is one whatever number of other holders lie between the two by name, with own contents and without."""
    between = [f"f1{c}" for c in "abcdefghijklmnopqrstuvwx"]
    own = [(p, f"{p}/own{i}.js", CODE + f"# {p}\nvalue = " + p * (i + 1)) for p in between for i in range(9)]
    parts = [LIB + f"let n = {i};\n" for i in range(5)]
    for folder in ("lib", "vendor"):
        held = [(p, f"{folder}/k{i}.js", t) for i, t in enumerate(parts) for p in ["f1", "f2", *between[12 * (i // 2) : 12 * (i // 2 + 1)]]]
        # What only the two forks hold is theirs, what the others hold as well is third-party code.
        assert judge(spark, own + held) == {(p, f): "vendored" for p, f, _ in held if f < f"{folder}/k4"}


def test_families_equal_all_pairs(spark):
    """The families of random projects are those of all pairs, counted one by one."""
    import random

    from pyspark.sql import functions as F

    for seed in range(3):
        rng = random.Random(seed)
        hot = [f"h{i}" for i in range(12)]
        sets = {f"p{p:02}": {(h, rng.random() < 0.7) for h in rng.sample(hot, rng.randint(0, 4))} | {(f"c{rng.randint(0, 25)}", rng.random() < 0.7) for _ in range(rng.randint(1, 4))} for p in range(45)}
        files = [(p, ("src/" if own else "vendor/x/") + h, h) for p, held in sets.items() for h, own in held]
        leaf = spark.createDataFrame(files, "project string, path string, hash string")
        copied = leaf.groupBy("hash").agg(F.count_distinct("project").alias("projects")).where("projects >= 2")
        owned, total = {p: {h for h, own in held if own} for p, held in sets.items()}, {p: {h for h, _ in held} for p, held in sets.items()}
        family = {p: p for p in sets}
        for a in sets:
            for b in sets:
                x, y = (owned[a], owned[b]) if owned[a] and owned[b] else (total[a], total[b])
                if a < b and len(x & y) > handwritten.FORK_SHARE * min(len(x), len(y)):
                    old, new = max(family[a], family[b]), min(family[a], family[b])
                    family = {p: new if f == old else f for p, f in family.items()}
        got = {r["project"]: r["family"] for r in handwritten.families(leaf, copied).collect()}
        assert len(set(family.values())) > 3 and {p: got.get(p, p) for p in sets} == family
