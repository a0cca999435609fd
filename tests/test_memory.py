import random

from conftest import rows

from stratagraph.functions import text
from stratagraph.operators import ingest, memory, metrics, resolve, retrieval
from stratagraph.runtime import numbered
from pyspark.sql import functions as F

C = "id string, subject string, predicate string, obj string, polarity boolean, confidence double, evidence_span string, valid_at double, recorded_at double, head_sha string, session_id string, entity_subject_id string"


def sequential(claims):
    """The rules one claim at a time."""
    out = []
    for c in sorted(claims, key=lambda c: (c[8], c[0])):
        open_ = [o for o in out if o["s"] == c[1] and o["p"] == c[2] and o["to"] is None]
        same = [o for o in open_ if (o["o"], o["pol"]) == (c[3], c[4])]
        if c[2] in memory.SINGLE_VALUED:
            for o in open_:
                if o not in same:
                    o["to"] = c[7]
        if same:
            o = same[0]
            o["conf"], o["rec"] = max(o["conf"], c[5]), c[8]
            o["ev"] = c[6] or o["ev"]
            o["sha"] = c[9] if c[9] is not None else o["sha"]
            o["ses"] = o["ses"] if o["ses"] is not None else c[10]
        else:
            out.append({"s": c[1], "p": c[2], "o": c[3], "pol": c[4], "conf": c[5], "ev": c[6], "at": c[7], "to": None, "rec": c[8], "sha": c[9], "ses": c[10]})
    return sorted(((o["s"], o["p"], o["o"], o["pol"], o["at"], o["to"], o["conf"], o["ev"], o["rec"], o["sha"], o["ses"]) for o in out), key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_claims_against_the_sequential_rules(spark):
    r = random.Random(4)
    claims = [
        (f"c{i:03}", r.choice("ab"), r.choice(["uses", "owns", "mentioned"]), r.choice("xyz"), r.random() < 0.8, r.randrange(1, 10) / 10, r.choice(["", "e1", "e2"]), float(r.randrange(100)), float(i), r.choice([None, "h1", "h2"]), r.choice([None, "s1", "s2"]), None)
        for i in range(200)
    ]
    got = rows(memory.claim_history(spark.createDataFrame(claims, C)), "subject", "predicate", "obj", "polarity", "valid_at", "valid_to", "confidence", "evidence_span", "recorded_at", "head_sha", "session_id")
    assert got == sequential(claims)


def test_leaders_against_the_sequential_rules(spark):
    r = random.Random(5)
    pairs = {(a, b): r.random() for a in range(40) for b in range(a + 1, 40) if r.random() < 0.1}
    want, leads = [], []
    for i in range(40):
        near = [(pairs[(a, i)], -a, a) for a in leads if (a, i) in pairs]
        want.append((i, max(near)[2] if near else i))
        if not near:
            leads.append(i)
    got = memory.leaders(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, similarity double"), spark.range(40))
    assert sorted(tuple(x) for x in got.collect()) == want


def test_intents(spark):
    texts = ["We use Postgres here", "do we prefer X or Y?", "I love it! how does it work?", "we don't want this", "it lives in src/app", "nothing", None, ""]
    got = rows(memory.claim_intent(spark.createDataFrame([(t,) for t in texts], "text string")), "text", "kind")
    assert got == [("I love it! how does it work?", "preference"), ("We use Postgres here", "decision"), ("it lives in src/app", "location"), ("we don't want this", "rejection")]


def test_quantiles_and_breaker(spark):
    import statistics

    xs = [float(x * x % 97) for x in range(40)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 1.0), ("b", float("nan")), ("b", None), ("b", -1.0)], "k string, x double")
    assert rows(metrics.latency_quantiles(df, ["k"], "x")) == [("a", 40, statistics.median(xs), round(statistics.quantiles(xs, n=20)[18], 6)), ("b", 1, 1.0, 1.0)]
    events = spark.createDataFrame([(1, i, i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 1])], "k int, ts int, event_id int, f int")
    assert rows(metrics.breaker(events, "k", F.col("f") == 1, 3)) == [(1, 5)]


def test_vector_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, vector array<float>")
    assert rows(retrieval.top_k(v, v, 1), "query", "id", "score") == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.0)]
    assert retrieval.top_k(v.limit(0), v, 1).count() == 0


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.normal_prompt(F.lit("  A\t\nB  c "))) == "a b c"
    assert value(text.slug(F.lit("--Ab c_d!"))) == "ab-c-d"
    assert value(text.kebab(F.lit(" Deployed To"))) == "deployed-to"
    assert value(text.last_identifier(F.lit("a.b\\c"))) == "c" and value(text.last_identifier(F.lit("a.b)"))) is None
    assert value(text.version_key(F.lit("1.20b.x"))) == [1, 20, 0, 0]
    assert [text.duration_seconds(x) for x in ("30d", "12h", "45m", "900s", "2w", "7")] == [2592000, 43200, 2700, 900, 1209600, 7]


def test_extract():
    got = ingest.extract("a.py", "import os\nfrom .b import c\nclass A:\n    def f(self, x):\n        return g(x, 1)\n")
    assert [s[:4] for s in got["symbols"]] == [("A", "class_definition", 3, 5), ("f", "function_definition", 4, 5)]
    assert got["imports"] == ["os", ".b"] and got["calls"] == [("g", 2)]
    js = ingest.extract("a.ts", "import { x } from './x';\nexport function run(a) {\n  return x(a);\n}\n")
    assert js["symbols"][0][:3] == ("run", "function_declaration", 2) and js["imports"] == ["./x"] and ("x", -1) in js["calls"]
    assert ingest.extract("bad.py", "def (")["symbols"] == []


def test_injections_and_types():
    ts = ingest.extract("a.ts", "class A extends Base<Item> {\n  svc = inject(Token);\n  run(x: Thing): Promise<Out> { return call(x as Other); }\n}\n")
    assert ts["injects"] == ["Token"] and ts["references"] == ["Base", "Item", "Thing", "Out", "Other"] and ("inject", -1) not in ts["calls"]
    py = ingest.extract("a.py", "class A(Base):\n    x: Thing = None\n    def f(self, y: list[Item]) -> mod.Out: ...\n")
    assert sorted(py["references"]) == ["Base", "Item", "Out", "Thing"]


def test_registry_pack_and_collection(spark):
    reg = "root string, slug string"
    got = ingest.reconcile(spark.createDataFrame([("a", "x"), ("b", "new"), ("c", "z")], reg), spark.createDataFrame([("b", "old"), ("c", "z"), ("d", "w")], reg))
    assert rows(got) == [("a", "x", "add"), ("b", "new", "rebind"), ("d", "w", "remove")]
    pack = spark.createDataFrame([("claims", 2, "s p o", 0.5, True), ("claims", 1, "a b c", 1.0, False)], "section string, rank int, title string, score double, negated boolean")
    assert rows(retrieval.render_pack(pack), "text") == [("## claims\n- a b c (1.000)\n- s p o NEGATED (0.500)",)]
    v = spark.createDataFrame([("a", [1.0, 2.0], "x")], "id string, vector array<float>, old string")
    assert [retrieval.check_collection(v, *a) for a in ((2,), (3,), (2, "none"), (2, "old"))] == ["", "dimension", "missing", "legacy"]
    assert rows(retrieval.hydrate(spark.createDataFrame([("b", 1), ("a", 2)], "id string, rank int"), v), "id", "rank") == [("a", 2)]


def test_relative_imports_and_members(spark):
    files = spark.createDataFrame([("p", f) for f in ("a/x.ts", "a/y/index.ts", "b.js", "q/m.py", "q/r/__init__.py", "q/s/t.py")], "project string, path string")
    asked = [("a/z.ts", "./x"), ("a/z.ts", "./y"), ("a/z.ts", "../b"), ("a/z.ts", "./none"), ("a/z.ts", "lib"), ("q/s/t.py", "..m"), ("q/k.py", ".r"), ("q/k.py", ".s.t")]
    got = resolve.resolve_imports(spark.createDataFrame([("p", f, m) for f, m in asked], "project string, file string, module string"), files)
    assert rows(got, "module", "target") == [("../b", "b.js"), ("..m", "q/m.py"), ("./x", "a/x.ts"), ("./y", "a/y/index.ts"), (".r", "q/r/__init__.py"), (".s.t", "q/s/t.py")]
    types = spark.createDataFrame([("T", "n1", "a1"), ("T", "n2", "a2")], "type_name string, namespace string, assembly string")
    members = spark.createDataFrame([("T", "n1", "a1", "Run", "int", False)] * 2 + [("T", "n2", "a2", "Go", "", True)], "type_name string, namespace string, assembly string, member string, params string, is_static boolean")
    ask = spark.createDataFrame([("T", "n1", None)], "type_name string, namespace string, assembly string")
    assert rows(resolve.assembly_members(types, members, ask), "member") == [("Run",)]


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in "dcbaf"], "x string").repartition(3)
    assert rows(numbered(df, "x"), "position", "x") == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "f")]
    assert numbered(df.limit(0), "x").count() == 0


def test_keyword_search(spark):
    docs = spark.createDataFrame([("a.ts", "load the Ledger"), ("b.ts", "ledger ledger cursor"), ("c.ts", None)], "path string, text string")
    got = retrieval.keyword_search(docs, spark.createDataFrame([("where is the ledger cursor",)], "query string"), 5)
    assert rows(got, "path", "matched", "rank") == [("a.ts", 1, 2), ("b.ts", 2, 1)]


def test_keyword_search_looks_at_all_files(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a/{i:04}.ts", "ledger") for i in range(700)] + [("z/last.ts", "ledger cursor"), ("z/last.ts", "ledger")], "path string, text string")
    ask = spark.createDataFrame([("ledger cursor",)], "query string")
    want = [("a/0000.ts", 1, 2), ("z/last.ts", 2, 1)]
    assert rows(retrieval.keyword_search(docs, ask, 2), "path", "matched", "rank") == want
    # The same where the words are too many to broadcast.
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert rows(retrieval.keyword_search(docs, ask, 2), "path", "matched", "rank") == want


def test_extract_typed_languages():
    cs = ingest.extract("a.cs", "using System.Text;\nusing static A.B;\nusing X = C.D;\n// using No;\nnamespace N;\npublic sealed class Box<T> : Base\n{\n    public Box(int n) : base(n) { }\n    public int Size { get; set; }\n    public async Task<List<T>> scanAlias(string a)\n    {\n        if (a == null) { return load(a); }\n        return run(\"class No {\", a);\n    }\n}\npublic FathomHandler sweep(string s)\n{\n    using (var f = open(s)) { }\n}\n")
    assert [s[:4] for s in cs["symbols"]] == [("Box", "class_declaration", 6, 15), ("Box", "method_declaration", 8, 8), ("Size", "property_declaration", 9, 9), ("scanAlias", "method_declaration", 10, 14), ("sweep", "method_declaration", 16, 19)]
    assert cs["imports"] == ["System.Text", "A.B", "C.D"] and [c[0] for c in cs["calls"]] == ["base", "load", "run", "open"]
    dart = ingest.extract("a.dart", "import 'a.dart';\nexport \"b.dart\";\nclass Box extends Base {\n  Box(this.n) : super();\n  int get size => n;\n  Future<void> load({int a = 1}) async {\n    return scan(a);\n  }\n}\nCinderVisitor scanSpan() {\n  while (walk(x) < 3) {\n    run(x);\n  }\n}\n")
    assert [s[:4] for s in dart["symbols"]] == [("Box", "class_declaration", 3, 9), ("size", "property_declaration", 5, 5), ("load", "function_declaration", 6, 8), ("scanSpan", "function_declaration", 10, 14)]
    assert dart["imports"] == ["a.dart", "b.dart"]
    php = ingest.extract("a.php", "<?php\nuse A\\B;\nuse C, D as E;\nuse F\\{G, H as I};\nrequire_once 'x.php';\nabstract class Box extends Base\n{\n    use SomeTrait;\n    public static function load($a)\n    {\n        return scan($a);\n    }\n}\nfunction run() { }\n")
    assert [s[:4] for s in php["symbols"]] == [("Box", "class_declaration", 6, 13), ("load", "method_declaration", 9, 12), ("run", "method_declaration", 14, 14)]
    assert php["imports"] == ["A\\B", "C", "D", "F\\G", "F\\H", "x.php"] and [c[0] for c in php["calls"]] == ["scan"]


def test_extract_broken_python():
    whole = "import os\nclass A(Base):\n    def f(self, x: Thing):\n        return g(x, 1)\n\n"
    want = ingest.extract("a.py", whole)
    # What is intact stays as it is, wherever the text breaks off.
    for end in ("def h(a, b", "def h(a):\n", "x = '''abc", "@wraps(", "if x:\n"):
        got = ingest.extract("a.py", whole + end)
        assert got["symbols"][:2] == want["symbols"] and got["imports"] == ["os"] and got["references"] == want["references"] and ("g", 2) in got["calls"]
    got = ingest.extract("a.py", whole + "def h(a, b=(1, 2)):\n    # def no():\n    from .c import d\n    s = 'class No:'\n    k(a)\n    def i(): return 1\n    m(b, [")
    assert got["symbols"][2:] == [("h", "function_definition", 6, 12, 2), ("i", "function_definition", 11, 11, 0)]
    assert got["imports"] == ["os", ".c"] and [c for c in got["calls"] if c[1] < 0] == [("k", -1), ("m", -1)]
    # An error in the middle leaves what comes after it.
    got = ingest.extract("a.py", "def a():\n    pass\nprint 'x'\ndef b(c):\n    return d(c)\n")
    assert [s[:4] for s in got["symbols"]] == [("a", "function_definition", 1, 2), ("b", "function_definition", 4, 5)] and got["calls"] == [("d", -1)]
    assert ingest.extract("a.py", "a\0b")["symbols"] == []


def test_search_within_models(spark, tmp_path):
    from stratagraph.plans import memory_queries

    one, two, bad = [1.0] + [0.0] * 63, [1.0, 1.0] + [0.0] * 62, [0.0] * 64
    h = lambda i: f"{i:015x}" + "0" * 49
    cache = [(h(20), "mini-64", one, [1], [1.0], 1.0), (h(20), "wide-64", two, [1], [2.0], 1.0), (h(21), "wide-64", one, [1, 2], [1.0, 1.0], 1.0), (h(22), "wide-64", bad, [1], [3.0], 1.0), (h(22), "mini-64", None, [1], [3.0], 1.0), (h(23), "mini-64", two, None, None, 1.0)]
    spark.createDataFrame(cache, "chunk_hash string, model string, dense array<float>, sparse_idx array<int>, sparse_val array<float>, ts double").write.parquet(f"{tmp_path}/embed_cache.parquet")
    # An unusable dense vector takes no sparse one away, and models don't meet.
    sparse = rows(memory_queries.q_sparse_topk_models(spark, str(tmp_path)), "model", "query", "id", "rank")
    assert sparse == [("mini-64", 20, 22, 1), ("wide-64", 20, 21, 2), ("wide-64", 20, 22, 1)]
    for q in (memory_queries.q_hybrid_rrf_models, memory_queries.q_hybrid_dbsf_models):
        assert {r[:3] for r in rows(q(spark, str(tmp_path)), "model", "query", "id")} == {("mini-64", 20, 22), ("mini-64", 20, 23), ("wide-64", 20, 21), ("wide-64", 20, 22)}


def test_breaker_states(spark):
    from stratagraph.operators import metrics

    events = [(i, k, float(t), bad) for i, (k, t, bad) in enumerate([("a", 0, True), ("a", 1, True), ("a", 2, True), ("a", 11, True), ("a", 15, False), ("a", 22, False), ("a", 23, True), ("a", 24, None), ("b", 0, True), (None, 0, True), (None, 1, True), (None, 2, False)])]
    df = spark.createDataFrame(events, "event_id long, k string, ts double, failed boolean").repartition(3)
    got = dict(rows(metrics.breaker_states(df, "k", F.col("failed"), 2, 10.0), "event_id", "state"))
    assert [got[i] for i in range(12)] == ["closed", "closed", "open", "half_open", "open", "half_open", "closed", "closed", "closed", "closed", "closed", "open"]
    assert metrics.breaker_states(df.limit(0), "k", F.col("failed"), 2, 10.0).count() == 0


def test_snapshots_of_two_places_and_what_is_pending(spark):
    s = "project string, head_sha string, at double"
    got = ingest.available(spark.createDataFrame([("p", "a", 1.0), ("p", "a", 2.0)], s), spark.createDataFrame([("p", "a", 0.0), ("p", "b", 5.0)], s))
    assert rows(got) == [("p", "a", 1.0, True), ("p", "b", 5.0, False)]
    order = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("q", "x", 1)], "project string, head_sha string, idx int")
    state = spark.createDataFrame([("p", "a"), ("q", "gone")], "project string, sha string")
    changes = spark.createDataFrame([("p", "f", "changed"), ("p", "g", "deleted"), ("p", "h", "changed")], "project string, path string, kind string")
    assert rows(ingest.pending(order, state, changes)) == [("p", "c", "a", 2, 2, 1), ("q", "x", "gone", 1, 0, 0)]


def test_digest_is_a_tree(spark, monkeypatch):
    df = spark.createDataFrame([("g", str(i)) for i in range(500)] + [("h", "x")], "g string, line string")
    one = rows(ingest.digest(df, ["g"], F.col("line")))
    assert one == rows(ingest.digest(df.repartition(7).orderBy(F.desc("line")), ["g"], F.col("line"))) and len(one) == 2
    assert rows(ingest.digest(df.where("line <> '7'"), ["g"], F.col("line")))[0] != one[0] and ingest.digest(df.limit(0), ["g"], F.col("line")).count() == 0
