import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stratagraph.__main__ import main
from stratagraph.api import Memory
from stratagraph.functions.text import letters
from stratagraph.operators import memory, pack, retrieval

FILES = [("src/app.module.ts", "import { Repo } from './repo';\nexport class App {\n  svc = inject(Repo);\n  go() { return flush(1); }\n}\n", "typescript"), ("src/repo.ts", "export class Repo { }\nexport function flush(n) { return n; }\n", "typescript"), ("src/notes.py", "x = 1\n", "python")]


@pytest.fixture
def m(spark, tmp_path):
    return Memory(spark, str(tmp_path), "p")


def test_episodes_are_recorded_once(m):
    first = m.record(" Fix the ledger ", tags=["a"], meta={"k": "1", "m": "1"}, ts=1.0)
    assert m.record("Fix the ledger", plan="the plan", verdict="pass", tags=["b", "a"], meta={"k": "2"}, ts=2.0) == first
    other = m.record("Another", verdict="idle", ts=3.0)
    got = {r["id"]: r for r in m.recent_episodes().collect()}
    assert list(got) == [other, first] and got[first]["ts"] == 2.0 and got[first]["plan"] == "the plan" and got[first]["tags"] == ["a", "b"] and got[first]["meta"] == {"k": "2", "m": "1"}
    with pytest.raises(ValueError):
        m.record("  ")


def test_claims_are_asserted(m):
    for bad in ({"subject": " "}, {"confidence": 2}, {"polarity": "yes"}):
        with pytest.raises(ValueError):
            m.assert_claim(**({"subject": "svc", "predicate": "uses", "obj": "postgres"} | bad))
    m.assert_claim(" Svc ", "Deployed To", "one", valid_at=1.0)
    m.assert_claim("Svc", "deployed-to", "two", valid_at=2.0)
    assert rows(m.claims(), "subject", "predicate", "obj") == [("Svc", "deployed-to", "two")]
    assert rows(m.claims(as_of=1.5), "obj", "valid_to") == [("one", 2.0)]
    # The letters are the same: the open claim is refreshed, not contradicted.
    m.assert_claim("Svc", "deployed-to", "tow", confidence=0.99, valid_at=3.0, embed=letters, threshold=0.999)
    assert rows(m.claims(), "obj", "valid_at", "confidence") == [("two", 2.0, 0.99)]
    m.assert_claim("Svc", "deployed-to", "tow", valid_at=4.0)
    assert rows(m.claims(), "obj") == [("tow",)]


def test_files_to_answers(m, spark):
    seen = m.ingest(spark.createDataFrame(FILES, "path string, text string, lang string"), "c1", 1)
    assert rows(seen.where("project = 'p'"), "files", "symbols", "chunks") == [(3, 4, 5)]
    assert rows(m.resolve_write(), "type", "tier", "n") == [("CALLS", "imported", 1), ("INJECTS", "imported", 1)]
    assert rows(m.callers("flush"), "caller", "hop") == [("src/app.module.ts", 1)] and rows(m.injectors("Repo"), "file") == [("src/app.module.ts",)]
    assert rows(m.importers("repo"), "file") == [("src/app.module.ts",)] and m.graph[0].where("key like 'name::%'").count() == 0
    m.record("flush the ledger", ts=1.0)
    m.assert_claim("flush", "uses", "ledger")
    found = m.retrieve("flush", letters, k_code=2)
    assert rows(found, "section", "rank") == [("claims", 1), ("code", 1), ("code", 2), ("episodes", 1)]
    told = json.loads(pack.pack_json(found).first()["json"])
    assert told["query"] == "flush" and [h["path"] for h in told["code"]][0] in ("src/repo.ts", "src/app.module.ts") and told["claims"][0]["obj"] == "ledger" and told["episodes"][0]["prompt"] == "flush the ledger"
    text = pack.render(found).first()["text"]
    assert text.startswith("# Query\nflush\n\n## Code\n- src/") and "## User claims\n- flush uses ledger (conf=0.95)" in text
    # A commit later a file is changed and one is gone.
    m.ingest(spark.createDataFrame([("src/repo.ts", "export class Repo { }\n", "typescript")], "path string, text string, lang string"), "c2", 2, spark.createDataFrame([("p", "src/notes.py")], "project string, file string"))
    assert m.definitions("flush").count() == 0 and m.definitions("Repo").count() == 1 and m.code().where("path = 'src/notes.py' or name = 'flush'").count() == 0
    assert rows(m.at_sha(1), "name") == [("App",), ("Repo",), ("flush",), ("go",)]


def test_snapshots_state_and_reset(m, spark, tmp_path):
    m.ingest(spark.createDataFrame(FILES, "path string, text string, lang string"), "c1", 1)
    n = m.graph[0].count()
    assert m.snapshot(str(tmp_path / "snaps"), "p", "c1")["counts"]["nodes"] == n
    m.set_state("/r", "c1", "main", 3, 4)
    m.set_state("/r", "c2", "main")
    assert rows(m.state("/r"), "sha", "file_count") == [("c2", None)]
    m.clear_state("/r")
    assert m.state().count() == 0
    m.append("retrieves", query_text="q", total_ms=5.0, code_hit_count=1)
    m.append("cache_stats", hits=3, misses=1)
    with pytest.raises(ValueError):
        m.append("cache_stats", unknown=1)
    assert rows(m.report(), "retrieves", "avg_total_ms", "hit_ratio", "ingests", "symbols") == [(1, 5.0, 0.75, 1, 4)]
    assert set(m.reset(["nodes", "edges"])) == {"nodes", "edges"} and not m.store("nodes").exists()
    assert m.restore(str(tmp_path / "snaps"), "p", "none") == "no manifest" and m.restore(str(tmp_path / "snaps"), "p", "c1") == "" and m.graph[0].count() == n
    m.reset()
    assert not m.has("nodes") and not m.has("retrieves") and m.table("retrieves").count() == 0
    with pytest.raises(ValueError):
        Memory(spark, str(tmp_path), "auto")


def test_retrieve_ranks_again(spark):
    """Entry points are raised, generated files lowered, idle and repeated episodes and the question itself are left out."""
    code = spark.createDataFrame([("1", "a.ts", "abc", False), ("2", "main.ts", "abc", False), ("3", "b.ts", "abc", True), ("4", "none.ts", "", False)], "id string, path string, text string, generated boolean").selectExpr("*", "1 as start", "2 as end", "'k' as kind", "'n' as name")
    eps = spark.createDataFrame([("1", "abc", None, None, None), ("2", "ABC d", None, None, "pass"), ("3", "abc  D", None, None, "pass"), ("4", "abc e", None, None, "idle")], "id string, prompt string, plan string, patch string, verdict string")
    asked = spark.createDataFrame([("abc",), ("abc",), (None,)], "query string")
    got = rows(pack.retrieve(asked, code, eps, None, 0.0, letters), "section", "rank", "id")
    assert got == [("code", 1, "2"), ("code", 2, "1"), ("code", 3, "3"), ("episodes", 1, "2")]
    idle = rows(pack.retrieve(asked, code, eps, None, 0.0, letters, include_idle=True).where("section = 'episodes'"), "id")
    assert idle == [("2",), ("4",)]
    assert pack.retrieve(asked.limit(0), code, eps, None, 0.0, letters).count() == 0 and pack.retrieve(asked, code.limit(0), eps.limit(0), None, 0.0, letters).count() == 0
    with pytest.raises(ValueError):
        pack.code_hits(asked, code, 1, "other")


def test_modes_and_claims_without_vectors(spark):
    sparse = "array(1) as sparse_idx, array(cast(1 as float)) as sparse_val"
    code = spark.createDataFrame([("1", "a.ts", [1.0, 0.0]), ("2", "b.ts", [0.0, 1.0])], "id string, path string, vector array<double>").selectExpr("*", "false as generated", sparse.split(" as ")[0] + " as sparse_idx", "if(id = '2', array(cast(5 as float)), array(cast(1 as float))) as sparse_val")
    asked = spark.createDataFrame([("q", [1.0, 0.1])], "query string, vector array<double>").selectExpr("*", "array(1) as sparse_idx", "array(cast(1 as float)) as sparse_val")
    assert rows(pack.code_hits(asked, code, 1), "id") == [("1",)]
    for mode in ("rrf", "dbsf"):
        assert rows(pack.code_hits(asked, code, 2, mode), "id") == [("1",), ("2",)]
    claims = spark.createDataFrame([("1", "ledger", "x", 0.5, "", 0.0), ("2", "ledger cursor", "x", 0.5, "", 0.0), ("3", "none", "x", 1.0, "", 0.0)], "id string, subject string, obj string, confidence double, evidence_span string, valid_at double")
    assert rows(pack.claim_hits(spark.createDataFrame([("the ledger cursor",)], "query string"), claims, 5, 0.0, False), "rank", "id") == [(1, "2"), (2, "1")]
    assert rows(memory.rank_lexical("the ledger cursor", claims.selectExpr("*", "'p' as predicate", "true as polarity"), 0.0, 5), "id") == [("1",), ("2",)]


def test_command_line(tmp_path, spark, capsys):
    folder, src = str(tmp_path / "d"), tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def flush():\n    return 1\n")
    (tmp_path / "d").mkdir()

    def run(*args):
        assert main([folder, "--project", "p", *args]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert {"files": 1, "symbols": 1}.items() <= run("ingest", str(src), "--sha", "c1")[0].items()
    assert run("record", "flush it", "--verdict", "pass", "--tag", "t")[0]["id"] and run("assert-claim", "svc", "uses", "flush")[0]["id"]
    assert [h["name"] for h in run("retrieve", "flush")[0]["json"] and json.loads(run("retrieve", "flush")[0]["json"])["code"]] == ["flush"]
    assert run("record-read", "a.py", "--chars", "5") == [{"recorded": "a.py"}] and run("state")[0]["sha"] == "c1"
    assert run("definitions", "flush")[0]["file"] == "a.py" and run("node-counts") and run("projects")[0]["head_sha"] == "c1" and run("report")[0]["ingests"] == 1
    assert run("recent-episodes")[0]["prompt"] == "flush it" and run("find-claims", "flush")[0]["obj"] == "flush"
    assert "nodes" in run("reset")[0]["gone"]
