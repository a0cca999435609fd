import pytest
from conftest import rows

from stratagraph.sources import trees


@pytest.mark.parametrize(
    ("rules", "path", "ignored"),
    [
        ("*.log", "a/b.log", True), ("/top.ts", "top.ts", True), ("/top.ts", "a/top.ts", False), ("gen/", "a/gen/x.ts", True), ("gen/", "gen", False), ("a/*.ts", "a/x.ts", True), ("a/*.ts", "a/b/x.ts", False),
        ("**/x.ts", "q/r/x.ts", True), ("a/**/z.ts", "a/z.ts", True), ("a/**/z.ts", "a/b/c/z.ts", True), ("*.ts\n!keep.ts", "keep.ts", False), ("[ab].ts", "b.ts", True), ("[!ab].ts", "b.ts", False), ("# no\n\n", "no", False), ("x?.ts", "xy.ts", True),
    ],
)
def test_ignore_rules(rules, path, ignored):
    assert trees.IgnoreRules([("", rules)]).ignores(path) is ignored


def test_nested_ignore_files():
    r = trees.IgnoreRules([("sub", "!a.ts"), ("", "*.ts")])
    assert r.ignores("a.ts") and not r.ignores("sub/a.ts") and r.ignores("sub/b.ts")


def test_scan(spark, tmp_path):
    for path, text in {"a.ts": "\ufeffconst x = 1;\nlet y;\n", "node_modules/b.ts": "x\ny", "c.txt": "x", "d/skip.py": "x = 1\n", "d/e.py": "import os\n", "min.js": "x" * 5000}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    rules = trees.IgnoreRules([("d", "skip.*")])
    assert rows(trees.scan(spark, str(tmp_path), rules), "path", "lang") == [("a.ts", "typescript"), ("d/e.py", "python"), ("min.js", "javascript")]
    assert rows(trees.source_files(spark, str(tmp_path), rules), "path", "text") == [("a.ts", "const x = 1;\nlet y;\n"), ("d/e.py", "import os\n")]


def test_projects_and_solutions(spark):
    a = '<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework><AssemblyName>Own</AssemblyName></PropertyGroup><ItemGroup><PackageReference Include="P" Version="1.0"/><PackageReference Include="P" Version="1.0"/><ProjectReference Include="..\\b\\b.csproj"/><ProjectReference Include="..\\no\\no.csproj"/></ItemGroup></Project>'
    s = 'Project("{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}") = "A", "src\\a\\a.csproj", "{AB-1}"\nProject("{2150E333-8FDC-42A3-9474-1A3956D46DE8}") = "F", "f", "{AB-2}"\nProject("{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}") = "G", "gone.csproj", "{AB-3}"\n'
    files = spark.createDataFrame([("src/a/a.csproj", a), ("src/b/b.csproj", "<Project><PropertyGroup><TargetFrameworks>net7.0;net6.0</TargetFrameworks></PropertyGroup></Project>"), ("all.sln", s)], "path string, text string")
    got = {r["path"]: (r["assembly"], r["framework"], r["references"], [tuple(p) for p in r["packages"]]) for r in trees.projects(files).collect()}
    assert got == {"src/a/a.csproj": ("Own", "net8.0", ["src/b/b.csproj"], [("P", "1.0")]), "src/b/b.csproj": ("b", "net7.0", [], [])}
    assert rows(trees.solutions(files)) == [("all.sln", "A", "src/a/a.csproj", "ab-1")]


def test_versions(spark):
    have = spark.createDataFrame([("p", "1.9.0"), ("p", "1.10.0-beta"), ("q", "2.0"), ("q", "3.0")], "package string, version string")
    assert rows(trees.chosen_versions(spark.createDataFrame([("p", None), ("q", "2.0"), ("r", "1")], "package string, version string"), have)) == [("p", "1.10.0-beta"), ("q", "2.0")]
