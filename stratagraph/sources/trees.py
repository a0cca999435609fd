"""Source trees as tables: scanning with ignore rules, project and solution files, and choosing package versions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.functions.text import version_key
from stratagraph.operators.ingest import looks_minified

#: Languages by extension, directories that are never scanned, and the greatest file that is read (fixed values).
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "cs": "csharp", "cshtml": "razor",
    "razor": "razor", "vb": "vb", "fs": "fsharp", "fsi": "fsharp", "fsx": "fsharp", "php": "php", "phtml": "php", "dart": "dart",
}
IGNORED_DIRS = (
    ".git", "node_modules", ".venv", "venv", "dist", "build", ".next", ".nuxt", "out", "coverage", ".turbo", ".cache", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target",
    ".angular", ".nx", ".yarn", ".parcel-cache", ".svelte-kit", "bower_components", "vendor", "tmp", "bin", "obj", "packages", "TestResults", ".vs", "artifacts",
)
MAX_BYTES = 500_000
#: The type of a solution's folders, which are no projects (fixed value).
FOLDER_TYPE = "2150e333-8fdc-42a3-9474-1a3956d46de8"


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


class IgnoreRules:
    """The rules of ignore files: (directory of the file, its text) pairs; the last rule that matches a path or one of its ancestors decides."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.rules: list[tuple[str, bool, bool, re.Pattern[str]]] = []
        for base, text in sorted(files, key=lambda f: (f[0].count("/") + bool(f[0]), f[0])):
            for line in text.splitlines():
                rule = line.strip()
                if not rule or rule.startswith("#"):
                    continue
                negated = rule.startswith("!")
                rule = rule.removeprefix("!").strip()
                only_dirs = rule.endswith("/")
                rule = rule.rstrip("/")
                if rule:
                    self.rules.append((base, negated, only_dirs, re.compile(self.pattern(rule))))

    @staticmethod
    def pattern(rule: str) -> str:
        """A regular expression for a path below the rule's directory. A rule with a slash inside is bound to that directory."""
        bound = "/" in rule and not rule.startswith("**/")
        out, i, rule = "" if bound else "(?:.*/)?", 0, rule.removeprefix("/").removeprefix("**/")
        while i < len(rule):
            if rule.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                out, i = out + ".*", i + 2
            elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
                inner = rule[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
            else:
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(rule[i], re.escape(rule[i])), i + 1
        return out + r"\Z"

    def ignores(self, path: str) -> bool:
        parts = path.split("/")
        ignored = False
        for n in range(1, len(parts) + 1):
            some, is_dir = "/".join(parts[:n]), n < len(parts)
            for base, negated, only_dirs, pattern in self.rules:
                if base and not some.startswith(base + "/"):
                    continue
                if (is_dir or not only_dirs) and pattern.match(some[len(base) + 1 if base else 0 :]):
                    ignored = not negated
        return ignored

    def column(self, path: Column) -> Column:
        @F.pandas_udf(T.BooleanType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for paths in batches:
                yield paths.map(lambda p: p is not None and self.ignores(p)).astype(bool)

        return run(path)


def scan(spark: SparkSession, root: str, ignore: IgnoreRules | None = None) -> DataFrame:
    """path (below root), lang, size of every file that would be read: a known language, no ignored directory, not too large.

    The contents aren't read: Spark prunes the column.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_extract("path", re.escape(root) + "/(.*)$", 1)
    rows = files.select(path.alias("path"), F.col("length").alias("size"), "content").withColumn("lang", language(F.col("path")))
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    rows = rows.where(F.col("lang").isNotNull() & ~F.arrays_overlap(dirs, F.array(*map(F.lit, IGNORED_DIRS))) & (F.col("size") <= MAX_BYTES))
    return rows if ignore is None else rows.where(~ignore.column(F.col("path")))


def source_files(spark: SparkSession, root: str, ignore: IgnoreRules | None = None) -> DataFrame:
    """path, lang, size, text of the files of scan() that don't look minified; a byte order mark is taken off."""
    rows = scan(spark, root, ignore).select("path", "lang", "size", F.regexp_replace(F.decode("content", "UTF-8"), "^\uFEFF", "").alias("text"))
    return rows.where(~looks_minified(F.col("text")))


def projects(files: DataFrame) -> DataFrame:
    """path, assembly, framework, references (paths), packages (name, version) of project files (path, text).

    The assembly is named like the file if the file doesn't say; of several frameworks the first counts; a package given
    twice counts once, references only if their file is among the files.
    """
    x = files.where(F.lower("path").rlike(r"\.(cs|fs|vb)proj$"))
    first = lambda q: F.get(F.filter(F.xpath("text", F.lit(q)), lambda v: v != ""), F.lit(0))
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    name, version = F.xpath("text", F.lit("//PackageReference/@Include")), "//PackageReference/@Version"
    framework = F.split(F.coalesce(first("//TargetFramework/text()"), first("//TargetFrameworks/text()")), ";")[0]
    parsed = x.select("path", F.coalesce(first("//AssemblyName/text()"), stem).alias("assembly"), framework.alias("framework"), F.xpath("text", F.lit("//ProjectReference/@Include")).alias("raw"), F.array_distinct(F.arrays_zip(name.alias("name"), F.xpath("text", F.lit(version)).alias("version"))).alias("packages"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    target = F.explode_outer("raw").alias("target")
    refs = parsed.select("path", folder.alias("folder"), target).where("target is not null").select("path", normal_path(F.concat("folder", F.replace("target", F.lit("\\"), F.lit("/")))).alias("target"))
    kept = refs.join(files.select(F.col("path").alias("target")), "target", "left_semi").groupBy("path").agg(F.sort_array(F.collect_set("target")).alias("references"))
    return parsed.drop("raw").join(kept, "path", "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def normal_path(path: Column) -> Column:
    """A relative path without '.' and '..' parts (those that lead above the root are dropped)."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    folded = F.aggregate(parts, start, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def solutions(files: DataFrame) -> DataFrame:
    """solution, name, path, guid of the projects that solution files (path, text) name and that are among the files; folders are left out."""
    line = r'(?m)^\s*Project\("\{([0-9A-Fa-f-]+)\}"\)\s*=\s*"([^"]+)",\s*"([^"]+)",\s*"\{([0-9A-Fa-f-]+)\}"'
    x = files.where(F.lower("path").endswith(".sln") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ("bin", "obj", "node_modules")))))
    groups = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(line), F.lit(i)).alias(a) for i, a in ((1, "type"), (2, "name"), (3, "rel"), (4, "guid"))])
    rows = x.select(F.col("path").alias("solution"), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder"), F.explode(groups).alias("g"))
    rows = rows.where(F.lower("g.type") != FOLDER_TYPE).select("solution", F.col("g.name").alias("name"), normal_path(F.concat("folder", F.replace("g.rel", F.lit("\\"), F.lit("/")))).alias("path"), F.lower("g.guid").alias("guid"))
    return rows.join(files.select("path"), "path", "left_semi").select("solution", "name", "path", "guid")


def chosen_versions(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """package, version: the wanted version (package, version, may be null) if it is available, else the newest by its four numbers."""
    rows = available.distinct().join(wanted.select("package", F.col("version").alias("asked")), "package")
    w = W.partitionBy("package").orderBy(F.coalesce(F.col("version") == F.col("asked"), F.lit(False)).desc(), version_key(F.col("version")).desc(), F.desc("version"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("package", "version")
