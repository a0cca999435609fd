"""Ingest: what files are, what changed, what to do about it, and the embedding cache and snapshots around it."""

from __future__ import annotations

import ast
import bisect
import keyword
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions.text import chunk_id
from stratagraph.runtime import numbered

#: What marks generated files and paths, and the limits beyond which a file looks minified (fixed values).
GENERATED_MARKERS = ("@generated", "auto-generated", "autogenerated", "code generated by", "do not edit", "this file was generated", "generated by openapi", "generated by swagger", "generated by ng-openapi-gen", "generated by openapi-generator")
GENERATED_PARTS = ("generated", "__generated__", "openapi-gen", "swagger-gen")
GENERATED_SUFFIXES = (".generated.ts", ".generated.js", ".g.ts", ".g.dart")
SAMPLE, LONGEST_LINE, MEAN_LINE, HEADER = 4096, 2000, 200, 2048
#: Leading digits that the hashes of a bucket share, at each level of a digest.
DIGEST_LEVELS = (6, 3, 0)
#: Characters of a symbol's body, of a file without symbols, and signature lines of a chunk.
BODY, WHOLE, SIGNATURE = 1500, 6000, 3


def looks_minified(text: Column) -> Column:
    """No line end in the sample, a line over 2000 characters, or more than 200 on average; an empty text isn't."""
    sample = F.substring(text, 1, SAMPLE)
    lines = F.split(F.regexp_replace(sample, "\n$", ""), "\n")
    longest = F.array_max(F.transform(lines, F.length))
    return F.coalesce((F.length(sample) > 0) & (~F.contains(sample, F.lit("\n")) | (longest > LONGEST_LINE) | (F.length(sample) / F.size(lines) > MEAN_LINE)), F.lit(False))


def looks_generated(path: Column, text: Column) -> Column:
    """By a part or suffix of the path, or a marker in the first 2048 characters, in any case."""
    low, head = F.lower(path), F.lower(F.substring(text, 1, HEADER))
    hit = F.exists(F.split(low, "/"), lambda p: p.isin(*GENERATED_PARTS))
    for s in GENERATED_SUFFIXES:
        hit = hit | low.endswith(s)
    for m in GENERATED_MARKERS:
        hit = hit | F.contains(head, F.lit(m))
    return F.coalesce(hit, F.lit(False))


def symbol_chunks(symbols: DataFrame, also: list[str] | None = None) -> DataFrame:
    """chunk_id, path, name, kind, start, end, text (and the columns also) of symbols (path, name, kind, start, end, snippet).

    A header, the first three lines that aren't blank, and the first 1500 characters of the body.
    """
    lines = F.slice(F.filter(F.split("snippet", "\n"), lambda x: F.trim(x) != ""), 1, SIGNATURE)
    signature = F.when(F.size(lines) > 0, F.concat(F.lit("SIGNATURE\n"), F.array_join(lines, "\n")))
    text = F.concat_ws("\n", F.concat(F.lit("FILE "), "path"), F.concat(F.lit("KIND "), "kind", F.lit(" NAME "), "name"), signature, F.substring("snippet", 1, BODY))
    return symbols.select(chunk_id(F.col("path"), F.concat_ws("#", "name", "start")).alias("chunk_id"), *(also or []), "path", "name", "kind", "start", "end", text.alias("text"))


def sanity(chunks: DataFrame) -> DataFrame:
    """project, n, missing, share: symbols with plain names whose text lacks the name as a whole word; more than 2 % is suspect."""
    plain = chunks.where((F.col("kind") != "file") & F.col("sym_name").rlike("^[A-Za-z_][A-Za-z0-9_]*$") & F.col("text").isNotNull())
    body = F.concat(F.lit(" "), F.regexp_replace("text", "[^A-Za-z0-9_]+", " "), F.lit(" "))
    # After everything but word characters has become a blank, a whole word is one between blanks.
    missing = ~F.contains(body, F.concat(F.lit(" "), "sym_name", F.lit(" ")))
    return plain.groupBy("project").agg(F.count("*").alias("n"), F.count_if(missing).alias("missing")).withColumn("share", F.round(F.col("missing") / F.col("n"), 6)).withColumn("suspect", F.col("share") > 0.02)


def health_check(counts: DataFrame) -> DataFrame:
    """Adds rebuild: files grew by more than a fifth and there are fewer symbols than half the files (none at all means a store that is down)."""
    return counts.withColumn("rebuild", (F.col("files") > 1.2 * F.col("prior_files")) & (F.col("symbols") < 0.5 * F.col("files")) & (F.col("symbols") > 0))


def available(local: DataFrame, remote: DataFrame) -> DataFrame:
    """project, head_sha, at, is_local: the snapshots of two places, each once; what is here counts, not what is there as well."""
    rows = local.select("project", "head_sha", "at", F.lit(True).alias("l")).unionByName(remote.select("project", "head_sha", "at", F.lit(False).alias("l")))
    return rows.groupBy("project", "head_sha").agg(F.coalesce(F.min(F.when(F.col("l"), F.col("at"))), F.min("at")).alias("at"), F.bool_or("l").alias("is_local"))


def pending(order: DataFrame, state: DataFrame, changes: DataFrame) -> DataFrame:
    """project, head_sha, last_sha, behind, changed, deleted: how far what was read last lies behind each project's head.

    order: snapshots (project, head_sha, idx); state: project, sha; changes: delta() with project. behind counts snapshots, all
    of them where nothing was read or its commit isn't known.
    """
    w = order.groupBy("project").agg(F.max("idx").alias("m"), F.max_by("head_sha", "idx").alias("head_sha"))
    at = state.join(order, (state["project"] == order["project"]) & (state["sha"] == order["head_sha"]), "left").select(state["project"], F.col("sha").alias("last_sha"), "idx")
    kinds = changes.groupBy("project").agg(F.count_if(F.col("kind") == "changed").alias("changed"), F.count_if(F.col("kind") == "deleted").alias("deleted"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return w.join(at, "project", "left").join(kinds, "project", "left").select("project", "head_sha", "last_sha", (F.col("m") - F.coalesce("idx", F.lit(0))).alias("behind"), none("changed"), none("deleted"))


def delta(base: DataFrame, head: DataFrame, key: list[str], version: str) -> DataFrame:
    """key..., kind: 'changed' for new or different files, 'deleted' for those gone, from two manifests (key, version)."""
    both = base.select(*key, F.col(version).alias("_b"), F.lit(True).alias("_in_b")).join(head.select(*key, F.col(version).alias("_h"), F.lit(True).alias("_in_h")), key, "full_outer")
    kind = F.when(F.col("_in_h").isNull(), "deleted").when(F.col("_in_b").isNull() | ~F.col("_b").eqNullSafe(F.col("_h")), "changed")
    return both.select(*key, kind.alias("kind")).where("kind is not null")


def reingest_paths(changed: DataFrame, dirty: DataFrame) -> DataFrame:
    """path, position: changed and then dirty paths, each once, in their order (both: path, position)."""
    rows = changed.select("path", F.lit(0).alias("list"), "position").unionByName(dirty.select("path", F.lit(1).alias("list"), "position"))
    first = rows.groupBy("path").agg(F.min(F.struct("list", "position")).alias("at"))
    return numbered(first.select("path", "at.list", F.col("at.position").alias("was")), "list", "was").select("path", "position")


def sync_action(states: DataFrame) -> DataFrame:
    """Adds action to states (is_git, locked, prior, head, dirty, snapshot_at_head, ancestor, base_reachable)."""
    c = F.col
    fallback = F.when(c("ancestor").isNotNull(), "pull_then_incremental").otherwise("full_ingest")
    action = (
        F.when(~c("is_git"), "full_ingest").when(c("locked"), "noop")
        .when(c("prior") == c("head"), F.when(c("dirty"), "dirty_only").otherwise("noop"))
        .when(c("snapshot_at_head"), "pull_snapshot").when(c("prior").isNull() | ~c("base_reachable"), fallback).otherwise("incremental")
    )
    return states.withColumn("action", action)


def cache_split(batch: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The rows of batch (with chunk_hash) with hit: whether the cache has a current vector of the model for them."""
    held = cache.where((F.col("model") == model) & F.col("dense").isNotNull()).select("chunk_hash").distinct().withColumn("hit", F.lit(True))
    return batch.join(held, "chunk_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_put(cache: DataFrame) -> DataFrame:
    """The current row of each (chunk_hash, model): the one with the greatest ts."""
    others = [c for c in cache.columns if c not in ("chunk_hash", "model")]
    return cache.where("chunk_hash is not null and model is not null").groupBy("chunk_hash", "model").agg(F.max_by(F.struct(*others), F.struct("ts", F.xxhash64("dense"))).alias("r")).select("chunk_hash", "model", *[F.col(f"r.{c}").alias(c) for c in others])


def cache_vacuum(cache: DataFrame, cutoff: float) -> DataFrame:
    """The current rows that are at least as new as the cutoff."""
    return cache_put(cache).where(F.col("ts") >= cutoff)


def snapshots_kept(manifest: DataFrame, keep_last: int) -> DataFrame:
    """project, head_sha, created_at, keep: the newest keep_last snapshots of a project stay (ties by head_sha)."""
    first = manifest.where("created_at is not null").groupBy("project", "head_sha").agg(F.min("created_at").alias("created_at"))
    return first.withColumn("keep", F.row_number().over(W.partitionBy("project").orderBy(F.desc("created_at"), F.desc("head_sha"))) <= keep_last)


def ancestor_snapshot(commits: DataFrame, available: DataFrame) -> DataFrame:
    """project, head_sha, ancestor: for each commit (project, head_sha, at) the last available snapshot (project, head_sha, at) not after it.

    An as-of join by one window over both, not by a join on inequality.
    """
    rows = commits.select("project", "head_sha", "at", F.lit(1).alias("q")).unionByName(available.select("project", "head_sha", "at", F.lit(0).alias("q")))
    w = W.partitionBy("project").orderBy("at", "q", "head_sha").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("ancestor", F.last(F.when(F.col("q") == 0, F.col("head_sha")), True).over(w)).where("q = 1").select("project", "head_sha", "ancestor")


def digest(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    """by..., digest: a hash of each group's rows that doesn't depend on their order.

    A tree of hashes: rows are hashed, and the sorted hashes that begin with the same DIGEST_LEVELS hexadecimal digits are
    hashed again, level by level. The inner levels join 4,096 hashes at most, and the lowest one has 16 million buckets a group,
    so that no task holds more than a group's rows divided by that.
    """
    level = rows.select(*by, F.lit("").alias("b"), F.sha2(line, 256).alias("h"))
    first = True
    for digits in DIGEST_LEVELS:
        at = F.substring("h" if first else "b", 1, digits) if digits else F.lit("")
        level = level.withColumn("at", at).groupBy(*by, "at").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("b", "h"))), ""), 256).alias("h")).withColumnRenamed("at", "b")
        first = False
    return level.select(*by, F.col("h").alias("digest"))


def reconcile(desired: DataFrame, current: DataFrame) -> DataFrame:
    """root, slug, action of two registries (root, slug): 'add', 'remove', or 'rebind' where the slug differs."""
    both = desired.select("root", F.col("slug").alias("_d"), F.lit(True).alias("_in_d")).join(current.select("root", F.col("slug").alias("_c"), F.lit(True).alias("_in_c")), "root", "full_outer")
    action = F.when(F.col("_in_c").isNull(), "add").when(F.col("_in_d").isNull(), "remove").when(~F.col("_d").eqNullSafe(F.col("_c")), "rebind")
    return both.select("root", F.coalesce("_d", "_c").alias("slug"), action.alias("action")).where("action is not null")


_JS_SYMBOL = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+(\w+)|class\s+(\w+)|(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>)", re.M)
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")
_JS_IMPORT = re.compile(r"^\s*(?:import\s[^'\"\n]*from\s*|import\s*|.*require\()\s*['\"]([^'\"]+)['\"]", re.M)
_INJECT = re.compile(r"\binject\(\s*([A-Za-z_$][\w$.]*)|^\s*@inject\s+([\w.<>]+)", re.M)
_TYPE = re.compile(r"\b(?:extends|implements|new|instanceof|as)\s+([A-Z][\w$]*)|:\s*([A-Z][\w$]*)|<\s*([A-Z][\w$]*)\s*>")
_PRIMITIVES = frozenset("Any Array Boolean Date Dict Dynamic Future Int Iterable Iterator List Map None Number Object Optional Promise Record Set String Tuple Type Union Void".split())
_KEYWORDS = frozenset("if for while switch return function catch typeof super constructor".split())

_QUIET_PYTHON = re.compile(r"#[^\r\n]*|\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z)|\"(?:\\.|[^\"\\\r\n])*\"?|'(?:\\.|[^'\\\r\n])*'?", re.S)
_ROUND = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_PYTHON_HEAD = re.compile(rf"^(?P<indent>[ \t]*)(?P<head>(?:async[ \t]+)?def[ \t]+(?P<def>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*{_ROUND}[ \t]*(?:->[^:\r\n]+)?:|class[ \t]+(?P<class>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?:{_ROUND})?[ \t]*:)", re.M)
_PYTHON_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+(\.*[ \t]*[\w.]*)[ \t]+import\b|import[ \t]+([\w., \t]+?)[ \t]*(?:;|\r?$))", re.M)
_PYTHON_DEFINED = re.compile(r"\b(?:def|class)[ \t]+$")


def _python(text: str) -> tuple[ast.Module, int]:
    """The tree of the longest beginning of whole top-level statements that can be parsed, and where the rest of the text begins."""
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
    n = len(lines)
    while n > 0:
        try:
            return ast.parse("".join(lines[:n])), sum(map(len, lines[:n]))
        except (SyntaxError, ValueError) as e:
            # Before the error, and at the beginning of a statement; each round ends earlier.
            n = min(n, getattr(e, "lineno", None) or n) - 1
            while n > 0 and not re.match(r"[A-Za-z_@]", lines[n]):
                n -= 1
    return ast.Module([], []), 0


def _broken_python(text: str, begin: int) -> tuple[list, list, list, list]:
    """Symbols, imports, calls and types of the part that can't be parsed, by patterns; headers that are whole are parsed."""
    if begin >= len(text):
        return [], [], [], []
    rest = text[begin:]
    bare = _QUIET_PYTHON.sub(lambda m: re.sub(r"[^\r\n]", " ", m.group()), rest)
    ends = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
    line_of = lambda p: bisect.bisect_right(ends, begin + p) + 1
    symbols, kinds = [], []
    for m in _PYTHON_HEAD.finditer(bare):
        params = None
        try:
            node = ast.parse(rest[m.start("head") : m.end()] + " pass").body[0]
            if m.group("def"):
                params = len(node.args.args)
                kinds.extend(a.annotation for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.annotation)
                kinds.extend([node.returns] if node.returns else [])
            else:
                kinds.extend(node.bases)
        except (SyntaxError, ValueError):
            pass
        after = re.compile(rf"^[ \t]{{0,{len(m.group('indent'))}}}[^\s)\]}}]", re.M).search(bare, m.end())
        end = m.end() + len(bare[m.end() : after.start() if after else len(bare)].rstrip())
        symbols.append((m.group("def") or m.group("class"), "function_definition" if m.group("def") else "class_definition", line_of(m.start("head")), line_of(end), params))
    imports = [re.sub(r"\s", "", a) if a else x.split()[0] for a, b in _PYTHON_IMPORT.findall(bare) for x in (a or b).split(",") if x.strip()]
    calls = [(m.group(1), -1) for m in _CALL.finditer(bare) if not keyword.iskeyword(m.group(1)) and not _PYTHON_DEFINED.search(bare, max(0, m.start() - 20), m.start())]
    return symbols, imports, calls, kinds


# Languages with typed declarations, by extension: comments and strings, declarations and imports.
_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|@\"(?:\"\"|[^\"])*\"?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.S)
_QUIET_PHP = re.compile(r"#(?!\[)[^\n]*|" + _QUIET.pattern, re.S)
_MODS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|unsafe|new|file|virtual|override|async|extern|delegate|required|final|const|external|late|covariant|factory|base|interface(?=\s+class\b)|mixin(?=\s+class\b))[ \t]+)*"
_HEAD = r"^[ \t]*(?:\[[^\]\n]*\][ \t]*|@\w[\w.]*(?:\([^()\n]*\))?[ \t]+)*(?!(?:return|new|throw|await|yield|else|case|goto|in|is|as|do|try|using|import|export|assert|var)\b)"
_KIND = r"(?P<kind>class|interface|struct|enum|record(?:[ \t]+(?:class|struct))?|mixin|extension(?:[ \t]+type)?|typedef|trait)[ \t]+"
_TYPED = r"(?:(?P<type>(?:\([^()\n]*\)|[\w.:]+(?:<[^(){};\n]*>)?)(?:\[[, ]*\])*\??)[ \t]+)"
_NAMED = r"(?:\w+(?:<[^<>(){};\n]*>)?\.)*(?P<member>[A-Za-z_$][\w$]*)"
_MEMBER = _HEAD + "(?P<mods>" + _MODS + ")(?:" + _KIND + r"(?P<name>[A-Za-z_]\w*)(?=\s*[<({:;=]|[ \t]+(?:extends|implements|with|on|where)\b|\s*$)|" + _TYPED + "?" + _NAMED
_DECLARED = {
    ".cs": re.compile(_MEMBER + r"[ \t]*(?:<[^(){};\n]*>)?[ \t]*(?:\((?:[^(){};]|\([^()]*\))*\)\s*(?:where\b[^{;]*)?(?P<tail>\{|=>|;|:\s*(?:base|this)\b)|\s*(?P<get>\{\s*(?:\w+\s+)?(?:get|set|init)\b|=>)))", re.M),
    ".dart": re.compile(_MEMBER + r"[ \t]*(?:<[^(){};\n]*>)?[ \t]*(?:\((?:[^();]|\([^()]*\))*\)\s*(?:(?:async|sync)\*?\s*)?(?P<tail>\{|=>|;|:)))|^[ \t]*(?:(?:static|external)[ \t]+)*(?:[\w.]+(?:<[^(){};\n]*>)?\??[ \t]+)?get[ \t]+(?P<getter>\w+)(?=\s*(?:async\b|=>|\{|;))", re.M),
    ".php": re.compile(r"^[ \t]*(?:<\?php[ \t]+)?(?:#\[[^\]\n]*\][ \t]*)*(?P<mods>(?:(?:abstract|final|public|protected|private|static|readonly)[ \t]+)*)(?:function[ \t]+&?[ \t]*(?P<member>\w+)[ \t]*(?P<tail>\()|(?P<kind>class|interface|trait|enum)[ \t]+(?P<name>[A-Za-z_]\w*)(?=\s*[:{]|\s+(?:extends|implements)\b|\s*$))", re.M | re.I),
}
_IMPORTED = {
    ".cs": re.compile(r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([A-Za-z_][\w.:]*)(?:<[^;\n]*>)?[ \t]*;", re.M),
    ".dart": re.compile(r"^[ \t]*(?:import|export)\s+['\"]([^'\"\n]+)['\"]", re.M),
    ".php": re.compile(r"^[ \t]*(?:<\?php[ \t]+)?use\s+(?!\()([^;(]+);|\b(?:require|include)(?:_once)?[ \t]*\(?[ \t]*['\"]([^'\"\n]+)['\"]", re.M | re.I),
}
_METHOD = {".cs": "method_declaration", ".dart": "function_declaration", ".php": "method_declaration"}
_NO_NAMES = _KEYWORDS | frozenset("foreach elseif using lock fixed sizeof nameof default isset unset empty array list echo print exit die match fn when await assert get set else do try return new throw".split())


def _typed(path: str, text: str) -> tuple[list, list, list] | None:
    """Symbols, imports and calls of a C#, Dart or PHP text; None for other languages. Comments and strings declare and call nothing."""
    kind = next((e for e in _DECLARED if path.endswith(e)), None)
    if not kind:
        return None
    bare = (_QUIET_PHP if kind == ".php" else _QUIET).sub(lambda m: re.sub(r"[^\r\n]", " ", m.group()), text)
    ends = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda p: bisect.bisect_left(ends, p) + 1
    closed: dict[int, int] = {}
    depth: list[int] = []
    for m in re.finditer("[{}]", bare):
        if m.group() == "{":
            depth.append(m.start())
        elif depth:
            closed[depth.pop()] = m.start()
    symbols, names, bodies = [], set(), []
    for m in _DECLARED[kind].finditer(bare):
        g = m.groupdict()
        group = "name" if g["name"] else "getter" if g.get("getter") else "member"
        name = g[group]
        if group == "member":
            if name in _NO_NAMES or (g.get("get") and not g["mods"]) or (kind != ".php" and not (g["mods"] or g["type"]) and g["tail"] != "{"):
                continue
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        stop = re.compile("[{;]").search(bare, m.end(group) if group != "member" or kind == ".php" else m.end() - 1 if g.get("tail") else m.end(group))
        end = len(text) if not stop else stop.start() if stop.group() == ";" else closed.get(stop.start(), len(text))
        what = f"{g['kind'].split()[0].lower()}_declaration" if group == "name" else "property_declaration" if group == "getter" or g.get("get") else _METHOD[kind]
        symbols.append((name, what, line_of(at), line_of(min(end, len(text.rstrip()))), None))
        names.add(m.start(group))
        if group == "name" and stop and stop.group() == "{":
            bodies.append((stop.start(), end))
    imports = []
    for m in _IMPORTED[kind].finditer(text):
        word = m.start() + len(m.group()) - len(m.group().lstrip())
        # A use within a class takes a trait in and imports nothing.
        if bare[word] == " " or (kind == ".php" and m.group(1) and any(a < word < b for a, b in bodies)):
            continue
        if kind != ".php" or m.group(2):
            imports.append(m.group(1) or m.group(2))
            continue
        clause = re.sub(r"^(?:function|const)\s+", "", m.group(1).strip(), flags=re.I)
        prefix, _, inner = clause.rpartition("{")
        imports.extend(prefix + re.sub(r"^(?:function|const)\s+|\s+as\s+\w+$", "", x.strip(), flags=re.I) for x in inner.rstrip("} \r\n").split(",") if x.strip())
    calls = [(m.group(1), -1) for m in _CALL.finditer(bare) if m.start(1) not in names and m.group(1) not in _NO_NAMES and m.group(1) not in ("function", "use")]
    return symbols, imports, calls


def extract(path: str, text: str) -> dict[str, list]:
    """Symbols (name, kind, start, end, params), imports, calls (name, args), injects and references of one source text.

    injects are tokens given to inject(...) or @inject (they are no calls then); references are names of types in bases,
    annotations, generics and casts, without primitive ones.

    Python by its own parser, and by patterns from where a text can't be parsed (calls have -1 arguments there); C#, Dart and PHP
    by patterns for their declarations, others by those for JavaScript: a coarser reading, as no grammars are at hand.
    """
    symbols: list[tuple] = []
    imports: list[str] = []
    calls: list[tuple] = []
    kinds: list[ast.AST] = []
    injects = [a or b for a, b in _INJECT.findall(text)]
    if path.endswith(".py"):
        tree, begin = _python(text)
        for n in ast.walk(tree):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                symbols.append((n.name, "function_definition", n.lineno, n.end_lineno, len(n.args.args)))
                kinds.extend(a.annotation for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs] if a.annotation)
                kinds.extend([n.returns] if n.returns else [])
            elif isinstance(n, ast.ClassDef):
                symbols.append((n.name, "class_definition", n.lineno, n.end_lineno, None))
                kinds.extend(n.bases)
            elif isinstance(n, ast.AnnAssign):
                kinds.append(n.annotation)
            elif isinstance(n, ast.Import):
                imports.extend(a.name for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                imports.append("." * n.level + (n.module or ""))
            elif isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    calls.append((name, len(n.args) + len(n.keywords)))
        for found, more in zip((symbols, imports, calls, kinds), _broken_python(text, begin), strict=True):
            found.extend(more)
    elif typed := _typed(path, text):
        symbols, imports, calls = typed
    else:
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        found = [(next(g for g in m.groups() if g), m.start(0) + len(m.group(0)) - len(m.group(0).lstrip())) for m in _JS_SYMBOL.finditer(text)]
        line_of = lambda p: sum(s <= p for s in starts)
        for i, (name, at) in enumerate(found):
            end = line_of(found[i + 1][1]) - 1 if i + 1 < len(found) else len(starts)
            symbols.append((name, "function_declaration", line_of(at), end, None))
        imports.extend(_JS_IMPORT.findall(text))
        calls.extend((m, -1) for m in _CALL.findall(text) if m not in _KEYWORDS and m != "inject")
    named = [m.id if isinstance(m, ast.Name) else m.attr for k in kinds for m in ast.walk(k) if isinstance(m, ast.Name | ast.Attribute)] if kinds else []
    named += [] if path.endswith(".py") else [next(g for g in m if g) for m in _TYPE.findall(text)]
    references = list(dict.fromkeys(r for r in named if r[:1].isupper() and r not in _PRIMITIVES))
    return {"symbols": symbols, "imports": imports, "calls": calls, "injects": list(dict.fromkeys(injects)), "references": references}


EXTRACTED = "path string, symbols array<struct<name string, kind string, start int, end int, params int>>, imports array<string>, calls array<struct<name string, args int>>, injects array<string>, references array<string>"


def extract_files(files: DataFrame) -> DataFrame:
    """One row per file (path, text) with what extract() finds in it; explode them for the rows of the graph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract(p or "", t or "") for p, t in zip(pdf.path, pdf.text, strict=True)]
            yield pd.DataFrame({
                "path": pdf.path,
                "symbols": [[dict(zip(("name", "kind", "start", "end", "params"), s, strict=True)) for s in g["symbols"]] for g in got],
                "imports": [g["imports"] for g in got],
                "calls": [[{"name": n, "args": a} for n, a in g["calls"]] for g in got],
                "injects": [g["injects"] for g in got],
                "references": [g["references"] for g in got],
            })

    return files.select("path", "text").mapInPandas(run, EXTRACTED)
