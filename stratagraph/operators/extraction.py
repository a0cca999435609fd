"""What a source text declares and calls, in the columns the graph needs: namespaces, parameters, arguments, receivers.

Symbols, imports and references are those of ingest.extract(); here calls are read with the number of their arguments and, in
JavaScript and TypeScript, with the type of the field they are made on; classes' methods, interfaces, enumerations and types of
these languages are symbols too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from stratagraph.operators import ingest

#: Names that are never calls of the graph: built-ins, framework and test helpers (fixed values).
NO_CALLS = frozenset(
    """
    console JSON Math Object Array Promise Number String Boolean Date RegExp Symbol Map Set parseInt parseFloat isNaN isFinite
    setTimeout setInterval clearTimeout clearInterval fetch structuredClone queueMicrotask
    inject Injectable Component Directive Pipe NgModule Input Output ViewChild ContentChild HostListener HostBinding
    pipe subscribe map filter tap switchMap mergeMap concatMap exhaustMap catchError take takeUntil first of from EMPTY throwError
    combineLatest forkJoin BehaviorSubject Subject ReplaySubject
    describe it test expect beforeEach afterEach beforeAll afterAll jest vi spyOn print
    """.split()
)
#: Kinds of symbols that may be declared in parts.
PARTIAL_KINDS = ("class_declaration", "struct_declaration", "interface_declaration", "record_declaration")
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")

_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_NOT_NAMES = ingest._NO_NAMES | frozenset("constructor with let const var function class typeof delete void instanceof async".split())
_DECLARE = re.compile(
    r"^[ \t]*(?:@\w+(?:\([^()\n]*\))?[ \t]*)*(?P<mods>(?:(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override)[ \t]+)*)"
    r"(?:(?P<kind>function\*?|class|interface|enum|type)[ \t]+(?P<name>[A-Za-z_$][\w$]*)|(?:const|let|var)[ \t]+(?P<arrow>[A-Za-z_$][\w$]*)[^=\n;]*=[ \t]*(?:async[ \t]*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\w+)[^=\n;{}]*=>"
    r"|(?:(?:get|set)[ \t]+)?(?P<method>[A-Za-z_$#][\w$]*)[ \t]*(?:<[^<>()\n]*>)?(?=\((?:[^(){};]|\([^()]*\)|\{[^{}]*\})*\)[^;{}()=\n]*\{))",
    re.M,
)
_KINDS = {"function": "function_declaration", "function*": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "type": "type_alias_declaration"}
_FIELD = re.compile(r"(?:\b(?:private|protected|public|readonly|static|override)[ \t]+)+([A-Za-z_$#][\w$]*)[ \t]*[?!]?[ \t]*:[ \t]*([A-Za-z_$][\w$.]*)|^[ \t]*(?:(?:private|protected|public|readonly)[ \t]+)*([A-Za-z_$#][\w$]*)[ \t]*[?!]?[ \t]*:[ \t]*([A-Z][\w$.]*)[^(){};\n]*[;=]", re.M)
_INJECTED = re.compile(r"([A-Za-z_$#][\w$]*)[ \t]*(?::[^=;\n]*)?=[ \t]*inject\([ \t]*([A-Za-z_$][\w$.]*)")
_ON_FIELD = re.compile(r"\bthis\s*[?!]?\.\s*([A-Za-z_$#][\w$]*)\s*[?!]?\.\s*$")
_NAMESPACE = {".cs": re.compile(r"^[ \t]*namespace[ \t]+([\w.]+)[ \t]*(?P<open>[;{]|$)", re.M), ".php": re.compile(r"^[ \t]*(?:<\?php[ \t]+)?namespace[ \t]+([\w\\]+)[ \t]*(?P<open>[;{]|$)", re.M)}


def masked(text: str, php: bool = False) -> str:
    """The text with comments blanked and strings as runs of '\"', line ends kept: brackets and commas in them count for nothing."""
    quiet = ingest._QUIET_PHP if php else _QUIET
    return quiet.sub(lambda m: re.sub(r"[^\r\n]", " " if m.group()[0] in "/#" else '"', m.group()), text)


def closing(bare: str) -> dict[int, int]:
    """Where each opening bracket of a masked text is closed; one that isn't closed is left out."""
    at: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", bare):
        c = m.group()
        if c not in pairs:
            open_.append((c, m.start()))
        elif any(o == pairs[c] for o, _ in open_):
            while open_[-1][0] != pairs[c]:
                open_.pop()
            at[open_.pop()[1]] = m.start()
    return at


def arguments(bare: str, begin: int, ends: dict[int, int]) -> int:
    """How many parts the brackets that open at `begin` hold, by the commas that are in no others; -1 if they aren't closed."""
    end = ends.get(begin)
    if end is None:
        return -1
    n, i, last = 0, begin + 1, begin + 1
    while i < end:
        if bare[i] in "([{":
            i = ends.get(i, end)
        elif bare[i] == ",":
            n += bool(bare[last:i].strip())
            last = i + 1
        i += 1
    return n + bool(bare[last:end].strip())


def parameters(bare: str, begin: int, ends: dict[int, int]) -> int | None:
    """arguments() of a declaration, where commas in <...> part nothing either; None if the brackets aren't closed."""
    if begin not in ends:
        return None
    part, before = bare[begin : ends[begin] + 1], ""
    while part != before:
        part, before = re.sub(r"<[^<>(){};]*>", lambda m: "T" * len(m.group()), part), part
    return arguments(part, 0, closing(part))


def call_sites(bare: str, ends: dict[int, int], declared: set[int], receivers: list[tuple[int, int, dict[str, str]]]) -> list[tuple[str, int, str | None]]:
    """name, arguments, receiver of each call; receivers: begin, end and types of the fields of each class."""
    found = []
    for m in ingest._CALL.finditer(bare):
        name = m.group(1)
        if m.start(1) in declared or name in _NOT_NAMES or name in NO_CALLS:
            continue
        on = _ON_FIELD.search(bare, max(0, m.start(1) - 120), m.start(1))
        fields = next((f for a, b, f in sorted(receivers, reverse=True) if a <= m.start() <= b), {}) if on else {}
        found.append((name, arguments(bare, m.end() - 1, ends), fields.get(on.group(1)) if on else None))
    return found


def _script(text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and calls of a JavaScript or TypeScript text."""
    bare = masked(text)
    ends = closing(bare)
    starts = [m.end() for m in re.finditer("\n", text)]
    line = lambda p: sum(s <= p for s in starts) + 1
    symbols, declared, classes = [], set(), []
    inside: list[tuple[int, int]] = []
    for m in _DECLARE.finditer(bare):
        group = next(g for g in ("name", "arrow", "method") if m.group(g))
        name = m.group(group)
        body = re.compile(r"[{;]|\n\s*\n").search(bare, m.end() if group != "method" else ends.get(bare.find("(", m.end(group)), m.end()))
        end = ends.get(body.start(), len(text)) if body and body.group() == "{" else (body.start() if body else len(text))
        if group == "method":
            # A method is one only within the body of a class or an object; elsewhere it is a call before a block.
            if (name in _NOT_NAMES and name != "constructor") or not any(a < m.start(group) < b for a, b in inside):
                continue
        kind = "method_definition" if group == "method" else "arrow_function" if group == "arrow" else _KINDS[m.group("kind")]
        params = None
        if kind in ("method_definition", "function_declaration", "arrow_function"):
            begin = bare.find("(", m.end(group))
            params = parameters(bare, begin, ends) if 0 <= begin < (body.start() if body else len(text)) or group != "arrow" else 1
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        symbols.append((name, kind, line(at), line(min(end, max(0, len(text.rstrip()) - 1))), params, "", False))
        declared.add(m.start(group))
        if m.group("kind") in ("interface", "type") and body and body.group() == "{":
            # What looks like calls there are signatures.
            declared |= {c.start(1) for c in ingest._CALL.finditer(bare, body.start(), end)}
        if m.group("kind") == "class" and body and body.group() == "{":
            inside.append((body.start(), end))
            part = bare[body.start() : end]
            fields = {a or c: (b or d).split(".")[-1] for a, b, c, d in _FIELD.findall(part)} | {a: b.split(".")[-1] for a, b in _INJECTED.findall(part)}
            classes.append((body.start(), end, {f: t for f, t in fields.items() if t[:1].isupper()}))
    return symbols, call_sites(bare, ends, declared, classes)


def extract_all(path: str, text: str) -> dict[str, list]:
    """symbols (name, kind, start, end, params, namespace, partial), imports, calls (name, args, receiver), injects, references.

    args is -1 where a call isn't closed. Calls of names in NO_CALLS are left out. A namespace counts from where it is declared
    to the end of its block or of the text; partial holds for C# types that say so. A byte order mark at the front is dropped.
    """
    text = text.removeprefix("﻿")
    got = ingest.extract(path, text)
    kind = next((e for e in ingest._DECLARED if path.endswith(e)), None)
    if path.endswith(SCRIPTS):
        symbols, calls = _script(text)
        return got | {"symbols": symbols, "calls": calls}
    if kind is None:
        return got | {"symbols": [(*s, "", False) for s in got["symbols"]], "calls": [(n, a, None) for n, a in got["calls"] if n not in NO_CALLS]}
    bare = masked(text, kind == ".php")
    ends = closing(bare)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    spaces = []
    for m in (_NAMESPACE[kind].finditer(bare) if kind in _NAMESPACE else ()):
        begin = bare.find("{", m.end(1)) if m.group("open") != ";" else -1
        spaces.append((m.start(), ends.get(begin, len(text)) if begin >= 0 else len(text), m.group(1)))
    symbols, declared = [], set()
    for name, what, start, end, _ in got["symbols"]:
        at = starts[min(start, len(starts)) - 1]
        spot = re.compile(rf"\b{re.escape(name)}\b").search(bare, at)
        head = bare[at : spot.start()] if spot else ""
        declared |= {spot.start()} if spot else set()
        params = None
        if what in ("method_declaration", "function_declaration") and spot:
            begin = re.compile(r"\s*(?:<[^(){};\n]*>)?\s*\(").match(bare, spot.end())
            params = parameters(bare, begin.end() - 1, ends) if begin else None
        inner = [n for a, b, n in spaces if a <= at <= b]
        symbols.append((name, what, start, end, params, ".".join(inner) if kind == ".cs" else (inner[-1] if inner else ""), what in PARTIAL_KINDS and bool(re.search(r"\bpartial\b", head))))
    return got | {"symbols": symbols, "calls": call_sites(bare, ends, declared, [])}


EXTRACTED = (
    "project string, path string, lang string, generated boolean, text string, symbols array<struct<name string, kind string, start int, end int, params int, namespace string, partial boolean>>, "
    "imports array<string>, calls array<struct<name string, args int, receiver string>>, injects array<string>, references array<string>"
)


def extract_rows(files: DataFrame) -> DataFrame:
    """files (project, path, lang, generated, text) with what extract_all() finds in each."""
    symbol, call = ("name", "kind", "start", "end", "params", "namespace", "partial"), ("name", "args", "receiver")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract_all(p, t) for p, t in zip(pdf.path, pdf.text, strict=True)]
            yield pdf.assign(
                symbols=[[dict(zip(symbol, s, strict=True)) for s in g["symbols"]] for g in got], imports=[g["imports"] for g in got],
                calls=[[dict(zip(call, c, strict=True)) for c in g["calls"]] for g in got], injects=[g["injects"] for g in got], references=[g["references"] for g in got],
            )

    return files.select("project", "path", "lang", "generated", "text").mapInPandas(run, EXTRACTED)
