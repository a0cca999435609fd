"""python -m stratagraph FOLDER COMMAND [ARGUMENT...]: prints the rows of a lookup, or what a write has done, as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from stratagraph.api import Memory
from stratagraph.functions.text import duration_seconds
from stratagraph.operators import pack
from stratagraph.sources import trees


def _write(m: Memory, a: argparse.Namespace) -> dict:
    if a.command == "record":
        return {"id": m.record(a.prompt, a.plan, a.patch, a.verdict, a.tag, head_sha=a.head_sha)}
    if a.command == "record-read":
        m.append("fs_reads", tool=a.tool, path=a.file, output_chars=a.chars, session_id=a.session)
        return {"recorded": a.file}
    if a.command == "assert-claim":
        return {"id": m.assert_claim(a.subject, a.predicate, a.object, not a.negated, a.confidence, a.evidence)}
    if a.command == "snapshot":
        return m.snapshot(a.root, a.project or "default", a.sha)
    if a.command == "restore":
        return {"refused": m.restore(a.root, a.project or "default", a.sha)}
    return {"gone": m.reset(a.names or None)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratagraph")
    p.add_argument("folder")
    p.add_argument("--project")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("definitions", "callers", "callees", "injects", "injectors", "importers", "dependencies"):
        s = sub.add_parser(name)
        s.add_argument("name")
        if name in ("callers", "callees"):
            s.add_argument("--depth", type=int, default=1)
    s = sub.add_parser("at-sha")
    s.add_argument("ordinal", type=int)
    s.add_argument("--label", default="Symbol")
    s = sub.add_parser("vacuum")
    s.add_argument("--before-ord", type=int)
    s.add_argument("--older-than")
    s.add_argument("--now", type=float)
    s.add_argument("--all", action="store_true")
    s = sub.add_parser("claims")
    s.add_argument("--subject")
    s.add_argument("--as-of", type=float)
    s = sub.add_parser("snapshot-gc")
    s.add_argument("keep_last", type=int)
    s = sub.add_parser("find-claims")
    s.add_argument("query")
    s.add_argument("--now", type=float)
    s = sub.add_parser("retrieve")
    s.add_argument("query")
    s.add_argument("--text", action="store_true")
    s.add_argument("--rows", action="store_true")
    s.add_argument("--include-idle", action="store_true")
    s = sub.add_parser("record")
    s.add_argument("prompt")
    for name in ("plan", "patch", "verdict", "head-sha"):
        s.add_argument(f"--{name}")
    s.add_argument("--tag", action="append", default=[])
    s = sub.add_parser("record-read")
    s.add_argument("file")
    s.add_argument("--tool", default="read")
    s.add_argument("--chars", type=int, default=0)
    s.add_argument("--session")
    s = sub.add_parser("assert-claim")
    for name in ("subject", "predicate", "object"):
        s.add_argument(name)
    s.add_argument("--not", dest="negated", action="store_true")
    s.add_argument("--confidence", type=float, default=0.95)
    s.add_argument("--evidence", default="")
    s = sub.add_parser("ingest")
    s.add_argument("root")
    s.add_argument("--sha", required=True)
    s.add_argument("--ordinal", type=int, default=1)
    s = sub.add_parser("reset")
    s.add_argument("names", nargs="*")
    for name in ("snapshot", "restore"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("sha")
    for name in ("recent-episodes", "recent-retrieves"):
        s = sub.add_parser(name)
        s.add_argument("--limit", type=int, default=20)
    for name in ("drift", "resolve", "resolve-write", "orphans", "changes", "snapshot-list", "summary", "report", "health", "projects", "node-counts", "state"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    m = Memory(SparkSession.builder.getOrCreate(), a.folder, a.project)
    if a.command in ("callers", "callees"):
        df = getattr(m, a.command)(a.name, a.depth)
    elif a.command in ("definitions", "injects", "injectors", "importers", "dependencies"):
        df = getattr(m, a.command)(a.name)
    elif a.command == "at-sha":
        df = m.at_sha(a.ordinal, a.label)
    elif a.command == "vacuum":
        age = None if a.older_than is None else (a.now or time.time()) - duration_seconds(a.older_than)
        df = m.vacuum(before_ord=a.before_ord, before_at=age, drop_all=a.all)
    elif a.command == "claims":
        df = m.claims(a.subject, a.as_of)
    elif a.command == "snapshot-gc":
        df = m.snapshot_gc(a.keep_last)
    elif a.command == "find-claims":
        df = m.find_claims(a.query, a.now or time.time())
    elif a.command == "retrieve":
        df = m.retrieve(a.query, include_idle=a.include_idle)
        df = pack.render(df) if a.text else df if a.rows else pack.pack_json(df)
    elif a.command == "ingest":
        df = m.ingest(trees.source_files(m.spark, a.root), a.sha, a.ordinal)
        m.set_state(a.root, a.sha)
    elif a.command in ("recent-episodes", "recent-retrieves"):
        df = getattr(m, a.command.replace("-", "_"))(a.limit)
    elif a.command in ("record", "record-read", "assert-claim", "reset", "snapshot", "restore"):
        print(json.dumps(_write(m, a)))
        return 0
    else:
        df = getattr(m, a.command.replace("-", "_"))()
    for line in df.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
