"""From source files to rows of the graph and chunks, and what a change of files does to tables that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.text import chunk_id
from stratagraph.operators import extraction, graph, ingest
from stratagraph.runtime import cut, spread

_NODE = "project string, label string, key string, name string, kind string, file string, start int, end int, params int, lang string, generated boolean, lines int, unresolved boolean"


def read_files(files: DataFrame) -> DataFrame:
    """files (project, path, text, lang) with what is extracted from each, cut once; minified files are left out, generated ones marked."""
    known = files.where("project is not null and path is not null and text is not null").where(~ingest.looks_minified(F.col("text")))
    return cut(extraction.extract_rows(spread(known.select("project", "path", "lang", ingest.looks_generated(F.col("path"), F.col("text")).alias("generated"), "text"))))


def symbol_key(path: Column, name: Column, line: Column, namespace: Column, partial: Column) -> Column:
    """One key for all parts of a partial type of a namespace, else the place of the definition."""
    return F.when(F.coalesce(partial, F.lit(False)) & (namespace != ""), F.concat(F.lit("partial::"), namespace, F.lit("."), name)).otherwise(F.concat(path, F.lit("::"), name, F.lit("#"), line.cast("string")))


def graph_rows(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted files: files, symbols, modules and placeholders; what they define, import, call, inject and refer to.

    Several calls of a name in a file are one edge, with the number of arguments of the first that has one, and its receiver.
    """
    null = lambda t: F.lit(None).cast(t)
    blank = {c.split()[0]: null(c.split()[1]) for c in _NODE.split(", ")}

    def nodes(df: DataFrame, **known: Column) -> DataFrame:
        return df.select(*[(known.get(c, v)).cast(t).alias(c) for (c, v), t in zip(blank.items(), [x.split()[1] for x in _NODE.split(", ")], strict=True)])

    s = read.select("project", "path", F.explode("symbols").alias("s"))
    key = symbol_key(F.col("path"), F.col("s.name"), F.col("s.start"), F.col("s.namespace"), F.col("s.partial"))
    names = lambda c: read.select("project", "path", F.explode(c).alias("x"))
    calls = names("calls").groupBy("project", "path", F.col("x.name").alias("name")).agg(F.first(F.when(F.col("x.args") >= 0, F.col("x.args")), True).alias("args"), F.first("x.receiver", True).alias("receiver_type"))
    injects, refs, imports = (names(c).select("project", "path", F.col("x").alias("name")).where("name <> ''").distinct() for c in ("injects", "references", "imports"))
    placeholders = calls.select("project", "name").unionByName(injects.select("project", "name")).unionByName(refs.select("project", "name")).distinct()
    node = nodes(read, project=F.col("project"), label=F.lit("File"), key=F.col("path"), lang=F.col("lang"), generated=F.when(F.col("generated"), True), lines=F.size(F.split("text", "\n")))
    node = node.unionByName(nodes(s, project=F.col("project"), label=F.lit("Symbol"), key=key, name=F.col("s.name"), kind=F.col("s.kind"), file=F.col("path"), start=F.col("s.start"), end=F.col("s.end"), params=F.col("s.params")).dropDuplicates(["project", "label", "key"]))
    node = node.unionByName(nodes(imports.select("project", "name").distinct(), project=F.col("project"), label=F.lit("Module"), key=F.col("name"), name=F.col("name")))
    node = node.unionByName(nodes(placeholders, project=F.col("project"), label=F.lit("Symbol"), key=F.concat(F.lit("name::"), "name"), name=F.col("name"), unresolved=F.lit(True)))

    def edges(df: DataFrame, kind: str, label: str, dst: Column, args: Column | None = None, receiver: Column | None = None) -> DataFrame:
        return df.select(
            "project", F.lit(kind).alias("type"), F.lit("File").alias("src_label"), F.col("path").alias("src_key"), F.lit(label).alias("dst_label"), dst.alias("dst_key"),
            (null("int") if args is None else args).alias("args"), (null("string") if receiver is None else receiver).alias("receiver_type"), F.lit(label == "Symbol" and kind != "DEFINES").alias("unresolved"),
        )

    place = F.concat(F.lit("name::"), "name")
    edge = edges(s, "DEFINES", "Symbol", key).distinct().unionByName(edges(imports, "IMPORTS", "Module", F.col("name"))).unionByName(edges(calls, "CALLS", "Symbol", place, F.col("args"), F.col("receiver_type")))
    return node, edge.unionByName(edges(injects, "INJECTS", "Symbol", place)).unionByName(edges(refs, "REFERENCES", "Symbol", place))


def chunk_rows(read: DataFrame) -> DataFrame:
    """chunk_id, project, path, name, kind, start, end, generated, text: a chunk of every symbol, and one of every file without symbols.

    A file's chunk has its first WHOLE characters, behind its path.
    """
    whole = F.split("text", "\n")
    s = read.select("project", "path", "generated", F.explode("symbols").alias("s"), whole.alias("l"))
    snippet = F.array_join(F.expr("slice(l, s.start, greatest(s.end - s.start + 1, 1))"), "\n")
    symbols = ingest.symbol_chunks(s.select("project", "generated", "path", "s.name", "s.kind", "s.start", "s.end", snippet.alias("snippet")), ["project", "generated"])
    bare = read.where("size(symbols) = 0").select(
        chunk_id(F.col("path"), F.lit("file")).alias("chunk_id"), "project", "generated", "path", F.lit(None).cast("string").alias("name"), F.lit("file").alias("kind"), F.lit(1).alias("start"), F.size(whole).alias("end"),
        F.concat(F.lit("FILE "), "path", F.lit("\n"), F.substring("text", 1, ingest.WHOLE)).alias("text"),
    )
    return symbols.unionByName(bare)


def counters(read: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, files, files_generated, symbols, calls, chunks: what an ingest has seen, per project and in all (null)."""
    per = read.groupBy("project").agg(F.count("*").alias("files"), F.count_if("generated").alias("files_generated"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size("calls")).alias("calls"))
    both = per.join(chunks.groupBy("project").agg(F.count("*").alias("chunks")), "project", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    sums = ("files", "files_generated", "symbols", "calls", "chunks")
    return both.rollup("project").agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def apply_change(nodes: DataFrame, edges: DataFrame, changed: DataFrame, deleted: DataFrame, sha: str, ordinal: int, at: float) -> tuple[DataFrame, DataFrame]:
    """Lifecycle tables after a commit: changed (extracted files, read_files()) and deleted (project, file) files.

    What a changed or deleted file defined, and every edge that touches either, is tombstoned at this commit; what it defines
    now is upserted after, so that what is there again is alive again, with its first sighting kept.
    """
    new_nodes, new_edges = graph_rows(changed)
    gone = deleted.select("project", "file").unionByName(changed.select("project", F.col("path").alias("file"))).distinct()
    n, e = graph.delete_files(nodes, edges, gone, sha, ordinal, at)
    # Calls of unchanged files into a changed one stay alive if what they call is there again.
    back = new_nodes.where("label = 'Symbol' and unresolved is null").select("project", F.col("key").alias("dst_key")).distinct()
    mine = e.where(F.col("invalid_sha").eqNullSafe(sha)).join(gone.select("project", F.col("file").alias("src_key")), ["project", "src_key"], "left_anti").join(back, ["project", "dst_key"], "left_semi")
    again = mine.select(*graph.EDGE)
    e2 = graph.upsert(e, new_edges.select(*[c for c in new_edges.columns if c in e.columns]), graph.EDGE, sha, ordinal)
    return graph.upsert(n, new_nodes.select(*[c for c in new_nodes.columns if c in n.columns]), graph.NODE, sha, ordinal), graph.upsert(e2, again, graph.EDGE, sha, ordinal)
