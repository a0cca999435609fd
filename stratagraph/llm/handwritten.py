"""Source files that nobody on the project wrote by hand: tool output, minified scripts, third-party copies, data.

Two kinds of evidence. Merkle hashes of each project's directory tree, built bottom-up, mark what unrelated projects
share. Header and layout rules read each text once and keep only a few numbers of it, so that no text is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.runtime import cut, spread_join, spread

#: Unrelated projects that must hold the same subtree, and characters a file must have to count by itself.
MIN_PROJECTS, MIN_CHARS = 2, 120
#: Two projects that share more than this part of the smaller one's own contents are forks of each other and count as one.
FORK_SHARE = 0.5
#: Further holders of a content that a project is compared with at first, in order of name.
NEIGHBOURS = 8
#: Share of a file's characters that lie in dense, literal or enumerated lines, from which layout decides.
LAYOUT_SHARE = 0.6
#: Holders of a content that are compared at first in one task.
HOLDERS = 100_000

#: Directories that hold third-party packages by convention (fixed values).
VENDOR_DIRS = ("vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "external", "externals", "node_modules", "bower_components", "Packages", "packages", "deps", "site-packages")

#: Directories and names that generators give their output by convention (fixed values).
GENERATED_PATHS = r"(^|/)(__generated__|generated|gen|openapi-gen|swagger-gen)/|(_pb2(_grpc)?\.pyi?|\.(pb|g|generated|designer)\.[A-Za-z]+)$"

_COMMENT = re.compile(r"^\s*(//|#(?!include|define|if|endif|pragma)|/\*|\*|--|<!--|;|\"\"\"|''')")
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bmachine[- ](generated|written|made)\b|\b(written|made|produced) by (a |the )?(machine|tool|script|generator)\b|\bauto-?generated (file|code|by|from)\b|\bcode generated by\b"
    r"|\b(file|code|module|source|class) (was|is|has been) (automatically |auto-?)?(generated|produced|created) (by|from|with|using)\b"
    r"|^\W*(automatically )?generated (by|from|with|using)\b|\bbuilt from \S+( \S+)? with \S+.*\bregenerate\b|\bregenerate (it |this file )?instead of\b"
    r"|\b(manual|hand) (edit|change)s? (is|are|will be) (overwritten|lost)\b|\bchanges will be (lost|overwritten)\b"
    r"|\bautomatisch (erzeugt|generiert|erstellt)\b|\b(produit|généré|genere|créé) automatiquement\b|\bautomatiquement (produit|généré)\b"
    r"|\b(archivo|fichero|código) (generado|creado|producido)( automáticamente)? (por|con|a partir)\b|\bgenerado automáticamente\b",
    re.I,
)
_NOT_GENERATED = re.compile(r"\bused to be\b|\bno longer\b|\bformerly\b|\bby hand, edit\b|\bmaintained by hand\b|\bnot (auto-?)?generated\b|\b(writes|emits|prints|creates) \S+ files\b|\bevery \S+ starts\b", re.I)
_NAME = r"([A-Za-z][\w.@/-]*)"
_BANNER = re.compile(
    rf"@license\s+{_NAME}\s+v?\d+\.\d|^\W*{_NAME}\s+v?\d+\.\d[\w.-]*\s*\|\s*\(c\)|\bvendored from https?://\S+/{_NAME} at\b|^\W*{_NAME}\s+-\s+version\s+\d"
    rf"|^\W*{_NAME}\s+v?\d+\.\d[\w.-]*,\s+unmodified\b",
    re.I,
)
_ALTERED = re.compile(r"(?<!un)\b(modified|patched|adapted|altered|changed) (by|for|from|locally|copy)\b|\blocal (changes|modifications|patch)\b", re.I)
_LITERAL = re.compile(r"""0x[0-9a-fA-F]+|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|"[^"\s]*"|'[^'\s]*'|\b(?:null|None|true|false|True|False)\b|[\[\](){},:;+|\s]""")
_STRING = re.compile(r""""[^"]*"|'[^']*'""")
_FIELDS = re.compile(r"^[\w.+-]*([;,\t|][\w.+/-]*){2,}$")
_ASSIGN = re.compile(r"^\s*(?:(?:export|const|var|let|static|public|final)\s+)*[\w$.]+\s*=\s*")
_COUNTED = re.compile(r"^\s*[\w$.]*?_?(\d+)\b[^\d]*=\s*(\d+)\s*[;,]?$|^\s*\S+\s+\S+\s+(\d+)\s+of\s+\S+$")
_BASE64 = re.compile(r"^[\"']?[A-Za-z0-9+/=]{48,}[\"']?[\s+;,)]*$")


def is_data(line: str) -> bool:
    """A line of nothing but literals and their punctuation, or of delimited fields with a number among them."""
    rest = _ASSIGN.sub("", line).strip()
    if not rest:
        return False
    if _BASE64.match(rest) or rest in ("'''", '"""', "[", "(", "{", "]", ")", "}", "];", ");", "};"):
        return True
    if _FIELDS.match(rest):
        return any(c.isdigit() for c in rest)
    if len(rest) < 12:
        return False
    left = _LITERAL.sub("", rest)
    return len(left) <= 0.05 * len(rest)


def is_dense(line: str) -> bool:
    """A line as minifiers leave it: long beside its strings, almost without blanks, full of brackets and operators."""
    value = _ASSIGN.sub("", line)
    if value[:1] in ('"', "'") and value.count(value[0]) == 1:
        return False  # one long string that the text breaks off in
    line = _STRING.sub('""', line)
    if len(line) < 60:
        return False
    return sum(map(line.count, " \t")) < 0.08 * len(line) and sum(map(line.count, ";{}()=[]?:.,!|&")) > 0.1 * len(line)


def features(text: str, whole_file: bool) -> tuple:
    """generated, banner, chars, data, dense, counted (characters in such lines), comment lines and a hash of one text without its path line."""
    body = (text.split("\n", 1)[1] if "\n" in text else "") if text.startswith("FILE ") else text
    lines = body.replace("\r", "").split("\n")
    full = [x for x in lines if x.strip()]
    generated, banner = False, None
    if whole_file:
        head: list[str] = []
        for x in full:
            if _COMMENT.match(x) or (head and head[-1].lstrip().startswith("/*") and "*/" not in head[-1]) or x.strip().startswith("<?"):
                head.append(x)
            else:
                break
        generated = any(_GENERATED.search(x) and not _NOT_GENERATED.search(x) for x in head)
        if not any(_ALTERED.search(x) for x in head):
            found = next((m for x in head if (m := _BANNER.search(x))), None)
            banner = next((g for g in found.groups() if g), None) if found else None
    data = dense = counted = comments = 0
    before = None
    for x in full:
        comments += bool(_COMMENT.match(x))
        m = _COUNTED.match(x)
        if m:
            number = int(next(g for g in m.groups() if g))
            if before is not None and number - before in (0, 1):
                counted += len(x)
            before = number
        elif is_data(x):
            data += len(x)
        elif is_dense(x):
            dense += len(x)
    plain = "\n".join(" ".join(x.split()) for x in full)
    return generated, banner, sum(map(len, full)), data, dense, counted, comments, hashlib.md5(plain.encode("utf-8", "surrogatepass")).hexdigest()


_COLUMNS = ["generated", "banner", "chars", "data", "dense", "counted", "comments", "h"]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [features(t if isinstance(t, str) else "", bool(w)) for t, w in zip(pdf.text, pdf.is_file, strict=True)]
        out = pdf.drop(columns=["text"]).reset_index(drop=True)
        yield pd.concat([out, pd.DataFrame(found, columns=_COLUMNS).astype({"banner": object})], axis=1)


def file_features(chunks: DataFrame) -> DataFrame:
    """One row per (project, path): what header, layout and content of its current chunks say."""
    rows = chunks.select("project", F.col("file_path").alias("path"), "chunk_id", "indexed_at", (F.col("kind") == "file").alias("is_file"), "text").where("project is not null and path is not null")
    read = spread(rows).mapInPandas(_read, "project string, path string, chunk_id string, indexed_at timestamp_ntz, is_file boolean, generated boolean, banner string, chars long, data long, dense long, counted long, comments long, h string")
    current = read.groupBy("project", "path", "chunk_id").agg(F.max_by(F.struct("is_file", *_COLUMNS), F.struct("indexed_at", "h")).alias("c")).select("project", "path", "c.*")
    return current.groupBy("project", "path").agg(
        F.coalesce(F.bool_or("generated"), F.lit(False)).alias("generated"),
        F.max("banner").alias("banner"),
        F.sum("chars").alias("chars"), F.sum("data").alias("data"), F.sum("dense").alias("dense"), F.sum("counted").alias("counted"), F.sum("comments").alias("comments"),
        # The leaf's hash: all chunks of the file, in no order.
        F.concat_ws("-", F.count("*"), F.bit_xor(F.xxhash64("is_file", "h")), F.sum(F.xxhash64("h", F.lit(1)).cast("decimal(38,0)"))).alias("leaf"),
    )


def merkle_tree(files: DataFrame) -> DataFrame:
    """project, path, is_dir, hash, chars of every file and directory, bottom-up from (project, path, leaf, chars).

    A directory's hash is made of its children's names and hashes by sums that need no order, so no directory is ever
    collected into one task. One round per level of depth; the root ('') is included.
    """
    depth = F.size(F.split("path", "/"))
    leaves = cut(files.select("project", "path", F.col("leaf").alias("hash"), "chars", depth.alias("depth")))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    done = leaves.select("project", "path", F.lit(False).alias("is_dir"), "hash", "chars")
    level = None
    for d in range(deepest, 0, -1):
        here = leaves.where(F.col("depth") == d).select("project", "path", "hash", "chars")
        here = here if level is None else here.unionByName(level)
        name = F.element_at(F.split("path", "/"), -1)
        parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
        level = cut(here.select("project", parent.alias("path"), name.alias("name"), "hash", "chars").groupBy("project", "path").agg(
            F.concat_ws("-", F.lit("d"), F.count("*"), F.bit_xor(F.xxhash64("name", "hash")), F.sum(F.xxhash64("hash", "name", F.lit(1)).cast("decimal(38,0)"))).alias("hash"), F.sum("chars").alias("chars")
        ))
        done = done.unionByName(level.select("project", "path", F.lit(True).alias("is_dir"), "hash", "chars"))
    return done


def components(edges: DataFrame) -> DataFrame:
    """project, family of the ends of (project, other), which is given in both directions: the least project that edges lead to."""
    kin = cut(edges.groupBy("project").agg(F.least("project", F.min("other")).alias("family")))
    while True:
        seen = edges.join(kin.select(F.col("project").alias("other"), F.col("family").alias("f")), "other").groupBy("project").agg(F.min("f").alias("f"))
        new = cut(kin.join(seen, "project").select("project", F.least("family", "f").alias("family"), (F.col("f") < F.col("family")).alias("moved")))
        kin = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return kin


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("other").alias("project"), F.col("project").alias("other")))


def far_forks(held: DataFrame, size: DataFrame, kin: DataFrame) -> DataFrame | None:
    """project, other of all forks between two families of kin, whatever lies between them by name; None if there are none.

    held: project, hash, own of the contents that several projects hold. Only contents of two families can make such a pair, and
    only a project that has enough of them can be its smaller one. Of its contents it needs more than FORK_SHARE in common, so it
    shares at least one of the rarest that are left when one less than that is put aside: the holders of these are the
    candidates, and their common contents are counted.
    """
    known = spread_join(spread_join(held, size, ["project"], ["hash"]), kin, ["project"], ["hash"], "left")
    known = cut(known.select("project", "hash", "own", "owned", "total", F.coalesce("family", "project").alias("family"), (F.col("owned") == 0).alias("bare")))
    # Where one of two projects has no own contents all count, and all common ones are that project's.
    of_bare = cut(known.where("bare").select("hash").distinct())
    sets = known.where("own").select(F.lit("own").alias("of"), "project", "hash", F.col("owned").alias("size"), "family", "bare")
    sets = sets.unionByName(spread_join(known, of_bare, ["hash"], ["project"], "left_semi").select(F.lit("all").alias("of"), "project", "hash", F.col("total").alias("size"), "family", "bare"))
    apart = cut(sets.groupBy("of", "hash").agg(F.count("*").alias("holders"), F.min("family").alias("a"), F.max("family").alias("b")).where("a <> b").select("of", "hash", "holders"))
    sets = cut(spread_join(sets, apart, ["of", "hash"], ["project"]))
    need = F.floor(F.first("size") * FORK_SHARE) + 1
    small = cut(sets.groupBy("of", "project").agg(F.count("*").alias("common"), need.alias("need")).where("common >= need"))
    if not small.limit(1).count():
        return None
    mine = cut(spread_join(sets, small, ["of", "project"], ["hash"]))
    rare = F.row_number().over(W.partitionBy("of", "project").orderBy("holders", "hash"))
    rarest = cut(mine.withColumn("k", rare).where("k <= common - need + 1").select("of", "hash", "project", "need", F.col("size").alias("s"), F.col("family").alias("f"), F.col("bare").alias("b")))
    theirs = sets.select("of", "hash", F.col("project").alias("other"), "size", "family", "bare")
    pairs = spread_join(theirs, rarest, ["of", "hash"], ["other"]).where("family <> f and (of = 'own' or bare or b) and (s < size or (s = size and project < other))")
    pairs = cut(pairs.select("of", "project", "other", "need").distinct())
    asked = spread_join(pairs, mine.select("of", "project", "hash"), ["of", "project"], ["other"])
    others = cut(theirs.select("of", "other", "hash").join(pairs.select("of", "other").distinct(), ["of", "other"], "left_semi"))
    edges = cut(spread_join(asked, others, ["of", "other", "hash"], ["project"]).groupBy("of", "project", "other", "need").agg(F.count("*").alias("n")).where("n >= need").select("project", "other"))
    return edges if edges.limit(1).count() else None


def families(leaf: DataFrame, copied: DataFrame) -> DataFrame:
    """project, family of the projects with a fork among the others: forks of forks are one family, named by its first project.

    Two projects are forks if they share more than FORK_SHARE of the smaller one's own contents, which are those outside
    third-party directories (of all contents where one has no others). Holders of a content are first compared with the next
    NEIGHBOURS by name, contents with more than HOLDERS holders in so many parts: what is found so is a fork, and most of a
    family hangs together by its chain. far_forks() then finds all forks that are left between families, so that neither
    decides which families there are. copied: hash, projects, of the contents of several projects.
    """
    third = F.col("path").rlike("(^|/)(?:" + "|".join(map(re.escape, VENDOR_DIRS)) + ")/")
    held = cut(leaf.groupBy("project", "hash").agg(F.max(~third).alias("own")))
    size = cut(held.groupBy("project").agg(F.count_if("own").alias("owned"), F.count("*").alias("total")))
    w = W.partitionBy("hash", "share").orderBy("project")
    shares = copied.select("hash", F.ceil(F.col("projects") / HOLDERS).alias("shares"))
    shared = cut(spread_join(held, shares, ["hash"], ["project"]).withColumn("share", F.pmod(F.xxhash64("project"), F.col("shares"))))
    near = shared.select("project", "own", F.array(*[F.struct(F.lead("project", i).over(w).alias("other"), F.lead("own", i).over(w).alias("too")) for i in range(1, NEIGHBOURS + 1)]).alias("n"))
    near = near.select("project", "own", F.explode("n").alias("n")).where("n.other is not null")
    met = near.groupBy("project", F.col("n.other").alias("other")).agg(F.count_if(F.col("own") & F.col("n.too")).alias("own"), F.count("*").alias("all"))
    both = met.join(size, "project").join(size.select(F.col("project").alias("other"), F.col("owned").alias("owned_o"), F.col("total").alias("total_o")), "other")
    least = F.least("owned", "owned_o")
    forks = F.when(least > 0, F.col("own") > FORK_SHARE * least).otherwise(F.col("all") > FORK_SHARE * F.least("total", "total_o"))
    edges = cut(both_ways(both.where(forks).select("project", "other")))
    kin = components(edges)
    far = far_forks(shared.select("project", "hash", "own"), size, kin)
    return kin if far is None else components(cut(edges.unionByName(both_ways(far))))


def shared_files(files: DataFrame, min_projects: int = MIN_PROJECTS) -> DataFrame:
    """project, path of the files that lie in a subtree, or are one, that at least min_projects unrelated projects hold."""
    tree = cut(merkle_tree(files))
    holders = tree.where(F.col("chars") >= MIN_CHARS).groupBy("hash", "project").agg(F.count("*").alias("n"))
    copied = cut(holders.groupBy("hash").agg(F.count("*").alias("projects")).where(F.col("projects") >= min_projects))
    leaf = tree.where(~F.col("is_dir"))
    kin = families(leaf, copied)
    family = F.coalesce("family", "project")
    # A project has many files and a content many projects: each (content, family) once, and both joins salted.
    met = spread_join(spread_join(holders, copied, ["hash"], ["project"], "left_semi"), kin, ["project"], ["hash"], "left")
    unrelated = met.select("hash", family.alias("family")).distinct().groupBy("hash").agg(F.count("*").alias("projects")).where(F.col("projects") >= min_projects).select("hash")
    unrelated = cut(unrelated)
    marked = cut(spread_join(tree.where(F.col("chars") >= MIN_CHARS), unrelated, ["hash"], ["project", "path"], "left_semi").select("project", "path", "is_dir"))
    by_dir = leaf.where(F.col("chars") < MIN_CHARS).select("project", "path", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> substring_index(path, '/', i))")).alias("dir"))
    inside = by_dir.join(marked.where("is_dir").select("project", F.col("path").alias("dir")), ["project", "dir"], "left_semi").select("project", "path")
    return marked.where(~F.col("is_dir")).select("project", "path").unionByName(inside).distinct()


def not_handwritten(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """project, node_key, reason of the File nodes (of any snapshot) whose file nobody on the project wrote by hand.

    reason is the first that holds of: generated (a header says so, the file is an enumeration a tool wrote, or it lies where
    generators put their output and has not one line of comment in it, as only tools write), vendored
    (a third party's banner, a package's directory among third-party code, or a subtree that unrelated projects share),
    minified, data. Paths and notices alone decide nothing: 'generators/', '.min.js' or a copyright of the project's own
    are ignored, and a directory counts only below a conventional third-party directory and with the name of a package
    that some snapshot has as a Package node. Null texts are no evidence; null projects and paths are left out; of a
    chunk's versions the last indexed counts; empty tables give an empty result.
    """
    files = cut(file_features(chunks))
    # Name of the package directory below a third-party directory, without a version behind it.
    vendored_dir = F.regexp_extract("path", "(?:^|/)(?:" + "|".join(map(re.escape, VENDOR_DIRS)) + ")/([^/]+)/", 1)
    package = F.lower(F.regexp_replace(vendored_dir, r"[-.@_]?v?\d+(\.\d+)*$", ""))
    packages = nodes.where(F.col("label") == "Package").select(F.lower("node_key").alias("package")).where("package is not null").distinct().withColumn("known", F.lit(True))
    shared = shared_files(files).withColumn("shared", F.lit(True))
    # Only files below such a directory meet the packages, of which one may be everywhere.
    in_package = spread_join(files.select("project", "path", package.alias("package")).where("package <> ''"), packages, ["package"], ["project", "path"]).select("project", "path", "known")
    rows = files.join(in_package, ["project", "path"], "left").join(shared, ["project", "path"], "left")
    share = lambda c: F.col(c) >= LAYOUT_SHARE * F.col("chars")
    big = F.col("chars") >= MIN_CHARS
    bare = F.col("path").rlike(GENERATED_PATHS) & (F.col("comments") == 0) & (F.col("chars") > 0)
    reason = (
        F.when(F.col("generated") | (big & share("counted")) | bare, "generated")
        .when((F.col("banner").isNotNull() & (F.lower("banner") != F.lower("project"))) | F.col("known") | F.col("shared"), "vendored")
        .when(big & share("dense"), "minified")
        .when(big & share("data"), "data")
    )
    found = rows.withColumn("reason", reason).where("reason is not null").select("project", F.col("path").alias("node_key"), "reason")
    return found.join(nodes.where(F.col("label") == "File").select("project", "node_key").distinct(), ["project", "node_key"], "left_semi")
