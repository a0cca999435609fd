"""Resolving placeholder references to definitions, set-wise: all tiers from one join and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.runtime import salted_join

#: Extensions tried on an import path without one, in this order (fixed values).
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".py", ".cs", ".dart", ".php")


def placeholder_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, type, file, placeholder, name, arity (-1 if unknown or no call), receiver_type of live unresolved edges."""
    p = nodes.where("label = 'Symbol' and key like 'name::%'").select("project", "key", "name")
    e = edges.where("type in ('CALLS', 'INJECTS', 'REFERENCES') and src_label = 'File' and dst_label = 'Symbol' and invalid_sha is null and dst_key like 'name::%'")
    arity = F.when(F.col("type") == "CALLS", F.coalesce("args", F.lit(-1))).otherwise(-1)
    receiver = F.when(F.col("type") == "CALLS", F.col("receiver_type"))
    return e.select("project", "type", F.col("src_key").alias("file"), F.col("dst_key").alias("key"), arity.alias("arity"), receiver.alias("receiver_type")).join(p, ["project", "key"], "left").select("project", "type", "file", F.col("key").alias("placeholder"), "name", "arity", "receiver_type")


def definition_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, name, key, def_file, params of live resolved symbols with the file that defines them."""
    d = edges.where("type = 'DEFINES' and dst_label = 'Symbol' and invalid_sha is null").select("project", F.col("src_key").alias("def_file"), F.col("dst_key").alias("key"))
    s = nodes.where("label = 'Symbol' and unresolved is null and invalid_sha is null and name is not null").select("project", "key", "name", "params")
    return d.join(s, ["project", "key"])


def relative_imports(edges: DataFrame) -> DataFrame:
    """project, file, target of live imports of files."""
    return edges.where("type = 'IMPORTS' and dst_label = 'File' and invalid_sha is null").select("project", F.col("src_key").alias("file"), F.col("dst_key").alias("target"))


def _tier(candidates: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys..., {name}_n, {name}_key, {name}_fits: how many candidates there are, the least, and both again per number of parameters.

    candidates: keys..., key, params and times, how often each counts.
    """
    per = candidates.groupBy(*keys, "params").agg(F.sum("times").alias("n"), F.min("key").alias("key"))
    fits = F.map_from_entries(F.collect_list(F.when(F.col("params").isNotNull(), F.struct("params", F.struct("n", "key").alias("f")))))
    return per.groupBy(*keys).agg(F.sum("n").alias(f"{name}_n"), F.min("key").alias(f"{name}_key"), fits.alias(f"{name}_fits"))


def resolve(refs: DataFrame, defs: DataFrame, imports: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """project, type, file, placeholder, name, arity, tier, target, confidence, assembly.

    refs: placeholder_edges(), defs: definition_index(), imports: relative_imports(); types (project, file, type_name,
    type_key, assembly), optional: assembly_types(). Tiers, the first that decides: same_file (the least key, of those with
    the call's number of arguments if there are any), imported (several without a single arity match: ambiguous, and no later
    tier is tried), receiver (only files that define the receiver's type; falls through if not single), unique in the project
    (or ambiguous), assembly, external. Candidates reached by two imports count twice.

    Definitions are counted before references meet them, per name, per name and file, per importing file: a name with many
    definitions and many references is a row for each reference, never a product.
    """
    key = ["project", "type", "file", "placeholder", "name", "arity", "receiver_type"]
    r = refs.select(*key).distinct()
    d = defs.select("project", "name", "key", "def_file", "params", F.lit(1).alias("times"))
    asked = r.where("name is not null").select("project", "file", "name").distinct()
    # Imported: the definitions of an asked name in the files that the asking file imports.
    times = imports.groupBy("project", "file", F.col("target").alias("def_file")).agg(F.count("*").alias("m"))
    imported = asked.join(times, ["project", "file"]).join(d, ["project", "def_file", "name"]).select("project", "file", "name", "key", "params", F.col("m").alias("times"))
    # Receiver: the definitions of a name in the files that define the type it is called on.
    receivers = r.where("receiver_type is not null and name is not null").select("project", "receiver_type", "name").distinct()
    owners = d.select("project", F.col("name").alias("receiver_type"), "def_file").distinct()
    owned = receivers.join(owners, ["project", "receiver_type"]).join(d, ["project", "def_file", "name"]).select("project", "receiver_type", "name", "key", "params", "times")

    g = salted_join(r, _tier(d, ["project", "name"], "all"), ["project", "name"], ["file", "type", "arity"], "left")
    g = g.join(_tier(d.withColumnRenamed("def_file", "file"), ["project", "file", "name"], "same"), ["project", "file", "name"], "left")
    g = g.join(_tier(imported, ["project", "file", "name"], "imp"), ["project", "file", "name"], "left")
    g = salted_join(g, _tier(owned, ["project", "receiver_type", "name"], "own"), ["project", "receiver_type", "name"], ["file", "type", "arity"], "left")
    if types is not None:
        t = types.groupBy("project", "file", F.col("type_name").alias("name")).agg(F.count("*").alias("type_n"), F.min("type_key").alias("type_key"), F.min("assembly").alias("assembly"))
        g = g.join(t, ["project", "file", "name"], "left")
    else:
        g = g.selectExpr("*", "cast(null as bigint) as type_n", "cast(null as string) as type_key", "cast(null as string) as assembly")

    def fit(t: str, field: str):  # noqa: ANN202
        return F.when(F.col("arity") >= 0, F.try_element_at(f"{t}_fits", F.col("arity"))[field])

    def single(t: str):  # noqa: ANN202
        return F.when(F.col(f"{t}_n") == 1, F.col(f"{t}_key")).when(fit(t, "n") == 1, fit(t, "key"))

    nameless = F.col("name").isNull() | (F.col("name") == "")
    tier_name = (
        F.when(nameless, "external").when(F.col("same_n") > 0, "same_file")
        .when(F.col("imp_n") > 0, F.when(single("imp").isNotNull(), "imported").otherwise("ambiguous"))
        .when((F.col("own_n") > 0) & single("own").isNotNull(), "receiver")
        .when(F.col("all_n") > 0, F.when(single("all").isNotNull(), "unique").otherwise("ambiguous"))
        .when(F.col("type_n") == 1, "assembly").otherwise("external")
    )
    out = g.withColumn("tier", tier_name)
    target = (
        F.when(F.col("tier") == "same_file", F.coalesce(fit("same", "key"), "same_key")).when(F.col("tier") == "imported", single("imp")).when(F.col("tier") == "receiver", single("own"))
        .when(F.col("tier") == "unique", single("all")).when(F.col("tier") == "assembly", F.col("type_key"))
    )
    confidence = F.when(F.col("tier").isin("same_file", "imported", "receiver"), "high").when(F.col("tier") == "unique", "medium").when(F.col("tier") == "assembly", "external")
    via = F.when(F.col("tier") == "assembly", F.col("assembly"))
    return out.select("project", "type", "file", "placeholder", "name", "arity", "tier", target.alias("target"), confidence.alias("confidence"), via.alias("assembly"))


def assembly_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, file, type_name, type_key, assembly: the types that a file's own project can see through the assemblies it uses."""
    e = lambda t, src, dst: edges.where(F.col("type") == t).select("project", F.col("src_key").alias(src), F.col("dst_key").alias(dst)).distinct()
    # A file is in one project; of several the last by name counts.
    home = e("CONTAINED_IN", "file", "owner").groupBy("project", "file").agg(F.max("owner").alias("owner"))
    names = nodes.where("label = 'Type' and name is not null").select("project", F.col("key").alias("type_key"), F.col("name").alias("type_name"))
    exposed = e("EXPOSES_TYPE", "assembly", "type_key").join(names, ["project", "type_key"])
    seen = e("USES_ASSEMBLY", "owner", "assembly").join(exposed, ["project", "assembly"])
    return home.join(seen, ["project", "owner"]).select("project", "file", "type_name", "type_key", "assembly")


def rewrite(edges: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The edges after resolving: those to a resolved placeholder are replaced by edges to what it means.

    A new edge has confidence, resolved and via_assembly and no stamps; where there is one already, it keeps its own columns and
    gets these. Edges of which nothing is known stay as they are.
    """
    mine = ["project", "type", "src_label", "src_key", "dst_label", "dst_key"]
    done = resolutions.where("target is not null").select(
        "project", "type", F.lit("File").alias("src_label"), F.col("file").alias("src_key"), F.lit("Symbol").alias("dst_label"), F.col("placeholder").alias("dst_key"),
        F.struct(F.when(F.col("tier") == "assembly", "Type").otherwise("Symbol").alias("label"), F.col("target").alias("key"), "confidence", "assembly").alias("to"),
    )
    fresh = done.select("project", "type", "src_label", "src_key", F.col("to.label").alias("dst_label"), F.col("to.key").alias("dst_key"), F.col("to.confidence").alias("_c"), F.col("to.assembly").alias("_a"))
    fresh = fresh.groupBy(*mine).agg(F.min("_c").alias("_c"), F.min("_a").alias("_a"))
    df = edges if "via_assembly" in edges.columns else edges.withColumn("via_assembly", F.lit(None).cast("string"))
    both = df.join(done.select(*mine), mine, "left_anti").join(fresh, mine, "full_outer")
    new = {"confidence": F.coalesce("_c", "confidence"), "resolved": F.when(F.col("_c").isNotNull(), True).otherwise(F.col("resolved")), "via_assembly": F.coalesce("_a", "via_assembly")}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def orphan_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, key of live placeholders that no live call, injection or reference points to."""
    used = edges.where("type in ('CALLS', 'INJECTS', 'REFERENCES') and dst_label = 'Symbol' and invalid_sha is null").select("project", F.col("dst_key").alias("key")).distinct()
    return nodes.where("label = 'Symbol' and key like 'name::%' and invalid_sha is null").join(used, ["project", "key"], "left_anti").select("project", "key")


def import_aliases(nodes: DataFrame) -> DataFrame:
    """project, file, alias: names a live file can be imported by: its path, its name without extension, and dotted within a Python package.

    The dotted name begins at the outermost directory of an unbroken chain that has an __init__.py in each; a file outside of
    such a chain has none. The top of a project has no name, so the chain ends below it.
    """
    f = nodes.where("label = 'File' and invalid_sha is null").select("project", F.col("key").alias("file"), F.split("key", "/").alias("p"))
    stem = F.regexp_replace(F.element_at("p", -1), r"^(.+)\.[^.]*$", "$1")
    # Directories upwards from the file: their numbers, and which of them are packages.
    up = f.select("project", "file", F.expr("posexplode(transform(sequence(1, greatest(size(p) - 1, 1)), i -> array_join(slice(p, 1, greatest(size(p) - i, 0)), '/')))").alias("step", "dir")).where("dir <> ''")
    package = f.where(F.element_at("p", -1) == "__init__.py").select("project", F.expr("array_join(slice(p, 1, size(p) - 1), '/')").alias("dir"), F.lit(1).alias("is"))
    climbed = up.join(package, ["project", "dir"], "left").groupBy("project", "file").agg(F.coalesce(F.min(F.when(F.col("is").isNull(), F.col("step"))), F.max("step") + 1).alias("n"))
    dotted = F.when(F.col("n") > 0, F.concat_ws(".", F.slice("p", F.size("p") - F.col("n"), F.col("n")), stem))
    named = f.join(climbed, ["project", "file"], "left").select("project", "file", F.array_distinct(F.array_compact(F.array("file", stem, dotted))).alias("a"))
    return named.select("project", "file", F.explode("a").alias("alias"))


def alias_edges(resolved_imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """project, file, alias: further module names that a file imports: the aliases of what its relative imports mean, but for the text it wrote.

    resolved_imports: resolve_imports(); aliases: import_aliases().
    """
    met = resolved_imports.join(aliases.select("project", F.col("file").alias("target"), "alias"), ["project", "target"])
    return met.where("alias <> module").select("project", "file", "alias").distinct()


def containing(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """project, file, root: the longest of the project's root directories that contains a file, by equality on its ancestors."""
    up = paths.select("project", "file", F.explode(F.expr("transform(sequence(1, size(split(file, '/'))), i -> substring_index(file, '/', i))")).alias("root"))
    hit = up.join(roots.select("project", "root").distinct(), ["project", "root"])
    return hit.groupBy("project", "file").agg(F.max_by("root", F.length("root")).alias("root"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """project, file, module, target: the project's file that each relative import means; those that mean none are left out.

    imports: project, file, module; files: project, path. Python's leading dots climb one directory less than there are, and
    `a.b` means a/b.py or a/b/__init__.py. Paths ('./x', '../x') mean the exact file, then one with a suffix in order, then
    an index file. All candidates are exploded with their order, joined once, and the first that exists is taken.
    """
    from stratagraph.sources.trees import normal_path

    rel = imports.where(F.col("module").startswith("."))
    folder = F.regexp_extract("file", r"^(.*/)?[^/]*$", 1)
    python = F.col("file").endswith(".py") & ~F.col("module").contains("/")
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    base = normal_path(F.when(python, F.concat(folder, up, F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/")))).otherwise(F.concat(folder, "module")))
    tried = F.when(python, F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).otherwise(
        F.array(base, *[F.concat(base, F.lit(x)) for x in SUFFIXES], *[F.concat(base, F.lit("/index" + x)) for x in SUFFIXES])
    )
    spread = rel.select("project", "file", "module", F.posexplode(tried).alias("ordinal", "path"))
    return spread.join(files, ["project", "path"]).groupBy("project", "file", "module").agg(F.min_by("path", "ordinal").alias("target"))


def assembly_members(types: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """The public members of asked types: type_name, namespace, assembly, member, params, is_static; each signature once.

    types: type_name, namespace, assembly; members: type_name, namespace, assembly, member, params, is_static; asked:
    type_name, and namespace and assembly, of which null asks for any.
    """
    a = asked.select(F.col("type_name").alias("_t"), F.col("namespace").alias("_n"), F.col("assembly").alias("_a"))
    fits = (F.col("type_name") == F.col("_t")) & (F.col("_n").isNull() | (F.col("_n") == F.col("namespace"))) & (F.col("_a").isNull() | (F.col("_a") == F.col("assembly")))
    found = types.join(a, fits).select("type_name", "namespace", "assembly").distinct()
    return found.join(members, ["type_name", "namespace", "assembly"]).select("type_name", "namespace", "assembly", "member", "params", "is_static").distinct()
