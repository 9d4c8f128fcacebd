"""Import resolution as joins: candidates with priorities, scopes, ancestors and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, join

# The order in which suffixes are tried, the TypeScript twins of JavaScript names, Python's common standard modules.
SUFFIXES = tuple(" .ts .tsx .js .jsx .mjs .cjs .mts .vue .svelte .py".split(" "))
TWINS = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
PY_STDLIB = tuple(
    "os sys json re time datetime typing math random logging pathlib collections itertools functools subprocess threading asyncio dataclasses enum abc io csv uuid hashlib base64 copy traceback warnings shutil tempfile glob "
    "argparse unittest sqlite3 socket ssl urllib http email string textwrap decimal struct pickle inspect operator contextlib secrets statistics zipfile tarfile signal platform getpass queue heapq bisect array weakref gc types".split()
)


def candidate_paths(target: Column) -> Column:
    """All paths a target may stand for, best first: with each suffix, TypeScript twins, then index and package files inside it."""
    plain = [F.concat(target, F.lit(s)) for s in SUFFIXES]
    twins = [F.when(target.endswith(end), F.concat(F.substring(target, F.lit(1), F.length(target) - len(end)), F.lit(t))) for end, ts in TWINS.items() for t in ts]
    inside = F.when(target == "", F.lit("")).otherwise(F.concat(target, F.lit("/")))
    nested = [F.concat(inside, F.lit(stem + s)) for s in SUFFIXES[1:] for stem in ("index", "__init__")]
    return F.array(*plain, *twins, *nested)


def first_existing(wanted: DataFrame, files: DataFrame, key: str, candidates: str) -> DataFrame:
    """``(key, path)``: of each row's array of candidate paths the first that is a file. Rows without one are left out.

    Candidates are exploded with their place, joined with ``files(path)``, and reduced by ``min_by``, which combines before it shuffles.
    """
    tried = wanted.select(key, F.posexplode(candidates).alias("place", "path")).where("path IS NOT NULL")
    return tried.join(files.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "place").alias("path"))


def best_scope(specs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Deepest-scope prefix matches: ``(id, place, target)`` for ``specs(id, path, spec)`` and ``scopes(ord, scope, prefix, targets, bare)``.

    A scope applies to files under it; a bare scope to every specifier, others to those that start with the prefix. The scope is matched as
    one of the file's ancestor directories, so the join has an equality and no nested loop; ``place`` orders the targets by scope
    depth, the order of the configuration, and the target's own place.
    """
    own = specs.withColumn("scope", F.explode(ancestors(dirname(F.col("path")))))
    hit = own.join(scopes, "scope").where(F.col("bare") | F.col("spec").startswith(F.col("prefix")))
    rest = F.when(F.col("bare"), F.col("spec")).otherwise(F.expr("substring(spec, length(prefix) + 1)"))
    each = hit.select("id", "ord", "scope", rest.alias("rest"), F.posexplode("targets").alias("k", "target"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("scope")), "ord", "k"))
    return each.select("id", place.alias("place"), join(F.col("target"), F.col("rest")).alias("target"))


def workspace_targets(specs: DataFrame, packages: DataFrame) -> DataFrame:
    """``(id, target)``: specifiers that name a workspace package or a path in it; ``packages(name, dir, entry)``.

    The first one or two segments of the specifier are the key of an equality join. The package alone stands for its entry.
    """
    name = F.when(F.col("spec").startswith("@"), F.substring_index("spec", "/", 2)).otherwise(F.substring_index("spec", "/", 1))
    hit = specs.withColumn("name", name).join(packages, "name")
    inside = F.expr("substring(spec, length(name) + 2)")
    targets = F.when(F.col("spec") == F.col("name"), F.array(join(F.col("dir"), F.col("entry")), join(F.col("dir"), F.lit("src/index")), join(F.col("dir"), F.lit("index"))))
    return hit.select("id", targets.alias("of_package"), F.array(join(F.col("dir"), inside), join(F.col("dir"), F.concat(F.lit("src/"), inside))).alias("of_path")).select("id", F.coalesce("of_package", "of_path").alias("targets"))


def resolve_js(specs: DataFrame, files: DataFrame, packages: DataFrame, scopes: DataFrame) -> DataFrame:
    """``(id, dst)`` for ``specs(id, path, spec)``: relative, else workspace, else aliases; the first existing candidate wins."""
    relative = specs.where(F.col("spec").startswith(".")).select("id", F.array(join(dirname(F.col("path")), F.col("spec"))).alias("targets"), F.lit(0).alias("way"))
    bare = specs.where(~F.col("spec").startswith("."))
    workspace = workspace_targets(bare, packages).select("id", "targets", F.lit(1).alias("way"))
    aliases = best_scope(bare, scopes).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("targets")).select("id", "targets", F.lit(2).alias("way"))
    every = relative.unionByName(workspace).unionByName(aliases)
    tried = every.select("id", "way", F.posexplode("targets").alias("k", "target")).select("id", "way", "k", F.posexplode(candidate_paths(F.col("target"))).alias("place", "path")).where("path IS NOT NULL")
    hit = tried.join(files.select("path").distinct(), "path")
    return hit.groupBy("id").agg(F.min_by("path", F.struct("way", "k", "place")).alias("dst"))


def module_candidates(directory: Column, module: Column) -> Column:
    """A Python module under a directory: the package's own file before the module file."""
    path = join(directory, F.replace(module, F.lit("."), F.lit("/")))
    slash = F.when(path == "", F.lit("")).otherwise(F.concat(path, F.lit("/")))
    return F.array(F.concat(slash, F.lit("__init__.py")), F.when(path != "", F.concat(path, F.lit(".py"))))


def resolve_python(imports: DataFrame, files: DataFrame, blocked: DataFrame) -> DataFrame:
    """``(id, dst)`` for ``imports(id, path, level, module, names)``: base module and imported submodules.

    Relative levels climb from the file's directory; absolute modules are tried under every ancestor directory, nearest first. Absolute
    modules whose first part is in ``blocked(name)``, declared or standard ones, don't resolve, unless a directory of that
    name holds Python files.
    """
    here = dirname(F.col("path"))
    up = F.when(F.col("level") > 0, F.array(F.element_at(ancestors(here), F.least(F.col("level"), F.size(ancestors(here)))))).otherwise(ancestors(here))
    head = F.lower(F.substring_index("module", ".", 1))
    local = files.where(F.col("path").endswith(".py")).select(F.explode(ancestors(dirname(F.col("path")))).alias("dir")).select(F.lower(basename(F.col("dir"))).alias("name")).distinct()
    stop = blocked.select("name").distinct().join(local, "name", "left_anti")
    free = imports.withColumn("name", F.when(F.col("level") == 0, head)).join(stop, "name", "left_anti")
    wanted = F.concat(F.array("module"), F.transform("names", lambda x: F.when(F.col("module") == "", x).otherwise(F.concat_ws(".", "module", x))))
    each = free.withColumn("dirs", up).select("id", "dirs", F.posexplode(wanted).alias("part", "target"))
    each = each.select("id", "part", "target", F.posexplode("dirs").alias("far", "dir")).select("id", "part", "far", F.posexplode(module_candidates(F.col("dir"), F.col("target"))).alias("place", "path"))
    hit = each.where("path IS NOT NULL").join(files.select("path").distinct(), "path")
    return hit.groupBy("id", "part").agg(F.min_by("path", F.struct("far", "place")).alias("dst")).select("id", "dst").distinct()


def first_party(spec: Column, repo_dirs: Column, workspace: Column, declared: Column, repo_name: str) -> Column:
    """Whether an unresolved specifier is the repository's own: relative, a top directory, a workspace package, not declared, or the repository's name."""
    return F.when(spec.startswith("."), True).when(repo_dirs, True).when(workspace, True).when(declared, False).otherwise(F.substring_index(F.substring_index(spec, "/", 1), ".", 1) == repo_name)


def with_first_party(specs: DataFrame, folders: DataFrame, packages: DataFrame, declared: DataFrame, repo_name: str) -> DataFrame:
    """Adds ``own`` to ``(spec, ...)`` rows: ``first_party`` by joins of the specifier's head with ``(name)`` tables of top folders, workspace and declared packages.

    Folders and declared packages are looked up by the first segment or dotted part without a scope's sign, packages by the first two segments of a scoped
    name. Adds ``head`` as well, which names what didn't resolve.
    """
    scoped = F.when(F.col("spec").startswith("@"), F.substring_index("spec", "/", 2))
    first = F.regexp_extract("spec", "^@?([^./]*)", 1)
    rows = specs.withColumns({"_first": first, "_scoped": F.coalesce(scoped, F.substring_index("spec", "/", 1)), "_plain": F.coalesce(scoped, F.replace(F.lower(first), F.lit("-"), F.lit("_")))})
    for key, mark, names in (("_first", "_folder", folders), ("_scoped", "_package", packages), ("_plain", "_declared", declared)):
        rows = rows.join(names.select(F.col("name").alias(key)).distinct().withColumn(mark, F.lit(True)), key, "left")
    known = [F.coalesce(mark, F.lit(False)) for mark in ("_folder", "_package", "_declared")]
    head = F.coalesce(scoped, F.when(F.col("_first") != "", F.col("_first")).otherwise(F.col("spec")))
    rows = rows.withColumn("own", first_party(F.col("spec"), *known, repo_name)).withColumn("head", head)
    return rows.drop("_first", "_scoped", "_plain", "_folder", "_package", "_declared")


def heaviest(unresolved: DataFrame, most: int = 6) -> DataFrame:
    """``(head, n)``: what unresolved specifiers of one's own begin with most often."""
    return unresolved.where("own").groupBy("head").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "head").limit(most)


def edges(resolved: DataFrame) -> DataFrame:
    """``(src, dst, is_value, is_lazy, is_static)`` from ``(src, dst, is_type, is_lazy)``: one row per pair, without self-imports.

    A target imported both as type and as value counts as value; one imported both lazily and statically isn't static.
    """
    kept = resolved.where("src <> dst").groupBy("src", "dst").agg(F.bool_or(~F.col("is_type")).alias("is_value"), F.bool_or("is_lazy").alias("is_lazy"))
    return kept.withColumn("is_static", F.col("is_value") & ~F.col("is_lazy"))


def health(specs: DataFrame | GroupedData) -> DataFrame:
    """``(resolved, unresolved_own, external)`` of ``specs(resolved BOOLEAN, own BOOLEAN)``, one row for all or for each group."""
    return specs.agg(F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved") & F.col("own")).alias("unresolved_own"), F.count_if(~F.col("resolved") & ~F.col("own")).alias("external"))
