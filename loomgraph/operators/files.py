"""File filters, per-file features and the classifier of generated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import comments
from ..functions.paths import extname, glob_pattern

# The extensions of code, of code with decision points, and the directories that are never scanned.
CODE_EXT = tuple(".ts .tsx .js .jsx .mjs .cjs .mts .cts .vue .svelte .py .go .rb .rs .java .kt .swift .php .cs .c .h .cc .cpp .hpp .sql .html .css .scss".split())
LOGIC_EXT = tuple(".ts .tsx .js .jsx .mjs .cjs .mts .cts .vue .svelte .py .go .rb .rs .java .kt .swift .php .cs .c .h .cc .cpp .hpp".split())
SKIP_DIRS = tuple("node_modules dist build out .next .turbo vendor __pycache__ .venv coverage .git target Pods .loomgraph".split())
FULL_READ, HEAD_READ, MOST_FILES = 2 * 1024 * 1024, 512 * 1024, 20_000
DECISIONS_C = r"(?<![A-Za-z0-9_])(?:if|for|while|case|catch|switch)(?![A-Za-z0-9_])|&&|\|\||\?\?|\?\."
DECISIONS_PY = r"(?<![A-Za-z0-9_])(?:if|elif|else|for|while|except|with|and|or|assert)(?![A-Za-z0-9_])"


def skip_pattern() -> str:
    return "(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")(?:/|$)"


def scannable(paths: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """``(ord, path)`` rows of code files outside skipped directories, with ``excluded`` set where a user's glob removes them."""
    kept = paths.where(extname(F.col("path")).isin(*CODE_EXT) & ~F.col("path").rlike(skip_pattern()))
    return kept.withColumn("excluded", F.col("path").rlike(glob_pattern(exclude)) if exclude else F.lit(False))


def capped(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The first ``most`` rows by ``ord``: a top-k, which each task prunes on its own, not a window over all rows."""
    return files.orderBy("ord").limit(most)


def loc(text: Column) -> Column:
    """Lines that aren't blank and don't start with a comment mark."""
    lines = F.split(text, "\n")
    return F.size(F.filter(lines, lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*(?://|#|\*|/\*|--)")))


def max_depth(text: Column, most: int = 20) -> Column:
    """Deepest indentation of a line that isn't blank, two columns a level, a tab counting two."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    levels = F.transform(lines, lambda x: F.floor(F.length(F.replace(F.regexp_extract(x, r"^([ \t]*)", 1), F.lit("\t"), F.lit("  "))) / 2).cast("int"))
    return F.least(F.lit(most), F.coalesce(F.array_max(levels), F.lit(0)))


def decisions(text: Column, ext: Column, generated: Column | None = None) -> Column:
    """Branching words and signs by language; 0 for generated files and extensions without logic."""
    counted = F.when(ext == ".py", F.regexp_count(text, F.lit(DECISIONS_PY))).otherwise(F.regexp_count(text, F.lit(DECISIONS_C)))
    off = ~ext.isin(*LOGIC_EXT) if generated is None else ~ext.isin(*LOGIC_EXT) | generated.isNotNull()
    return F.when(off, F.lit(0)).otherwise(counted)


# What shows that a file is generated, by its path, its first four lines or its first 4000 characters, in the order in which it is tried.
GENERATED: list[tuple[str, str, str]] = [
    ("path", r"(?i)\.(?:min|bundle|chunk)\.(?:js|css)$", "minified"),
    ("path", r"(?i)(?:^|/)(?:vendor|vendored|polyfills?|third[_-]?party|generated|__generated__|node_modules|bower_components)/", "vendored"),
    ("path", r"(?i)(?:^|/)(?:dist|build|out|\.output|umd)/.*\.(?:js|mjs|cjs|css)$", "build-output"),
    ("top", r"(?im)^\s*(?://|#|/\*)\s*(?:@generated(?![A-Za-z0-9_])|AUTO-GENERATED|Code generated by|DO NOT EDIT(?![A-Za-z0-9_])[^\n]{0,20}$)", "generated"),
    ("head", r"//\s*#region\s+\x00?rolldown", "generated"),
    ("head", r"var\s+\w+\s*=\s*\(\s*\(\s*\)\s*=>\s*\{\s*var\s+__", "generated"),
    ("head", r"(?i)/\*!\s*(?:bundle|generated|For license information)", "generated"),
]


#: All rules of ``generated_reason`` that aren't in GENERATED.
TRACES = ("bundler", "long lines", "short names")


def generated_reason(path: Column, text: Column, traces: tuple[str, ...] = TRACES) -> Column:
    """Why a file counts as generated, or null; the first rule that holds decides: GENERATED, then those of ``traces``: bundler traces, very long lines, very short names.

    Short names tell code that was minified from code that wasn't; a text that isn't code can have them too, by repeating a word of one letter.
    """
    lines = F.greatest(F.lit(1), F.size(F.split(text, "\n")))
    parts = {"path": path, "head": F.substring(text, 1, 4000), "top": F.array_join(F.slice(F.split(text, "\n"), 1, 4), "\n")}
    names = F.regexp_count(parts["head"], F.lit(r"(?<![A-Za-z0-9_$])[A-Za-z_$][A-Za-z0-9_$]*"))
    single = F.regexp_count(parts["head"], F.lit(r"(?<![A-Za-z0-9_$])[A-Za-z_$](?![A-Za-z0-9_$])"))
    indented = F.regexp_count(text, F.lit(r"(?m)^[ \t]+\S"))
    rules = [(parts[part].rlike(pattern), reason) for part, pattern, reason in GENERATED]
    bundler = (F.regexp_count(text, F.lit("__webpack_require__")) > 3) | F.substring(text, -2000, 2000).contains("sourceMappingURL=data:application/json;base64")
    others = {
        "bundler": (bundler, "generated"),
        "long lines": (F.length(text) / lines > 300, "minified"),
        "short names": ((names > 200) & (single / F.greatest(F.lit(1), names) > 0.45) & (indented / lines < 0.2), "minified"),
    }
    rules += [others[t] for t in TRACES if t in traces]
    return F.coalesce(*[F.when(holds, reason) for holds, reason in rules])


def duplicate_artefacts(files: DataFrame, least_copies: int = 3, least_loc: int = 5) -> DataFrame:
    """Adds ``copies`` (files with the same hash and enough lines) and marks copied scripts and style sheets as generated.

    Counts come from a group-by with map-side combining and are joined back, so a hash that very many files share isn't gathered.
    """
    counts = files.where(F.col("loc") >= least_loc).groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    counts = counts.where(F.col("copies") >= least_copies)
    joined = files.join(counts, "hash", "left")
    eligible = F.col("copies").isNotNull() & (F.col("loc") >= least_loc)
    copied = eligible & F.col("ext").isin(".js", ".mjs", ".cjs", ".css")
    return joined.withColumn("copies", F.when(eligible, F.col("copies"))).withColumn("generated", F.coalesce("generated", F.when(copied, "duplicate")))


def features(files: DataFrame) -> DataFrame:
    """All per-file features of ``(path, content, ...)`` rows; clean texts are kept for the import and surface rules."""
    f = files.withColumn("ext", F.lower(extname(F.col("path"))))
    f = f.withColumn("nocomment", comments.clean_text("content", "ext")).withColumn("clean", comments.code_text("content", "ext"))
    f = f.withColumn("generated", generated_reason(F.col("path"), F.col("content"))).withColumn("loc", loc(F.col("content"))).withColumn("hash", F.sha1(F.col("content")))
    f = f.withColumn("complexity", decisions(F.col("clean"), F.col("ext"), F.col("generated"))).withColumn("max_depth", max_depth(F.col("content")))
    return duplicate_artefacts(f)


def rankable(files: DataFrame) -> DataFrame:
    return files.where((F.col("loc") > 0) & F.col("generated").isNull())
