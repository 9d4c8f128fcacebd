"""Import statements of JavaScript-like and Python files, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_NAME = "(?<![A-Za-z0-9_$.])", "(?![A-Za-z0-9_$])"
#: Cuts a text before every word that may begin an import; each piece then holds one statement at its start.
_JS_CUT = _NO_NAME[0] + "(?=(?:import|export|require)" + _NO_NAME[1] + ")"
_PY_CUT = r"(?m)^[ \t]*(?=(?:from|import)[ \t])"
_STRING = r"""["']([^"']+)["']"""
#: The braces of a statement's list: names in them may be strings.
_LIST = r"(?s)^((?:import|export)(?:\s+type)?(?:\s+[A-Za-z_$][A-Za-z0-9_$]*\s*,)?\s*)\{[^}]*\}"


def js_imports(files: DataFrame) -> DataFrame:
    """``(path, spec, is_type, is_lazy)`` for every import, export-from, require and dynamic import of ``(path, nocomment)`` rows.

    The text is cut before each word that may begin one; the specifier is the piece's first string, if nothing but a bracket, or a list that ends in
    ``from``, stands before it. Lists may be of any length, and of strings. Type-only if the statement says ``type`` next; lazy if it is a call of ``import``.
    """
    pieces = files.select("path", F.explode(F.split("nocomment", _JS_CUT)).alias("piece")).withColumn("piece", F.regexp_replace("piece", _LIST, "$1{}"))
    before = F.regexp_extract("piece", r"""^([^"']*)["']""", 1)  # all up to the first string
    lead, rest = F.regexp_extract(before, "^([a-z]+)", 1), F.regexp_extract(before, r"(?s)^[a-z]+\s*(.*?)\s*$", 1)
    call = (rest == "(") & lead.isin("import", "require")
    whole = pieces.where(lead.isin("import", "export", "require")).select("path", lead.alias("lead"), rest.alias("rest"), call.alias("call"), F.regexp_extract("piece", r"^[^\"']*" + _STRING, 1).alias("spec"))
    listed = (F.col("lead") != "require") & F.col("rest").rlike("(?:^|[^A-Za-z0-9_$])from$")
    plain = (F.col("lead") == "import") & (F.col("rest") == "")
    kept = whole.where((F.col("spec") != "") & (F.col("call") | listed | plain))
    return kept.select("path", "spec", (~F.col("call") & F.col("rest").rlike(r"^type(?![A-Za-z0-9_$])")).alias("is_type"), (F.col("call") & (F.col("lead") == "import")).alias("is_lazy"))


def python_imports(files: DataFrame) -> DataFrame:
    """``(path, level, module, names)``: relative level by dots, dotted module (may be empty), imported names without aliases.

    The text is cut at lines that begin with one of the two words; a list goes to its closing bracket, or to the end of a line that isn't continued.
    """
    pieces = files.select("path", F.explode(F.split("nocomment", _PY_CUT)).alias("piece"))
    two = F.split(F.regexp_replace("piece", r"^from[ \t]+", ""), r"[ \t]+import(?=[ \t(*])", 2)
    source, listed = F.trim(F.translate(two[0], "\t", " ")), F.ltrim(F.translate(two[1], "\t", " "))
    line = lambda c: F.regexp_extract(F.replace(c, F.lit("\\\n"), F.lit(" ")), "^([^\n;#]*)", 1)
    names = F.when(listed.startswith("("), F.regexp_extract(listed, r"^\(([^)]*)", 1)).otherwise(line(listed))
    module = F.ltrim(F.regexp_replace(source, "^[. ]+", ""))
    dots = F.length(F.regexp_replace(F.regexp_extract(source, "^([. ]*)", 1), " ", ""))
    good = F.col("piece").startswith("from") & (F.size(two) == 2) & source.rlike(r"^[. ]*(?:[A-Za-z_][A-Za-z0-9_.]*)?$") & (source != "")
    first = pieces.where(good).select("path", dots.alias("level"), module.alias("module"), import_names(names).alias("names"))
    plain = pieces.where(F.col("piece").startswith("import")).select("path", F.explode(import_names(line(F.expr("substring(piece, 7)")))).alias("module"))
    return first.unionByName(plain.select("path", F.lit(0).alias("level"), "module", F.array().cast("array<string>").alias("names")))


def import_names(listed: Column) -> Column:
    """Names of a comma-separated import list, without brackets, aliases and the star."""
    parts = F.split(F.translate(listed, "()\t\n\r\\", "      "), ",")
    names = F.transform(parts, lambda x: F.regexp_extract(F.trim(x), r"^([A-Za-z_][A-Za-z0-9_.]*)", 1))
    return F.filter(names, lambda x: x != "")


def package_key(spec: Column) -> Column:
    """The package a bare specifier names: two segments if scoped, else one; null for built-in modules."""
    scoped = F.substring_index(spec, "/", 2)
    return F.when(~spec.startswith("node:"), F.when(spec.startswith("@"), scoped).otherwise(F.substring_index(spec, "/", 1)))


def external_counts(specs: DataFrame, most: int = 25) -> DataFrame:
    """``(package, n)``: the most imported packages of unresolved ``(spec)`` rows."""
    keyed = specs.select(package_key(F.col("spec")).alias("package")).where("package IS NOT NULL")
    return keyed.groupBy("package").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "package").limit(most)
