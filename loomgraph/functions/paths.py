"""POSIX path functions on columns, without Python UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def extname(path: Column) -> Column:
    """The last dot and what follows; empty for names that only start with a dot."""
    return F.regexp_extract(basename(path), r"[^.]+.*(\.[^.]*)$|^\..*[^.](\.[^.]*)$", 1)


def normalise(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments; ``..`` beyond the root stays."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(last, F.lit("..")) != "..")
        return F.when((part == "") | (part == "."), done).when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def join(directory: Column, spec: Column) -> Column:
    return normalise(F.concat_ws("/", directory, spec))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first; the root, as the empty text, last."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    n = F.size(parts)
    up = F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(parts, F.lit(1), n - k), "/"))
    return F.when(n > 0, up).otherwise(F.array(F.lit("")))


def depth(path: Column) -> Column:
    """Number of directories above the name."""
    return F.size(F.split(path, "/")) - 1


def java_quote(text: str) -> str:
    """Text as a pattern that matches just itself, in Java and RE2."""
    return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", text)


def glob_pattern(globs: list[str]) -> str:
    """One anchored pattern for globs: ``**`` is anything, ``*`` anything but a slash; a match ends at a slash or the end."""
    one = (".*".join("[^/]*".join(java_quote(x) for x in part.split("*")) for part in g.split("**")) for g in globs)
    return "^(?:" + "|".join(one) + ")(?:/|$)"
