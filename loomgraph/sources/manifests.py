"""Dependency manifests, package files and compiler configurations."""

from __future__ import annotations

import configparser
import posixpath
import re
import tomllib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.comments import read_jsonc
from ..plans.storage import written

NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def distribution(requirement: object) -> str | None:
    """The name a requirement starts with, as modules spell it: before extras, versions, markers and addresses; null for anything else."""
    text = str(requirement).strip()
    end = next((k for k, c in enumerate(text) if not (c.isascii() and c.isalnum()) and c not in "-_."), len(text))
    return text[:end].strip("-_.").replace("-", "_").lower() or None


def _distributions(requirements: Iterable[object]) -> set[str]:
    return {name for r in requirements if (name := distribution(r))}


def requirements_txt(path: str, text: str) -> tuple[set[str], set[str]]:
    """Names and included files of pip's format: logical lines of one requirement or one option each."""
    names: set[str] = set()
    includes: set[str] = set()
    for line in text.replace("\\\n", " ").splitlines():
        words = line.split(" #")[0].replace("=", " = ", 1).split() if line.lstrip().startswith("-") else line.split(" #")[0].split()
        if not words or words[0].startswith("#"):
            continue
        if words[0] in ("-r", "--requirement", "-c", "--constraint"):
            includes.update(posixpath.normpath(posixpath.join(posixpath.dirname(path), w)) for w in words[1:] if w != "=")
        elif words[0][:2] in ("-r", "-c") and words[0][2:]:
            includes.add(posixpath.normpath(posixpath.join(posixpath.dirname(path), words[0][2:])))
        elif not words[0].startswith("-"):
            names |= _distributions(words[:1])
    return names, includes


def toml_manifest(text: str) -> set[str]:
    """Names in the tables where project, Poetry, PDM and Pipenv files, dependency groups and build systems list them; broken files declare nothing."""
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return set()

    def at(*keys: str) -> object:
        value: object = found
        for k in keys:
            value = value.get(k) if isinstance(value, dict) else None
        return value

    listed = [at("project", "dependencies"), at("build-system", "requires")]
    tables = [at("packages"), at("dev-packages"), at("tool", "poetry", "dependencies"), at("tool", "poetry", "dev-dependencies")]
    for groups in (at("project", "optional-dependencies"), at("dependency-groups"), at("tool", "pdm", "dev-dependencies")):
        listed += groups.values() if isinstance(groups, dict) else []
    groups = at("tool", "poetry", "group")
    tables += [g.get("dependencies") for g in groups.values() if isinstance(g, dict)] if isinstance(groups, dict) else []
    names = {n for group in listed if isinstance(group, list) for n in _distributions(x for x in group if isinstance(x, str))}
    return names | {n for t in tables if isinstance(t, dict) for n in _distributions(t)} - {"python"}


def cfg_manifest(text: str) -> set[str]:
    """Names in the requirement options of setuptools' declarative file; broken files declare nothing."""
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    try:
        parser.read_string(text)
    except configparser.Error:
        return set()
    values = [parser.get("options", k, fallback="") for k in ("install_requires", "setup_requires", "tests_require")]
    values += parser["options.extras_require"].values() if parser.has_section("options.extras_require") else []
    return _distributions(line for v in values for line in v.replace(";", "\n").splitlines())


def manifest_names(path: str, text: str) -> tuple[set[str], set[str]]:
    """Declared names and included manifests of one file, by its dialect."""
    base = posixpath.basename(path)
    if base == "package.json":
        found = read_jsonc(text)
        if not isinstance(found, dict):
            return set(), set()
        keys = {k for s in NPM_SECTIONS if isinstance(found.get(s), dict) for k in found[s]}
        return keys | {k.removeprefix("@").split("/")[0] for k in keys}, set()
    if base in ("pyproject.toml", "Pipfile"):
        return toml_manifest(text), set()
    return (cfg_manifest(text), set()) if base == "setup.cfg" else requirements_txt(path, text)


def declared(texts: DataFrame, rounds: int = 50) -> DataFrame:
    """``(name)`` of all dependencies that the manifests among ``texts(path, content)`` declare, following includes.

    Each round reads the included files that no round has read; it ends when there are none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, i) for p, t in zip(b["path"], b["content"], strict=True) for names, inc in [manifest_names(p, t or "")] for n, i in [*((n, None) for n in names), *((None, i) for i in inc)]]
            yield pd.DataFrame(rows, columns=["path", "name", "include"])

    pattern = r"(?:^|/)(?:package\.json|constraints\.txt|pyproject\.toml|Pipfile|setup\.cfg|requirements[^/]*\.(?:txt|in)|requirements/[^/]+\.(?:txt|in))$"
    schema = "path string, name string, include string"
    found = texts.where(F.col("path").rlike(pattern)).mapInPandas(parse, schema)
    found = written(found, "manifests")
    names, read = found.select("name").where("name IS NOT NULL"), texts.where(F.col("path").rlike(pattern)).select("path")
    for _ in range(rounds):
        wanted = found.select(F.col("include").alias("path")).where("path IS NOT NULL").distinct().join(read, "path", "left_anti")
        if wanted.isEmpty():
            break
        found = written(texts.join(wanted, "path", "left_semi").mapInPandas(parse, schema), "manifests")
        names, read = names.unionByName(found.select("name").where("name IS NOT NULL")), read.unionByName(wanted)
    return names.distinct()


def collect_strings(value: object) -> Iterator[str]:
    """All strings of a nested value."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for v in value.values() if isinstance(value, dict) else value:
            yield from collect_strings(v)


def package_entries(text: str) -> set[str]:
    """Entry points of a package file: strings of exports, main, module and bin."""
    found = read_jsonc(text)
    return set(collect_strings({k: found.get(k) for k in ("exports", "main", "module", "bin")})) if isinstance(found, dict) else set()


def workspace_packages(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``(name, dir, entry)`` of named package files; the entry is source, module, main or index.js."""
    rows = []
    for path, text in texts.items():
        found = read_jsonc(text)
        if isinstance(found, dict) and isinstance(found.get("name"), str):
            entry = next((found[k] for k in ("source", "module", "main") if isinstance(found.get(k), str)), "index.js")
            rows.append((found["name"], posixpath.dirname(path), entry))
    return spark.createDataFrame(rows, "name string, dir string, entry string")


def path_aliases(spark: SparkSession, texts: dict[str, str], hops: int = 3) -> DataFrame:
    """``(ord, scope, prefix, targets, bare)`` from compiler configurations, shallow ones first, following relative extends and references."""
    rows: list[tuple[str, str, list[str], bool]] = []
    seen: set[str] = set()

    def load(path: str, scope: str, left: int) -> None:
        if (path, scope) in seen or path not in texts or left < 0:
            return
        seen.add((path, scope))  # type: ignore[arg-type]
        found = read_jsonc(texts[path])
        if not isinstance(found, dict):
            return
        here = posixpath.dirname(path)
        options = found.get("compilerOptions") if isinstance(found.get("compilerOptions"), dict) else {}
        base = posixpath.normpath(posixpath.join(here, options.get("baseUrl") or ".")).removeprefix("./")
        base = "" if base == "." else base
        for key, targets in (options.get("paths") or {}).items():
            rows.append((scope, key.split("*")[0], [posixpath.join(base, str(t).split("*")[0]) for t in targets], False))
        if options.get("baseUrl"):
            rows.append((scope, "", [base], True))
        nested = [found.get("extends"), *(r.get("path") for r in found.get("references") or [] if isinstance(r, dict))]
        for ref in (r for r in nested if isinstance(r, str) and r.startswith(".")):
            target = posixpath.normpath(posixpath.join(here, ref))
            options_ = [target, target + ".json", posixpath.join(target, "tsconfig.json")]
            load(next((t for t in options_ if t in texts), target), scope, left - 1)

    for path in sorted((p for p in texts if re.fullmatch(r"[tj]sconfig[^/]*\.json", posixpath.basename(p))), key=lambda p: (p.count("/"), p)):
        load(path, posixpath.dirname(path), hops)
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, scope string, prefix string, targets array<string>, bare boolean")


def package_scripts(packages: DataFrame, most: int = 20) -> DataFrame:
    """``(path, script, command)`` of package files ``(path, content)``, at most so many of each file, by name."""
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    entries = F.slice(F.sort_array(F.map_entries(scripts)), 1, most)
    return packages.select("path", F.explode(entries).alias("e")).select("path", F.col("e.key").alias("script"), F.col("e.value").alias("command"))
