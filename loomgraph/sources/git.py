"""A git repository as DataFrames, through Python data sources: ``git_tracked``, ``git_commits``, ``git_commit_files`` and so on, and ``git_touched`` as a stream.

History is read in partitions of ``SPAN`` commits each, wherever every executor sees the repository's folder, and options for author, commit time and path
narrow what git looks at. Trees have a partition for each commit asked for, small tables one. Failures of git give no rows, as degraded input must lead to warnings and
not to a crash.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_MARK, _FIELD = "\x1e", "\x1f"


def git(root: str, *args: str) -> str:
    """Output of a git command, empty on any failure."""
    try:
        return subprocess.run(["git", "-c", "core.quotepath=off", "-C", root, *args], capture_output=True, check=True, timeout=600).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.SubprocessError):
        return ""


#: Commits of one partition.
SPAN = 1000


def _log(root: str, args: list[str], skip: int, most: int) -> Iterator[tuple[int, str, int, int, str, str, list[str]]]:
    form = _FIELD.join(("%H", "%at", "%ct", "%an", "%s"))
    text = git(root, "log", f"--skip={skip}", f"--max-count={most}", "--no-renames", "--name-only", "-z", f"--pretty=format:{_MARK}{form}{_FIELD}", *args)
    for k, part in enumerate(text.split(_MARK)[1:], skip):
        sha, authored, committed, author, subject, names = part.split(_FIELD, 5)
        yield k, sha, int(authored), int(committed), author, subject, [x for x in names.strip("\n\0").split("\0") if x]


def default_branch(root: str) -> str:
    """The upstream's main branch as a remote name; ``origin/main`` if the remote doesn't say."""
    return git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip() or "origin/main"


def _lines(text: str, end: str = "\n") -> list[str]:
    return [x for x in text.split(end) if x]


def _tracked(root: str, _: str) -> Iterator[tuple]:
    yield from enumerate(_lines(git(root, "ls-files", "-z"), "\0"))


def _commits(root: str, args: list[str], skip: int, most: int) -> Iterator[tuple]:
    yield from (row[:6] for row in _log(root, args, skip, most))


def _commit_files(root: str, args: list[str], skip: int, most: int) -> Iterator[tuple]:
    yield from ((row[1], name) for row in _log(root, args, skip, most) for name in row[6])


def _order(root: str, args: list[str], skip: int, most: int) -> Iterator[tuple]:
    yield from enumerate(_lines(git(root, "log", f"--skip={skip}", f"--max-count={most}", "--pretty=format:%H", *args)), skip)


def _added(root: str, args: list[str], skip: int, most: int) -> Iterator[tuple]:
    log = git(root, "log", f"--skip={skip}", f"--max-count={most}", "--no-renames", "--name-status", "-z", f"--pretty=format:{_MARK}%H{_FIELD}", *args)
    for part in log.split(_MARK)[1:]:
        sha, names = part.split(_FIELD, 1)
        codes = _lines(names.strip("\n\0"), "\0")
        yield from ((sha, path) for code, path in zip(codes[::2], codes[1::2], strict=True) if code.strip() == "A")


def _touched(root: str, args: list[str], skip: int, most: int) -> Iterator[tuple]:
    for _, sha, at, _, author, _, names in _log(root, args, skip, most):
        yield from ((sha, name, datetime.fromtimestamp(at, UTC), author) for name in names)


def _found(root: str, names: str) -> Iterator[tuple]:
    for name in names.split(","):
        if name and (full := git(root, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}").strip()):
            yield name, full


def _trees(root: str, sha: str) -> Iterator[tuple]:
    yield from ((sha, x) for x in _lines(git(root, "ls-tree", "-r", "--name-only", "-z", sha), "\0") if sha)


def _status(root: str, _: str) -> Iterator[tuple]:
    yield from ((line[:2], line[3:].strip('"')) for line in _lines(git(root, "status", "--porcelain")))


def _diffstat(root: str, _: str) -> Iterator[tuple]:
    for line in _lines(git(root, "diff", "--numstat", "--no-renames", "-z", "HEAD"), "\0"):
        more, less, path = line.split("\t", 2)
        yield path, int(more) if more.isdigit() else None, int(less) if less.isdigit() else None


def _ahead(root: str, _: str) -> Iterator[tuple]:
    for k, line in enumerate(_lines(git(root, "log", f"--pretty=format:%h{_FIELD}%s", f"{default_branch(root)}..HEAD"))):
        yield k, *line.split(_FIELD, 1)


def _branch_files(root: str, _: str) -> Iterator[tuple]:
    yield from ((x,) for x in _lines(git(root, "diff", "--name-only", "-z", f"{default_branch(root)}...HEAD"), "\0"))


#: Rows and schema of each table; ``since`` or the names asked for come in the second argument.
TABLES: dict[str, tuple[Callable[[str, str], Iterator[tuple]], str]] = {
    "tracked": (_tracked, "ord long, path string"),
    "found": (_found, "sha string, full string"),
    "trees": (_trees, "sha string, path string"),
    "status": (_status, "code string, path string"),
    "diffstat": (_diffstat, "path string, added long, deleted long"),
    "ahead": (_ahead, "ord long, sha string, subject string"),
    "branch_files": (_branch_files, "path string"),
}


#: The same of history, which is read in spans: rows of ``most`` commits beyond ``skip``, the schema, and how git is asked for the commits.
HISTORY: dict[str, tuple[Callable[[str, list[str], int, int], Iterator[tuple]], str, list[str]]] = {
    "commits": (_commits, "ord long, sha string, at long, committed_at long, author string, subject string", ["--no-merges"]),
    "commit_files": (_commit_files, "sha string, path string", ["--no-merges"]),
    "order": (_order, "ord long, sha string", []),
    "added": (_added, "sha string, path string", []),
    "touched": (_touched, "sha string, path string, at timestamp, author string", ["--no-merges"]),
}


def spans(root: str, args: list[str], span: int = SPAN) -> list[tuple[int, int]]:
    """``(skip, most)`` of the partitions of what ``git log`` shows with these arguments; one, empty, if that is nothing."""
    paths = args.index("--") if "--" in args else len(args)
    ends = [] if any(".." in x for x in args[:paths]) else ["HEAD"]
    n = git(root, "rev-list", "--count", *args[:paths], *ends, *args[paths:]).strip()
    return [(at, span) for at in range(0, int(n or 0), span)] or [(0, 0)]


class _Part(InputPartition):
    def __init__(self, asked: str, skip: int = 0, most: int = 0):
        self.asked, self.skip, self.most = asked, skip, most


class _Reader(DataSourceReader):
    """Reads a table. Options narrow the log of ``commits``, ``commit_files`` and ``touched``: ``author`` (part of a name or address), ``since`` and ``until`` in
    seconds of commit time, both included, and ``path``, a file or, with a slash behind it, a folder.

    They are options and not ``pushFilters``, because Spark 4.1.2 keeps what a filter pushed with the frame: a second scan of the same frame without that
    filter would miss rows.
    """

    def __init__(self, kind: str, options: dict[str, str]):
        self.kind, self.root, self.asked = kind, options["root"], options.get("asked", "")
        self.span = int(options.get("span", SPAN))
        self.args = [*HISTORY[kind][2], *([f"--since={self.asked}"] if self.asked else [])] if kind in HISTORY else []
        if author := options.get("author"):
            self.args += ["--fixed-strings", f"--author={author}"]
        self.args += [f"{flag}=@{options[name]}" for name, flag in (("since", "--since-as-filter"), ("until", "--until")) if options.get(name)]
        if path := options.get("path"):
            self.args += ["--full-history", "--", f":(top,literal){path}"]

    def partitions(self) -> list[InputPartition]:
        if self.kind in HISTORY:
            return [_Part(self.asked, *x) for x in spans(self.root, self.args, self.span)]
        return [_Part(x) for x in (self.asked.split(",") if self.kind == "trees" else [self.asked])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.kind in HISTORY:
            yield from HISTORY[self.kind][0](self.root, self.args, partition.skip, partition.most)
        else:
            yield from TABLES[self.kind][0](self.root, partition.asked)


class _Arrivals(DataSourceStreamReader):
    """Files touched by commits as they arrive. An offset is the head commit, so a trigger reads what the new head has and the last one hadn't, and a restart goes on from there."""

    def __init__(self, options: dict[str, str]):
        self.root, self.span = options["root"], int(options.get("span", SPAN))

    def initialOffset(self) -> dict:
        return {"head": ""}

    def latestOffset(self) -> dict:
        return {"head": git(self.root, "rev-parse", "--verify", "--quiet", "HEAD").strip()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["head"] == end["head"]:
            return []
        new = f"{start['head']}..{end['head']}" if start["head"] else end["head"]
        n = int(git(self.root, "rev-list", "--count", "--no-merges", new).strip() or 0)
        return [_Part(new, at, self.span) for at in range(0, n, self.span)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _touched(self.root, ["--no-merges", partition.asked], partition.skip, partition.most)


def _source(kind: str, schema: str) -> type[DataSource]:
    class Git(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"git_{kind}"

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(kind, dict(self.options))

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            if kind != "touched":
                raise NotImplementedError("only git_touched is a stream")
            return _Arrivals(dict(self.options))

    return Git


def register(spark: SparkSession) -> None:
    for kind, (_, schema, *_) in (TABLES | HISTORY).items():
        spark.dataSource.register(_source(kind, schema))


def read(spark: SparkSession, root: str, kind: str, asked: str | None = None, **narrow: str | int) -> DataFrame:
    """One of TABLES or HISTORY. ``asked`` is git's ``--since`` for history, and the names of commits, by commas, for found commits and trees; ``narrow`` are the reader's options."""
    register(spark)
    reader = spark.read.format(f"git_{kind}").option("root", root).option("asked", asked or "")
    return reader.options(**{k: str(v) for k, v in narrow.items()}).load()


def probe(root: str) -> dict[str, object]:
    """State of a repository: its top, branch, head, whether it is shallow, whose it is, and how it stands to its upstream."""
    top = git(root, "rev-parse", "--show-toplevel").strip()
    counts = git(root, "rev-list", "--left-right", "--count", "@{upstream}...HEAD").split()
    return {
        "top": top or None, "is_repo": bool(top), "head": git(root, "rev-parse", "HEAD").strip() or None, "branch": git(root, "rev-parse", "--abbrev-ref", "HEAD").strip() or None,
        "shallow": git(root, "rev-parse", "--is-shallow-repository").strip() == "true", "user": git(root, "config", "user.name").strip() or None,
        "behind": int(counts[0]) if len(counts) == 2 else None, "ahead": int(counts[1]) if len(counts) == 2 else None,
    }


def branches(root: str, most: int = 15) -> list[str]:
    return [x for x in git(root, "for-each-ref", "--sort=-committerdate", f"--count={most}", "--format=%(refname:short)", "refs/heads").split("\n") if x]


def merges(root: str, most: int = 20) -> list[tuple[str, str]]:
    """Merge commits, newest first, for repositories whose pull requests can't be asked for."""
    return [tuple(x.split(_FIELD, 1)) for x in git(root, "log", "--merges", f"-{most}", f"--pretty=format:%h{_FIELD}%s").split("\n") if _FIELD in x]  # type: ignore[misc]


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """``(sha, path, at, author)`` of commits as they arrive, each once, for the operators of ``streaming``."""
    register(spark)
    return spark.readStream.format("git_touched").option("root", root).load()
