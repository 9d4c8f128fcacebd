"""Staleness of a document against its repository, and the redacted activity digest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.comments import strip_fences, strip_inline_code
from ..functions.redaction import redact
from ..operators import activity, files, staleness
from ..sources import git, manifests
from .scan import atomic_write, read_texts
from .storage import written


def document_sections(spark: SparkSession, text: str) -> tuple[DataFrame, int, bool]:
    """Sections of one document, the number of stamps that fences swallowed, and whether a fence never closes."""
    stripped, unclosed = strip_fences(text)
    clean = strip_inline_code(stripped)
    docs = spark.createDataFrame([("document", text, clean)], "doc string, raw string, content string")
    lost = staleness.swallowed(docs).first()
    return written(staleness.sections(docs), "sections"), int(lost["swallowed"]) if lost else 0, unclosed


def refresh(spark: SparkSession, root: str, text: str) -> dict[str, DataFrame]:
    """Stale and unverifiable sections, uncovered paths, and those of them added since the oldest stamp, of a document in a git repository.

    Stamps may hold abbreviated hashes and commits of any kind; git says which commits they name, and what files those had.
    """
    found, _, _ = document_sections(spark, text)
    names = ",".join(sorted({r["sha"] for r in found.select("sha").distinct().collect() if r["sha"].isalnum()}))  # those of one document
    full = git.read(spark, root, "found", names)
    order = written(git.read(spark, root, "order"), "order")
    changed = written(git.read(spark, root, "commit_files"), "changed")
    tracked = written(git.read(spark, root, "tracked").select("path"), "tracked")
    stamped = written(found.join(full, "sha", "left").withColumn("sha", F.coalesce("full", "sha")).select(found.columns), "stamped")
    trees = git.read(spark, root, "trees", ",".join(sorted({r["full"] for r in full.collect()})))
    bare = staleness.uncovered(files.scannable(tracked), stamped).select("path")
    added = git.read(spark, root, "added").join(order, "sha").groupBy("path").agg(F.min("ord").alias("ord"))
    return {
        "stale": staleness.stale(stamped, order, changed),
        "unverifiable": staleness.unverifiable(stamped, order, tracked, trees),
        "uncovered": bare,
        "added": staleness.added_since(bare, added, staleness.oldest_stamp(stamped, order)),
    }


def write_stale(result: dict[str, DataFrame], path: str, shown: int = 20, swallowed: int = 0, unclosed: bool = False) -> str:
    """``stale.md`` and a one-line notice. Lists of sections are as long as the document; of uncovered paths the first ``shown`` come to the driver, those
    added since the oldest stamp if there are any."""
    stale = result["stale"].orderBy("id").collect()
    unsure = result["unverifiable"].orderBy("id").collect()
    bare, fresh = result["uncovered"].count(), result["added"].count()
    listed = result["added"] if fresh else result["uncovered"]
    lines = ["# Stale sections", ""]
    lines += ["> A fence of the document never closes; what follows it was left out."] * unclosed + [f"> {swallowed} stamps lie inside fences or inline code and aren't checked."] * bool(swallowed)
    lines += [f"- {r['id']}: {', '.join(r['changed'])} ({', '.join(c[:7] for c in r['commits'])})" for r in stale] or ["Every section that can be checked is current."]
    lines += ["", "# Not verifiable", *(f"- {r['id']}: {r['why']}" for r in unsure), "", f"# Uncovered: {bare}, {fresh} of them added since the oldest stamp"]
    lines += [f"- {r['path']}" for r in listed.orderBy("path").limit(shown).collect()] + [f"- … and {n - shown} more" for n in [fresh or bare] if n > shown]
    atomic_write(path, "\n".join(lines) + "\n")
    return f"{len(stale)} stale, {len(unsure)} unverifiable, {bare} uncovered"


# How many rows each list of the activity digest has.
DIRTY, DIFFSTAT, AHEAD, BRANCH_FILES, COMMITS, OPEN, MERGED, DETAILED, OF_REQUEST, MISSING = 40, 25, 30, 40, 30, 15, 20, 5, 12, 12


def _requests(requests: DataFrame, files_of: DataFrame, tracked: DataFrame, behind: int) -> list[str]:
    """Lines on pull requests ``(id, title, author, state, at, body)`` and their files ``(id, path, added, deleted)``."""
    new = lambda state, n: requests.where(F.col("state") == state).orderBy(F.desc("at"), "id").limit(n)
    lines = ["", "## Open requests", *(f"- #{r['id']} {r['title']} ({r['author']}, {r['at']})" for r in new("open", OPEN).collect())]
    lines += ["", "## Merged requests", *(f"- #{r['id']} {r['title']} ({r['author']}, {r['at']})" for r in new("merged", MERGED).collect())]
    newest = new("merged", DETAILED).select("id", "title", "body").collect()
    of = files_of.join(F.broadcast(new("merged", DETAILED).select("id")), "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    by_id: dict = {}
    for r in of.withColumn("place", place).where(F.col("place") <= OF_REQUEST).orderBy("id", "path").collect():
        by_id.setdefault(r["id"], []).append(f"  - {r['path']} (+{r['added']}/-{r['deleted']})")
    for r in newest:
        why = [f"  > {x}" for x in (r["body"] or "").split("\n") if x.strip()][:OF_REQUEST]
        lines += ["", f"### #{r['id']} {r['title']}", *by_id.get(r["id"], []), *why]
    if behind:
        merged = requests.where("state = 'merged'").select("id", "at").join(files_of.select("id", "path"), "id")
        gone = staleness.missing_files(merged, tracked).orderBy("path").limit(MISSING).collect()
        lines += ["", "## Changed by the newest merged requests, but not in this checkout", *(f"- {r['path']}" for r in gone)] if gone else []
    return lines


def recon(spark: SparkSession, root: str, since: str = "90 days ago", author: str | None = None, requests: DataFrame | None = None, request_files: DataFrame | None = None) -> str:
    """The activity digest of a repository, redacted before anything is written; raises if it is empty.

    Pull requests come as tables ``requests(id, title, author, state, at, body)`` and ``request_files(id, path, added, deleted)`` from whatever service holds
    them; without them merge commits stand in. Every list is cut to its length before it comes to the driver.
    """
    state = git.probe(root)
    commits, changed = git.read(spark, root, "commits", since), git.read(spark, root, "commit_files", since)
    tracked = written(git.read(spark, root, "tracked"), "tracked")
    who = author or state["user"] or next((r["author"] for r in activity.most_active_author(commits).collect()), "")
    mine = commits.where(F.col("author").rlike(activity.author_pattern(str(who)))) if who else commits
    lines = [f"# {os.path.basename(str(state['top'] or root))}", f"branch {state['branch']}, author {who}, ahead {state['ahead']}, behind {state['behind']}"]
    if state["behind"]:
        lines += ["", f"> This checkout is {state['behind']} commits behind its upstream; newer work is not in it."]
    dirty = git.read(spark, root, "status")
    status = dirty.limit(DIRTY).collect()
    noise = " (lock files and build output only)" if status and activity.without_noise(dirty).isEmpty() else ""
    lines += ["", f"## Uncommitted{noise}", *(f"- {r['code'].strip()} {r['path']}" for r in status)]
    lines += [f"- {r['path']} +{r['added']} -{r['deleted']}" for r in git.read(spark, root, "diffstat").orderBy("path").limit(DIFFSTAT).collect()]
    lines += ["", "## On this branch only", *(f"- {r['sha']} {r['subject']}" for r in git.read(spark, root, "ahead").orderBy("ord").limit(AHEAD).collect())]
    lines += [f"- {r['path']}" for r in git.read(spark, root, "branch_files").orderBy("path").limit(BRANCH_FILES).collect()]
    lines += ["", "## Touched most", *(f"- {r['path']} ({r['n']})" for r in activity.touched_most(changed.join(mine.select("sha"), "sha", "left_semi")).collect())]
    recent = mine.orderBy("ord").limit(COMMITS).select("sha", "subject", activity.iso_date(F.col("at")).alias("day"))
    lines += ["", "## Commits", *(f"- {r['day']} {r['sha'][:7]} {r['subject']}" for r in recent.collect())]
    lines += ["", "## Branches", *(f"- {b}" for b in git.branches(root))]
    if requests is not None and request_files is not None:
        lines += _requests(requests, request_files, tracked, int(state["behind"] or 0))
    else:
        lines += ["", "## Merges", *(f"- {a} {b}" for a, b in git.merges(root))]
    texts = read_texts(tracked.where(F.col("path").rlike(r"\.md$|^package\.json$")), root)
    lines += ["", "## Documents", *(f"- {r['path']}: {r['heading'] or 'no heading'}" for r in staleness.first_heading(texts).collect())]
    lines += ["", "## Scripts", *(f"- {r['script']}: {r['command']}" for r in manifests.package_scripts(texts.where("path = 'package.json'")).orderBy("script").collect())]
    text = spark.createDataFrame([("\n".join(lines),)], "text string").select(redact(F.col("text")).alias("text")).first()["text"]
    if not text.strip() or not state["is_repo"]:
        raise RuntimeError("nothing to report: not a git repository, or git failed")
    return text


def write_recon(spark: SparkSession, root: str, path: str, **options) -> None:
    """``recon.md``; no file is written when there is nothing to say."""
    atomic_write(path, recon(spark, root, **options))
