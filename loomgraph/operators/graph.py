"""Graph operators: driver loops over DataFrames, whose rounds are written to the shared folder. No step gathers a graph, whatever its size."""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import counted, discard, shared_dir, written


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, fan_out, fan_in)`` from distinct ``edges(src, dst)``, summed up before anything is shuffled; nodes without edges are absent."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("end")
    return edges.select(ends).groupBy("end.id").agg(F.sum("end.out").alias("fan_out"), F.sum("end.into").alias("fan_in"))


def fan(edges: DataFrame) -> DataFrame:
    """``(id, fan_out, fan_in, imported_by)`` from distinct ``edges(src, dst)``: the degrees and every importer's name. For reports; ``degrees`` has the counts alone."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("imported_by"))
    return degrees(edges).join(into, "id", "left").select("id", "fan_out", "fan_in", F.coalesce("imported_by", F.array().cast(into.schema["imported_by"].dataType)).alias("imported_by"))


def _kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def _bucketed(links: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """A table in the shared folder, dealt into buckets by ``keys`` as a shuffle would deal them, so that joins on them leave it where it is."""
    spark = links.sparkSession
    name = f"loomgraph_links_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = links.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", posixpath.join(shared_dir(spark), name)).saveAsTable(name)
    return spark.table(name), name


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 30, stride: int = 6, most_links: int | None = None) -> DataFrame:
    """``(id, rank)``: fixed iterations from 1/n; dangling mass is spread evenly; edges from or to unknown nodes are ignored.

    An iteration is linear in the ranks, and what it adds to all nodes alike is one number. So only the powers of the link matrix applied to ones are computed,
    and their totals, one number each, give the coefficients of all powers on the driver; one last aggregation adds them up.

    Links lie in buckets by source. A power comes out of its aggregation dealt the same way, so an iteration shuffles its messages alone, combined by target before. ``stride``
    iterations are one job and one written table. A source with more than ``most_links`` links (a quarter of a bucket's share if unset, so
    there are few such sources) has them spread over buckets by a salt, and its value is sent to each.
    """
    spark = nodes.sparkSession
    ids = written(nodes.select("id").distinct(), "nodes")
    n = ids.count()
    known = edges.select("src", "dst").distinct()
    known = known.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    known = written(known, "known")
    degree = known.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    all_links, largest = degree.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
    most_links = most_links or max(1000, all_links // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(F.col("degree") / most_links).cast("int")
    hubs = degree.where(F.col("degree") > most_links).select(F.col("src").alias("id"), salts.alias("salts"))
    keys = ["src", "salt"] if largest > most_links else ["src"]
    weighed = known.join(degree, "src").select("src", "dst", (1 / F.col("degree")).alias("weight"), F.pmod(F.xxhash64("dst"), salts).cast("int").alias("salt"))
    links, name = _bucketed(weighed.select(*keys, "dst", "weight"), keys)
    links.written_to = posixpath.join(shared_dir(spark), name)
    whole = links.where("src IS NOT NULL AND dst IS NOT NULL")  # said at once, each power's shuffle is the same wherever it is read, and runs once
    power, powers = ids.withColumn("x", F.lit(1.0)), []
    spread = "(SELECT /*+ BROADCAST(h) */ q.id, x, explode(sequence(0, coalesce(salts, 1) - 1)) AS salt FROM p{0} q LEFT JOIN {{hubs}} h ON q.id = h.id)" if "salt" in keys else "p{0}"
    met = " AND ".join(["l.src = p.id", "l.salt = p.salt"][: len(keys)])
    for first in range(0, iterations, stride):
        last = min(first + stride, iterations)
        steps = [f"p{k + 1} AS (SELECT l.dst AS id, sum(p.x * l.weight) AS x FROM {{links}} l JOIN {spread.format(k)} p ON {met} GROUP BY l.dst)" for k in range(first, last)]
        union = " UNION ALL ".join(f"SELECT id, x, {k + 1} AS power FROM p{k + 1}" for k in range(first, last))
        used = {"links": whole, "power": power} | ({"hubs": hubs} if "salt" in keys else {})
        powers.append(written(spark.sql(f"WITH p{first} AS (SELECT id, x FROM {{power}}), {', '.join(steps)} {union}", **used), "powers"))
        power = powers[-1].where(F.col("power") == last).select("id", "x")
    every = reduce(DataFrame.unionByName, powers, ids.withColumns({"x": F.lit(1.0), "power": F.lit(0)}))
    total = {r["power"]: r["s"] for r in every.groupBy("power").agg(F.sum("x").alias("s")).collect()}
    part = [1.0 / max(1, n)]
    for _ in range(iterations):
        lost = 1 - sum(a * total.get(k + 1, 0.0) for k, a in enumerate(part))
        part = [(1 - damping + damping * lost) / max(1, n), *(damping * a for a in part)]
    of_power = F.element_at(F.array(*[F.lit(a) for a in part]), F.col("power") + 1)
    ranks = written(every.groupBy("id").agg(F.sum(of_power * F.col("x")).alias("rank")), "ranks")
    spark.sql(f"DROP TABLE {name}")
    discard(ids, known, links, *powers)
    return ranks


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """``(id, hops, via)``: the ``most`` smallest seeds of each id in ``rows(id, hops, seed)``. Every batch keeps its smallest ones only, so what is shuffled and gathered of an id doesn't grow with its rows."""

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f.drop_duplicates(["id", "seed"]).sort_values(["id", "seed"]).groupby("id", sort=False).head(most)

    parts = rows.mapInPandas(combined, rows.schema)
    return parts.groupBy("id").agg(F.min("hops").alias("hops"), F.slice(F.array_sort(F.collect_set("seed")), 1, most).alias("via"))


def hops(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most_seeds: int = 3) -> DataFrame:
    """``(id, hops, via)``: level of a breadth-first search from all seeds at once, null where unreachable, and at most three seeds that lead there.

    Seeds reach a node only through parents one level up; of several the smallest ids stay, so the result doesn't depend on
    any order of visits. A level is one join with the frontier, and the loop ends when the frontier is empty.
    """
    links = written(edges.select("src", "dst").distinct(), "links")
    front, left = counted(seeds.select("id").distinct().select("id", F.lit(0).alias("hops"), F.array("id").alias("via")), "front")
    seen = [front]
    while left:
        step = links.join(front.select(F.col("id").alias("src"), "hops", "via"), "src").join(reduce(DataFrame.unionByName, [s.select(F.col("id").alias("dst")) for s in seen]), "dst", "left_anti")
        each = step.select(F.col("dst").alias("id"), (F.col("hops") + 1).alias("hops"), F.explode("via").alias("seed"))
        front, left = counted(_smallest(each, most_seeds), "front")
        seen.append(front)
        if len(seen) > 16:
            old, seen = seen, [written(reduce(DataFrame.unionByName, seen), "seen")]
            front = seen[0].where(F.col("hops") == front.agg(F.max("hops")).first()[0])
            discard(*old)
    found = reduce(DataFrame.unionByName, seen)
    return nodes.select("id").distinct().join(found, "id", "left").select("id", "hops", F.coalesce("via", F.array().cast(front.schema["via"].dataType)).alias("via"))


def _tarjan(f: pd.DataFrame) -> pd.DataFrame:
    """Components of more than one node, without recursion."""
    after: dict = {}
    for a, b in zip(f["src"], f["dst"], strict=True):
        after.setdefault(a, []).append(b)
    number: dict = {}
    low: dict = {}
    path, on_path, rows = [], set(), []
    for start in after:
        work = [] if start in number else [(start, iter(after[start]))]
        while work:
            node, rest = work[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                path.append(node)
                on_path.add(node)
            for b in rest:
                if b not in number:
                    work.append((b, iter(after.get(b, ()))))
                    break
                if b in on_path:
                    low[node] = min(low[node], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(path.pop())
                    on_path.difference_update(members)
                    if len(members) > 1:
                        name = min(members)
                        rows += [(x, name) for x in members]
    return pd.DataFrame(rows, columns=["id", "component"])


def _contracted(live: DataFrame, chunks: int, turn: int) -> tuple[DataFrame, int, DataFrame]:
    """Edges after each task has merged the components among its own, how many are left, and ``(was, now)`` of every merged node.

    Edges are dealt by the unordered pair of their ends. Nodes that one task joins are in one component of the whole graph. A node joined in several tasks takes
    the smallest name, and names that belong together by then are tied by edges both ways, which the next turn merges.
    """
    kind = _kind(live, "src")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield _tarjan(pd.concat(parts, ignore_index=True))

    pair = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(turn))
    merged = written(live.repartition(chunks, pair).mapInPandas(merge, f"id {kind}, component {kind}"), "merged")
    names = written(merged.groupBy(F.col("id").alias("was")).agg(F.min("component").alias("now")), "names")

    def named(frame: DataFrame, column: str) -> DataFrame:
        return frame.join(names.withColumnRenamed("was", column), column, "left").withColumn(column, F.coalesce("now", column)).drop("now")

    ties = named(named(merged.select(F.col("id").alias("src"), F.col("component").alias("dst")), "src"), "dst")
    left = named(named(live, "src"), "dst").select("src", "dst").unionByName(ties.select("src", "dst")).unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out, n = counted(left.where("src <> dst").distinct(), "live")
    discard(merged)
    return out, n, names


def strong_components(edges: DataFrame, most: int = 500_000, least: int = 2_000) -> DataFrame:
    """``(id, component)`` of every node of a strongly connected component with more than one node; the component is its smallest id.

    First the graph is contracted by partitions: every task merges the components among its own edges, at most about ``most`` (and, as long as all
    cores have work, not fewer than ``least``), and passes the rest on under the merged names, until nothing shrinks. What is left then is taken apart by
    colouring: nodes without an edge in or out are trimmed away, the smallest reachable-from name is spread forward, and from every
    root the nodes of its colour that reach it backward make one component and leave the graph.
    """
    spark = edges.sparkSession
    live, left = counted(edges.where("src <> dst").select("src", "dst").distinct(), "live")
    names = written(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("name", F.col("id")), "names")
    turn, before = 0, None
    while left and (before is None or left < 0.8 * before):
        chunks = max(math.ceil(left / most), min(spark.sparkContext.defaultParallelism, math.ceil(left / least)))
        old, before, turn = (live, names), left, turn + 1
        live, left, moved = _contracted(live, chunks, turn)
        names = written(names.join(moved.withColumnRenamed("was", "name"), "name", "left").select("id", F.coalesce("now", "name").alias("name")), "names")
        discard(*old, moved)
        if chunks == 1:
            left = 0  # one task has seen all edges
    if left:
        coloured = _coloured(live, left)
        names = names.join(coloured.select(F.col("id").alias("name"), "component"), "name", "left").select("id", F.coalesce("component", "name").alias("name"))
    sizes = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component")).where("n > 1")
    return written(names.join(sizes, "name").select("id", "component"), "components")


def _coloured(live: DataFrame, left: int) -> DataFrame:
    """``(id, component)`` by colouring, single nodes included if they were not trimmed. Each round is one write, which counts what is left as well."""
    done = live.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    while left:
        before = None
        while left and left != before:
            inner = live.select(F.col("src").alias("id")).distinct().join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            before = left
            live, left = counted(live.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"), "live")
        if not left:
            break
        colour, moved = written(live.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")), "colour"), 1
        while moved:
            step = _spread(_spread(colour.withColumn("was", F.col("colour")), live), live)
            colour, moved = counted(step.select("id", "colour", "was"), "colour", F.col("colour") < F.col("was"))
            colour = colour.drop("was")
        same = written(live.join(colour.select(F.col("id").alias("src"), "colour"), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", "colour"), "same")
        reached, more = counted(colour.where("id = colour").select("id", "colour"), "reached")
        front = reached
        while more:
            back = same.join(front.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            front, more = counted(back.join(reached, ["id", "colour"], "left_anti"), "front")
            reached = written(reached.unionByName(front), "reached") if more else reached
        done = done.unionByName(reached.withColumnRenamed("colour", "component"))
        gone = reached.select("id")
        live, left = counted(live.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), "live")
    return done


def _spread(colour: DataFrame, live: DataFrame) -> DataFrame:
    """Colours after one step along the edges, the smallest winning."""
    sent = live.join(colour.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("got"))
    return colour.join(sent, "id", "left").select("id", F.least("colour", F.coalesce("got", "colour")).alias("colour"), "was")


def cycle_witnesses(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(component, cycle)``: for each component a shortest directed loop from its smallest member back to it, always the same one.

    A breadth-first search inside all components at once keeps each node's smallest parent; a component leaves it once a node of
    its frontier has an edge to the start. The loops are then read off the parents, backwards and all at once. Rounds are bounded by the longest loop.
    """
    member, other = components.select(F.col("id").alias("src"), "component"), components.select(F.col("id").alias("dst"), F.col("component").alias("other"))
    inside = written(edges.select("src", "dst").distinct().join(member, "src").join(other, "dst").where("component = other").select("src", "dst", "component"), "inside")
    front, left = counted(components.where("id = component").select("component", "id"), "front")
    parents = seen = None
    ends = components.select("component", F.col("id").alias("last")).limit(0)
    while left:
        seen = front if seen is None else written(seen.unionByName(front), "seen")
        step = inside.join(front.select("component", F.col("id").alias("src")), ["component", "src"])
        closed = written(step.where("dst = component").groupBy("component").agg(F.min("src").alias("last")), "closed")
        ends = ends.unionByName(closed)
        fresh = step.join(closed.select("component"), "component", "left_anti").join(seen.select("component", F.col("id").alias("dst")), ["component", "dst"], "left_anti")
        found, left = counted(fresh.groupBy("component", F.col("dst").alias("id")).agg(F.min("src").alias("parent")), "parents")
        parents = found if parents is None else parents.unionByName(found)
        front = found.select("component", "id")
    open_, left = counted(ends.select("component", F.col("last").alias("at"), F.array("last", "component").alias("cycle")), "loops")
    whole = open_.where("at = component").select("component", "cycle")
    while left and parents is not None:
        back = open_.where("at <> component").join(parents.select("component", F.col("id").alias("at"), "parent"), ["component", "at"])
        open_, left = counted(back.select("component", F.col("parent").alias("at"), F.concat(F.array("parent"), "cycle").alias("cycle")), "loops")
        whole = whole.unionByName(open_.where("at = component").select("component", "cycle"))
    return whole


def surface_paths(reached: DataFrame, edges: DataFrame, top: DataFrame) -> DataFrame:
    """``(via, id, hops, lazy)``: for each of ``top(id)`` that isn't a surface itself, its first surface and the way there.

    Lazy if the surface imports the file lazily, or the file imports anything lazily.
    """
    rows = reached.join(top.select("id"), "id", "left_semi").where((F.col("hops") > 0) & (F.size("via") > 0)).select("id", "hops", F.col("via")[0].alias("via")).distinct()
    lazy = edges.where("is_lazy")
    direct = lazy.select(F.col("src").alias("via"), F.col("dst").alias("id"), F.lit(True).alias("direct"))
    own = lazy.select(F.col("src").alias("id")).distinct().withColumn("own", F.lit(True))
    return rows.join(direct, ["via", "id"], "left").join(own, "id", "left").select("via", "id", "hops", F.coalesce("direct", "own", F.lit(False)).alias("lazy"))


def orphans(reached: DataFrame, degrees: DataFrame, tests: DataFrame) -> DataFrame:
    """``(id, only_tests)``: nodes no surface reaches and that aren't tests; with importers they are reached by tests only."""
    lost = reached.where("hops IS NULL").join(tests.select("id"), "id", "left_anti").select("id")
    return lost.join(degrees.select("id", "fan_in"), "id", "left").select("id", (F.coalesce("fan_in", F.lit(0)) > 0).alias("only_tests"))
