"""Near-duplicate vectors by int8 tile products with rigorous error bounds and exact recomputation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, small_batches, written


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 with a scale each, and an upper bound of each one's quantisation error.

    ``x = scale * q + e`` with ``|e| <= error``; the bound is the error's true norm, raised by a margin for its own rounding.
    """
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - scale[:, None] * q) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return q, scale, error


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, step: int = 1024) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs with a cosine of at least ``threshold`` between unit vectors x and y, and how many needed full precision.

    ``x . y`` differs from the int8 product by at most ``|x| e_y + e_x |y| + e_x e_y``. Products of int8 are exact: in float32
    up to 1040 dimensions, in float64 beyond. Pairs whose bound stays below the threshold are out, all others are recomputed. With
    ``same`` only pairs i < j count.
    """
    qx, sx, ex = quantise(x)
    qy, sy, ey = quantise(y)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    right = qy.astype(kind).T
    found_i, found_j, recomputed = [], [], 0
    for at in range(0, len(x), step):
        top = (qx[at : at + step].astype(kind) @ right) * (sx[at : at + step, None] * sy) + (ey + ex[at : at + step, None] * (1 + ey)) + 1e-9
        i, j = np.nonzero(top >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        recomputed += len(i)
        for k in range(0, len(i), 1 << 17):
            a, b = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            keep = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            found_i.append(a[keep])
            found_j.append(b[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none), recomputed


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node that has links to the smallest node of its component: at most n - 1 of them."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    i = np.flatnonzero(root != np.arange(n))
    return i, root[i]


def near_vectors(rows: DataFrame, threshold: float = 0.93, tile: int = 2048) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``rows(vec_id, embedding, label)``.

    Rows are linked when their labels are equal and not null, they have as many components and the cosine in double precision is at
    least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing. n_links
    counts the other rows linked directly, copies included; component_id is the smallest vec_id reachable. Null
    vec_ids take part; repeated ids are rows of their own. Other columns are ignored.

    Equal vectors of a label are one class, so a vector that many rows hold costs one comparison. The classes of a label are dealt
    into blocks of about ``tile``, and every pair of blocks is one unit of work: int8 products, exact recomputation where the
    bound allows a link, then only the sums of links and a spanning forest come out. Work grows with the square of a
    label's distinct vectors, evenly cut into units; memory doesn't.
    """
    spark = rows.sparkSession
    small_batches(spark)
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    ok = ok & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    # -0.0 equals 0.0 as a component; the key of a class is the vector itself
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v).cast("double"))
    base = rows.select("vec_id", "label", F.when(F.coalesce(ok, F.lit(False)), plain).alias("v")).withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: x.cast("string"))), 256)))
    one = base.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    classes = written(one.select("*", F.size("v").alias("dims"), F.monotonically_increasing_id().alias("c")), "classes")
    counts = written(classes.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks")), "blocks")
    cut = classes.join(counts, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    units = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("label", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "copies", "v")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        x = np.stack(g["v"].to_numpy())
        x /= np.abs(x).max(1)[:, None]  # before the norm, so that neither large nor small components overflow
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        c, copies, block = g["c"].to_numpy(), g["copies"].to_numpy(), g["block"].to_numpy()
        left, right = (np.arange(len(g)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        a, b, _ = tile_links(x[left], x[right], threshold, i == j)
        a, b = left[a], right[b]
        links = np.bincount(a, copies[b], len(g)) + np.bincount(b, copies[a], len(g))
        child, parent = spanning(a, b, len(g))
        up = np.arange(len(g))
        up[child] = parent
        some = links > 0
        return pd.DataFrame({"c": c[some], "links": links[some].astype(np.int64), "up": c[up[some]]})

    found = written(units.groupBy("label", "dims", "i", "j").applyInPandas(work, "c long, links long, up long"), "links")
    roots = components(found.select(F.col("c").alias("a"), F.col("up").alias("b")))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    of_key = classes.select("key", "copies", "c").join(links, "c", "left").join(roots.select(F.col("id").alias("c"), "root"), "c", "left")
    of_key = of_key.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "c").alias("root"))
    members = written(base.select("vec_id", "key").join(of_key, "key", "left").select("vec_id", "n_links", "root"), "members")
    # written, so that both sides of the join are plain shuffles, which a component with very many members lets Spark split
    smallest = written(members.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least")), "smallest")
    discard(classes, counts, found, roots)
    out = members.join(smallest, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
