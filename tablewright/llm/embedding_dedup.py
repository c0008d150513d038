"""Operator 4, embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Unit vectors are rotated so that leading dimensions
hold the most. A grid over the leading axes, as wide as linked vectors can be apart, puts each class at home in
one cell; it visits those neighbouring cells, of each two only the later one, that lie within that distance of it. The larger
the labels, the more axes the grid has. A cell is compared in tiles: visitors with residents, and residents
with each other. A tile's products start with a few dimensions; a pair whose product so far plus the
product of its suffix norms is below the threshold is dropped, and so on by steps. What is left is
decided by the cosine of the vectors themselves. A tile returns counts and a forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import components, local_labels, written
from tablewright.llm.vectors import rotated, rotations, suffix_norms, usable

THRESHOLD = 0.98
#: Residents of a tile hold about so many components, or are so many at least; visitors, VISITORS times as many.
TILE_CELLS, LEAST_TILE, VISITORS, ROWS, STEPS = 1 << 18, 256, 4, 256, (8, 24)
#: Axes of the grid, and the bits of a place on one of them.
AXES, BITS = 6, 10
SLACK = 1e-9


def tile_links(one: np.ndarray, two: np.ndarray, turn, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one and two with a cosine of at least threshold; i < j if same."""
    n1, n2 = np.sqrt((one**2).sum(axis=1)), np.sqrt((two**2).sum(axis=1))
    r1, r2 = turn(one / n1[:, None]), turn(two / n2[:, None])
    steps = [s for s in STEPS if s < one.shape[1]]
    tails = [(suffix_norms(r1, s), suffix_norms(r2, s)) for s in steps]
    left, right = [], []
    for at in range(0, len(one), ROWS):
        rows = slice(at, at + ROWS)
        if steps:
            k = steps[0]
            reach = r1[rows, :k] @ r2[:, :k].T + np.outer(tails[0][0][rows], tails[0][1])
            i, j = np.nonzero(reach >= threshold - SLACK)
        else:
            i, j = (x.reshape(-1) for x in np.indices((len(one[rows]), len(two))))
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for s, (t1, t2) in zip(steps[1:], tails[1:], strict=True):
            ok = np.einsum("ij,ij->i", r1[i, :s], r2[j, :s]) + t1[i] * t2[j] >= threshold - SLACK
            i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", one[i], two[j]) / (n1[i] * n2[j]) >= threshold
        left.append(i[ok])
        right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


def _tile(basis: dict, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        ids, n = pdf["class"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        home = pdf["home"].to_numpy(bool)
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        turn = lambda x: rotated(x, basis)
        pairs = []
        if len(a) > 1 and pdf["share"].iloc[0] == 0:
            i, j = tile_links(vectors[a], vectors[a], turn, threshold, True)
            pairs.append((a[i], a[j]))
        if len(a) and len(b):
            i, j = tile_links(vectors[b], vectors[a], turn, threshold, False)
            pairs.append((b[i], a[j]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (a[:0], a[:0])
        links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
        label = local_labels(len(ids), i, j)
        hit = np.flatnonzero(links)
        return pd.DataFrame({"class": ids[hit], "root": ids[label[hit]], "links": links[hit].astype(np.int64)})

    return run


def _later(axes: int) -> list[tuple[int, ...]]:
    """Steps to the later one of each two neighbouring cells: the first part that is not 0 is 1."""
    return [s for s in product((-1, 0, 1), repeat=axes) if next((x for x in s if x), -1) == 1]


def visits(units: np.ndarray, reach: float, axes: int) -> tuple[np.ndarray, list[list[int]]]:
    """The cell of each unit vector, and the later neighbouring cells within reach of it, as numbers."""
    width = max(reach, 2.0 / ((1 << BITS) - 4))
    k = min(axes, units.shape[1])
    place = units[:, :k] / width
    cell = np.floor(place).astype(np.int64)
    number = np.zeros(len(units), np.int64)
    for i in range(k):
        number = (number << BITS) + cell[:, i] + (1 << (BITS - 1))
    low, steps = place - cell, _later(k)
    gap = {-1: low**2, 0: np.zeros_like(low), 1: (1 - low) ** 2}
    out: list[list[int]] = [[] for _ in range(len(units))]
    for step in steps:
        far = sum(gap[s][:, i] for i, s in enumerate(step))
        move = sum(s << (BITS * (k - 1 - i)) for i, s in enumerate(step))
        for r in np.flatnonzero(far <= (reach / width) ** 2 + 1e-9):
            out[r].append(int(number[r]) + move)
    return number, out


def _placed(basis: dict, reach: float, axes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part = part.reset_index(drop=True)
            cell, guests = np.zeros(len(part), np.int64), [[]] * len(part)
            for at in part.groupby("dim").indices.values():
                x = np.array(part["embedding"].iloc[at].tolist(), dtype=np.float64)
                x /= np.abs(x).max(axis=1)[:, None]
                cell[at], some = visits(rotated(x / np.sqrt((x**2).sum(axis=1))[:, None], basis), reach, axes)
                for r, v in zip(at, some, strict=True):
                    guests[r] = v
            yield part.assign(cell=cell, guests=pd.Series(guests, dtype=object))

    return run


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of table.

    table has vec_id, embedding and label; other columns are ignored. Rows link when their
    labels are equal and not null, their dimensions are equal, and their cosine is at least threshold.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: they are
    their own component and kept. A row with a null vec_id links with nothing either; its
    component is null and it is not kept. Rows that repeat vec_id, label and embedding are one vector, and each
    gets a result row; rows of one vec_id with different labels or embeddings are vectors of their own, each with
    its own links and component, and kept if that has no smaller vec_id. An empty table gives an empty result.
    """
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = rows.withColumn(
        "ok",
        usable(F.col("embedding"))
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)),
    )
    good = rows.filter("ok").drop("ok")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count_distinct("vec_id").alias("n"))
    classes = classes.withColumns({"class": F.monotonically_increasing_id(), "dim": F.size("embedding")})
    classes = written(classes, "vector-classes")
    basis = rotations(classes, "embedding")
    # Unit vectors with a cosine >= threshold are at most so far apart.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    most = classes.groupBy("label", "dim").count().agg(F.max("count"), F.max("dim")).first()
    tile = max(LEAST_TILE, TILE_CELLS // max(1, most[1] or 1))
    axes = min(AXES, max(1, math.ceil(math.log(max(1, (most[0] or 0) / tile), 4))))
    kind = f"{classes.select('class', 'label', 'dim', 'n', 'embedding')._jdf.schema().toDDL()}, cell long, guests array<long>"
    placed = classes.select("class", "label", "dim", "n", "embedding").mapInPandas(_placed(basis, reach, axes), kind)
    placed = written(placed, "vector-cells")
    keys = ["label", "dim", "cell"]
    homes = placed.groupBy(*keys).agg(F.count("*").alias("homes"))
    visitors = placed.select("label", "dim", F.explode("guests").alias("cell")).groupBy(*keys).agg(F.count("*").alias("visitors"))
    cells = homes.join(visitors, keys, "left").select(
        *keys,
        F.ceil(F.col("homes") / tile).cast("int").alias("tiles"),
        F.ceil((F.col("homes") + F.coalesce("visitors", F.lit(0))) / (VISITORS * tile)).cast("int").alias("shares"),
    )
    cells = written(cells, "vector-cell-sizes")
    mine = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    resident = placed.select("class", "n", "embedding", *keys).join(cells, keys).withColumn("mine", mine)
    own = F.struct(F.col("mine").alias("tile"), F.lit(True).alias("home"))
    rest = F.transform(F.slice(F.sequence(F.lit(0), F.col("tiles")), F.col("mine") + 2, F.col("tiles") - F.col("mine") - 1), lambda t: F.struct(t.alias("tile"), F.lit(False).alias("home")))
    resident = resident.withColumn("t", F.explode(F.concat(F.array(own), rest)))
    guest = placed.select("class", "n", "embedding", "label", "dim", F.explode("guests").alias("cell")).join(cells, keys)
    guest = guest.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(t.alias("tile"), F.lit(False).alias("home")))))
    columns = ["class", "n", "embedding", *keys, "t", "shares"]
    met = resident.select(*columns).unionByName(guest.select(*columns))
    # Residents go to every share of their tile's visitors, a visitor to one.
    share = F.when(F.col("t.home"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class", "cell"), F.col("shares")).cast("int")))
    dealt = met.select("class", "n", "embedding", *keys, "t.tile", "t.home", F.explode(share).alias("share"))
    found = dealt.groupBy(*keys, "tile", "share").applyInPandas(_tile(basis, threshold), "class long, root long, links long")
    found = written(found, "vector-links")
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), "class", "root")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "root").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
