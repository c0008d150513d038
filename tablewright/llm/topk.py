"""Operator 5, exact top-k search on norm-sorted inner products.

Components become floor(SCALE * x). Candidates are dealt into slices by length. Every query starts with the k-th
best score it has among the longest candidates; by Cauchy-Schwarz it needs only those slices whose
longest candidate can reach that score, and is sent to no other. Queries that need equally long candidates are in one
block, so that a slice goes only to the blocks with a query for it. Within a block, runs of candidates come by falling length: by
Cauchy-Schwarz a run ends a query's work when even its longest candidate cannot reach the k-th score;
else a partial product over LEAD rotated dimensions plus the product of the residual lengths selects the
candidates whose integer product is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm.shared import written
from tablewright.llm.vectors import rotated, rotations, suffix_norms, usable

SCALE, TOP = 1024, 10
SEEDS, QUERY_BLOCK, BLOCK, RUN, LEAD = 2048, 16384, 4096, 1024, 16
#: Slices of length, of BLOCK candidates or more; each is split by hash into parts of PART candidates.
SLICES, PART = 64, 32768
#: Blocks of queries by the length that they need; each is split by hash where it holds more than QUERY_BLOCK.
BANDS = 64
#: Rounding that a bound allows for, as a share of it.
SLACK = 1e-9
#: In place of a null id, so that it comes last.
UNKNOWN = (1 << 63) - 1


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise integer products; 64-bit integers where doubles would round."""
    if len(q) and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= 2.0**53:
        return (q.astype(np.int64) * c.astype(np.int64)).sum(axis=1)
    return np.einsum("ij,ij->i", q, c).astype(np.int64)


class Best:
    """The k best candidates of each query, as places in the candidates: larger scores, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.astype(np.float64)
        self.query = self.place = self.vec = self.score = np.empty(0, np.int64)
        self.n = n

    def add(self, query: np.ndarray, place: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        columns = (self.query, query), (self.place, place), (self.vec, vec), (self.score, score)
        q, p, v, s = (np.concatenate(x) for x in columns)
        order = np.lexsort((v, -s, q))
        q, p, v, s = q[order], p[order], v[order], s[order]
        start = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - start[q]
        keep = rank < self.k
        self.query, self.place, self.vec, self.score = q[keep], p[keep], v[keep], s[keep]
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def search(
    rows: np.ndarray, q: np.ndarray, floor: np.ndarray, others: np.ndarray, ids: np.ndarray, c: np.ndarray, basis: dict, k: int
) -> Best:
    """The k best candidates of each query that reach its floor.

    rows and others number the rows of the queries q and of the candidates c, whose ids order equal scores.
    """
    qn, cn = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    order = np.argsort(-cn, kind="stable")
    c, cn, others, ids = c[order], cn[order], others[order], ids[order]
    rq, rc = rotated(q, basis), rotated(c, basis)
    lead = min(LEAD, q.shape[1])
    tq, tc = suffix_norms(rq, lead), suffix_norms(rc, lead)
    best = Best(len(q), k, floor)
    for at in range(0, len(c), RUN):
        run = slice(at, at + RUN)
        slack = SLACK * qn * cn[at] + 1e-6
        live = np.flatnonzero(qn * cn[at] + slack >= best.floor)
        if not len(live):
            break
        for some in (live[x : x + RUN] for x in range(0, len(live), RUN)):
            reach = rq[some, :lead] @ rc[run, :lead].T + np.outer(tq[some], tc[run]) + slack[some, None]
            i, j = np.nonzero((reach >= best.floor[some, None]) & (rows[some, None] != others[run][None, :]))
            i, j = some[i], j + at
            scores = [exact(q[i[x : x + 65536]], c[j[x : x + 65536]]) for x in range(0, len(i), 65536)]
            if scores:
                score = np.concatenate(scores)
                ok = score >= best.floor[i]
                best.add(i[ok], order[j[ok]], ids[j[ok]], score[ok])
    return best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def top_products(table: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.

    table has vec_id and embedding; other columns are ignored. is_query is a condition on vec_id; where it is
    null, a row is no query. A query's candidates are all other rows of its dimension. Vectors that are null
    or hold null or non-finite components take no part; an empty vector has the product 0 with another empty one.
    Equal scores are ordered by vec_id, null last. Rows that repeat a vec_id are queries and candidates of their own, also for
    each other, and each query has its own ranks. Scores must fit 64 bits; the largest 64-bit number is no id. An empty table gives an empty result.
    """
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    rows = table.filter(usable(F.col("embedding"))).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(UNKNOWN)).alias("vec_id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = written(rows.withColumns({"length": length, "dim": F.size("v")}), "top-vectors")
    n, nq = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = rotations(rows, "v")
    longest = rows.orderBy(F.desc("length"), "row").limit(SEEDS).select("row", "vec_id", "v", "dim").toPandas()
    seeds = {
        d: (longest["row"].to_numpy(np.int64)[at], longest["vec_id"].to_numpy(np.int64)[at], _matrix(longest["v"].iloc[at]))
        for d, at in longest.groupby("dim").indices.items()
    }

    def floors(batches):
        for part in batches:
            floor = np.full(len(part), -np.inf)
            for d, at in part.groupby("dim").indices.items():
                if d in seeds:
                    best = search(part["row"].to_numpy()[at], _matrix(part["v"].iloc[at]), floor[at], *seeds[d], basis, k)
                    floor[at] = best.floor
            length = part["length"].to_numpy()
            # The least length of a candidate that can reach the floor.
            needs = np.where(floor <= 0, 0.0, (floor - 1e-6) / np.maximum(length, 1e-300) * (1 - SLACK))
            yield part.assign(floor=floor, needs=needs)

    kind = "row long, vec_id long, v array<double>, length double, dim int, floor double, needs double"
    started = written(rows.filter("asks").drop("asks").mapInPandas(floors, kind), "top-queries")

    def cut(frame: DataFrame, column: str, parts: int) -> Column:
        """A number from 0 to parts - 1, larger for larger values."""
        cuts = frame.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
        above = [(F.col(column) > F.lit(float(c))).cast("int") for c in sorted(set(cuts))] if parts > 1 else []
        return sum(above, F.lit(0))

    sliced = rows.drop("asks").withColumn("slice", cut(rows, "length", min(SLICES, max(1, -(-n // BLOCK)))))
    # At most SLICES rows of three numbers.
    slices = sliced.groupBy("slice").agg(F.max("length").alias("most"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).collect()
    banded = started.withColumn("band", cut(started, "needs", min(BANDS, max(1, -(-nq // QUERY_BLOCK)))))
    bands = banded.groupBy("band").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"), F.min("needs").alias("needs")).collect()

    def of(pairs: list, key: str, value: str, kind: str) -> Column:
        """The value of a slice or band, as a Column."""
        out = F.lit(None).cast(kind)
        for r in pairs:
            out = F.when(F.col(key) == r[key], F.lit(r[value]).cast(kind)).otherwise(out)
        return out

    def parts_of(r) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.lit(r.parts - 1)), lambda x: F.struct(F.lit(r.slice).alias("slice"), x.alias("part")))
        return F.when(F.col("needs") <= F.lit(r.most), every).otherwise(F.array().cast("array<struct<slice:int,part:int>>"))

    banded = banded.withColumn("share", F.pmod(F.xxhash64("row"), of(bands, "band", "parts", "int")).cast("int"))
    asked = banded.select("band", "share", F.explode(F.flatten(F.array(*map(parts_of, slices)))).alias("b"), "dim", "row", "vec_id", "v", "floor")
    asked = asked.select("band", "share", "b.slice", "b.part", "dim", "row", "vec_id", "v", "floor")
    sliced = sliced.withColumn("part", F.pmod(F.xxhash64("row"), of(slices, "slice", "parts", "int")).cast("int"))

    def shares_of(r) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.lit(r.parts - 1)), lambda x: F.struct(F.lit(r.band).alias("band"), x.alias("share")))
        return F.when(F.col("most") >= F.lit(r.needs), every).otherwise(F.array().cast("array<struct<band:int,share:int>>"))

    blocks = F.flatten(F.array(F.array().cast("array<struct<band:int,share:int>>"), *map(shares_of, bands)))
    offered = sliced.withColumn("most", of(slices, "slice", "most", "double")).select(F.explode(blocks).alias("b"), "slice", "part", "dim", "row", "vec_id", "v")
    offered = offered.select("b.band", "b.share", "slice", "part", "dim", "row", "vec_id", "v")

    def compare(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        ids = two["vec_id"].to_numpy()
        best = search(one["row"].to_numpy(), _matrix(one["v"]), one["floor"].to_numpy(), two["row"].to_numpy(), ids, _matrix(two["v"]), basis, k)
        asking = one.iloc[best.query].reset_index(drop=True)
        return pd.DataFrame({"query": asking["row"], "query_id": asking["vec_id"], "vec_id": ids[best.place], "score": best.score})

    keys = ["band", "share", "slice", "part", "dim"]
    schema = "query long, query_id long, vec_id long, score long"
    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(compare, schema)
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    known = lambda c: F.nullif(F.col(c), F.lit(UNKNOWN)).alias(c)
    return ranked.select(known("query_id"), "rank", known("vec_id"), "score")
