"""Operator 10, toxicity by nearest labelled examples.

A text's vector is TF-IDF over all its words; a word's weight grows with how much oftener it is in toxic examples than
by chance (the root of its log-likelihood ratio), and no word is left out. Its NEIGHBOURS nearest examples by
exact cosine come from an inverted index with block maxima: blocks of examples are scored in order of their bounds,
until no block left can reach the worst neighbour. The commonest terms, whose postings would be most of the work, lie in
columns: a product of matrices gives what they add for many texts at once, to the bounds as well. The neighbours vote with their cosines; an isotonic curve, fitted on
the examples with each left out in turn, makes the vote a probability. Nothing but the text enters a score.

The classifier is fitted on labelled rows in order of their hash: at most SAMPLE of them, and only those that fit in
what is left of POSTINGS distinct words; their whole texts count. So the model, which the driver makes and each task holds, has a size that no corpus changes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import partitions, written

SAMPLE = 4_000
#: Distinct words of all examples together: 24 bytes each in the index, some 150 MB on the driver while it is made.
POSTINGS = 2_500_000
NEIGHBOURS, BLOCK, PRIOR = 16, 64, 0.5
#: The toxic share that is assumed where nothing is labelled.
PRIOR_RATE = 0.1
#: Examples lie side by side by their heaviest term, of those in one of so many examples; so blocks hold like texts.
COMMON = 50
#: Blocks that are scored first; each following run is four times as long.
FIRST_BLOCKS, GROWTH = 24, 4
#: A term in one of so many examples lies in a column of its own instead of the postings; so many columns at most (16 MB).
FREQUENT, COLUMNS = 16, 512
#: Texts that are searched for at once, and their postings, unless one text has more; what a product of matrices may be off.
BATCH, WORK, OFF = 64, 500_000, 1e-9
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII but for letters becomes blank; so many other characters that are in no word do by hand, beyond that the pattern is faster.
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
MARKS = 32


def _words(text: str) -> list[bytes]:
    """What _WORD finds in a text, as UTF-8."""
    if not text.isascii():
        marks = [c for c in set(text) if c > "\x7f" and not _WORD.match(c)]
        if len(marks) > MARKS:
            return [w.encode() for w in _WORD.findall(text)]
        for c in marks:
            text = text.replace(c, " ")
    return text.encode().translate(_BLANK).split()


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a text as 64-bit hashes, ascending, and their counts."""
    counts = Counter(_words((text or "").lower()))
    terms = np.fromiter(map(xxhash.xxh64_intdigest, counts), dtype=np.uint64, count=len(counts)).view(np.int64)
    order = np.argsort(terms)
    return terms[order], np.fromiter(counts.values(), dtype=np.int32, count=len(counts))[order]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from start to start + size of each pair, one after the other."""
    ends = np.cumsum(size)
    out = np.repeat(start - ends + size, size)
    out += np.arange(len(out))
    return out


class Weights:
    """The terms of the examples and their weights; an unknown term weighs as one of no example."""

    def __init__(self, terms: np.ndarray, bad: np.ndarray, clean: np.ndarray, toxic: int, total: int) -> None:
        df = bad + clean
        expected = df * toxic / max(1, total)
        ratio = bad * np.log(np.maximum(bad, 1e-9) / np.maximum(expected, 1e-9)) + clean * np.log(
            np.maximum(clean, 1e-9) / np.maximum(df - expected, 1e-9)
        )
        relevance = np.where(bad > expected, np.sqrt(np.maximum(0.0, 2 * ratio)), 0.0)
        self.terms, self.weight = terms, np.log((2 + total) / (1 + df)) * (1 + relevance)
        self.unknown = float(np.log(2 + total))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms, and their parts of the vector of unit length of all terms."""
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        tf = 1 + np.log(counts)
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        part = tf * np.where(known, self.weight[at], self.unknown)
        return at[known], part[known] / np.sqrt((part**2).sum())


class BlockMaxIndex:
    """Examples by term, in blocks of BLOCK, with each block's largest weight of each term.

    Cells are pairs of a term and a block, in order; a cell has its block, its largest weight and its postings.
    Frequent terms have no cells but columns of weights.
    """

    def __init__(self, toxic: np.ndarray, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int) -> None:
        """Examples' labels, their numbers of terms, and the terms and weights of one after the other."""
        n = len(sizes)
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        common = np.bincount(term, minlength=size) * COMMON >= n
        # The heaviest common term of each example; size if it has none.
        heavy, some = np.full(n, size, dtype=np.int64), np.flatnonzero(common[term])
        some = some[np.lexsort((weight[some], row[some]))]
        heavy[row[some]] = term[some]
        #: The example at each place.
        self.example = np.argsort(heavy, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.example] = np.arange(n)
        self.toxic = toxic[self.example].astype(np.float64)
        self.blocks = -(-n // BLOCK)
        row = self.place[row].astype(np.int32)
        held = np.bincount(term, minlength=size)
        frequent = np.argsort(-held, kind="stable")[:COLUMNS]
        frequent = frequent[held[frequent] * FREQUENT >= n]
        #: The column of each term; -1 if it has none.
        self.column = np.full(size, -1, dtype=np.int32)
        self.column[frequent] = np.arange(len(frequent))
        own = self.column[term]
        some = own >= 0
        self.columns = np.zeros((n, len(frequent)))
        self.columns[row[some], own[some]] = weight[some]
        row, term, weight = row[~some], term[~some], weight[~some]
        order = np.lexsort((row, term))
        self.row, self.weight, term = row[order], weight[order], term[order]
        cell = term * max(1, self.blocks) + self.row // BLOCK
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        self.cell_at = np.append(first, len(cell))
        self.cell_block = (cell[first] % max(1, self.blocks)).astype(np.int32)
        self.cell_top = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.term_at = np.searchsorted(term[first], np.arange(size + 1))
        #: Postings of each term.
        self.postings = np.bincount(term, minlength=size).astype(np.int32)

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of positive cosine, nearest first; equal cosines by example."""
        return next(self.nearest_of([(at, weight)], k, None if without is None else np.array([without])))

    def nearest_of(self, queries: Iterable[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As nearest, for each query; what one gets does not depend on the others."""
        part, left, done = [], WORK, 0
        for at, weight in queries:
            work = int(self.postings[at].sum())
            if part and (len(part) == BATCH or work > left):
                yield from self._nearest(part, k, None if without is None else without[done : done + len(part)])
                part, left, done = [], WORK, done + len(part)
            part.append((at, weight))
            left -= work
        if part:
            yield from self._nearest(part, k, None if without is None else without[done:])

    def _nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, n = len(queries), len(self.example)
        owner, places, cosines, floor = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.zeros(m)
        at, weight = (np.concatenate(x) for x in zip(*queries, strict=True))
        query = np.repeat(np.arange(m), [len(a) for a, _ in queries])
        column = self.column[at]
        some = column >= 0
        dense = np.zeros((m, self.columns.shape[1]))
        dense[query[some], column[some]] = weight[some]
        common = dense @ self.columns.T
        at, weight, query = at[~some], weight[~some], query[~some]
        size = self.term_at[at + 1] - self.term_at[at]
        cell, own, query = _ranges(self.term_at[at], size), np.repeat(weight, size), np.repeat(query, size)
        block = query * self.blocks + self.cell_block[cell]
        bound = np.bincount(block, own * self.cell_top[cell], minlength=m * self.blocks).reshape(m, self.blocks)
        if n:
            bound = bound + np.maximum.reduceat(common, np.arange(0, n, BLOCK), axis=1)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        first, step = 0, FIRST_BLOCKS
        while first < self.blocks:
            chosen = (rank >= first) & (rank < first + step) & (bound > 0) & (bound >= floor[:, None] - OFF)
            if not chosen.any():
                break
            some = np.flatnonzero(chosen.ravel()[block])
            start = self.cell_at[cell[some]]
            size = self.cell_at[cell[some] + 1] - start
            posting = _ranges(start, size)
            row = np.repeat(query[some] * n, size) + self.row[posting]
            score = np.bincount(row, np.repeat(own[some], size) * self.weight[posting], minlength=m * n).reshape(m, n)
            near = (score + common) * np.repeat(chosen, BLOCK, axis=1)[:, :n]
            if without is not None:
                near[np.arange(m), without] = 0.0
            least, short = floor.copy(), np.flatnonzero(floor == 0)
            if len(short) and n > k:
                least[short] = np.partition(near[short], n - k, axis=1)[:, n - k]
            who, hit = np.nonzero((near > 0) & (near >= least[:, None] - OFF))
            # Summed anew for these alone, as the product's last digits hang on the other texts.
            exact = score[who, hit] + np.einsum("ij,ij->i", self.columns[hit], dense[who])
            owner, places, cosines = np.append(owner, who), np.append(places, hit), np.append(cosines, np.round(exact, 12))
            best = np.lexsort((self.example[places], -cosines, owner))
            best = best[np.arange(len(best)) - np.searchsorted(owner[best], owner[best]) < k]
            owner, places, cosines = owner[best], places[best], cosines[best]
            ends = np.searchsorted(owner, np.arange(m), "right")
            full = np.bincount(owner, minlength=m) == k
            floor[full] = cosines[ends[full] - 1]
            first, step = first + step, GROWTH * step
        ends = np.searchsorted(owner, np.arange(1, m))
        yield from zip(np.split(places, ends), np.split(cosines, ends), strict=True)

    def vote(self, places: np.ndarray, cosines: np.ndarray, base: float) -> float:
        """Share of toxic neighbours weighted by cosine, with a little weight on the base rate."""
        return float(((cosines * self.toxic[places]).sum() + PRIOR * base) / (cosines.sum() + PRIOR))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, last x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([float(b), 1.0, float(a), float(a)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], last]
    at = [v for p in pools for v in (p[2], p[3])]
    value = [p[0] / p[1] for p in pools for _ in range(2)]
    return np.array(at), np.array(value)


class Model:
    """Weights, index and, once calibrated, a curve; scores texts."""

    def __init__(self, ids: list, toxic: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Examples in order of their ids: labels, numbers of terms, and the terms and counts of one after the other."""
        self.ids, n = ids, len(ids)
        known, at = np.unique(terms, return_inverse=True)
        bad = np.bincount(at, np.repeat(toxic, sizes), minlength=len(known))
        clean = np.bincount(at, minlength=len(known)) - bad
        self.base = (float(toxic.sum()) + PRIOR_RATE) / (n + 1)
        self.weights = Weights(known, bad, clean, int(toxic.sum()), n)
        part = (1 + np.log(counts)) * self.weights.weight[at]
        length = np.sqrt(np.bincount(np.repeat(np.arange(n), sizes), part**2, minlength=n))
        self.index = BlockMaxIndex(toxic, sizes, at, part / np.repeat(length, sizes), len(known))
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def without(self, examples: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """The votes on examples, given by their terms and counts, by the others."""
        queries, places = (self.weights.vector(*v) for v in vectors), self.index.place[examples]
        return [self.index.vote(*found, self.base) for found in self.index.nearest_of(queries, NEIGHBOURS, places)]

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Fit the curve from votes to probabilities."""
        if len(votes):
            self.knots, self.values = isotonic(np.concatenate(([0.0], votes, [1.0])), np.concatenate(([0.0], toxic, [1.0])))

    def scores(self, texts: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Each text's probability of the label, and its evidence: the neighbours' places and cosines, nearest first.

        Repeated texts are scored once.
        """
        own = list(dict.fromkeys(texts))
        found = self.index.nearest_of((self.weights.vector(*counted(t)) for t in own), NEIGHBOURS)
        seen = {t: (float(np.interp(self.index.vote(p, c, self.base), self.knots, self.values)), p, c) for t, (p, c) in zip(own, found, strict=True)}
        return [seen[t] for t in texts]

    def evidence(self, found: list[tuple[float, np.ndarray, np.ndarray]], own: pa.DataType) -> pa.Array:
        """Arrays of (example's doc_id, cosine, label), one for each score."""
        ends = np.cumsum([0, *(len(p) for _, p, _ in found)]).astype(np.int32)
        places = np.concatenate([np.empty(0, np.int64), *(p for _, p, _ in found)])
        cosines = np.concatenate([np.empty(0), *(c for _, _, c in found)])
        ids = pa.array(self.ids, own).take(pa.array(self.index.example[places]))
        rows = pa.StructArray.from_arrays([ids, pa.array(cosines), pa.array(self.index.toxic[places].astype(np.int32))], ["doc_id", "cosine", "toxic"])
        return pa.ListArray.from_arrays(pa.array(ends), rows)


def held_out(doc_id) -> F.Column:
    """True where crc32 of the doc_id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Callable[[], Model]:
    """What gives tasks the model of the labelled rows that are not held out; at most SAMPLE of them, by hash of doc_id.

    Rows with a null label or doc_id are not used; of several labels of a doc_id the largest counts, and of several texts of
    a doc_id the one with the smallest hash.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = chosen.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [counted(t) for t in part["text"]]
            columns = {"terms": [t for t, _ in made], "counts": [c for _, c in made]}
            yield part[["doc_id", "toxic", "key"]].assign(**{k: pd.Series(v, index=part.index, dtype=object) for k, v in columns.items()})

    # At most SAMPLE rows of two numbers are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, key long, terms array<long>, counts array<int>"
    single = rows.mapInPandas(vectors, kind).groupBy("doc_id").agg(F.min_by(F.struct("toxic", "terms", "counts"), "key").alias("e"))
    every = written(single.select("doc_id", "e.*"), "toxicity-examples")
    # At most SAMPLE rows: the examples' sizes, and then those of them that fit.
    sizes = every.select("doc_id", F.size("terms").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    left, fitting = POSTINGS, []
    for r in sizes:
        if r["n"] <= left:
            fitting.append((r["doc_id"],))
            left -= r["n"]
    if len(fitting) < len(sizes):
        chosen = docs.sparkSession.createDataFrame(fitting, every.select("doc_id").schema)
        every = every.join(F.broadcast(chosen), "doc_id")
    examples = every.orderBy("doc_id")
    # The model itself.
    found = examples.toPandas()
    sizes = np.array([len(x) for x in found["terms"]], dtype=np.int64)
    flat = lambda c: np.concatenate([np.empty(0, np.int64), *found[c]])
    model = Model(found["doc_id"].tolist(), found["toxic"].to_numpy(np.float64), sizes, flat("terms"), flat("counts"))
    spark, place = docs.sparkSession, {d: i for i, d in enumerate(model.ids)}
    shared = spark.sparkContext.broadcast((model, place))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, place = shared.value
        for part in batches:
            vectors = [(np.asarray(t), np.asarray(c)) for t, c in zip(part["terms"], part["counts"], strict=True)]
            made = fitted.without([place[d] for d in part["doc_id"]], vectors)
            yield pd.DataFrame({"vote": np.array(made, dtype=np.float64), "toxic": part["toxic"].to_numpy(np.float64)})

    spread = examples.repartition(min(partitions(docs), max(1, len(sizes) // 64)))
    del found
    left_out = spread.mapInPandas(votes, "vote double, toxic double").toPandas()
    model.calibrate(left_out["vote"].to_numpy(), left_out["toxic"].to_numpy())
    knots, values = model.knots, model.values
    del model, place

    def calibrated() -> Model:
        """The model that was broadcast once, with its curve."""
        out = shared.value[0]
        out.knots, out.values = knots, values
        return out

    return calibrated


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and evidence array<struct<doc_id, cosine, toxic>>, the nearest examples, for each row of docs.

    docs has doc_id and text, labels has doc_id and toxic; other columns are ignored. A null text is
    empty; a text without words gets the rate of the label. Repeated rows get equal results, and so do rows
    that share a text. A row with a null doc_id is scored and not held out. Without
    usable labels every score is PRIOR_RATE, so that nothing is predicted to be toxic. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    own = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            fitted, column = model(), lambda name, part=part: part.column(part.schema.get_field_index(name))
            found = fitted.scores(column("text").to_pylist())
            score = np.array([s for s, _, _ in found], dtype=np.float64)
            ids = column("doc_id")
            columns = [ids, column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), fitted.evidence(found, ids.type)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence"])

    kind = f"doc_id {own}, held_out boolean, score double, predicted int, evidence array<struct<doc_id: {own}, cosine: double, toxic: int>>"
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted to be toxic."""
    model = fit(docs, labels)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([s for s, _, _ in model().scores(texts.tolist())], dtype="float64")

    return docs.filter(score("text") < 0.5)
