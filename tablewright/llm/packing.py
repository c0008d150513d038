"""Operator 1, best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most LENGTH tokens. Pieces of full length are sequences of
their own. The others are dealt by hash into cells of about CELL pieces; each cell is packed
by ISLANDS populations that run as separate rows. A child takes one parent, receives
whole well-filled bins of the other, loses the bins that hold duplicates, and best-fits the
documents thus displaced. After each epoch, every island's elite moves to the next island
of its cell. The emptiest bins of all cells are opened and packed again, in fewer cells,
until one cell is left, so that the corpus ends with a few bins that are not full, however many
cells there were.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import written

LENGTH, CELL, ISLANDS, EPOCHS = 2048, 4096, 3, 3
POPULATION, CHILDREN, OPEN_BINS = 4, 6, 8
CACHE_WORDS, RUN_WORDS, GROUP_CHARS = 1_000_000, 256, 8_000_000
#: A comma or full stop between a letter and white space is a token apart.
_MARK = re.compile("([.,])(?<=[a-zà-öø-ÿ].)(?=\\s)")
_STATE: dict = {}


class WordIds:
    """Token ids of texts; ids of words are kept, up to CACHE_WORDS of them.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids.
    Arrow splits texts and numbers their distinct words; only those are looked up or encoded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are encoded in runs: each ends with an end-of-word token."""
        self._each([w for w in words if not w.isalpha()])
        plain = [w for w in words if w.isalpha()]
        runs = [plain[a : a + RUN_WORDS] for a in range(0, len(plain), RUN_WORDS)]
        found = self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)
        for run, e in zip(runs, found, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(run) or cut[-1] != len(ids):
                self._each(run)
                continue
            body, at = ids.tobytes(), [0, *(4 * cut).tolist()]
            self.known.update((w, body[x:y]) for w, x, y in zip(run, at, at[1:], strict=False))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts, as little-endian bytes."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        lists = pc.ascii_split_whitespace(pa.array([_lowered(t) for t in texts], pa.large_string()))
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.known])
        each = list(map(self.known.__getitem__, words))
        flat = np.frombuffer(b"".join(each), dtype="<u4")
        sizes = np.array([len(x) for x in each], dtype=np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        own = sizes[codes]
        ends = np.cumsum(own)
        out = flat[np.repeat(starts[codes] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[lists.offsets.to_numpy()]
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _lowered(text: str) -> str:
    """The text as the tokenizer lower-cases it, where that is sure; fewer words are then distinct."""
    if "<|" not in text and "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text):
        return _MARK.sub(r" \1", text.lower())
    return text


def _pieces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _STATE:
            _STATE[path] = WordIds(path)
        words = _STATE[path]
        for part in batches:
            which, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in part["text"]]
            encoded = (x for a, b in _groups(texts) for x in words.ids(texts[a:b]))
            for i, body in enumerate(encoded):
                ids = body + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * LENGTH)):
                    body = ids[at : at + 4 * LENGTH]
                    which.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(body) // 4)
                    crc.append(zlib.crc32(body))
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].iloc[which].reset_index(drop=True),
                    "piece": np.array(piece, np.int32),
                    "start": np.array(start, np.int64),
                    "length": np.array(length, np.int64),
                    "ids_crc32": np.array(crc, np.int64),
                }
            )

    return run


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about GROUP_CHARS in all."""
    a = total = 0
    for b, t in enumerate(texts):
        total += len(t)
        if total >= GROUP_CHARS:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], free: list[int]) -> None:
    """Put items, largest first, each into the bin with the least room that still holds it."""
    rooms = sorted((room, b) for b, room in enumerate(free) if room)
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = LENGTH, len(bins)
            bins.append([])
            free.append(LENGTH)
        bins[b].append(i)
        free[b] = room - sizes[i]
        if free[b]:
            insort(rooms, (free[b], b))


def crossover(sizes: list[int], one: list[list[int]], two: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """A child of `one` with well-filled bins of `two` injected whole."""
    fill = np.array([sum(sizes[i] for i in b) for b in two])
    order = np.argsort(-(fill + rng.random(len(fill)) * LENGTH / 8), kind="stable")
    injected = [two[b] for b in order[: int(rng.integers(1, max(2, len(two) // 3 + 1)))]]
    taken = {i for b in injected for i in b}
    bins, displaced = [list(b) for b in injected], []
    for b in one:
        if taken.isdisjoint(b):
            bins.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    # The worst bin is opened too, so that its documents can find room elsewhere.
    if len(bins) > 1:
        displaced += bins.pop(min(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k])))
    best_fit(sizes, displaced, bins, [LENGTH - sum(sizes[i] for i in b) for b in bins])
    return bins


def fitness(sizes: list[int], bins: list[list[int]]) -> tuple[int, float]:
    """Fewer bins first; then the larger sum of squared fills."""
    return len(bins), -float(sum(sum(sizes[i] for i in b) ** 2 for b in bins))


def evolve(sizes: list[int], elite: list[list[int]] | None, seed: int) -> list[list[int]]:
    """The best packing that one island finds, from best-fit starts and an immigrant."""
    bound = -(-sum(sizes) // LENGTH)
    rng = np.random.default_rng(seed)
    first: list[list[int]] = []
    best_fit(sizes, list(range(len(sizes))), first, [])
    people = [first] + ([elite] if elite else [])
    best = min(people, key=lambda p: fitness(sizes, p))
    if len(best) <= bound:
        return best
    while len(people) < POPULATION:
        mixed, keep = [], rng.random(len(first)) < 0.5
        bins = [list(b) for b, k in zip(first, keep, strict=True) if k]
        mixed = [i for b, k in zip(first, keep, strict=True) if not k for i in b]
        free = [LENGTH - sum(sizes[i] for i in b) for b in bins]
        rng.shuffle(mixed)
        half = len(mixed) // 2
        for group in (mixed[:half], mixed[half:]):
            best_fit(sizes, group, bins, free)
        people.append(bins)
    for _ in range(CHILDREN):
        a, b = rng.choice(len(people), 2, replace=False)
        child = crossover(sizes, people[a], people[b], rng)
        people = sorted([*people, child], key=lambda p: fitness(sizes, p))[:POPULATION]
        if len(people[0]) <= bound:
            break
    return people[0]


def _assigned(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _epoch(number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                sizes, elite = [int(x) for x in r.sizes], None
                if r.elite is not None:
                    elite = [[] for _ in range(int(max(r.elite)) + 1)]
                    for i, b in enumerate(r.elite):
                        elite[b].append(i)
                if elite and len(elite) <= -(-sum(sizes) // LENGTH):
                    bins = elite
                else:
                    bins = evolve(sizes, elite, hash((r.cell, r.island, number)) & 0x7FFFFFFF)
                rows.append((r.cell, r.island, r.sizes, _assigned(bins, len(sizes)), len(bins), -(-sum(sizes) // LENGTH)))
            yield pd.DataFrame(rows, columns=["cell", "island", "sizes", "assign", "bins", "bound"])

    return run


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each item's bin and offset, and whether its bin is among the emptiest, to be opened."""
    for part in batches:
        rows = []
        for r in part.itertuples(index=False):
            sizes, assign = np.asarray(r.sizes, dtype=np.int64), np.asarray(r.assign)
            order = np.argsort(assign, kind="stable")
            ends = np.cumsum(sizes[order])
            starts = np.flatnonzero(np.append(True, assign[order][1:] != assign[order][:-1]))
            base = np.repeat((ends - sizes[order])[starts], np.diff(np.append(starts, len(order))))
            offset = np.empty(len(sizes), np.int64)
            offset[order] = ends - sizes[order] - base
            fill = np.bincount(assign, weights=sizes, minlength=r.bins)
            opened = np.zeros(r.bins, dtype=bool)
            opened[[b for b in np.argsort(fill, kind="stable")[:OPEN_BINS] if fill[b] < LENGTH]] = True
            rows.append((r.cell, assign.tolist(), offset.tolist(), opened[assign].tolist()))
        yield pd.DataFrame(rows, columns=["cell", "bin", "offset", "opened"])


def _packed_cells(items: DataFrame, cells: int) -> DataFrame:
    """(uid, length, cell, bin, offset, opened) for items (uid, length) of less than LENGTH."""
    grouped = (
        items.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(cells)))
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("items"))
    )
    grouped = written(grouped, "packing-cells")
    state = grouped.select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.transform("items", lambda x: x["length"].cast("int")).alias("sizes"),
        F.lit(None).cast("array<int>").alias("elite"),
    )
    kind = "cell long, island int, sizes array<int>, assign array<int>, bins int, bound int"
    for number in range(EPOCHS):
        done = state.repartition("cell", "island").mapInPandas(_epoch(number), kind).checkpoint()
        if number + 1 == EPOCHS or done.groupBy("cell").agg(F.min(F.expr("bins - bound")).alias("over")).filter("over > 0").isEmpty():
            break
        moved = done.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("assign").alias("elite"))
        state = done.select("cell", "island", "sizes").join(moved, ["cell", "island"])
    best = done.groupBy("cell").agg(F.min_by(F.struct("sizes", "assign", "bins"), F.struct("bins", "island")).alias("b"))
    placed = best.select("cell", "b.sizes", "b.assign", "b.bins").mapInPandas(
        _placed, "cell long, bin array<int>, offset array<long>, opened array<boolean>"
    )
    rows = grouped.join(placed, "cell").select("cell", F.explode(F.arrays_zip("items", "bin", "offset", "opened")).alias("x"))
    return rows.select("x.items.uid", "x.items.length", "cell", "x.bin", "x.offset", "x.opened")


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    docs has doc_id and text; other columns are ignored. Each document's ids are its
    text's and a final 0; a null text is empty and gives one piece of one id. Repeated rows and
    null doc_ids are documents of their own. sequence_id is odd for shared sequences, even for
    pieces of LENGTH tokens. An empty table gives an empty result.
    """
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    made = docs.select("doc_id", "text").mapInPandas(_pieces(tokenizer_path), kind)
    pieces = written(made.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    whole = pieces.filter(F.col("length") == LENGTH).withColumns({"sequence_id": F.col("uid") * 2, "offset": F.lit(0).cast("long")})
    items, placed, level = pieces.filter(F.col("length") < LENGTH).select("uid", "length"), None, 0
    n = items.count()
    while n:
        cells = -(-n // CELL)
        rows = written(_packed_cells(items, cells), "packing-level")
        number = F.lit(level << 55) + F.col("cell") * (1 << 24) + F.col("bin")
        open_count = 0 if cells == 1 else rows.filter("opened").count()
        again = 0 < open_count < n
        settled = rows.filter("NOT opened") if again else rows
        settled = settled.select("uid", (number * 2 + 1).alias("sequence_id"), "offset")
        placed = settled if placed is None else placed.unionByName(settled)
        items, n, level = rows.filter("opened").select("uid", "length"), open_count if again else 0, level + 1
    out = whole if placed is None else whole.unionByName(pieces.join(placed, "uid"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
