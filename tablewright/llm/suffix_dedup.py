"""Operator 8, suffix-array dedup over sampled suffixes.

A byte goes if a WIDTH-byte string over it also starts in a document with a smaller
doc_id. Sorting every suffix of a corpus would move many times its size, so suffixes are
sampled by content: of the GRAM-byte strings in each WIDTH-byte window, one with the
smallest hash is an anchor. Equal windows have equal anchors at equal places, so each match is
seen at an anchor.

1. Anchors' hashes go to buckets as compressed blobs; a bucket says which of them occur in
   more than one document. Of documents that share a hash within a blob, one asks for all, and all are told.
2. Those documents send the context of every such anchor, WIDTH - GRAM bytes before it and
   WIDTH after, to a range of leading bytes; the ranges' splitters come from a sample. Of equal
   contexts in one task, only the smallest doc_id's travels; the others are covered.
3. Each range sorts its suffixes by multikey quicksort over 8-byte characters, takes common
   prefixes of neighbours, and finds for each window the smallest doc_id that has it. Equal
   leading bytes share a range, so no match crosses a boundary between ranges. Leading bytes that are too frequent in
   the sample for one range are compared by windows: each of their contexts' windows goes to a range of its own hash,
   once for each task that has it, and is sorted there.
4. Spans join their documents again and are cut out.

All comparisons that decide are of bytes; hashes only choose what to compare.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import partitions, written

WIDTH, GRAM = 50, 24
WINDOWS = WIDTH - GRAM + 1
LEFT = WIDTH - GRAM
CONTEXT = LEFT + WIDTH
PAD = 255  # never a byte of UTF-8
CHUNK_BYTES, BLOB_ENTRIES, CONTEXT_ROWS = 1 << 20, 1 << 19, 1 << 17
#: The splitters' sample: a share of the documents, at most so many of them, and at most so many anchors of a chunk.
SAMPLE_SHARE, SAMPLE_DOCS, SAMPLE_ANCHORS = 0.01, 2000, 4096
#: Leading bytes are compared by windows if they have this share of a range's part of the sample, and so many anchors in it.
HOT_SHARE, HOT_ANCHORS = 0.25, 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte string."""
    parts, have = {1: (data.astype(np.uint64) + np.uint64(1)) * _M3}, 1
    while have * 2 <= GRAM:
        a = parts[have]
        parts[have * 2] = a[:-have] * _M1 + (a[have:] ^ (a[have:] >> np.uint64(29))) * _M2
        have *= 2
    n, rest = len(data) - GRAM + 1, GRAM - have
    g = parts[have][:n]
    if rest:
        g = g * _M1 + parts[rest][have : have + n] * _M2
    return g ^ (g >> np.uint64(31))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its rows' bounds in them; nothing is copied."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), bounds


def _chunks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [i, j) of about CHUNK_BYTES: where they start in row i, their bytes, and their bounds in these.

    A longer row is cut into overlapping parts, so that each of its windows lies in one of them.
    """
    i, n = 0, len(bounds) - 1
    while i < n:
        size = int(bounds[i + 1] - bounds[i])
        if size > CHUNK_BYTES:
            for at in range(0, size - WIDTH + 1, CHUNK_BYTES):
                part = data[bounds[i] + at : min(bounds[i] + at + CHUNK_BYTES + WIDTH - 1, bounds[i + 1])]
                yield i, i + 1, at, part, np.array([0, len(part)])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, 0, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def _anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows that lie within one document, and their hashes."""
    if len(data) < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = _grams(data)
    least = _slide(g, WINDOWS, np.minimum)
    inside = np.ones(len(least), dtype=bool)
    for b in bounds[1:-1]:
        inside[max(0, b - WIDTH + 1) : b] = False
    least = np.where(inside, least, np.uint64(0))
    ends = np.zeros(WINDOWS - 1, dtype=np.uint64)
    most = _slide(np.concatenate((ends, least, ends)), WINDOWS, np.maximum)
    at = np.flatnonzero(most == g)
    doc = np.searchsorted(bounds, at, side="right") - 1
    at = at[at + GRAM <= bounds[doc + 1]]
    # Anchors' hashes are small, being minima; multiplied, they deal evenly into buckets.
    return at, g[at] * _M2


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


#: A bucket's questions; or, with a bucket below 0, what the documents of group -1 - bucket share.
_BLOBS = pa.schema([("bucket", pa.int32()), ("low", pa.int64()), ("blob", pa.binary())])
_CONTEXTS = pa.schema(
    [
        ("range", pa.int32()),
        ("low", pa.int64()),
        ("blob", pa.binary()),
        ("doc_id", pa.int64()),
        ("text_key", pa.int32()),
        ("at", pa.int32()),
        ("end", pa.int32()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _anchor_blobs(buckets: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)

        def entry(bucket: int, hashes: np.ndarray, d: np.ndarray) -> tuple:
            low = int(d.min())
            return bucket, low, pack.compress(_planes(hashes) + _planes((d - low).astype("<u8")))

        def blobs(hashes: list, docs: list) -> pa.RecordBatch:
            g, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(g, kind="stable")
            g, d = g[order], d[order]
            bucket = (((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            first = np.append(True, g[1:] != g[:-1])
            run = np.cumsum(first) - 1
            # Runs of one hash in which the document changes.
            many = np.zeros(run[-1] + 1, dtype=bool)
            many[run[1:][~first[1:] & (d[1:] != d[:-1])]] = True
            lo = g & np.uint64(0xFFFFFFFF)
            asks, own, which = lo[first].astype("<u4"), d[first], bucket[first]
            rows = [entry(int(which[a]), asks[a:z], own[a:z]) for a, z in _runs(which)]
            told = many[run]
            small, d = (bucket[told].astype(np.uint64) << np.uint64(32)) | lo[told], d[told]
            group = _grouped(d, groups)
            order = np.argsort(group, kind="stable")
            small, d, group = small[order].astype("<u8"), d[order], group[order]
            rows += [entry(-1 - int(group[a]), small[a:z], d[a:z]) for a, z in _runs(group)]
            return _batch(rows, _BLOBS)

        hashes, docs, n = [], [], 0
        for part in batches:
            ids = part.column("doc_id").to_numpy()
            for i, j, _, data, bounds in _chunks(*_bytes_of(part.column("body"))):
                at, g = _anchors(data, bounds)
                if len(at):
                    doc = ids[i:j][np.searchsorted(bounds, at, side="right") - 1]
                    hashes.append(g)
                    docs.append(doc)
                    n += len(g)
                if n >= BLOB_ENTRIES:
                    yield blobs(hashes, docs)
                    hashes, docs, n = [], [], 0
        if n:
            yield blobs(hashes, docs)

    return run


def _grouped(doc: np.ndarray, groups: int) -> np.ndarray:
    """A group of each doc_id, by a hash."""
    mixed = (doc.astype(np.uint64) * _M1) ^ ((doc.astype(np.uint64) * _M3) >> np.uint64(29))
    return (((mixed >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(sorted_values):
        return []
    cut = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return list(zip(cut.tolist(), np.append(cut[1:], len(sorted_values)).tolist(), strict=True))


def _shared(groups: int):
    """Of one bucket: documents' hashes that another document has too, as a blob for each group of documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pd.DataFrame({"group": -1 - pdf["bucket"], "bucket": -1, "low": pdf["low"], "blob": pdf["blob"]})
        los, docs = [], []
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for low, blob in zip(pdf["low"], pdf["blob"], strict=True):
            body = unpack.decompress(blob)
            n = len(body) // 12
            los.append(_unplanes(body[: 4 * n], "<u4"))
            docs.append(_unplanes(body[4 * n :], "<u8").astype(np.int64) + low)
        lo, doc = np.concatenate(los), np.concatenate(docs)
        order = np.lexsort((doc, lo))
        lo, doc = lo[order], doc[order]
        keep = np.append(True, (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1]))
        lo, doc = lo[keep], doc[keep]
        same = lo[1:] == lo[:-1]
        many = np.append(same, False) | np.append(False, same)
        lo, doc = lo[many], doc[many]
        group = _grouped(doc, groups)
        order = np.lexsort((doc, group))
        lo, doc, group = lo[order], doc[order], group[order]
        bucket, rows = int(pdf["bucket"].iloc[0]), []
        for a, b in _runs(group):
            body = _planes(lo[a:b].astype("<u4")) + _planes((doc[a:b] - doc[a]).astype("<u8"))
            rows.append((int(group[a]), bucket, int(doc[a]), pack.compress(body)))
        return pd.DataFrame(rows, columns=["group", "bucket", "low", "blob"])

    return run


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one group of documents: each one's shared hashes, with the bucket in front (in the blobs of bucket -1 it is there)."""
    unpack, hashes, docs = zstandard.ZstdDecompressor(), [], []
    for bucket, low, blob in zip(pdf["bucket"], pdf["low"], pdf["blob"], strict=True):
        body = unpack.decompress(blob)
        if bucket < 0:
            n = len(body) // 16
            hashes.append(_unplanes(body[: 8 * n], "<u8"))
            docs.append(_unplanes(body[8 * n :], "<u8").astype(np.int64) + low)
            continue
        n = len(body) // 12
        hashes.append((np.uint64(bucket) << np.uint64(32)) | _unplanes(body[: 4 * n], "<u4").astype(np.uint64))
        docs.append(_unplanes(body[4 * n :], "<u8").astype(np.int64) + low)
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    runs = _runs(doc)
    return pd.DataFrame({"doc_id": [int(doc[a]) for a, _ in runs], "shared": [h[a:b].tobytes() for a, b in runs]})


def _contexts(buckets: int, splitters: list, hot: list):
    """Contexts of the anchors that other documents share, and the spans already certain."""
    splits, frequent = np.array(splitters, dtype=np.uint64), np.array(sorted(hot), dtype=np.uint64)
    column = np.arange(CONTEXT)
    base = len(splits) + 1

    def windows(doc: np.ndarray, key: np.ndarray, at: np.ndarray, ctx: np.ndarray) -> tuple[tuple, list]:
        """Spans that are certain, and (range, doc_id, text_key, at, bytes) of each window's smallest doc_id."""
        low, high = _valid(ctx)
        parts = []
        for offset in range(WINDOWS):
            ok = np.flatnonzero((low <= offset) & (offset <= high))
            parts.append((doc[ok], key[ok], at[ok] - offset, ctx[ok, LEFT - offset : LEFT - offset + WIDTH]))
        doc, key, at, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, group = np.unique(np.ascontiguousarray(seen).view(f"V{WIDTH}").reshape(-1), return_inverse=True)
        first = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(first, group, doc)
        covered = first[group] < doc
        sure = doc[covered], key[covered], at[covered], at[covered] + WIDTH
        doc, key, at, seen = doc[~covered], key[~covered], at[~covered], seen[~covered]
        mixed = np.zeros(len(doc), dtype=np.uint64)
        for k in range(WIDTH):
            mixed = (mixed ^ seen[:, k]) * _M1
        return sure, [base + (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64), doc, key, at, seen]

    def emit(found: list) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=6)
        doc, key, at, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
        _, group = np.unique(ctx.view(f"V{CONTEXT}").reshape(-1), return_inverse=True)
        first = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, group, doc)
        # An equal context of a smaller doc_id covers all windows of this anchor.
        covered = first[group] < doc
        low, high = _valid(ctx)
        sure = doc[covered], key[covered], (at - high)[covered], (at - low + WIDTH)[covered]
        doc, key, at, ctx = doc[~covered], key[~covered], at[~covered], ctx[~covered]
        lead = ctx[:, LEFT : LEFT + 8].copy().view(">u8").reshape(-1).astype(np.uint64)
        by_window = np.isin(lead, frequent)
        dealt = [[np.searchsorted(splits, lead[~by_window], side="right"), doc[~by_window], key[~by_window], at[~by_window], ctx[~by_window]]]
        if by_window.any():
            more, rest = windows(doc[by_window], key[by_window], at[by_window], ctx[by_window])
            sure = tuple(np.concatenate(x) for x in zip(sure, more, strict=True))
            dealt.append(rest)
        rows = [(-1 - i % 64, 0, None, *x) for i, x in enumerate(zip(*(c.tolist() for c in _joined(*sure)), strict=True))]
        for ranges, doc, key, at, seen in dealt:
            order = np.argsort(ranges, kind="stable")
            ranges, doc, key, at, seen = (x[order] for x in (ranges, doc, key, at, seen))
            for a, b in _runs(ranges):
                least = int(doc[a:b].min())
                parts = (doc[a:b] - least).astype("<u8"), key[a:b].astype("<i4"), at[a:b].astype("<u4")
                body = b"".join(map(_planes, parts)) + seen[a:b].tobytes()
                rows.append((int(ranges[a]), least, pack.compress(body), 0, 0, 0, 0))
        return _batch(rows, _CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            part = part.filter(part.column("shared").is_valid())
            if not part.num_rows:
                continue
            ids = part.column("doc_id").to_numpy()
            replies, places = _bytes_of(part.column("shared"))
            found, held = [], 0
            whole, ends = _bytes_of(part.column("body"))
            answers, of_row = {}, -1
            for i, j, offset, data, bounds in _chunks(whole, ends):
                at, g = _anchors(data, bounds)
                if not len(at):
                    continue
                if offset == 0 or of_row != i:
                    answers, keys, of_row = {}, [zlib.crc32(whole[a:b]) for a, b in zip(ends[i:j], ends[i + 1 : j + 1], strict=True)], i
                    keys = np.array(keys, dtype=np.uint32).view(np.int32)
                doc = np.searchsorted(bounds, at, side="right") - 1
                bucket = (((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint64)
                small = (bucket << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
                firsts = np.searchsorted(doc, np.arange(j - i + 1))
                chosen = np.zeros(len(at), dtype=bool)
                for k in range(j - i):
                    a, b = firsts[k], firsts[k + 1]
                    if a == b:
                        continue
                    if k not in answers:
                        answers[k] = np.sort(np.frombuffer(replies[places[i + k] : places[i + k + 1]].tobytes(), "<u8"))
                    place = np.minimum(np.searchsorted(answers[k], small[a:b]), len(answers[k]) - 1)
                    chosen[a:b] = answers[k][place] == small[a:b]
                at, doc = at[chosen], doc[chosen]
                # The bytes with those before and after them in the same row, for a part of a long row.
                size = ends[i + 1] - ends[i] if j == i + 1 else 0
                left = min(offset, LEFT)
                if j == i + 1:
                    data = whole[ends[i] + offset - left : min(ends[i] + offset + len(data) + WIDTH, ends[i + 1])]
                padded = np.concatenate((np.full(LEFT, PAD, np.uint8), data, np.full(WIDTH, PAD, np.uint8)))
                views = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)
                for a in range(0, len(at), CONTEXT_ROWS):
                    some, of = at[a : a + CONTEXT_ROWS], doc[a : a + CONTEXT_ROWS]
                    ctx = views[some + left].copy()
                    before = some - bounds[of] + offset
                    after = size - before if j == i + 1 else bounds[of + 1] - some
                    ctx[(column < (LEFT - before)[:, None]) | (column >= (LEFT + after)[:, None])] = PAD
                    found.append((ids[i:j][of], keys[of], before, ctx))
                    held += len(some)
                    if held >= CONTEXT_ROWS:
                        yield emit(found)
                        found, held = [], 0
            if found:
                yield emit(found)

    return run


def _joined(doc: np.ndarray, key: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple:
    """Spans of one document that touch, in one; they come in order of place."""
    if not len(doc):
        return doc, key, at, end
    order = np.lexsort((at, key, doc))
    doc, key, at, end = doc[order], key[order], at[order], end[order]
    # Places are under 2**31 and spans of a document are sorted, so that a running maximum needs no reset.
    run = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    reach = np.maximum.accumulate(end + run * (1 << 32)) - run * (1 << 32)
    new = np.append(True, (run[1:] != run[:-1]) | (at[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], key[new], at[new], reach[last]


def _valid(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest offset of an anchor in the windows that lie in its document."""
    high = (ctx[:, : LEFT + 1] != PAD).sum(axis=1) - 1
    low = WIDTH - (ctx[:, LEFT:] != PAD).sum(axis=1)
    return low, high


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of an (n, w) array of 8-byte characters by multikey quicksort.

    Rows are sorted by a character; only runs of equals go on to the next one.
    """
    order = np.arange(len(words))
    open_rows, run = order.copy(), np.zeros(len(words), dtype=np.int64)  # places still tied, and their runs
    for c in range(words.shape[1]):
        if not len(open_rows):
            break
        value = words[order[open_rows], c]
        within = np.lexsort((value, run))
        order[open_rows] = order[open_rows][within]
        value, run = value[within], run[within]
        new = np.append(True, (run[1:] != run[:-1]) | (value[1:] != value[:-1]))
        run = np.cumsum(new)
        tied = np.bincount(run)[run] > 1
        open_rows, run = open_rows[tied], run[tied]
    return order


def range_spans(doc: np.ndarray, key: np.ndarray, at: np.ndarray, ctx: np.ndarray) -> pd.DataFrame:
    """Spans of one range's contexts that a smaller doc_id has too."""
    n = len(doc)
    width = -(-WIDTH // 8) * 8
    suffix = np.zeros((n, width), dtype=np.uint8)
    suffix[:, :WIDTH] = ctx[:, LEFT:]
    order = multikey_order(suffix.view(">u8").astype(np.uint64))
    doc, key, at, ctx = doc[order], key[order], at[order], ctx[order]
    differs = ctx[1:, LEFT:] != ctx[:-1, LEFT:]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH)
    low, high = _valid(ctx)
    least, most = np.full(n, WIDTH), np.full(n, -1)
    # Identifiers of the l bytes before an anchor: pairs (identifier of l - 1 bytes, next byte), numbered.
    left = np.zeros(n, dtype=np.int64)
    alive = np.flatnonzero(np.append(lcp >= GRAM, False) | np.append(False, lcp >= GRAM))
    for offset in range(WINDOWS):
        if offset:
            _, left[alive] = np.unique(left[alive] * 256 + ctx[alive, LEFT - offset], return_inverse=True)
        run = np.append(0, np.cumsum(lcp < WIDTH - offset))
        ok = alive[(low[alive] <= offset) & (offset <= high[alive])]
        if len(ok) < 2:
            continue
        pair = run[ok] * (left.max() + 1) + left[ok]
        sort = np.argsort(pair, kind="stable")
        pair, rows = pair[sort], ok[sort]
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        first = np.minimum.reduceat(doc[rows], start)
        hit = rows[np.repeat(first, np.diff(np.append(start, len(rows)))) < doc[rows]]
        least[hit] = np.minimum(least[hit], offset)
        most[hit] = offset
    hit = np.flatnonzero(most >= 0)
    joined = _joined(doc[hit], key[hit], at[hit] - most[hit], at[hit] - least[hit] + WIDTH)
    return pd.DataFrame(dict(zip(("doc_id", "text_key", "at", "end"), joined, strict=True))).astype(
        {"at": np.int32, "end": np.int32}
    )


def window_spans(doc: np.ndarray, key: np.ndarray, at: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
    """Spans of windows that a smaller doc_id has too."""
    padded = np.zeros((len(doc), -(-WIDTH // 8) * 8), dtype=np.uint8)
    padded[:, :WIDTH] = seen
    order = multikey_order(padded.view(">u8").astype(np.uint64))
    doc, key, at, seen = doc[order], key[order], at[order], seen[order]
    start = np.flatnonzero(np.append(True, (seen[1:] != seen[:-1]).any(axis=1)))
    hit = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(doc)))) < doc
    joined = _joined(doc[hit], key[hit], at[hit], at[hit] + WIDTH)
    return pd.DataFrame(dict(zip(("doc_id", "text_key", "at", "end"), joined, strict=True))).astype({"at": np.int32, "end": np.int32})


def _spans(base: int):
    """Rows come sorted by range; a range's rows are compared together. From `base` on, ranges hold windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _range_by_range(batches, base)

    return run


def _range_by_range(batches: Iterator[pd.DataFrame], base: int) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    current = None
    unpack = zstandard.ZstdDecompressor()

    def flush() -> Iterator[pd.DataFrame]:
        if held:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            yield (range_spans if current < base else window_spans)(*columns)

    for part in batches:
        sure = part["range"] < 0
        if sure.any():
            yield part.loc[sure, ["doc_id", "text_key", "at", "end"]]
        for r in part[~sure].itertuples(index=False):
            if r.range != current:
                yield from flush()
                current = r.range
            body = unpack.decompress(r.blob)
            width = CONTEXT if r.range < base else WIDTH
            n = len(body) // (16 + width)
            held.append(
                (
                    _unplanes(body[: 8 * n], "<u8").astype(np.int64) + r.low,
                    _unplanes(body[8 * n : 12 * n], "<i4"),
                    _unplanes(body[12 * n : 16 * n], "<u4").astype(np.int64),
                    np.frombuffer(body, np.uint8, offset=16 * n).reshape(n, width),
                )
            )
    yield from flush()


def _merge(spans: list, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _cut(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for body, spans in zip(part["body"], part["spans"], strict=True):
                own = np.uint32(zlib.crc32(body)).view(np.int32)
                mine = [(x["at"], x["end"]) for x in spans if x["text_key"] == own] if spans is not None else []
                merged = _merge(mine, len(body))
                kept, last = [], 0
                for a, b in merged:
                    kept.append(body[last:a])
                    last = b
                kept.append(body[last:])
                rest = b"".join(kept)
                text = rest.decode("utf-8", "ignore") if with_text else None
                removed = sum(b - a for a, b in merged)
                rows.append((len(body), removed, len(merged), text, hashlib.sha256(rest).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "text", "kept_sha256"])
            out.insert(0, "doc_id", part["doc_id"].reset_index(drop=True))
            out["carried"] = part["carried"].reset_index(drop=True)
            yield out

    return run


def _splitters(bodies: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """n - 1 values that part the leading bytes of a bounded sample's anchors evenly, and those that are too frequent for one part."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for _, _, _, data, bounds in _chunks(*_bytes_of(part.column("body"))):
                at, _ = _anchors(data, bounds)
                at = at[:: max(1, len(at) // SAMPLE_ANCHORS)]
                lead = np.lib.stride_tricks.sliding_window_view(data, 8)[at].copy().view(">u8") if len(at) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(lead.reshape(-1).astype(np.uint64).view(np.int64))], names=["lead"])

    sample = written(bodies.sample(SAMPLE_SHARE, seed=1).limit(SAMPLE_DOCS).mapInArrow(leads, "lead long"), "suffix-sample")
    unsigned = F.col("lead").bitwiseXOR(F.lit(-(1 << 63)))
    cuts, total = sample.agg(F.percentile_approx(unsigned, [i / n for i in range(1, n)] or [0.5], 1000), F.count("*")).first()
    counted = sample.groupBy("lead").agg(F.count("*").alias("n"))
    plain = lambda c: (int(c) ^ -(1 << 63)) & (2**64 - 1)
    # At most n / HOT_SHARE rows.
    hot = counted.filter(F.col("n") >= max(HOT_ANCHORS, HOT_SHARE * total / n)).select("lead").collect()
    return sorted({plain(c) for c in cuts or []}), [r[0] & (2**64 - 1) for r in hot]


def cut_repeats(docs: DataFrame, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the columns named in carry, for each row of docs.

    with_text adds text: the bytes left, without the remains of characters that a cut has split.

    docs has doc_id and text; other columns are ignored. A null text is empty. Texts of
    fewer than WIDTH bytes lose nothing. A row with a null doc_id is compared with nothing. Rows
    that share a doc_id are one another's equals, so that none loses bytes to the other;
    each has its own result row. An empty table gives an empty result. Long texts are read in parts of CHUNK_BYTES;
    a task holds a text a few times.
    """
    n = partitions(docs)
    carry = carry or []
    # In a struct, so that no name of a carried column can clash.
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    bodies = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"), carried.alias("carried"))
    known = bodies.filter("doc_id IS NOT NULL").select("doc_id", "body")
    ranges, hot = _splitters(known.filter(F.length("body") >= WIDTH).select("body"), 2 * n)
    blobs = known.mapInArrow(_anchor_blobs(n, n), "bucket int, low long, blob binary")
    shared = (
        blobs.repartition(n, "bucket")
        .groupBy("bucket")
        .applyInPandas(_shared(n), "group int, bucket int, low long, blob binary")
        .repartition(n, "group")
        .groupBy("group")
        .applyInPandas(_by_document, "doc_id long, shared binary")
    )
    # Both joins deal the same documents by doc_id, so Spark can use one exchange for the two.
    contexts = bodies.join(shared, "doc_id", "left").mapInArrow(
        _contexts(n, ranges, hot), "range int, low long, blob binary, doc_id long, text_key int, at int, end int"
    )
    spans = contexts.repartition(n, "range").sortWithinPartitions("range").mapInPandas(
        _spans(len(ranges) + 1), "doc_id long, text_key int, at int, end int"
    )
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "at", "end")).alias("spans"))
    own = bodies.schema["carried"].dataType.simpleString()
    kind = f"doc_id long, n_bytes long, n_removed long, n_spans long, text string, kept_sha256 string, carried {own}"
    out = bodies.join(listed, "doc_id", "left").mapInPandas(_cut(with_text), kind)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if with_text else [])]
    return out.select(*columns, *[F.col("carried")[f"c{i}"].alias(c) for i, c in enumerate(carry)])
