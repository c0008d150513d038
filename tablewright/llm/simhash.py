"""Operator 9, SimHash near-dedup by pigeonring filtering.

Fingerprints are 64 bits over the XXH64 values of 3-word shingles. Two texts link when
their fingerprints differ in at most two bits. With three ring segments and two allowed
differences, some segment starts a chain whose cumulative differences keep within
2/3, 4/3 and 2 bits: none in the first segment, at most one in the first two. Rows meet
on that equal segment; as the other 43 bits differ in at most two places, they also agree
on one of three parts of those bits, which makes the buckets narrow (35 equal bits). The
full Hamming check follows. Only distinct fingerprints are compared, buckets of more than
TILE of them are compared in tiles, and each task returns a forest rather than pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import components, local_labels, partitions, written

WORDS, SEED, MOST = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
TILE = 1024
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text; null is the empty text, without words it is 0."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z, space and 09-0D
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    digest = xxhash.xxh64_intdigest
    n, ones = max(1, len(words) - WORDS + 1), np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=n)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long, for every row of docs."""
    return docs.select("doc_id", _fingerprints("text").alias("fp"))


def _mask(at: int, width: int) -> int:
    mask = ((1 << width) - 1) << at
    return mask - (1 << 64) if mask >> 63 else mask


def _keys() -> list:
    """Nine bucket keys of a fingerprint: segment, part of the rest, and both masked values."""
    out = []
    for i, (at, width) in enumerate(SEGMENTS):
        rest = [p % 64 for p in range(at + width, at + 64)]
        cut = [0, len(rest) // 3, 2 * len(rest) // 3, len(rest)]
        for j in range(3):
            bits = sum(1 << p for p in rest[cut[j] : cut[j + 1]]) | (_mask(at, width) & (2**64 - 1))
            signed = bits - (1 << 64) if bits >> 63 else bits
            out.append(F.struct(F.lit(i * 3 + j).cast("byte").alias("slot"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star edges (a, b) between linked fingerprints; rows come sorted by bucket."""
    masks = np.array([_mask(*SEGMENTS[(i + 1) % 3]) for i in range(3)], dtype=np.int64).view(np.uint64)
    held = None
    for part in batches:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        if len(held) < CHUNK:
            continue
        same = _bucket_starts(held)
        cut = same[-1]
        if cut:
            yield _compare(held.iloc[:cut], masks)
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield _compare(held, masks)


def _bucket_starts(rows: pd.DataFrame) -> np.ndarray:
    new = np.ones(len(rows), dtype=bool)
    if len(rows) > 1:
        new[1:] = False
        for c in ("slot", "bits", "t", "u"):
            v = rows[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _compare(rows: pd.DataFrame, masks: np.ndarray) -> pd.DataFrame:
    fp = rows["fp"].to_numpy().view(np.uint64)
    following = masks[rows["slot"].to_numpy() // 3]
    starts = _bucket_starts(rows)
    ends = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
    left, right, found, shift = [], [], 0, 1
    active = np.flatnonzero(ends - np.arange(len(fp)) > 1)

    def fold() -> tuple[list, list, int]:
        label = local_labels(len(fp), np.concatenate(left), np.concatenate(right))
        members = np.flatnonzero(label != np.arange(len(fp)))
        return [members], [label[members]], len(members)

    while len(active):
        x = fp[active] ^ fp[active + shift]
        chain = active[(np.bitwise_count(x & following[active]) <= 1)]
        linked = chain[np.bitwise_count(fp[chain] ^ fp[chain + shift]) <= MOST]
        left.append(linked)
        right.append(linked + shift)
        found += len(linked)
        if found > 4_000_000:
            left, right, found = *fold()[:2], 0
        shift += 1
        active = active[ends[active] - active > shift]
    if not left:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    left, right, _ = fold()
    out = pd.DataFrame({"a": fp[left[0]].view(np.int64), "b": fp[right[0]].view(np.int64)})
    return out[out.a != out.b].drop_duplicates()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id for every row of docs.

    docs has doc_id and text; other columns are ignored. component_id is the smallest
    doc_id reachable by links, the row's own included. A null text is empty; texts without
    words have fingerprint zero and link with each other. A row with a null doc_id has its
    own result row; its component_id is the smallest known doc_id of its group, else null.
    Repeated rows give repeated rows. An empty table gives an empty result.
    """
    own = written(fingerprints(docs), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rows = classes.select("fp", F.explode(F.array(*_keys())).alias("k")).select("fp", "k.slot", "k.bits")
    wide = (
        rows.groupBy("slot", "bits")
        .count()
        .filter(F.col("count") > TILE)
        .select("slot", "bits", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    )
    tiled = rows.join(wide, ["slot", "bits"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own_tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = tiled.withColumn("mine", own_tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(
        "slot", "bits", F.least("mine", "other").alias("t"), F.greatest("mine", "other").alias("u"), "fp"
    )
    keys = ["slot", "bits", "t", "u"]
    edges = tiled.repartition(partitions(docs), *keys).sortWithinPartitions(*keys).mapInPandas(_links, "a long, b long")
    roots = components(edges, "fp", "root")
    grouped = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
