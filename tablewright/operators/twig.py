"""Twig joins: selectors with structure, fields of cards and counts, in one ordered pass over each page's nodes.

Nodes are regions (node, last) in page order. A pass keeps the open regions on a stack; a node's state is a set of bits, one for each step of each
selector, worked out from the step before it on the parent, on any open region, or on the siblings before. The tests of single nodes are Columns, so that
only nodes that pass one of them reach the pass, and memory is the depth of a page. Nothing is joined and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.selectors import classes, condition, parse
from tablewright.operators.relational import once

Test = str | Column
#: The class words of a node: a column that conditions may read.
WORDS = "_words"


class Program:
    """Selectors compiled to bits. A step's bit is set by its own test and, but for first steps, by the bit before it."""

    def __init__(self) -> None:
        self.tests: list[Column] = []
        self.known: dict = {}
        #: One condition that is given several times is one test.
        self.held: list[Column] = []
        #: By kind of join, (bit before, bit) of each step; and the bits that need none before them.
        self.joins: dict[str, list[tuple[int, int]]] = {" ": [], ">": [], "+": [], "~": []}
        self.free = 0
        #: By test, the bits that it may set.
        self.sets: list[int] = []
        self.steps = 0

    def _test(self, key: object, column: Column) -> int:
        if key not in self.known:
            self.known[key] = len(self.tests)
            self.tests.append(column)
            self.sets.append(0)
        return self.known[key]

    def _step(self, test: int) -> int:
        bit = 1 << self.steps
        self.steps += 1
        self.sets[test] |= bit
        return bit

    def add(self, test: Test) -> list[tuple[int, tuple | None]]:
        """(last bit, position) of each chain of a selector, or of a condition."""
        if isinstance(test, Column):
            self.held.append(test)
            bit = self._step(self._test(id(test), F.coalesce(test, F.lit(False))))
            self.free |= bit
            return [(bit, None)]
        out = []
        for chain in parse(test):
            before = 0
            for i, compound in enumerate(chain.compounds):
                bit = self._step(self._test(compound, condition(compound, F.col(WORDS))))
                if i:
                    self.joins[chain.joins[i - 1]].append((before, bit))
                else:
                    self.free |= bit
                before = bit
            out.append((bit, chain.pick))
        return out

    def hit(self, nodes: DataFrame) -> DataFrame:
        """nodes with hits: the tests that a node passes, each worked out once."""
        hits = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(self.tests)]))
        return once(nodes.withColumn(WORDS, classes()), *nodes.columns, hits.alias("hits"))


class Pass:
    """The stack of one page's open regions that pass a test: [last, bits, bits of it and all around it, node, extra]; and the siblings that do, by parent."""

    def __init__(self, free: int, joins: dict[str, list[tuple[int, int]]], sets: list[int]) -> None:
        self.free, self.sets = free, sets
        self.joins = [(k, joins[k]) for k in joins if joins[k]]
        self.beside = bool(joins["+"] or joins["~"])
        self.start()

    def start(self) -> None:
        self.stack: list[list] = []
        self.root: list = [1 << 62, 0, 0, -1, None]
        #: By parent: the bits of its children so far, the end of the latest and its bits.
        self.children: dict[int, tuple[int, int, int]] = {}

    def enter(self, node: int, last: int, parent: int, hits: list[int]) -> tuple[int, list[list]]:
        """(bits of a node, the regions that ended before it). The node's region is open afterwards."""
        stack, ended = self.stack, []
        while stack and stack[-1][0] < node:
            ended.append(stack.pop())
        above = stack[-1] if stack else self.root
        can = 0
        for h in hits:
            can |= self.sets[h]
        bits = can & self.free
        if can != bits:
            older, end, latest = self.children.get(parent, (0, -2, 0))
            for kind, pairs in self.joins:
                if kind == " ":
                    have = above[2]
                elif kind == ">":
                    have = above[1] if above[3] == parent else 0
                else:
                    have = older if kind == "~" else latest if end == node - 1 else 0
                if have:
                    for before, bit in pairs:
                        if have & before:
                            bits |= can & bit
        if self.beside:
            self.children[parent] = (self.children.get(parent, (0,))[0] | bits, last, bits)
        stack.append([last, bits, above[2] | bits, node, None])
        return bits, ended


def ordered(nodes: DataFrame) -> DataFrame:
    """Nodes of a page together and in order: needed where a table of nodes was written and is read again."""
    return nodes.repartition("page_id").sortWithinPartitions("page_id", "node")


def _walk(batches: Iterator[pa.RecordBatch], walker: Pass, names: list[str]):
    """(page, its number changed, row values, bits, ended regions) of each row; a last (None, True, ...) at the end."""
    page, begun = None, False
    for batch in batches:
        for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names], strict=True):
            if not begun or row[0] != page:
                if begun:
                    yield page, True, None, 0, list(reversed(walker.stack))
                page, begun = row[0], True
                walker.start()
            bits, ended = walker.enter(row[1], row[2], row[3], row[4])
            yield page, False, row, bits, ended
    if begun:
        yield page, True, None, 0, list(reversed(walker.stack))


#: Rows that a task hands on at once.
BLOCK = 5000


def find(nodes: DataFrame, selectors: dict[str, Test], in_order: bool = False) -> DataFrame:
    """page_id, name, node, last: the nodes that each selector finds on each page.

    nodes has the columns of html_nodes. A chain's :first, :last or :eq(n) picks among what that chain finds on the page (eq(-1) is the last). A node found by
    several chains of a selector is one row. in_order: nodes come as html_nodes makes them, page by page.
    """
    program = Program()
    chains = [(name, bit, pick) for name, test in selectors.items() for bit, pick in program.add(test)]
    free, joins, sets = program.free, program.joins, program.sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        seen: dict[int, list[tuple]] = {}
        wanted = 0
        for _, bit, _ in chains:
            wanted |= bit

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "name", "node", "last"])
            out.clear()
            return made

        for page, over, row, bits, _ in _walk(batches, Pass(free, joins, sets), ["page_id", "node", "last", "parent", "hits"]):
            if over:
                found: set[tuple] = set()
                for k, rows in seen.items():
                    name, _, (kind, n) = chains[k]
                    at = 0 if kind == "first" else -1 if kind == "last" else n
                    if -len(rows) <= at < len(rows):
                        found.add((page, name, *rows[at]))
                done = {r for r in out if r[0] == page}
                out.extend(sorted(found - done))
                seen = {}
                if len(out) >= BLOCK:
                    yield batch()
            elif bits & wanted:
                names = set()
                for k, (name, bit, pick) in enumerate(chains):
                    if bits & bit:
                        if pick is None:
                            names.add(name)
                        elif pick[0] == "last":
                            seen[k] = [(row[1], row[2])]
                        elif pick[0] != "first" or k not in seen:
                            seen.setdefault(k, []).append((row[1], row[2]))
                out.extend((page, name, row[1], row[2]) for name in sorted(names))
        yield batch()

    hit = program.hit(nodes).filter("size(hits) > 0").select("page_id", "node", "last", "parent", "hits")
    return (hit if in_order else ordered(hit)).mapInArrow(run, "page_id long, name string, node int, last int")


def near(nodes: DataFrame, of: Test, to: Test, how: str = "closest", in_order: bool = False) -> DataFrame:
    """page_id, node, other: for each node that `of` finds, the one that it leads to.

    how: "closest" is the nearest of it and the regions around it that `to` finds; "next" is the sibling right behind it, if `to` finds that.
    Nodes that lead nowhere give no row.
    """
    program = Program()
    mine, theirs = (sum({bit for bit, _ in program.add(t)}) for t in (of, to))
    free, joins, sets = program.free, program.joins, program.sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        walker = Pass(free, joins, sets)
        latest: dict[int, tuple[int, int]] = {}

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["page_id", "node", "other"])
            out.clear()
            return made

        for page, over, row, bits, _ in _walk(batches, walker, ["page_id", "node", "last", "parent", "hits"]):
            if over:
                latest.clear()
                if len(out) >= BLOCK:
                    yield batch()
                continue
            _, node, last, parent, _ = row
            if how == "next":
                # By parent: the latest node of `of` and its last; the right sibling begins right behind it.
                before = latest.pop(parent, None)
                if before and before[1] == node - 1 and bits & theirs:
                    out.append((page, before[0], node))
                if bits & mine:
                    latest[parent] = (node, last)
            elif bits & mine:
                other = next((r[3] for r in reversed(walker.stack) if r[1] & theirs), None)
                if other is not None:
                    out.append((page, node, other))
        yield batch()

    hit = program.hit(nodes).filter("size(hits) > 0").select("page_id", "node", "last", "parent", "hits")
    return (hit if in_order else ordered(hit)).mapInArrow(run, "page_id long, node int, other int")


def fields(
    nodes: DataFrame,
    roots: dict[str, Test | None],
    roles: dict[str, dict[str, list[Test]]],
    values: dict[str, Column],
    counts: dict[str, dict[str, Test]] | None = None,
    whole: bool = True,
    in_order: bool = False,
) -> DataFrame:
    """page_id, kind, root, last, found map<string, string>, n map<string, long>: one row for each region that a kind's root finds, or for each page where that is None.

    roles: by kind and role, tests in order of preference. found has each role's value: that of the first node (by test, then by place) inside the root that has a value
    which is not null; values: by role, the value of a node row. counts: by kind, how many nodes inside the root pass a test. whole: the root itself is inside.
    A page's region has root -1. Pages without nodes give no row.
    """
    program, counts = Program(), counts or {}
    tops = {kind: program.add(test) if test is not None else None for kind, test in roots.items()}
    ranks = [(kind, role, rank, bit) for kind, by in roles.items() for role, tests in by.items() for rank, t in enumerate(tests) for bit, _ in program.add(t)]
    tallies = [(kind, name, bit) for kind, by in counts.items() for name, t in by.items() for bit, _ in program.add(t)]
    free, joins, sets = program.free, program.joins, program.sets
    names = sorted({role for by in roles.values() for role in by})
    open_bits = [(kind, sum({bit for bit, _ in found})) for kind, found in tops.items() if found]
    pages, kinds = [kind for kind, found in tops.items() if found is None], list(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        walker = Pass(free, joins, sets)
        place = {role: 5 + i for i, role in enumerate(names)}
        roots_of: dict[str, list] = {kind: [] for kind in kinds}
        cared = [0, 0]
        for _, _, _, bit in ranks:
            cared[0] |= bit
        for _, _, bit in tallies:
            cared[1] |= bit
        page_tops: list[list] = []

        def ended(regions: list[list], page: int) -> None:
            for region in regions:
                for top in region[4] or ():
                    roots_of[top[0]].remove(top)
                    out.append((page, top[0], top[1], top[2], [(k, v[1]) for k, v in top[3].items()], list(top[4].items())))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.int64())]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "kind", "root", "last", "found", "n"])
            out.clear()
            return made

        begun = False
        for page, over, row, bits, closed in _walk(batches, walker, ["page_id", "node", "last", "parent", "hits", *(f"v_{role}" for role in names)]):
            ended(closed, page)
            if over:
                for top in page_tops:
                    roots_of[top[0]].remove(top)
                    out.append((page, top[0], -1, -1, [(k, v[1]) for k, v in top[3].items()], list(top[4].items())))
                begun, page_tops = False, []
                if len(out) >= BLOCK:
                    yield batch()
                continue
            if not begun:
                begun = True
                page_tops = [[kind, -1, -1, {}, {name: 0 for k, name, _ in tallies if k == kind}] for kind in pages]
                for top in page_tops:
                    roots_of[top[0]].append(top)
            node = row[1]
            if bits:
                for kind, wanted in open_bits:
                    if bits & wanted:
                        top = [kind, node, row[2], {}, {name: 0 for k, name, _ in tallies if k == kind}]
                        roots_of[kind].append(top)
                        region = walker.stack[-1]
                        region[4] = [*(region[4] or ()), top]
            if bits & cared[0]:
                for kind, role, rank, bit in ranks:
                    if bits & bit and roots_of[kind]:
                        value = row[place[role]]
                        if value is not None:
                            for top in roots_of[kind]:
                                if whole or top[1] != node:
                                    best = top[3].get(role)
                                    if best is None or rank < best[0]:
                                        top[3][role] = (rank, value)
            if bits & cared[1]:
                counted = set()
                for kind, name, bit in tallies:
                    if bits & bit and (kind, name) not in counted:
                        counted.add((kind, name))
                        for top in roots_of[kind]:
                            if whole or top[1] != node:
                                top[4][name] += 1
        yield batch()

    carried = [values[role].cast("string").alias(f"v_{role}") for role in names]
    # A page's own row needs one node of it, whatever that passes.
    hit = program.hit(nodes).filter("size(hits) > 0 OR node = 0" if pages else "size(hits) > 0").select("page_id", "node", "last", "parent", "hits", *carried)
    return (hit if in_order else ordered(hit)).mapInArrow(run, "page_id long, kind string, root int, last int, found map<string, string>, n map<string, long>")


def outside(nodes: DataFrame, test: Column) -> DataFrame:
    """Nodes that neither pass the test nor lie in a region that does: behind the end of every such region that began before them."""
    from pyspark.sql import Window

    before = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(test, F.col("last"))).over(before)
    return nodes.withColumn("_reach", reach).filter("_reach IS NULL OR _reach < node").drop("_reach")
