"""Operator 12: the cheapest repair of damaged conversations, by a dynamic program over ranks instead of audit strings.

A conversation is legal if its roles' initials are nothing or an s or none and then pairs of u and a. Four states read
them: start, after s, after u, after a. A macro edit is a run of inserted turns and what is done to the next turn; the
macros' audit codes are free of prefixes, so that two audits of as many turns differ before either ends and
compare as their codes do, one by one. A layer (all turns up to one) therefore needs, for each state, its cost and the rank of its audit among
the layer's; the next layer compares (cost, rank before, code). Audits are read from parent pointers in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import written

START, SYSTEM, USER, ASSISTANT = range(4)
READ = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one role that a new or renamed turn can have in a state, and the state after it.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Macro edits in ASCII order. An insert before a deletion costs the same behind it, where the audit is less.
CODES = ("D", "IIK", "IIR", "IK", "IR", "K", "R")
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: Longer runs of inserts come back to the state of a shorter one.
RUN = 2
#: Turns that end a legal conversation, by the state before them.
TAIL = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
#: A conversation is worked on in pieces of at most so many distinct rows, or of so many characters and one row.
PIECE_ROWS = 2048
PIECE_CHARS = 1 << 20

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = (
    "part int, piece int, done boolean, low long, high long, turns long, first string, last string, n long, costs array<long>, ranks array<int>, "
    "roles array<string>, texts array<string>, faults array<int>, copies array<long>"
)

BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)


def _moves() -> dict[tuple[str, int], list[list[tuple[int, int, int]]]]:
    """By (initial, fault) and state after: the best (state before, cost, code) of each state before."""
    out = {}
    for initial in ("s", "u", "a", ""):
        for fault in range(4):
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for before in range(4):
                at, paid = before, 0
                for run in range(RUN + 1):
                    if run:
                        at, paid = NEXT[at], paid + INSERT
                    options = [("D", DELETE, at)] if not run else []
                    if fault >= TRUNCATED:
                        extra = BROKEN if fault == TRUNCATED else 0
                        options.append(("R", REROLE + extra, NEXT[at]))
                        if (at, initial) in READ:
                            options.append(("K", extra, READ[at, initial]))
                    for letter, cost, after in options:
                        move = (paid + cost, CODES.index("I" * run + letter))
                        best[before, after] = min(best.get((before, after), move), move)
            out[initial, fault] = [[(b, *best[b, after]) for b in range(4) if (b, after) in best] for after in range(4)]
    return out


MOVES = _moves()


def fault_of(text: str, again: bool) -> int:
    """The first fault of a turn."""
    end = text.rstrip(SPACE)
    return BLANK if not end else DUPLICATE if again else TRUNCATED if end[-1] not in ".!?" else SOUND


class Layers:
    """The layers of some turns from one state: costs and ranks of the last, parent pointers of all."""

    def __init__(self, start: int, turns: list[tuple[str, int, int]]) -> None:
        self.cost, self.rank = [NEVER] * 4, [0] * 4
        self.cost[start] = 0
        self.parents: list[list[tuple[int, int]]] = []
        for initial, fault, copies in turns:
            cost, rank = self.cost, self.rank
            new, parent = [NEVER] * 4, [(0, 0)] * 4
            for after, moves in enumerate(MOVES[initial, fault]):
                least = min(((cost[b] + paid, rank[b], code, b) for b, paid, code in moves if cost[b] < NEVER), default=None)
                if least:
                    new[after], parent[after] = least[0] + DELETE * (copies - 1), (least[3], least[2])
            order = sorted((rank[parent[s][0]], parent[s][1], s) for s in range(4) if new[s] < NEVER)
            self.cost, self.rank = new, [0] * 4
            for place, (_, _, s) in enumerate(order):
                self.rank[s] = place
            self.parents.append(parent)

    def codes(self, end: int) -> list[tuple[int, int]]:
        """(state before, code) of every turn on the way to a state."""
        out = []
        for parent in reversed(self.parents):
            out.append(parent[end])
            end = parent[end][0]
        return out[::-1]


def _insert(state: int, run: int, lines: list[str]) -> int:
    for _ in range(run):
        state = NEXT[state]
        lines.append(f"{NAMES[state]}:")
    return state


def spelled(path: list[tuple[int, int]], rows: list[tuple[str, str, int]], end: int, tail: int) -> tuple[str, str]:
    """(audit, repaired lines) of a path over (role, text, copies), with `tail` turns inserted behind it."""
    audit, lines = [], []
    for (state, code), (role, text, copies) in zip(path, rows, strict=True):
        word = CODES[code]
        state = _insert(state, len(word) - 1, lines)
        if word[-1] == "K":
            lines.append(f"{role}:{text}")
        elif word[-1] == "R":
            lines.append(f"{NAMES[NEXT[state]]}:{text}")
        audit.append(word + "D" * (copies - 1))
    _insert(end, tail, lines)
    return "".join(audit) + "I" * tail, "\n".join(lines)


def best_end(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """(cost, state) of the cheapest legal end, ties to the least audit."""
    total, _, state = min((cost[s] + INSERT * TAIL[s], rank[s], s) for s in range(4) if cost[s] < NEVER)
    return total, state


class Piece:
    """Adjacent rows of one conversation in order: (turn, role, text, copies, fault)."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        if copies:
            self.rows.append((turn, role, text, copies, fault_of(text, again)))
            self.chars += len(text) + len(role)

    def full(self, rows: int, chars: int) -> bool:
        return len(self.rows) >= rows or self.chars >= chars

    def counts(self) -> tuple[int, int, int, int]:
        """blank, duplicate, truncated, illegal pairs within."""
        tally = [0] * 4
        illegal, last = 0, None
        for _, role, _, copies, fault in self.rows:
            tally[fault] += 1 if fault != BLANK else copies
            if fault != BLANK:
                tally[DUPLICATE] += copies - 1
            illegal += copies - 1 + (last is not None and last + role[:1] not in LEGAL)
            last = role[:1]
        return tally[BLANK], tally[DUPLICATE], tally[TRUNCATED], illegal

    def turns(self) -> list:
        """The different turns that are not null, in order."""
        known = [r[0] for r in self.rows if r[0] is not None]
        return [t for i, t in enumerate(known) if not i or t != known[i - 1]]

    def layers(self, start: int) -> Layers:
        return Layers(start, [(r[1][:1] if r[1][:1] in ("s", "u", "a") else "", r[4], r[3]) for r in self.rows])

    def texts(self) -> list[tuple[str, str, int]]:
        return [(r[1], r[2], r[3]) for r in self.rows]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _solved(piece: Piece) -> dict:
    """The result columns of a whole conversation."""
    layers, turns = piece.layers(START), piece.turns()
    cost, end = best_end(layers.cost, layers.rank)
    audit, repaired = spelled(layers.codes(end), piece.texts(), end, TAIL[end])
    counts = (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *piece.counts())
    return dict(zip(COUNTS, counts, strict=True)) | {"cost": cost, "audit": audit, "repaired_sha256": digest(repaired)}


def _open(piece: Piece) -> dict:
    """What other pieces of the conversation need to know of this one, and its rows."""
    turns, ways = piece.turns(), [piece.layers(s) for s in range(4)]
    out = dict(zip(COUNTS, (0, *piece.counts()), strict=True))
    out |= {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns), "n": len(piece.rows)}
    out |= {"first": piece.rows[0][1][:1] if piece.rows else None, "last": piece.rows[-1][1][:1] if piece.rows else None}
    out |= {"costs": [c for w in ways for c in w.cost], "ranks": [r for w in ways for r in w.rank]}
    _, roles, texts, copies, faults = zip(*piece.rows, strict=True) if piece.rows else ((),) * 5
    return out | {"roles": list(roles), "texts": list(texts), "copies": list(copies), "faults": list(faults)}


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in rows], schema)


def _scanned(schema: pa.Schema, rows: int, chars: int):
    """Sorted rows to results of the conversations that begin and end within a partition, and to pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, inside, begun, split, conv = TaskContext.get().partitionId(), 0, False, False, False, None
        piece, out = Piece(), []

        def close(whole: bool) -> None:
            nonlocal piece, number
            found = _solved(piece) if whole else _open(piece)
            out.append({"conv_id": conv, "part": part, "piece": number, "done": whole} | found)
            piece, number = Piece(), number + 1

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again")]
            for key, turn, role, text, copies, again in zip(*columns, strict=True):
                if not begun or not _same(key, conv):
                    if begun:
                        close(inside and not split)
                        inside = True
                    begun, conv, split = True, key, False
                elif piece.full(rows, chars):
                    close(False)
                    split = True
                piece.add(turn, role, text, copies, again)
            if out:
                yield _batch(out, schema)
                out.clear()
        if begun:
            close(False)
            yield _batch(out, schema)

    return run


def _joined(pieces: list[dict]) -> tuple[dict, list[tuple[int, int]]]:
    """The counts of a conversation and (state before, state after) of each of its pieces, from what _open says of them."""
    cost, rank, back = [0, NEVER, NEVER, NEVER], [0] * 4, []
    total, high, last = dict.fromkeys(COUNTS, 0), None, None
    low, turns = None, 0
    for p in pieces:
        new, parent = [NEVER] * 4, [0] * 4
        for after in range(4):
            least = min(((cost[b] + p["costs"][4 * b + after], rank[b], b) for b in range(4) if cost[b] < NEVER and p["costs"][4 * b + after] < NEVER), default=None)
            if least:
                new[after], parent[after] = least[0], least[2]
        order = sorted((rank[parent[s]], p["ranks"][4 * parent[s] + s], s) for s in range(4) if new[s] < NEVER)
        cost, rank = new, [0] * 4
        for place, (_, _, s) in enumerate(order):
            rank[s] = place
        back.append(parent)
        for k in COUNTS[1:]:
            total[k] += p[k]
        if p["n"]:
            total["illegal"] += last is not None and last + p["first"] not in LEGAL
            last = p["last"]
        if p["turns"]:
            turns += p["turns"] - (high == p["low"])
            low, high = low if low is not None else p["low"], p["high"]
    if turns:
        total["gaps"] = high - low + 1 - turns
    total["cost"], end = best_end(cost, rank)
    path = []
    for parent in reversed(back):
        path.append((parent[end], end))
        end = parent[end]
    return total, path[::-1]


def _ways(schema: pa.Schema):
    """Conversations with what is known of their pieces, in order, to a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total, path = _joined(row["pieces"])
                last = len(path) - 1
                out = [
                    total | {"part": p["part"], "piece": p["piece"], "before": a, "after": b, "tail": TAIL[b] if i == last else 0}
                    for i, (p, (a, b)) in enumerate(zip(row["pieces"], path, strict=True))
                ]
                yield _batch(out, schema)

    return run


def _spelled(schema: pa.Schema):
    """Pieces whose states are known to their parts of the audit and of the repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                piece = Piece()
                piece.rows = list(zip([None] * row["n"], row["roles"], row["texts"], row["copies"], row["faults"], strict=True))
                path = piece.layers(row["before"]).codes(row["after"])
                row["audit"], row["repaired"] = spelled(path, piece.texts(), row["after"], row["tail"])
                yield _batch([row], schema)

    return run


def _finished(schema: pa.Schema):
    """Sorted parts of audits and texts to results; only audits are held, texts go into the hash as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, audits, sha, begun = None, [], None, False
        for batch in batches:
            for now in batch.to_pylist():
                if row is None or not _same(now["conv_id"], row["conv_id"]):
                    if row is not None:
                        yield _batch([row | {"audit": "".join(audits), "repaired_sha256": sha.hexdigest()}], schema)
                    audits, sha, begun = [], hashlib.sha256(), False
                row = now
                audits.append(now["audit"])
                if now["repaired"]:
                    sha.update((("\n" if begun else "") + now["repaired"]).encode("utf-8", "surrogatepass"))
                    begun = True
        if row is not None:
            yield _batch([row | {"audit": "".join(audits), "repaired_sha256": sha.hexdigest()}], schema)

    return run


def _schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair_conversations(turns: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    turns has conv_id, turn, role and text; other columns are ignored. Null roles and texts count as one space. A conversation's rows are
    taken by turn (nulls first), then role and text. gaps counts turn numbers missing between the least and the largest (nulls ignored).
    Each row counts for its first fault: blank, duplicate (role and text seen earlier) or truncated. illegal counts neighbours
    whose roles' initials may not follow each other. The audit is the cheapest list of edits that makes the conversation legal, ties ASCII-least:
    keep 0, rerole 1, delete 2 (what blank and duplicate rows must be), insert 5; a truncated row that stays costs 5 more. A role that begins with
    none of s, u, a, an empty one too, is renamed or deleted. repaired_sha256 is of the repaired `role:text` lines. `absent` (conv_id) names conversations that get a
    row even if turns has none of them: zeros, an empty audit, the hash of nothing. Rows with a null conv_id are one conversation. An empty table gives
    an empty result.

    Equal rows are counted before anything else. Rows are sorted by ranges, so that a conversation may lie in many partitions; one that ends where it began is
    solved there. Of the others, pieces of bounded size are solved for each state before them, those tables are joined per conversation, and each piece is read again
    from its true state. Per conversation, one task then holds a table row for each piece, the audit, and hashes the text as it passes, as one hash demands.
    """
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    one = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"), F.lit(1).cast("long").alias("copies"))
    if absent is not None:
        none = absent.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
        rows = rows.unionByName(none)
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    first = counted.filter("copies > 0").groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("places"))
    # Few texts come twice; only these are looked up.
    seen = first.filter("places > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("first.turn").alias("first"), F.lit(True).alias("known"))
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    again = F.coalesce(F.col("known") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False)).alias("again")
    marked = counted.join(seen, met, "left").select("conv_id", "turn", "role", "text", "copies", again)
    order = ["conv_id", "turn", "role", "text"]
    ddl = f"conv_id {kind}, {PIECE}, {RESULT}"
    scanned = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scanned(_schema(spark, ddl), PIECE_ROWS, PIECE_CHARS), ddl)
    scanned = written(scanned, "conversation-pieces")
    columns = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    whole = scanned.filter("done").select(*columns)
    pieces = scanned.filter("NOT done")
    known = F.struct("part", "piece", "low", "high", "turns", "n", "first", "last", *COUNTS[1:], "costs", "ranks")
    ddl = "part int, piece int, before int, after int, tail int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    ways = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(known)).alias("pieces"))
    ways = ways.select("pieces").mapInArrow(_ways(_schema(spark, ddl)), ddl)
    ddl = f"conv_id {kind}, part int, piece int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
    stored = pieces.select("conv_id", "part", "piece", "n", "roles", "texts", "copies", "faults")
    spelt = stored.join(ways, ["part", "piece"]).mapInArrow(_spelled(_schema(spark, ddl)), ddl)
    ddl = f"conv_id {kind}, {RESULT}"
    rest = spelt.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_finished(_schema(spark, ddl)), ddl)
    return whole.unionByName(rest.select(*columns))
