import hashlib
import re
import zlib
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import conversation_repair as cr
from tablewright.llm import q12

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def make(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("copies", F.lit("clash")).withColumn("piece", F.lit(1)).withColumn("audit", F.lit("x")).repartition(5)


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def counts(rows):
    f, turns = faults(rows), {t for t, _, _ in rows if t is not None}
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("b"), f.count("d"), f.count("t"), bad)


def every_repair(rows):
    """The best of all edits with up to two inserts at each place: (cost, audit, lines)."""
    gaps = [i for k in range(3) for i in product("ua", repeat=k)]
    full, options = {"u": "user", "a": "assistant"}, []
    for (_, role, text), f in zip(rows, faults(rows), strict=True):
        mine = [(2, "D", "", [])]
        if f not in ("b", "d"):
            extra = 5 if f == "t" else 0
            mine.append((extra, "K", role[:1] or "?", [f"{role}:{text}"]))
            mine += [(1 + extra, "R", i, [f"{full[i]}:{text}"]) for i in "ua"]
        options.append([(5 * len(g) + c, "I" * len(g) + e, "".join(g) + i, [f"{full[x]}:" for x in g] + lines) for g in gaps for c, e, i, lines in mine])
    options.append([(5 * len(g), "I" * len(g), "".join(g), [f"{full[x]}:" for x in g]) for g in gaps])
    best = None
    for way in product(*options):
        cost, audit = sum(w[0] for w in way), "".join(w[1] for w in way)
        if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in way)):
            best = (cost, audit, [line for w in way for line in w[3]])
    return best


def by_strings(rows):
    """The same for long conversations: the best (cost, audit) of each state, audits kept whole."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    full, best = {"u": "user", "a": "assistant"}, {"": (0, "", ())}

    def inserted(best):
        out, now = dict(best), best
        for _ in range(2):
            more = {}
            for q, (c, e, lines) in now.items():
                for i in "ua":
                    if (q, i) in step:
                        new, z = (c + 5, e + "I", (*lines, f"{full[i]}:")), step[q, i]
                        more[z] = min(more.get(z, new), new)
            now = more
            for z, new in more.items():
                out[z] = min(out.get(z, new), new)
        return out

    for (_, role, text), f in zip(rows, faults(rows), strict=True):
        new = {}
        for q, (c, e, lines) in inserted(best).items():
            ways = [(q, c + 2, e + "D", lines)]
            if f not in ("b", "d"):
                extra = 5 if f == "t" else 0
                ways += [(step[q, i], c + extra + 1, e + "R", (*lines, f"{full[i]}:{text}")) for i in "ua" if (q, i) in step]
                if (q, role[:1]) in step:
                    ways.append((step[q, role[:1]], c + extra, e + "K", (*lines, f"{role}:{text}")))
            for z, *w in ways:
                new[z] = min(new.get(z, tuple(w)), tuple(w))
        best = new
    ends = inserted(best)
    return min(ends[z] for z in ("", "a") if z in ends)


def brute(table, solve=by_strings, absent=()):
    out = [(c, 0, 0, 0, 0, 0, 0, "", sha([])) for c in absent if c not in {r[0] for r in table}]
    for c in {r[0] for r in table}:
        rows = ordered([r for r in table if r[0] == c])
        cost, audit, lines = solve(rows)
        out.append((c, *counts(rows), cost, audit, sha(lines)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_table(seed, convs, most, odd=True):
    rng, out = np.random.default_rng(seed), []
    roles = ["user", "assistant", "system", *(["tool", "", None, "usher"] if odd else [])]
    for c in range(convs):
        for _ in range(rng.integers(1, most + 1)):
            turn = None if odd and rng.random() < 0.1 else int(rng.integers(0, 2 * most))
            text = [f"Text {rng.integers(0, most)}.", "cut off", "", " \t", None, "Yes!", "ok? \n", "\x85", "é."][rng.integers(0, 9)]
            out.append((c if c else None, turn, roles[rng.choice(len(roles))] if rng.random() < 0.7 else "user", text))
    return out


def test_equals_all_edit_lists(spark):
    table = random_table(1, 60, 3)
    want = brute(table, every_repair)
    assert want == brute(table)
    assert got(cr.repair_conversations(make(spark, table))) == want


@pytest.mark.parametrize("rows,chars", [(2048, 1 << 20), (3, 1 << 20), (1, 40)])
def test_pieces_of_any_size(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(cr, "PIECE_ROWS", rows)
    monkeypatch.setattr(cr, "PIECE_CHARS", chars)
    table = random_table(2, 25, 40) + random_table(3, 25, 9, odd=False)
    df = make(spark, table)
    assert got(cr.repair_conversations(df)) == brute(table)
    if rows == 3:
        scanned = cr._scanned(cr._schema(spark, f"conv_id long, {cr.PIECE}, {cr.RESULT}"), 3, chars)
        sizes = df.select("conv_id", "turn", "role", "text", F.lit(1).alias("copies"), F.lit(False).alias("again")).fillna(" ", ["role", "text"]).sort("conv_id", "turn")
        sizes = sizes.coalesce(1).mapInArrow(scanned, f"conv_id long, {cr.PIECE}, {cr.RESULT}").filter("NOT done").select("n").collect()
        assert len(sizes) > 200 and max(r["n"] for r in sizes) == 3


def test_one_conversation_over_many_partitions(spark):
    # A third of all rows and more are one conversation's, and many of them copies.
    table = [(7, i, ["user", "assistant"][i % 2 ^ (i % 97 == 0)], f"{i}{'.' if i % 5 else ''}") for i in range(6000)]
    table += [(7, 3000, "user", "same.")] * 500 + [(7, 4000, "user", "same.")] * 3 + [(c, 0, "user", "Hi.") for c in range(100, 200)]
    want = brute(table)
    assert len(want) == 101
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")
    try:
        ranges = make(spark, table).repartitionByRange("conv_id", "turn").filter("conv_id = 7").select(F.spark_partition_id()).distinct().count()
        assert ranges > 5
        assert got(cr.repair_conversations(make(spark, table))) == want
    finally:
        spark.conf.set(key, before)


def test_moves_are_the_best_macros():
    # No macro that inserts before a deletion, and none with a longer run, is ever better.
    for (initial, fault), table in cr.MOVES.items():
        for after in range(4):
            for before, paid, code in table[after]:
                assert 0 <= before < 4 and paid >= 0 and cr.CODES[code]
        if fault < cr.TRUNCATED:
            assert all(m == [(after, 2, 0)] for after, m in enumerate(table)), initial


def test_odd_tables(spark):
    assert cr.repair_conversations(make(spark, [])).collect() == []
    none = make(spark, [])
    absent = spark.createDataFrame([(5,), (5,), (None,), (6,)], "conv_id long")
    rows = [(6, None, None, None), (6, None, "user", "Hi."), (6, None, "user", "Hi."), (8, 2, "assistant", "x" * 100_000 + ".")]
    assert got(cr.repair_conversations(none, absent)) == brute([], absent=[5, 6, None])
    assert got(cr.repair_conversations(make(spark, rows), absent)) == brute(rows, absent=[5, 6, None])


def harmed(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    mine = got(q12.op12_conversation_repair(spark, SF))
    assert mine == sorted(con.sql(q12.SQL).fetchall(), key=str) == brute(harmed(rows), absent={r[0] for r in rows})


def test_damage(spark):
    rows = random_table(5, 40, 20) + [(i, 0, "user", "One. Two! Three?") for i in range(1000, 1040)]
    kept, dropped = q12.damaged(make(spark, rows))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(harmed(rows), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got(cr.repair_conversations(kept, dropped)) == sorted(con.sql(q12.SQL).fetchall(), key=str)
