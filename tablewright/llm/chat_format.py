"""Operator 3, chat formatting: native expressions only.

A conversation's turns are sorted by turn, put between role marks, and adjacent
turns of one role share a block. Control strings inside texts are escaped so that
the output can be read back exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
#: Places are summed in runs of so many turns, and spans are read in blocks of so many characters; so work
#: grows with the length of a conversation and not with its square.
RUN, BLOCK = 128, 1024
SPANS = "array<struct<at:bigint,len:bigint>>"


def escape(text: Column) -> Column:
    """No '<|' is left: a backslash is doubled, then '<|' becomes '<\\|'."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As escape; a line feed, which would end the role, becomes '<\\n' (never left by escape)."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    """The inverse of escape_role."""
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conv_id: conv_id, formatted string, loss_spans array<struct<at, len>>.

    turns has conv_id, turn, role and text; other columns are ignored. A null role or
    text is empty. Equal turn numbers are ordered by role, then text; null turns come
    first; a repeated row is a turn of its own. A null conv_id is a conversation too.
    loss_spans are the code-point places (from 0) of every `learn` text as escaped in
    `formatted`; an empty table gives an empty result.
    """
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("ts")
    )
    role_at = lambda i: F.get(F.col("ts"), i)["role"]
    marked = grouped.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                F.when(t["role"].eqNullSafe(role_at(i - 1)), F.lit(SEP))
                .otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
                .alias("head"),
                escape(t["text"]).alias("body"),
                F.when(t["role"].eqNullSafe(role_at(i + 1)), F.lit("")).otherwise(F.lit(END)).alias("tail"),
                (t["role"] == learn).alias("learn"),
            ),
        ).alias("ps"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["head"])
        n = F.length(p["body"]).cast("long")
        span = F.struct(at.alias("at"), n.alias("len"))
        return F.struct(
            (at + n + F.length(p["tail"])).alias("at"),
            F.when(p["learn"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    def spans_of(ps: Column) -> Column:
        """The spans of each run of turns from its own start; then all of them, moved by the lengths of the runs before."""
        starts = F.sequence(F.lit(1), F.greatest(F.size(ps), F.lit(1)), F.lit(RUN))
        runs = F.transform(starts, lambda i: F.aggregate(F.slice(ps, i, RUN), zero, step))
        return _let(runs, lambda rs: _let(_starts(rs), lambda at: F.flatten(F.transform(rs, lambda r, k: _moved(r, F.get(at, k))))))

    formatted = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return marked.select("conv_id", formatted.alias("formatted"), spans_of(F.col("ps")).alias("loss_spans"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _moved(run: Column, by: Column) -> Column:
    return F.transform(run["spans"], lambda s: F.struct((s["at"] + by).alias("at"), s["len"].alias("len")))


def _starts(runs: Column) -> Column:
    """The places at which runs start: again sums over RUN of them at a time."""
    total = lambda rs: F.aggregate(rs, F.lit(0).cast("long"), lambda acc, r: acc + r["at"])
    starts = F.sequence(F.lit(0), F.size(runs) - 1)
    of_groups = F.transform(F.sequence(F.lit(0), (F.size(runs) / RUN).cast("int")), lambda g: total(F.slice(runs, 1, g * RUN)))
    own = lambda k: total(F.slice(runs, k - k % RUN + 1, k % RUN))
    return _let(of_groups, lambda gs: F.transform(starts, lambda k: F.get(gs, (k / RUN).cast("int")) + own(k)))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text: what the formatted strings say.

    The blocks are read back from `formatted`; loss_text is the unescaped text under
    loss_spans, in order, with nothing between.
    """
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2)
        body = F.substr(body, F.lit(1), F.length(body) - len(END))
        texts = F.split(body, r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    def under(span: Column, cut: Column) -> Column:
        first = (span["at"] / BLOCK).cast("int")
        last = ((span["at"] + span["len"]) / BLOCK).cast("int")
        some = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
        return unescape(F.substr(some, (span["at"] % BLOCK + 1).cast("int"), span["len"].cast("int")))

    cut = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(_let(cut, lambda c: F.transform("loss_spans", lambda s: under(s, c))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
