r"""Chat formatting as relational expressions.

A conversation's turns are collected as structs and sorted by (turn, role, text). Positions where the role changes cut the
array into slices, each slice of one role is aggregated into a block, and the blocks are concatenated:

    <|im_start|>role \n text <|turn|> text <|im_end|> \n

Inside roles and texts ``\`` becomes ``\\``, a line end of a role ``\n``, and ``<|`` becomes ``<\|``, so no control
string can stand there, and reading back is exact. The loss mask lists, in order, runs of bytes (UTF-8) that are under the
loss or not; what is under the loss is read by cutting these runs out of the formatted text.

One output row is one conversation, so its turns meet in one row; partial aggregation gathers them in each task before
the shuffle. A conversation is bounded by what a string can hold, 2 GB; adding up run lengths copies an array of places,
which is noticeable from about 50,000 turns on.

Nulls and edge cases: null text and null role are empty. A null turn comes first. Turns that tie are ordered by role, then
text; repeated rows are turns of their own. A null conv_id is a conversation of its own. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN = "<|im_start|>", "<|im_end|>\n", "<|turn|>"


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(x, F.lit("<|"), F.lit("<\\|"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\n"))


def unescape(x: Column) -> Column:
    """Between doubled backslashes, the other escapes are undone."""
    parts = F.split(x, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """From conv_id, turn, role, text: conv_id, formatted, mask (array of length, in bytes, and loss)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))
    # where each slice of one role begins (from 1), and one past the last turn
    places = F.sequence(F.lit(1), F.size("turns"))
    begins = F.filter(places, lambda i: (i == 1) | (F.get("turns", i - 1).role != F.get("turns", i - 2).role))
    rows = rows.withColumn("begins", F.concat(begins, F.array(F.size("turns") + 1)))

    def block(i: Column, k: Column) -> Column:
        role = F.get("turns", i - 1).role
        bodies = F.transform(F.slice("turns", i, F.get("begins", k + 1) - i), lambda x: escape(x.text))
        return F.struct(F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), bodies.alias("bodies"), (role == loss_role).alias("loss"))

    rows = rows.select("conv_id", F.transform(F.slice("begins", 1, F.size("begins") - 1), block).alias("blocks"))
    run = lambda length, loss: F.struct(length.cast("long").alias("length"), loss.alias("loss"))
    rest = lambda x: run(F.lit(len(x)), F.lit(False))

    def runs(b: Column) -> Column:
        texts = F.flatten(F.transform(b.bodies, lambda x: F.array(run(F.octet_length(x), b.loss), rest(TURN))))
        return F.concat(F.array(run(F.octet_length(b.head), F.lit(False))), F.slice(texts, 1, F.size(texts) - 1), F.array(rest(END)))

    written = F.transform("blocks", lambda b: F.concat(b.head, F.array_join(b.bodies, TURN), F.lit(END)))
    return rows.select("conv_id", F.array_join(written, "").alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """From formatted and mask: conv_id, formatted, turns (array of role, text), loss (array of the texts under the loss)."""
    literal = lambda x: "\\Q" + x + "\\E"
    blocks = F.split(F.expr("substr(formatted, 1, length(formatted) - " + str(len(END)) + ")"), literal(END), -1)
    role = lambda b: F.substring_index(b, "\n", 1)
    rest = lambda b: F.substr(b, F.length(role(b)) + 2)

    def turns(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(START) + 1))
        return F.transform(F.split(rest(inner), literal(TURN), -1), lambda t: F.struct(unescape(role(inner)).alias("role"), unescape(t).alias("text")))

    # where the runs under the loss lie: their lengths are added up along the mask
    span = lambda at, length: F.array(F.struct(at.alias("at"), length.alias("length")))
    nothing = F.array().cast("array<struct<at: bigint, length: bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("end"), nothing.alias("spans"))
    spans = F.aggregate("mask", start, lambda a, m: F.struct((a.end + m.length).alias("end"), F.when(m.loss, F.concat(a.spans, span(a.end, m.length))).otherwise(a.spans).alias("spans"))).spans
    rows = chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.col("formatted").cast("binary").alias("bytes"), spans.alias("spans"))
    cut = lambda x: unescape(F.decode(F.substring("bytes", (x.at + 1).cast("int"), x.length.cast("int")), "UTF-8"))
    return rows.select("conv_id", "formatted", "turns", F.transform("spans", cut).alias("loss"))
