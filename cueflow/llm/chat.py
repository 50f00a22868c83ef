r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn renders as ``<|im_start|>ROLE\nTEXT<|im_end|>\n``; a conversation is its turns in
order.  The grammar: a formatted text is a sequence of turns and nothing else; each opens
with ``<|im_start|>`` and closes with ``<|im_end|>\n``, and neither control string, nor
``<|nl|>``, stands anywhere else.  The parser is deterministic: it cuts at every
``<|im_start|>``, gives up (null) unless each piece ends with the only ``<|im_end|>`` in it,
takes the role up to the first newline and undoes escapes.  An escape puts one more backslash
between ``<`` and ``|`` wherever a text has these two with any number of backslashes between
them, so an escaped text has no ``<|``; undoing it takes one backslash away.  A newline in a
role is ``<|nl|>``.

The round trip: every turn is rendered as it is, parsed again and compared with its source;
turns that don't come back are escaped.  The whole conversation is then rendered, parsed and
compared again, with every turn escaped if it still differs.  A conversation that differs
even then would fail the job (the grammar excludes it).

The loss mask is a list of (start, length) in code points of the formatted text, over what
assistants said.

Defined results: null role or text is empty; turns sort by turn (nulls first), equal turns by role and
text; repeated rows are repeated turns; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TURN = "struct<turn:bigint,role:string,text:string>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def rendered(role: Column, text: Column, escape: Column) -> tuple[Column, Column, Column]:
    """Head, body and tail of a turn in the template."""
    head = F.concat(F.lit(START), F.replace(F.when(escape, escaped(role)).otherwise(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    return head, F.when(escape, escaped(text)).otherwise(text), F.lit(END)


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; null if it isn't one of the grammar."""

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(1), F.length(piece) - len(END))
        cut = F.locate("\n", inner)
        role = F.replace(F.substring(inner, F.lit(1), cut - 1), F.lit(NEWLINE), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    pieces = F.split(formatted, r"<\|im_start\|>")
    turns = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    closed = lambda p: F.endswith(p, F.lit(END)) & (F.locate(END[:-1], p) == F.length(p) - len(END) + 1) & (F.locate("\n", p) < F.length(p))
    return F.when((F.element_at(pieces, 1) == "") & F.forall(turns, closed), F.transform(turns, turn))


def _conversations(turns: DataFrame, escape: Column) -> DataFrame:
    """conv_id, formatted, source (role, text), escapes and mask from turns(conv_id, turn, role, text)."""
    head, body, tail = rendered(F.col("role"), F.col("text"), escape)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    pieces = turns.withColumn("escape", escape).withColumn("head", head).withColumn("body", body).withColumn("piece", F.concat("head", "body", tail))
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)) + F.length("head")).withColumn("nr", F.count("*").over(order))
    rows = F.sort_array(F.collect_list(F.struct("nr", "piece", "role", "text", "escape", "at", F.length("body").alias("length"))))
    return placed.groupBy("conv_id").agg(rows.alias("rows")).select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
        F.transform(F.filter("rows", lambda r: r["role"] == "assistant"), lambda r: F.struct((r["at"] + 1).cast("int").alias("start"), r["length"].alias("length"))).alias("loss_spans"),
        F.exists("rows", lambda r: r["escape"]).alias("any_escaped"),
    )


def formatted_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length), any_escaped."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A turn alone: does its rendering come back as this one turn?
    plain = parsed(F.concat(*rendered(F.col("role"), F.col("text"), F.lit(False))))
    own = F.array(F.struct("role", "text"))
    marked = turns.withColumn("conflict", ~plain.eqNullSafe(own))
    first = _conversations(marked, F.col("conflict")).withColumn("back", parsed(F.col("formatted")))
    good = first.where(F.col("back").eqNullSafe(F.col("source")))
    bad = first.where(~F.col("back").eqNullSafe(F.col("source"))).select("conv_id").distinct()
    again = turns.join(bad, turns["conv_id"].eqNullSafe(bad["conv_id"]), "left_semi")
    second = _conversations(again, F.lit(True))
    checked = second.withColumn("formatted", F.when(parsed(F.col("formatted")).eqNullSafe(F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't survive the round trip"))))
    columns = ["conv_id", "formatted", "loss_spans", "any_escaped"]
    return good.select(*columns).unionByName(checked.select(*columns))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What formatted_chats wrote, read back: turns, their digest, and the text under the loss mask."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    return chats.withColumn("turns", parsed(F.col("formatted"))).withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
