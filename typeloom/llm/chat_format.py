"""Chat formatting by prefix-target expansion.

Turns are rendered with a template that marks each turn and escapes control strings
inside roles and texts reversibly. Every assistant turn is then exploded into an example
of its own: all preceding turns are its context and only its reply is trainable.

A conversation's contexts are prefixes of its one rendered text. The examples therefore
carry the length of their prefix and their target's text; contexts() writes the prefixes
out for a trainer that needs them. Storing them all would grow with the square of a
conversation's turns.

Turns stand in the order of (turn, role, text), so ties and repeated rows have one order.
Null roles and texts are empty; a null conv_id is a conversation like any other. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINABLE = "assistant"
#: Escapes, applied in this order and undone in the reverse order. No "<" or "[" is left in an
#: escaped text, so none of "<|...|>", "</s>" or "[INST]" can occur in it.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
#: A role ends at its line's end.
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, safe in pairs:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, safe in reversed(pairs):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def render(turns: DataFrame) -> DataFrame:
    """conv_id, rendered (the whole conversation's formatted text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
    return whole.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("rendered"))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation: array of struct(raw, role, text), raw still escaped."""
    pieces = F.filter(F.split(rendered, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    head = lambda p: F.substring_index(body(p), "\n", 1)
    raw = lambda p: F.substr(body(p), F.length(head(p)) + 2)
    return F.transform(pieces, lambda p: F.struct(p.alias("piece"), raw(p).alias("raw"), unescape(head(p), ROLE_ESCAPES).alias("role"), unescape(raw(p)).alias("text")))


def examples(rendered: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, turn_no, context_chars, target (escaped), target_chars.

    The context is the first context_chars of the rendered text: all preceding turns and the
    head of this one. Only target is under the loss mask.
    """
    turns = rendered.select("conv_id", parse(F.col("rendered")).alias("turns"))
    # Running ends of the turns, so that each example knows its place without a second pass.
    ends = F.aggregate("turns", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t["piece"]) + len(CLOSE))))
    placed = turns.select("conv_id", F.posexplode(F.arrays_zip("turns", F.slice(ends, 1, F.size("turns")).alias("start"))).alias("turn_no", "z"))
    mine = placed.where(F.col("z.turns.role") == TRAINABLE)
    raw = F.col("z.turns.raw")
    return mine.select("conv_id", "turn_no", (F.col("z.start") + F.length("z.turns.piece") - F.length(raw)).cast("long").alias("context_chars"), raw.alias("target"), F.length(raw).cast("long").alias("target_chars"))


def contexts(rendered: DataFrame, some: DataFrame) -> DataFrame:
    """examples with the text of their context written out."""
    return some.join(rendered, some.conv_id.eqNullSafe(rendered.conv_id)).select(some["*"], F.expr("substring(rendered, 1, int(context_chars))").alias("context"))
