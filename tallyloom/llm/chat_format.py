"""Relational chat formatting: turns to one string per conversation, with a loss mask.

Template, per block of adjacent turns of one role::

    <|ROLE|>\\nTEXT<|turn|>TEXT ...<|end|>\\n

Texts and roles are escaped (``&`` ``<`` ``[``, in roles ``|`` too), so that neither
the template's own marks nor marks such as ``</s>`` or ``[INST]`` can come from a
text; the escape is reversed by :func:`read_back`. The loss mask is a list of spans
(0-based start, length, in code points of ``formatted``), one for each assistant text.

Everything is built-in: windows for neighbours' roles and running lengths, then collect, sort, transform and join, linear in a conversation's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The escape: text character, its written form. The first one must stay first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("|", "&#124;"))
TURN_MARK, END_MARK = "<|turn|>", "<|end|>\n"


def _literal(text: str) -> Column:
    return F.lit(text)


def escape(col: Column, pairs=ESCAPES) -> Column:
    for raw, safe in pairs:
        col = F.replace(col, _literal(raw), _literal(safe))
    return col


def unescape(col: Column, pairs=ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        col = F.replace(col, _literal(safe), _literal(raw))
    return col


def format_chats(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted string, loss_spans array<struct<start, len>>.

    Input columns: conv_id, turn, role, text; any others are left out.
    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows give one
    defined order and each row stays a turn. A null text or role counts as empty; rows
    with a null conv_id form one conversation. No rows give no rows. A conversation is one
    value and so must fit into one row (2 GB).
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # dealt as the list of a conversation needs it
    near = rows.select("*", F.lag("role").over(order).alias("before"), F.lead("role").over(order).alias("after"), F.row_number().over(order).alias("pos"))
    starts, ends = (F.coalesce(F.col(c) != F.col("role"), F.lit(True)) for c in ("before", "after"))
    pieces = near.select(
        "conv_id", "turn", "role", "text", "pos",
        F.when(starts, F.concat(F.lit("<|"), escape(F.col("role"), ROLE_ESCAPES), F.lit("|>\n"))).otherwise(F.lit(TURN_MARK)).alias("head"),
        escape(F.col("text")).alias("body"), F.when(ends, F.lit(END_MARK)).otherwise(F.lit("")).alias("tail"), (F.col("role") == loss_role).alias("loss"),
    )
    chars = lambda c: F.length(c).cast("bigint")
    upto = F.sum(chars("head") + chars("body") + chars("tail")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.select("conv_id", "pos", F.concat("head", "body", "tail").alias("piece"), (upto - chars("tail") - chars("body")).alias("start"), chars("body").alias("len"), "loss")
    listed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "start", "len", "loss"))).alias("turns"))
    return listed.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["len"].alias("len"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_texts array<string>, from the output alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")
    role = lambda b: F.substring_index(F.substring(b, 3, 2147483647), "|>", 1)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(b.substr(F.length(role(b)) + 6, F.length(b)), r"<\|turn\|>"),
                lambda t: F.struct(unescape(role(b), ROLE_ESCAPES).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["len"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))
