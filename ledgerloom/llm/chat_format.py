"""Preference formatting: the longest common turn prefix of two conversations, rendered once.

chosen and rejected share their first turns; these become the prompt. What follows in each becomes
its completion, a list of segments with a mask: trained on are only the texts of the trained roles,
with the mark that ends the turn. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Template of a turn (fixed values).
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = ("assistant",)


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _segments(turns: Column, trained: tuple[str, ...]) -> Column:
    """Two segments a turn: its head, never trained on, and its body."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(_head(t).alias("text"), F.lit(False).alias("trained")),
                F.struct(_body(t).alias("text"), F.coalesce(t["role"].isin(*trained), F.lit(False)).alias("trained")),
            ),
        )
    )


def _trained_spans(turns: Column, trained: tuple[str, ...]) -> Column:
    """(start, end) of the code points of the rendered turns that are trained on."""
    size = lambda c: F.length(c).cast("long")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + size(_head(t))
        end = begin + size(_body(t))
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"].isin(*trained), F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preferences(turns: DataFrame, pairs: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row for each row of pairs (pair_id, chosen_id, rejected_id), ids of conversations.

    turns: (conv_id, turn, role, text). Result: pair_id, chosen_id, rejected_id, n_prefix (turns of the
    prompt), prompt, chosen and rejected (array of text, trained), chosen_text and rejected_text, their masks
    chosen_spans and rejected_spans (start and end, in code points of the text, of what is trained on), and
    n_chosen_trained and n_rejected_trained (code points trained on).

    Turns are ordered by turn, then role and text (nulls first); repeated rows are repeated turns.
    Two turns are equal when role and text are, a null being equal to a null; a null renders as an
    empty text. Rows with a null conv_id belong to no conversation. An id without turns, or a null
    one, is a conversation without turns. A conversation is one value of the result, so its turns
    meet in one row; pairs and conversations spread over the cluster by their ids.
    """
    chats = (
        turns.where(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    side = lambda name: chats.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"{name}_turns"))
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    both = (
        pairs.select("pair_id", "chosen_id", "rejected_id")
        .join(side("chosen"), "chosen_id", "left")
        .join(side("rejected"), "rejected_id", "left")
        .withColumns({f"{s}_turns": F.transform(F.coalesce(f"{s}_turns", none), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) for s in ("chosen", "rejected")})
    )
    differ = F.array_position(F.zip_with("chosen_turns", "rejected_turns", lambda a, b: a.eqNullSafe(b)), False)
    shorter = F.least(F.size("chosen_turns"), F.size("rejected_turns"))
    # beyond the shorter conversation zip_with pads with null, which differs from every turn
    both = both.withColumn("n_prefix", F.when(differ > 0, F.least(differ - 1, shorter)).otherwise(shorter).cast("long"))
    rest = lambda s: F.slice(f"{s}_turns", F.col("n_prefix").cast("int") + 1, F.size(f"{s}_turns"))
    n_trained = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda acc, t: acc + F.when(t["role"].isin(*trained), F.length(_body(t))).otherwise(0))
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prefix",
        _render(F.slice("chosen_turns", F.lit(1), F.col("n_prefix").cast("int"))).alias("prompt"),
        _segments(rest("chosen"), trained).alias("chosen"),
        _segments(rest("rejected"), trained).alias("rejected"),
        _render(rest("chosen")).alias("chosen_text"),
        _render(rest("rejected")).alias("rejected_text"),
        _trained_spans(rest("chosen"), trained).alias("chosen_spans"),
        _trained_spans(rest("rejected"), trained).alias("rejected_spans"),
        n_trained(rest("chosen")).alias("n_chosen_trained"),
        n_trained(rest("rejected")).alias("n_rejected_trained"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of the conversations 2k (chosen) and 2k + 1 (rejected); one without its partner stands against no turns."""
    return (
        turns.where(F.col("conv_id").isNotNull())
        .select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), "conv_id")
        .groupBy("pair_id")
        .agg(F.min(F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id"))).alias("chosen_id"), F.min(F.when(F.pmod("conv_id", F.lit(2)) == 1, F.col("conv_id"))).alias("rejected_id"))
    )
