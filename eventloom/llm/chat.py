"""Preference formatting: one shared prompt and two masked completions for a pair of conversations.

The prompt is the longest run of turns that chosen and rejected have in common, rendered once; what follows is
rendered for each side, with a mask that trains on the assistant's words only. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def plain(text: Column) -> Column:
    """Text that can't be taken for a marker; null becomes empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))


def turns_of(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each conversation of (keys, turn, role, text), its turns in order as array of (role, text).

    Equal turn numbers go by role, then text. A null turn number comes first, null roles and texts are empty. A
    conversation is one training example and has to fit a row, as its rendered form must.
    """
    turn = F.struct("turn", plain(F.col("role")).alias("role"), plain(F.col("text")).alias("text"))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    bare = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return listed.select(*keys, bare.alias("turns"))


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(END))), "")


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns at the start that are equal on both sides."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(chosen)).otherwise(first - 1).cast("int")


def mask_runs(turns: Column) -> Column:
    """The loss mask as run lengths in characters: for each turn how many to skip, then how many to train on.

    An assistant's turn is trained on its text and its end marker, any other turn is skipped whole.
    """

    def runs(t: Column) -> Column:
        ahead, body = F.length(header(t)), F.length(t["text"]) + len(END)
        trained = t["role"] == ASSISTANT
        return F.concat_ws(",", F.when(trained, ahead).otherwise(ahead + body), F.when(trained, body).otherwise(0))

    return F.array_join(F.transform(turns, runs), ",")


def trained_chars(turns: Column) -> Column:
    answers = F.filter(turns, lambda t: t["role"] == ASSISTANT)
    return F.aggregate(answers, F.lit(0).cast("bigint"), lambda n, t: n + F.length(t["text"]) + len(END))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Add prompt, completions and masks to pairs(..., chosen, rejected), arrays of (role, text).

    Adds prompt_turns, prompt, chosen_text, rejected_text, chosen_mask, rejected_mask, chosen_trained,
    rejected_trained and drops the arrays. Sides that are equal leave both completions empty; sides that differ
    from their first turn leave the prompt empty. A null side counts as no turns. Other columns are kept, those
    of the names above replaced.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    chosen, rejected = F.coalesce("chosen", none), F.coalesce("rejected", none)
    counted = pairs.withColumns({"chosen": chosen, "rejected": rejected}).withColumn("prompt_turns", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {side: F.slice(side, F.col("prompt_turns") + 1, F.size(side)) for side in ("chosen", "rejected")}
    made = {"prompt": rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns")))}
    for side, turns in rest.items():
        made |= {f"{side}_text": rendered(turns), f"{side}_mask": mask_runs(turns), f"{side}_trained": trained_chars(turns)}
    return counted.withColumns(made).drop("chosen", "rejected")


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) from plain conversations(conv_id, turn, role, text).

    Conversations 2k and 2k + 1 are partners. Chosen is a conversation as it is; rejected is the conversation up to
    its last assistant turn, with the last assistant turn of the partner in that place: fluent, but an answer to
    something else. A conversation whose partner is missing, or that lacks an answer on either side, makes no
    pair. Rows without conv_id belong to no conversation. All rows move once, by partner.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", F.shiftright("conv_id", 1).alias("_both"), "turn", "role", "text")
    each = turns_of(rows.repartition("_both"), "_both", "conv_id")
    answer = F.get(F.reverse(F.filter("turns", lambda t: t["role"] == ASSISTANT)), F.lit(0))
    backwards = F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), ASSISTANT)
    ahead = F.slice("turns", F.lit(1), F.size("turns") - backwards.cast("int"))
    # two conversations at most
    both = each.select("_both", F.struct("conv_id", "turns", answer.alias("answer"), ahead.alias("ahead")).alias("c")).groupBy("_both").agg(F.collect_list("c").alias("cs"))
    facing = both.where(F.size("cs") == 2).select(
        F.explode(F.array(*[F.struct(F.get("cs", F.lit(i)).alias("own"), F.get("cs", F.lit(1 - i))["answer"].alias("other")) for i in (0, 1)])).alias("p")
    )
    answered = facing.where("p.own.answer is not null and p.other is not null")
    return answered.select("p.own.conv_id", F.col("p.own.turns").alias("chosen"), F.concat("p.own.ahead", F.array("p.other")).alias("rejected"))
