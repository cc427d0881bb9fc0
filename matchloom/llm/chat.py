"""Preference formatting: two conversations that start alike become one prompt and two masked completions.

``chosen`` and ``rejected`` are arrays of turns (role, text). Their longest common prefix of turns is rendered once, as
the prompt; the rest of each is its completion. Spans mark the characters of prompt + completion that are learned
from: the texts of the assistant's turns in the completion, with the closing mark. Everything is native column
expressions over one row, so nothing is shuffled beyond bringing a conversation's turns together.

A null role counts as ``user``, a null text as empty, a null array as no turns. Marks inside a text are broken up, so
a text cannot close its own turn. If both conversations are the same in full, ``identical`` is true, the prompt is all of
it and both completions are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, turns``: the turns of each conversation in order; one conversation's turns meet in one group.

    Repeated rows count once; turns with the same number are ordered by role and text. Null ids or numbers take no part.
    """
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull())
    grouped = kept.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    differs = F.array_position(same, False)
    return F.when(differs == 0, n).otherwise((differs - 1).cast("int"))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit(MIDDLE), _safe(turn["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learned_spans(turns: Column, offset: Column) -> Column:
    """Start and end of what is learned, counted in characters from the start of the prompt."""
    zero = F.struct(offset.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        after = state["at"] + F.length(rendered(turn))
        head = F.length(_safe(turn["role"])) + len(OPEN) + len(MIDDLE)
        span = F.struct((state["at"] + head).alias("start"), after.alias("end"))
        return F.struct(after.alias("at"), F.when(turn["role"] == LEARNED, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: state["spans"])


def format_pairs(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """From ``id, chosen, rejected``: n_common, prompt, two completions and their spans, and identical."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select(F.col(id_col).alias("id"), F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    rows = rows.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    rows = rows.select(
        "id",
        F.col("n").alias("n_common"),
        render(F.slice("chosen", 1, F.col("n"))).alias("prompt"),
        tail("chosen").alias("chosen"),
        tail("rejected").alias("rejected"),
    )
    at = F.length("prompt")
    return rows.select(
        F.col("id").alias(id_col),
        "n_common",
        "prompt",
        render(F.col("chosen")).alias("chosen"),
        render(F.col("rejected")).alias("rejected"),
        learned_spans(F.col("chosen"), at).alias("chosen_spans"),
        learned_spans(F.col("rejected"), at).alias("rejected_spans"),
        ((F.size("chosen") == 0) & (F.size("rejected") == 0)).alias("identical"),
    )


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: rejected is a conversation with the last answer of its neighbour by id.

    Conversations 2n and 2n + 1 are neighbours. The last turn is swapped if it is the assistant's and the neighbour has
    an answer; otherwise the rejected side just ends before it.
    """
    convs = turns_of(conversations)
    answers = F.filter("turns", lambda t: t["role"] == LEARNED)
    # negative ids too: x xor 1
    last = convs.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.try_element_at(answers, F.lit(-1)).alias("other"))
    rows = convs.join(last, "id", "left")
    answered = F.element_at("turns", -1)["role"] == LEARNED
    before = F.slice("turns", 1, F.size("turns") - F.when(answered, 1).otherwise(0))
    return rows.select("id", F.col("turns").alias("chosen"), F.when(F.col("other").isNull() | ~answered, before).otherwise(F.array_append(before, F.col("other"))).alias("rejected"))


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation against its swapped form; spans as text, so that any engine compares them."""
    got = format_pairs(swapped_pairs(conversations))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return got.select(
        F.col("id").alias("conv_id"),
        F.col("n_common").cast("long").alias("n_common"),
        "prompt",
        "chosen",
        "rejected",
        shown("chosen_spans").alias("chosen_spans"),
        shown("rejected_spans").alias("rejected_spans"),
        "identical",
    )
