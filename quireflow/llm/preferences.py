"""Preference formatting of conversations. DataFrame and SQL functions only.

Two conversations with the same opening turn answer the same prompt: the one with the lesser conv_id is taken as chosen,
the other as rejected. Their longest common prefix of turns is rendered once as the prompt; what follows are the
two completions, with masks that keep the loss to what the assistant says.

Defined results: turns are in the order of turn (null first), then role and text; null role or text counts as empty;
repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; of the conversations
with an opening, each has one partner at most; the odd one, and one whose opening nobody shares, has a row with no rejected
side, its last assistant turn as completion and all before as prompt (no assistant turn: all is prompt). Where one
conversation continues the other, the shorter one's completion is empty; for equal ones both are. An empty table gives an
empty result; very long texts and conversations are rendered whole, a conversation in one task; only conv_id, turn, role and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import stored

#: Conversations with one opening are paired in so many parts, then what is left of the parts: at most one of each.
PARTS = 256


def assembled(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, role, text) in order."""
    c = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return c.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """Pairs neighbours by conv_id: pair is the lesser one's conv_id; the last of an odd number has none."""
    w = Window.partitionBy(*by).orderBy("conv_id")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("before", F.lag("conv_id").over(w)).withColumn("after", F.lead("conv_id").over(w))
    pair = F.when(F.col("rank") % 2 == 0, F.col("before")).otherwise(F.when(F.col("after").isNotNull(), F.col("conv_id")))
    return rows.withColumn("pair", pair)


def pairs(conversations: DataFrame, parts: int = PARTS) -> DataFrame:
    """conv_id, pair (the chosen one's conv_id; its own if it has no partner), from conv_id and opening."""
    first = _ranked(conversations.select("conv_id", "opening", F.pmod(F.col("conv_id"), F.lit(parts)).alias("part")), "opening", "part")
    first = stored(first.select("conv_id", "opening", "pair"), "pairs")
    rest = _ranked(first.filter("pair IS NULL").select("conv_id", "opening"), "opening")
    return first.filter("pair IS NOT NULL").select("conv_id", "pair").unionByName(rest.select("conv_id", F.coalesce("pair", "conv_id").alias("pair")))


def common_turns(a: str, b: str) -> Column:
    """The length of the longest common prefix of two arrays of turns, by role and text."""
    same = f"{a}[i].role = {b}[i].role AND {a}[i].text = {b}[i].text"
    n = f"least(size({a}), size({b}))"
    return F.expr(f"CASE WHEN {n} = 0 THEN 0 ELSE aggregate(sequence(0, {n} - 1), 0, (n, i) -> CASE WHEN n = i AND {same} THEN n + 1 ELSE n END) END")


OPEN, MID, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MID), t["text"], F.lit(CLOSE))), "")


def mask(turns: str) -> Column:
    """start:end, comma-joined, in code points of the rendered turns: the texts of assistant turns with their closing mark."""
    head = f"a.at + {len(OPEN) + len(MID)} + length(t.role)"
    end = f"{head} + length(t.text) + {len(CLOSE)}"
    out = f"CASE WHEN t.role = 'assistant' THEN concat(a.out, array(concat_ws(':', {head}, {end}))) ELSE a.out END"
    return F.array_join(F.expr(f"aggregate({turns}, named_struct('at', 0, 'out', cast(array() AS array<string>)), (a, t) -> named_struct('at', {end}, 'out', {out}), a -> a.out)"), ",")


def formatted(both: DataFrame) -> DataFrame:
    """From pair, chosen_id, rejected_id and the arrays of turns a (chosen) and b (rejected, or null): the training rows."""
    last = F.expr("coalesce(element_at(filter(transform(a, (t, i) -> CASE WHEN t.role = 'assistant' THEN i END), i -> i IS NOT NULL), -1), size(a))")
    n = F.when(F.col("b").isNotNull(), common_turns("a", "b")).otherwise(F.when(F.exists("a", lambda t: t["role"] == "assistant"), last).otherwise(F.size("a")))
    f = both.withColumn("n", n).withColumn("prefix", F.expr("slice(a, 1, n)"))
    f = f.withColumn("x", F.expr("slice(a, n + 1, size(a))")).withColumn("y", F.expr("slice(b, n + 1, size(b))"))
    return f.select(
        "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_common"), rendered(F.col("prefix")).alias("prompt"),
        rendered(F.col("x")).alias("chosen"), rendered(F.col("y")).alias("rejected"), mask("x").alias("chosen_mask"), mask("y").alias("rejected_mask"),
    )


def preferences(conversations: DataFrame, parts: int = PARTS) -> DataFrame:
    """A row for each pair of conversations with the same opening turn, and for each that is left without a partner."""
    c = stored(assembled(conversations), "conversations")
    opening = F.sha2(F.concat(F.length(F.col("turns")[0]["role"]).cast("string"), F.lit(":"), F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256)
    p = pairs(c.select("conv_id", opening.alias("opening")), parts)
    joined = c.join(p, "conv_id")
    chosen = F.col("conv_id") == F.col("pair")
    side = lambda when, x: F.first(F.when(when, F.col(x)), ignorenulls=True)
    both = joined.groupBy("pair").agg(side(chosen, "turns").alias("a"), side(~chosen, "turns").alias("b"), F.first(F.when(~chosen, F.col("conv_id")), ignorenulls=True).alias("rejected_id"))
    return formatted(both.withColumnRenamed("pair", "chosen_id"))
