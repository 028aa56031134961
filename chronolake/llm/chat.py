"""Chat formatting in budgeted windows, in DataFrame functions only.

Turns fill a window while their prefix sums stay within the fresh budget; the next turn begins another. Each
window begins with the system turn, if there is room for it, and the last turns before it that fit both the history budget
and what is left of the whole, so every window is turn-aligned and, but for a single longer turn, within budget.
Repeated turns are masked: each assistant turn is a target once. Prefix sums are taken in blocks of turn
numbers, then over blocks; windows are filled in blocks of ``BLOCK`` turns, each of which begins a new window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import once

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 2048, 512
#: Tokens of the marks around a turn.
MARKS = 4
#: Turn numbers whose rows are summed in one task.
BLOCK = 256
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_TURN = r"(?s)<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _placed(conversations: DataFrame) -> DataFrame:
    """Turns with ``pos`` and ``before``: turns and tokens before each in its conversation."""
    turns = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select("*", (F.regexp_count("text", F.lit(_TOKEN)) + F.regexp_count("role", F.lit(_TOKEN)) + MARKS).cast("long").alias("tokens"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"))
    inner = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    numbered = turns.select("*", (F.row_number().over(inner) - 1).alias("_pos"), (F.sum("tokens").over(upto) - F.col("tokens")).alias("_before"))
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    outer = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    offsets = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), (F.sum("n").over(outer) - F.col("n")).alias("_n"), (F.sum("t").over(outer) - F.col("t")).alias("_t"))
    joined = numbered.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return joined.select("conv_id", "role", "text", "tokens", (F.col("_pos") + F.col("_n")).alias("pos"), (F.col("_before") + F.col("_t")).alias("before"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formats conversations: ``conv_id, window, tokens, text, context, loss``.

    ``text`` marks the turns of a window, ``tokens`` is at most ``budget`` unless a single turn has more, ``context``
    counts the turns at its front that earlier windows held as well, ``loss`` has (start, length) of each target by code points. Rows are ordered by turn, then role and
    text; null turns come first; null texts and roles are empty; repeated rows are turns of their own; null
    conv_ids are one conversation; a very long turn is a window of its own; no rows give no windows; extra columns are ignored.
    """
    placed = _placed(conversations)
    system = placed.where((F.col("pos") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("_sc"), F.col("tokens").alias("_s"), F.col("role").alias("_srole"), F.col("text").alias("_stext"))
    own = placed.join(system.select("_sc", "_s"), F.col("conv_id").eqNullSafe(F.col("_sc")), "left").drop("_sc")
    lead = F.when(F.col("_s") < budget, F.col("_s")).otherwise(0).cast("long")
    own = own.withColumn("lead", lead).withColumn("fresh", F.greatest(budget - history - F.col("lead"), F.floor((budget - F.col("lead")) / 2), F.lit(1)))
    own = own.withColumn("at", F.col("before") - F.coalesce("_s", F.lit(0))).where(F.col("_s").isNull() | (F.col("pos") > 0))
    # Each turn folds the tokens of those before it in its block, which are few, into its window's number.
    block = F.floor(F.col("pos") / BLOCK)
    upto = F.collect_list(F.struct("tokens", "fresh")).over(W.partitionBy("conv_id", block).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    start = F.struct(F.lit(-1).cast("long").alias("n"), F.lit(1 << 60).alias("held"))
    fill = lambda acc, t: F.when(acc["held"] + t["tokens"] <= t["fresh"], F.struct(acc["n"].alias("n"), (acc["held"] + t["tokens"]).alias("held"))).otherwise(F.struct((acc["n"] + 1).alias("n"), t["tokens"].alias("held")))
    turn = own.withColumn("_upto", upto).select("conv_id", (block * BLOCK + F.aggregate("_upto", start, fill)["n"]).alias("window"), "lead", "at", "tokens", "pos", "role", "text")

    spans = turn.groupBy("conv_id", "window").agg(F.min("at").alias("_from"), F.sum("tokens").alias("_fresh"), F.max("lead").alias("_lead"))
    spans = spans.withColumn("_led", (F.col("_lead") + F.col("_fresh") <= budget))
    spans = spans.withColumn("_room", F.least(F.lit(history), budget - F.col("_fresh") - F.when(F.col("_led"), F.col("_lead")).otherwise(0)))
    # History reaches back less than one cell of its size.
    cell = F.floor(F.col("_from") / history)
    reach = spans.where("_room > 0").select(F.col("conv_id").alias("_wc"), F.col("window").alias("_w"), "_from", "_room", F.explode(F.array(cell - 1, cell)).alias("_cell"))
    earlier = turn.join(reach, F.col("conv_id").eqNullSafe(F.col("_wc")) & (F.floor(F.col("at") / history) == F.col("_cell")) & (F.col("at") + F.col("tokens") <= F.col("_from")) & (F.col("at") >= F.col("_from") - F.col("_room")))
    only = spans.groupBy("conv_id").agg(F.min_by("window", "window").alias("_least"), F.min_by("_led", "window").alias("_fits"))
    firsts = system.join(only, F.col("_sc").eqNullSafe(F.col("conv_id")), "left").select("_sc", "_s", "_srole", "_stext", "_least", (F.coalesce("_fits", F.lit(False)) & (F.col("_s") < budget)).alias("_fits"))
    # Where it does not fit the first window, the system turn has one of its own before it.
    own_window = firsts.where(~F.col("_fits") | F.col("_least").isNull()).select(F.col("_sc").alias("conv_id"), F.lit(-1).cast("long").alias("window"), "_s", "_srole", "_stext", F.lit("fresh").alias("kind"))
    repeated = F.when(F.col("_fits") & (F.col("window") == F.col("_least")), "fresh").otherwise("again")
    led = spans.where("_led").join(firsts.where(F.col("_s") < budget), F.col("conv_id").eqNullSafe(F.col("_sc"))).select("conv_id", "window", "_s", "_srole", "_stext", repeated.alias("kind")).unionByName(own_window)

    piece = lambda w, pos, tokens, role, text, kind: ("conv_id", F.col(w).alias("window"), pos.alias("pos"), F.col(tokens).alias("tokens"), F.col(role).alias("role"), F.col(text).alias("text"), kind.alias("kind"))
    zero = F.lit(0).cast("long")
    parts = (
        turn.select(*piece("window", F.col("pos"), "tokens", "role", "text", F.lit("fresh")))
        .unionByName(earlier.select(*piece("_w", F.col("pos"), "tokens", "role", "text", F.lit("again"))))
        .unionByName(led.select(*piece("window", zero, "_s", "_srole", "_stext", F.col("kind"))))
    )
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    learn = (F.col("kind") == "fresh") & (F.col("role") == "assistant")
    written = parts.select("conv_id", "window", "tokens", F.struct("pos", head.alias("head"), escape(F.col("text")).alias("body"), learn.alias("learn"), (F.col("kind") == "again").alias("again")).alias("t"))
    grouped = written.groupBy("conv_id", "window").agg(F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list("t")).alias("ts"))
    close = f"{END}\n"
    # Lengths are folded, not texts: (offset so far, targets).
    size = F.transform("ts", lambda t: F.struct(F.char_length(t["head"]).cast("long").alias("h"), F.char_length(t["body"]).cast("long").alias("b"), t["learn"].alias("learn")))
    begin = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    target = lambda acc, s: F.array(F.struct((acc["at"] + s["h"]).alias("start"), s["b"].alias("length")))
    step = lambda acc, s: F.struct((acc["at"] + s["h"] + s["b"] + len(close)).alias("at"), F.when(s["learn"], F.concat(acc["loss"], target(acc, s))).otherwise(acc["loss"]).alias("loss"))
    return grouped.select(
        "conv_id", "window", "tokens",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(close))), "").alias("text"),
        F.size(F.filter("ts", lambda t: t["again"])).alias("context"),
        F.aggregate(size, begin, step)["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations in ``formatted`` windows, once each: turns and targets with their digests."""
    new = lambda group: F.regexp_extract_all("text", F.lit(_TURN), F.lit(group))
    whole = F.zip_with(new(1), new(2), lambda r, t: F.concat(unescape(r), F.lit("\n"), unescape(t), F.lit("\n")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    per_window = formatted.select("conv_id", "window", F.char_length("text").cast("long").alias("chars"), "context", F.array_join(targets, "").alias("targets"), once(whole).alias("_turns"))
    per_window = per_window.select("conv_id", "window", "chars", "targets", (F.size("_turns") - F.col("context")).alias("n"), F.array_join(F.slice("_turns", F.col("context") + 1, F.greatest(F.size("_turns"), F.lit(1))), "").alias("turns"))
    # The digest of a conversation is over all of it, so its windows meet here, in order.
    one = per_window.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("ws"))
    joined = one.select("conv_id", "n_turns", "formatted_chars", F.array_join("ws.turns", "").alias("turns"), F.array_join("ws.targets", "").alias("targets"))
    return joined.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("targets").cast("long").alias("loss_chars"), F.sha2("targets", 256).alias("loss_sha256"), "formatted_chars")
