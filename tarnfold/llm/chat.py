"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns become ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so that no text can hold a marker, and reading undoes it.

Prefix sums of turn tokens choose the windows: a conversation's tokens are cut every
``step``, and a turn belongs to the stretch its first token is in. A turn of more than one
step has a window of its own. As ``step`` is half of what the system turn and the history leave,
a window keeps to the budget, but for a single turn that is too long for any. Every window
begins with the system turn and the turns before it that begin within ``history`` tokens;
both are left out of the loss there, so that each target counts once.

The sums are taken within blocks of turns first and then over the blocks, so that one
long conversation is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


@dataclass(frozen=True)
class Settings:
    """All in tokens, estimated as a quarter of the bytes; ``block`` in turns."""

    budget: int = 1024
    history: int = 256
    least_step: int = 64
    block: int = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(
    turns: DataFrame, settings: Settings = Settings(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per window: conv, window, text, repeated_chars, n_tokens, n_turns and loss_spans.

    ``repeated_chars``: length of the repeated part the text begins with. ``loss_spans``: begin and
    length, in characters, of each assistant text that counts. NULL roles and texts are empty, a
    NULL conversation is one of its own, NULL turn numbers come first, and rows with equal numbers
    follow by role and text; repeated rows all stay. Other columns are not used.
    """
    s = settings
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    ).withColumn("head", F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n")))
    rows = rows.withColumn("shown", F.concat("head", "body", F.lit(f"{END}\n"))).withColumn(
        "tokens", F.ceil(F.octet_length("shown") / 4).cast("long")
    )
    rows = rows.withColumn("block", F.floor(F.col("turn") / s.block))
    order = ["turn", "role", "body"]
    inside = W.partitionBy("conv", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("tokens").over(inside)).withColumn("nth", F.count("*").over(inside))
    over = W.partitionBy("conv").orderBy("block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    per_block = rows.groupBy("conv", "block").agg(
        F.sum("tokens").alias("all_tokens"), F.count("*").alias("all_turns"), F.min(F.struct(*order, "tokens", "shown")).alias("opening")
    )
    first = F.first("opening").over(over)
    per_block = per_block.select(
        F.col("conv").alias("b_conv"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("all_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("all_turns").over(before), F.lit(0)).alias("turns_before"),
        F.when(first.role == "system", first.tokens).otherwise(0).alias("system_tokens"),
        F.when(first.role == "system", first.shown).otherwise("").alias("system"),
    )
    rows = rows.join(per_block, F.col("conv").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    rows = rows.withColumn("place", F.col("turns_before") + F.col("nth"))
    is_system = (F.col("place") == 1) & (F.col("system") != "")
    step = F.greatest(F.lit(s.least_step), F.floor((F.lit(s.budget - s.history) - F.col("system_tokens")) / 2))
    rows = rows.withColumn("step", step).withColumn(
        "begin", F.when(is_system, 0).otherwise(F.col("tokens_before") + F.col("upto") - F.col("tokens") - F.col("system_tokens"))
    )
    rows = rows.withColumn("cell", F.floor(F.col("begin") / F.col("step"))).withColumn(
        "window", 2 * F.col("cell") + F.when(~is_system & (F.col("tokens") > F.col("step")), 1).otherwise(0)
    )
    columns = ["conv", "window", "place", "role", "head", "body", "shown", "tokens", "system", "system_tokens"]
    fresh = rows.select(*columns, F.lit(True).alias("fresh"))
    spans = rows.groupBy("conv", "window").agg(F.min("begin").alias("s_begin"), F.min("step").alias("s_step"))
    spans = spans.select(
        F.col("conv").alias("s_conv"), F.col("window").alias("s_window"), "s_begin", F.floor(F.col("s_begin") / F.col("s_step")).alias("s_cell")
    )
    reach = F.explode(F.sequence(F.col("cell"), F.floor((F.col("begin") + s.history) / F.col("step"))))
    early = rows.filter(~is_system & (F.col("tokens") <= s.history)).withColumn("ahead", reach)
    history = early.join(spans, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("ahead") == F.col("s_cell"))).filter(
        (F.col("s_begin") >= F.col("begin") + F.col("tokens")) & (F.col("s_begin") - F.col("begin") <= s.history)
    )
    history = history.drop("window").withColumnRenamed("s_window", "window").select(*columns, F.lit(False).alias("fresh"))
    again = F.when(F.col("window") == 0, "").otherwise(F.col("system"))
    ordered = W.partitionBy("conv", "window").orderBy("place", "role", "body").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = fresh.union(history).withColumn("end", F.char_length(again) + F.sum(F.char_length("shown")).over(ordered))
    target = F.struct(
        (F.col("end") - F.char_length("shown") + F.char_length("head")).cast("long").alias("begin"),
        F.char_length("body").cast("long").alias("length"),
    )
    grouped = placed.groupBy("conv", "window").agg(
        F.first(again).alias("again"),
        F.array_sort(F.collect_list(F.struct("end", "shown"))).alias("parts"),
        F.sum(F.when(~F.col("fresh"), F.char_length("shown")).otherwise(0)).alias("old_chars"),
        F.sum("tokens").alias("turn_tokens"),
        F.first(F.when(F.col("window") == 0, 0).otherwise(F.col("system_tokens"))).alias("again_tokens"),
        F.count_if("fresh").alias("n_turns"),
        F.array_sort(F.collect_list(F.when(F.col("fresh") & (F.col("role") == "assistant"), target))).alias("loss_spans"),
    )
    return grouped.select(
        F.col("conv").alias(conv),
        "window",
        F.concat("again", F.array_join(F.transform("parts", lambda p: p.shown), "")).alias("text"),
        (F.char_length("again") + F.col("old_chars")).cast("long").alias("repeated_chars"),
        (F.col("turn_tokens") + F.col("again_tokens")).cast("long").alias("n_tokens"),
        F.col("n_turns").cast("long").alias("n_turns"),
        "loss_spans",
    )


def read_turns(text: Column, repeated_chars: Column) -> Column:
    """The roles and texts that a window holds behind its repeated part."""
    fresh = F.substring(text, repeated_chars.cast("int") + 1, F.char_length(text))
    shown = F.filter(F.split(fresh, r"<\|im_end\|>\n"), lambda x: x != "")

    def parsed(turn: Column) -> Column:
        name = F.substring_index(F.substring(turn, len(START) + 1, F.char_length(turn)), "\n", 1)
        body = F.substring(turn, F.char_length(name) + len(START) + 2, F.char_length(turn))
        return F.struct(unescape(F.replace(name, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(shown, parsed)


def read_targets(text: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, as they were before formatting."""
    return F.transform(loss_spans, lambda s: unescape(F.substring(text, s.begin.cast("int") + 1, s.length.cast("int"))))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its windows: turns and targets as digests, and sizes.

    A digest needs the whole conversation in one value, so it is here and not in ``windows``.
    """
    told = F.array_join(F.transform(read_turns(F.col("text"), F.col("repeated_chars")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    counted = F.size(read_turns(F.col("text"), F.col("repeated_chars")))
    read = formatted.select(
        conv,
        F.struct("window", told.alias("turns"), F.array_join(read_targets(F.col("text"), F.col("loss_spans")), "").alias("loss")).alias("w"),
        counted.alias("n"),
        F.char_length("text").alias("chars"),
    )
    whole = read.groupBy(conv).agg(F.array_sort(F.collect_list("w")).alias("all"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    turns = F.array_join(F.transform("all", lambda w: w.turns), "")
    loss = F.array_join(F.transform("all", lambda w: w.loss), "")
    return whole.select(
        conv,
        F.col("n").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
