r"""Operator 5: chat formatting in budgeted windows, in DataFrame functions only.

A turn is written ``### role: text </turn>`` and a line end. Inside roles and texts a backslash is
doubled, ``##`` becomes ``#\#`` and ``</turn>`` becomes ``<\/turn>`` (and ``:`` in a role ``\:``),
so that no text can hold ``###`` or ``</turn>`` and reading back is a plain unescape.

Windows: prefix sums of turn tokens (characters over four, rounded up, markers included) lay a
conversation on a line that is cut every ``stride`` tokens. The turns that lie wholly between two
cuts are one window, a turn across a cut is a window of its own; so a window's new turns come in
order, are never cut, and stay within the stride unless one turn alone exceeds it. The stride is
what the budget leaves beside the history and the conversation's system turn (the first turn, if its role is
``system``). Every later window starts with the system turn and all turns before its first whose tokens, by the prefix sums,
fit the history. So a window of several new turns never exceeds the budget; one of a single new turn does only
if this turn (with the system turn) leaves no other way. The loss mask holds the texts of the window's new assistant turns: repeated turns are left out
of it, so each target counts once over all windows.

Output, one row per window: conv_id, window (from 0), n_turns (new ones), text, new_start (code
points of repeated turns before the first new one), mask (array of start, length in code points).

Edge cases: null text and null role count as empty; rows with a null conv_id are one conversation of
their own; rows with equal turn numbers follow their role and text; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE = "### ", " </turn>\n"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("##"), F.lit("#\\#"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), F.replace(escaped(role), F.lit(":"), F.lit("\\:")), F.lit(": "), escaped(text), F.lit(TURN_CLOSE))


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 512, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One shuffle, on the conversation: both groupings below reuse it."""
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    rows = turns.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = escaped(F.col("text"))
    rows = rows.withColumn("piece", turn_text(F.col("role"), F.col("text"))).withColumn("length", F.length(body))
    rows = rows.withColumn("tokens", F.ceil(F.length("piece") / 4))
    rows = rows.withColumns({"end": F.sum("tokens").over(order), "nth": F.row_number().over(order), "first": F.first(F.struct("role", "piece", "tokens")).over(order)})
    rows = rows.withColumn("start", F.col("end") - F.col("tokens"))
    # (cut before the start, cut before the end): equal for a turn between two cuts.
    stride = F.greatest(F.lit(budget - history) - F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(0), F.lit(1))
    cut = F.struct(F.floor(F.col("start") / stride).alias("a"), F.floor((F.col("end") - 1) / stride).alias("b"))
    rows = rows.withColumn("cut", cut)
    opens = F.coalesce(F.lag("cut").over(order) != F.col("cut"), F.lit(True))
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("long")).over(order) - 1)
    # The windows that open within the history's tokens behind this turn's start repeat it.
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, max(history, 1))
    rows = rows.withColumn("ahead", F.collect_list(F.when(F.col("opens"), F.col("window"))).over(ahead) if history else F.array().cast("array<long>"))
    is_system = F.col("first.role") == "system"
    repeats = F.when(is_system & (F.col("nth") == 1), F.array().cast("array<long>")).otherwise(F.col("ahead"))
    own = F.struct(F.col("window"), F.lit(1).alias("kind"), F.col("nth").cast("long").alias("nth"), F.col("piece"))
    again = F.transform(repeats, lambda a: F.struct(a.alias("window"), F.lit(0).alias("kind"), F.col("nth").cast("long").alias("nth"), F.col("piece").alias("piece")))
    system = F.when(is_system & F.col("opens") & (F.col("nth") > 1), F.array(F.struct(F.col("window"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("nth"), F.col("first.piece").alias("piece")))).otherwise(F.array())
    entries = rows.select("conv_id", "role", "length", F.explode(F.concat(F.array(own), again, system)).alias("x"))
    entries = entries.select("conv_id", "x.window", F.struct("x.kind", "x.nth", "x.piece", "role", "length").alias("x"))
    windows = entries.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    windows = windows.select("conv_id", "window", "xs", F.array_join(F.transform("xs", lambda x: x.piece), "").alias("text"), F.transform("xs", lambda x: F.length(x.piece)).alias("sizes"))
    # Where each piece starts in the window, then the assistant texts among the new ones.
    add = lambda s, x: s + x
    start_of = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), add)
    starts = F.filter(F.transform("xs", lambda x, i: F.struct(x.kind.alias("kind"), x.role.alias("role"), (start_of(i) + F.length(x.piece) - len(TURN_CLOSE) - x.length).alias("start"), x.length.alias("length"))), lambda x: (x.kind == 1) & (x.role == "assistant"))
    repeated = F.aggregate(F.filter("xs", lambda x: x.kind == 0), F.lit(0), lambda s, x: s + F.length(x.piece))
    return windows.select("conv_id", "window", F.size(F.filter("xs", lambda x: x.kind == 1)).cast("long").alias("n_turns"), "text", repeated.alias("new_start"), F.transform(starts, lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("mask"))


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the windows' texts and masks: turns and loss digests, formatted length."""
    new = F.expr("substring(text, new_start + 1)")
    pieces = F.filter(F.split(new, " </turn>\n"), lambda p: p != "")
    header = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    turns = F.transform(pieces, lambda p: F.concat(unescaped(F.regexp_extract(p, header, 1)), F.lit("\n"), unescaped(F.regexp_extract(p, header, 2)), F.lit("\n")))
    loss = F.transform("mask", lambda m: unescaped(F.substring(F.col("text"), m.start + 1, m.length)))
    read = windows.select("conv_id", "window", F.size(pieces).cast("long").alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("xs"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = whole.select("conv_id", "n_turns", F.array_join(F.transform("xs", lambda x: x.turns), "").alias("turns"), F.array_join(F.transform("xs", lambda x: x.loss), "").alias("loss"), "formatted_chars")
    return joined.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
