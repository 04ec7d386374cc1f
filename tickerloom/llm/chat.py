"""Chat formatting in budgeted windows, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import seal, sealed_column, word_count

#: The template: ``### role: text</turn>`` and a line end.
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens that the template adds to a turn.
TEMPLATE_TOKENS = 4


def escape(text: Column) -> Column:
    """No control string of the template is left in the result: a backslash breaks each, and backslashes are doubled."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def windows(turns: DataFrame, budget: int = 512, history: int = 128, trained_role: str = "assistant", system_role: str = "system",
            id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, window, n_context, tokens, formatted, loss): training examples of the conversations.

    Turns in order have prefix sums of tokens (words and the template's own). The token stream behind a leading system turn is cut into
    stretches of ``budget`` less the system turn's tokens and ``history`` (which gives way, to less than half of what the system turn leaves); a window's new turns
    are those that start in its stretch, whole. If the last of several reaches so far beyond that they are more than a stretch, it is a window of its own (an odd
    number). In front stand the system turn and as many of the turns before as ``history`` tokens, and the room that the new turns leave, hold:
    the ``n_context`` first turns, which are repeats (but for the system turn in the first window). So a window is over the budget only if the system turn and a
    single turn are, or the system turn is by itself (then windows are cut as if there were none). ``loss`` lists the spans, in code points from 0, of the texts of
    ``trained_role`` that are new in the window; repeated ones are masked, so each is trained on once.

    Null texts and roles are empty ones; rows of the same turn stand in the order of role and text, null turns last; rows with a null
    id form a conversation. A conversation's turns meet in one task (its order and digests need them all), a window's text is bounded by the budget and a
    turn. Other columns are ignored. An empty table gives no rows."""
    rows, names = seal(turns)
    conv, turn, role, text = (F.col(sealed_column(names, c)) for c in (id_column, turn_column, role_column, text_column))
    told = rows.select(conv.alias("conv_id"), turn.alias("_turn"), F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_last(), "_role", "_text")
    whole = Window.partitionBy("conv_id")
    counted = told.select("*", F.row_number().over(order).alias("_at"), (word_count(F.col("_text")) + TEMPLATE_TOKENS).alias("_tokens"))
    lead = counted.withColumn("_lead", (F.col("_at") == 1) & (F.col("_role") == system_role))
    placed = lead.select("*", F.coalesce(F.sum(F.when(F.col("_lead"), F.col("_tokens"))).over(whole), F.lit(0)).alias("_system"),
                         F.coalesce(F.sum(F.when(F.col("_lead"), F.lit(0)).otherwise(F.col("_tokens"))).over(
                             Window.partitionBy("conv_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    left = budget - F.col("_system")
    roomy = placed.withColumn("_room", F.when(left > 0, left).otherwise(F.lit(budget)).cast("bigint"))
    held = roomy.withColumn("_history", F.least(F.lit(history).cast("bigint"), F.floor((F.col("_room") - 1) / 2)))
    stretched = held.withColumn("_stretch", F.floor(F.col("_before") / (F.col("_room") - F.col("_history"))))
    told_new = F.when(~F.col("_lead"), F.col("_tokens"))
    stretch = Window.partitionBy("conv_id", "_stretch")
    beyond = ~F.col("_lead") & (F.sum(told_new).over(stretch) > F.col("_room") - F.col("_history")) & (F.col("_at") == F.max("_at").over(stretch)) \
        & (F.count(told_new).over(stretch) > 1)
    cut = stretched.withColumn("window", (2 * F.col("_stretch") + beyond.cast("int")).cast("bigint"))
    summed = cut.withColumn("_fresh", F.sum(told_new).over(Window.partitionBy("conv_id", "window")))
    last = F.max("window").over(whole)

    def new_in(number: Column, new: bool) -> Column:
        return F.struct(number.alias("window"), F.lit(new).alias("new"))

    def following(ahead: int) -> Column:
        """The first turn of the window so many numbers ahead."""
        return F.min(F.when(~F.col("_lead"), F.struct("_before", "_fresh"))).over(Window.partitionBy("conv_id").orderBy("window").rangeBetween(ahead, ahead))

    # a turn can be history of its own stretch's second window and of the next stretch's two, for history is shorter than a stretch
    known = summed.withColumns({f"_next{k}": following(k) for k in (1, 2, 3)})
    repeats = [F.when(F.col(f"_next{k}._before") - F.col("_before") <= F.least(F.col("_history"), F.col("_room") - F.col(f"_next{k}._fresh")),
                      new_in(F.col("window") + k, False)) for k in (1, 2, 3)]
    copies = F.when(F.col("_lead"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_last")), lambda w: F.struct(w.alias("window"), (w == 0).alias("new")))) \
        .otherwise(F.filter(F.array(new_in(F.col("window"), True), *repeats), lambda c: c.isNotNull()))
    spread = known.withColumn("_last", last).select(
        "conv_id", "_at", "_lead", "_tokens", F.concat(F.lit(OPEN), escape_role(F.col("_role")), F.lit(BETWEEN)).alias("_head"),
        escape(F.col("_text")).alias("_body"), (F.col("_role") == trained_role).alias("_trained"), F.explode(copies).alias("_copy"))
    inside = Window.partitionBy("conv_id", "window").orderBy("_at")
    parts = spread.select("conv_id", F.col("_copy.window").alias("window"), F.col("_copy.new").alias("_new"), "_at", "_lead", "_tokens", "_head", "_body", "_trained").select(
        "*", (F.length("_head") + F.length("_body") + len(CLOSE)).alias("_long")).select(
        "*", (F.sum("_long").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_long") + F.length("_head")).alias("_start"))
    made = parts.groupBy("conv_id", "window").agg(
        F.sum((~F.col("_new")).cast("int")).cast("int").alias("n_context"), F.sum("_tokens").alias("tokens"),
        F.max((F.col("_new") & ~F.col("_lead")).cast("int")).alias("_some"),
        F.sort_array(F.collect_list(F.struct("_at", F.concat("_head", "_body", F.lit(CLOSE)).alias("said"), F.col("_start").alias("start"),
                                             (F.col("_start") + F.length("_body")).alias("end"), (F.col("_trained") & F.col("_new")).alias("loss")))).alias("_turns"))
    # a stretch that a long turn of an earlier one covers has nothing new
    return made.where("_some = 1 or window = 0").select(
        "conv_id", "window", "n_context", "tokens", F.array_join(F.transform("_turns", lambda t: t["said"]), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss"))


def read_back(examples: DataFrame) -> DataFrame:
    """Adds, from the formatted text and spans alone, ``turns`` (the new turns as role and text) and ``trained`` (the texts under the loss mask)."""
    said = F.split("formatted", CLOSE, -1)
    fresh = F.slice(said, F.col("n_context") + 1, F.size(said) - 1 - F.col("n_context"))
    head = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    return examples.select(
        "*", F.transform(fresh, lambda t: F.struct(unescape(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_extract(t, head, 2)).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))).alias("trained"))


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation with what ``read_back`` finds in its windows, in order."""
    found = read_back(examples).select(
        "conv_id", "window", F.size("turns").cast("bigint").alias("n"), F.length("formatted").cast("bigint").alias("long"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("trained", "").alias("trained"))
    whole = found.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
                                         F.sort_array(F.collect_list(F.struct("window", "said", "trained"))).alias("w"))
    joined = whole.select("*", F.array_join(F.transform("w", lambda x: x["said"]), "").alias("said"), F.array_join(F.transform("w", lambda x: x["trained"]), "").alias("trained"))
    return joined.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("trained").cast("bigint").alias("loss_chars"),
                         F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
