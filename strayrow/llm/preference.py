"""Preference formatting: one prompt and two masked completions from a pair of conversations.

The longest common turn prefix of the chosen and the rejected conversation is rendered
once, as the prompt. What remains of each is its completion; the mask names the spans of
characters in prompt plus completion that are trained on: the assistant's texts and end
marks within the completion. All of it is DataFrame functions, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.greatest(n, F.lit(1)))
    same = F.transform(pairs, lambda x: F.coalesce(x["a"].eqNullSafe(x["b"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("long")


def render(turns: Column) -> Column:
    """The turns as one text."""
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))
    return F.array_join(parts, "")


def spans(turns: Column, start: Column) -> Column:
    """``begin:end`` of every trained text with its end mark, joined by commas."""
    head = lambda t: F.char_length(t["role"]) + len(OPEN) + len(MIDDLE)
    whole = lambda t: head(t) + F.char_length(t["text"]) + len(CLOSE)
    zero = F.struct(start.cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + whole(t)
        mark = F.concat(F.when(acc["out"] == "", "").otherwise(","), (acc["at"] + head(t)).cast("string"), F.lit(":"), (end - len("\n")).cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["out"], mark)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda acc: acc["out"])


def clean(turns: Column) -> Column:
    """Null conversations are empty; null roles and texts are empty texts; null turns go."""
    kept = F.filter(F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")), lambda t: t.isNotNull())
    return F.transform(kept, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds n_shared, prompt, chosen_completion, rejected_completion and both spans.

    ``chosen`` and ``rejected`` are arrays of (role, text). Equal conversations give two
    empty completions; without a common turn the prompt is empty. Null parts count as
    empty. Rows are formatted one by one; columns of these names are replaced.
    """
    df = pairs.withColumns({"_a": clean(F.col(chosen)), "_b": clean(F.col(rejected))})
    df = df.withColumn("n_shared", common_prefix(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(F.col(c), F.col("n_shared").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    df = df.withColumns({
        "prompt": render(F.slice(F.col("_a"), F.lit(1), F.col("n_shared").cast("int"))),
        "chosen_completion": render(rest("_a")),
        "rejected_completion": render(rest("_b")),
    })
    start = F.char_length("prompt")
    return df.withColumns({"chosen_spans": spans(rest("_a"), start), "rejected_spans": spans(rest("_b"), start)}).drop("_a", "_b")


def stale_answers(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pairs from plain conversations: chosen as written, rejected with a stale last answer.

    The rejected conversation ends at the last answer, whose text is that of the first
    answer. A conversation without an answer is its own rejected one. Turns are ordered by
    number, ties by role and text; turns without a conversation id form none.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    whole = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    whole = whole.withColumn("chosen", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    answers = F.filter("chosen", lambda t: t["role"] == TRAINED)
    last = F.size("chosen") - F.array_position(F.transform(F.reverse("chosen"), lambda t: F.coalesce(t["role"] == TRAINED, F.lit(False))), True) + 1
    stale = F.array(F.struct(F.lit(TRAINED).alias("role"), F.element_at(F.col("_answers"), 1)["text"].alias("text")))
    whole = whole.withColumns({"_answers": answers, "_last": last.cast("int")})
    rejected = F.when(F.size("_answers") == 0, F.col("chosen")).otherwise(
        F.concat(F.slice("chosen", F.lit(1), F.greatest(F.col("_last") - 1, F.lit(0))), stale))
    return whole.select(id_col, "chosen", rejected.alias("rejected"))
