"""Rewards of streaming answers as columns. All have a defined value for null input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answer forms that must match as a whole.
STRICT_FORMS = ("binary", "yes_no", "multiple_choice", "mc", "number", "numeric", "short_exact", "entity", "literal")
#: The most letters of an answer that can score, and the weights of the five rewards.
LONGEST = 1000
WEIGHTS = {"outcome": 1.0, "timing": 0.3, "format": 0.1, "spam": -0.2, "silent": 0.2}


def outcome(answer: Column, gold: Column, form: Column) -> Column:
    """1 for the right answer, else 0: the whole text in strict forms, either text inside the other in all others."""
    a, g = F.lower(F.trim(answer)), F.lower(F.trim(gold))
    loose = F.contains(a, g) | F.contains(g, a)
    right = F.when(form.isin(*STRICT_FORMS), a == g).otherwise(loose)
    scorable = (F.length(answer) <= LONGEST) & (g != "")
    return F.coalesce(F.when(scorable & right, 1.0), F.lit(0.0))


def timing(answer: Column, start: Column, end: Column, late: int = 1) -> Column:
    """1 in the window, -1 before it, down to 0.5 over ``late`` units after it and then 0; -0.5 unanswered, 0 without a window."""
    delay = answer - end
    fading = F.when((delay <= late) & F.lit(late > 0), 1.0 - 0.5 * delay / max(late, 1)).otherwise(0.0)
    return F.when(start.isNull(), 0.0).when(answer.isNull(), -0.5).when(answer < start, -1.0).when(end.isNull() | (answer <= end), 1.0).otherwise(fading)


def spam(recalls: Column, compressions: Column, recall_budget: int = 1, compress_budget: int = 1) -> Column:
    """Half a point per recall and 0.3 per compression over budget."""
    over = lambda n, budget: F.greatest(F.coalesce(n, F.lit(0)) - budget, F.lit(0))
    return 0.5 * over(recalls, recall_budget) + 0.3 * over(compressions, compress_budget)


def silent_quality(answer: Column, action: Column, gold: Column) -> Column:
    """0.3 for silence where it is due, -0.6 for an answer there and for silence where an answer is due, else 0."""
    said = F.coalesce(F.trim(answer) != "", F.lit(False))
    due = F.coalesce(F.trim(gold) != "", F.lit(False))
    act = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    quiet = (act == "silent") | (act.isin("", "none") & ~due)
    return F.when(quiet, F.when(said, -0.6).otherwise(0.3)).when(act.isin("response", "recall_response") & due & ~said, -0.6).otherwise(0.0)


def well_formed(output: Column) -> Column:
    """1 where think tags are balanced and exactly one of answer and tool call closes the turn, the call being valid JSON with a name."""
    count = lambda x: F.regexp_count(output, F.lit(x))
    answers, calls = count("(?s)<answer>.*?</answer>"), count("(?s)<tool_call>.*?</tool_call>")
    named = F.get_json_object(F.regexp_extract(output, r"(?s)<tool_call>(.*?)</tool_call>", 1), "$.name").isNotNull()
    ok = (count("<think>") == count("</think>")) & (answers + calls == 1) & ((calls == 0) | named)
    return F.coalesce(ok.cast("double"), F.lit(0.0))


def total(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of rewards."""
    w = WEIGHTS | (weights or {})
    out = F.lit(0.0)
    for k, c in parts.items():
        out = out + w[k] * c
    return out
