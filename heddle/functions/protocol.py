"""The turn protocol, action stems and lenient JSON as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stem(action: Column) -> Column:
    """The head verb of an action without its ending: -ing or -ed (a doubled consonant is made single) or -s."""
    a = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    head = F.regexp_extract(a, r"^([a-z]+)", 1)
    long = lambda n: F.length(head) > n + 2
    cut = F.when(head.endswith("ing") & long(3), F.regexp_replace(head, "ing$", "")).when(head.endswith("ed") & long(2), F.regexp_replace(head, "ed$", ""))
    single = F.regexp_replace(cut, r"([^aeiou])\1$", "$1")
    return F.when(head == "", a).otherwise(F.coalesce(single, F.when(head.endswith("s") & long(1), F.regexp_replace(head, "s$", "")), head))


def terminal(output: Column) -> Column:
    """How a turn ends: answer, tool_call, both or none."""
    a, c = (F.coalesce(output.rlike(f"(?s)<{x}>.*?</{x}>"), F.lit(False)) for x in ("answer", "tool_call"))
    return F.when(a & c, "both").when(a, "answer").when(c, "tool_call").otherwise("none")


def assistant_turn(think: Column, answer: Column, call: Column) -> Column:
    """A turn's text: the think tag, then the call if there is one, else the answer (empty for silence)."""
    inner = F.concat(F.lit("<think>"), F.trim(F.coalesce(think, F.lit(""))), F.lit("</think>"))
    end = F.when(F.trim(call) != "", F.concat(F.lit("<tool_call>"), F.trim(call), F.lit("</tool_call>"))).otherwise(F.concat(F.lit("<answer>"), F.trim(F.coalesce(answer, F.lit(""))), F.lit("</answer>")))
    return F.concat(inner, end)


def without_fence(c: Column) -> Column:
    """A text without a surrounding code fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-z]*\s*", ""), r"\s*```$", "")


def balanced(text: str | None) -> str | None:
    """The first JSON object or array of a text; a broken one is closed after its last whole element. None where none begins."""
    import json

    if not text:
        return None
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    stack, quoted, escaped, whole = [], False, False, []
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            continue
        if c == '"':
            quoted, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
            whole.append((i + 1, list(stack)))
            if not stack:
                break
    for end, open_ones in reversed(whole):
        got = text[start:end].rstrip().rstrip(",") + "".join(reversed(open_ones))
        try:
            json.loads(got)
        except ValueError:
            continue
        return got
    return None


def _rescued(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(balanced)


def robust_json(c: Column) -> Column:
    """A struct of ``mode`` (direct, fenced, rescued, failed) and ``json``. Only texts that no JVM parser takes go to Python."""
    plain = without_fence(c)
    ok = lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).rlike(r"^[\{\[]")
    mode = F.when(ok(c), "direct").when(ok(plain), "fenced")
    rescued = F.pandas_udf(_rescued, T.StringType())(F.when(mode.isNull(), c))
    return F.struct(F.coalesce(mode, F.when(rescued.isNotNull(), "rescued"), F.lit("failed")).alias("mode"), F.coalesce(F.when(mode == "direct", c), F.when(mode == "fenced", plain), rescued).alias("json"))


def min_max(x: Column, over) -> Column:
    """``x`` scaled to 0..1 within a window; 0 where all values are the same."""
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))
