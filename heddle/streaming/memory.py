"""Bounded streaming memory: a key's thinks are kept up to a budget and compacted beyond it.

One kernel serves the batch operator (``applyInPandas`` over ordered chunks) and the Structured Streaming twin
(``applyInPandasWithState``). Its state holds the uncompacted thinks only, so it is bounded by the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, at long, tokens long, held long, segments long, first_held long, cut_first long, cut_last long, ranges string"


@dataclass
class Memory:
    """Thinks as (position, tokens); a summary costs ``summary`` tokens, the two oldest of more than ``most`` become one over both their ranges."""

    trigger: int = 320
    target: int = 220
    least: int = 2
    summary: int = 28
    most: int = 5
    thinks: list = field(default_factory=list)
    segments: list = field(default_factory=list)  # (first, last) of each summary, oldest first

    def step(self, at: int, tokens: int) -> tuple:
        self.thinks.append((int(at), int(tokens)))
        first = last = None
        if self.cost() > self.trigger and len(self.thinks) > self.least:
            first = self.thinks[0][0]
            while self.cost() > self.target and len(self.thinks) > 1 or last is None:
                last = self.thinks.pop(0)[0]
            self.segments.append((first, last))
            if len(self.segments) > self.most:
                self.segments[:2] = [(self.segments[0][0], self.segments[1][1])]
        return self.cost(), len(self.thinks), len(self.segments), self.thinks[0][0], first, last, ",".join(f"{a}-{b}" for a, b in self.segments)

    def cost(self) -> int:
        return sum(t for _, t in self.thinks) + self.summary * len(self.segments)


def _rows(key: str, memory: Memory, p: pd.DataFrame) -> pd.DataFrame:
    out = [(key, a, t, *memory.step(a, t)) for a, t in zip(p["at"], p["tokens"], strict=True)]
    df = pd.DataFrame(out, columns=["key", "at", "tokens", "_cost", "held", "segments", "first_held", "cut_first", "cut_last", "ranges"]).drop(columns="_cost")
    return df.astype({"cut_first": "Int64", "cut_last": "Int64"})


def memory_batch(chunks: DataFrame, **budget: int) -> DataFrame:
    """``chunks(key, at, tokens)`` with one row per chunk, through the memory in order of ``at``."""

    def run(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return _rows(k[0], Memory(**budget), p.sort_values("at"))

    return chunks.groupBy("key").applyInPandas(run, OUTPUT)


def memory_stream(chunks: DataFrame, **budget: int) -> DataFrame:
    """The same over a stream whose chunks of a key arrive in order."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory(**budget)
        if state.exists:
            ats, tokens, firsts, lasts = state.get
            memory.thinks, memory.segments = list(zip(ats, tokens, strict=True)), list(zip(firsts, lasts, strict=True))
        p = pd.concat(list(batches)).sort_values("at")
        out = _rows(k[0], memory, p)
        state.update(([a for a, _ in memory.thinks], [t for _, t in memory.thinks], [a for a, _ in memory.segments], [b for _, b in memory.segments]))
        yield out

    return chunks.groupBy("key").applyInPandasWithState(run, OUTPUT, "ats array<long>, tokens array<long>, firsts array<long>, lasts array<long>", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, ts: str, width: str, *dims: str) -> DataFrame:
    """Counts per fixed window; works on streams with a watermark as on tables."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w"), *dims).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *dims, "n")


def sessions(events: DataFrame, ts: str, gap: str, *dims: str) -> DataFrame:
    """Counts per run of events less than ``gap`` apart."""
    return events.groupBy(F.session_window(F.col(ts).cast("timestamp"), gap).alias("w"), *dims).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *dims, "n")
