"""Row checks of samples and summaries as columns: each is null where the row passes, else the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a silent video cannot show, feelings, guessed wishes, and talk about the system.
NOT_SEEN = ("sound", "hear", "listen", "noise", "sizzle", "sizzling", "music", "speech", "talking", "voice", "smell", "aroma", "scent", "fragrant", "aromatic", "emotion", "happy", "sad", "angry", "seems to want", "intend", "the user wants", "the video shows", "system triggered", "memory compression", "retrieved evidence")
#: The greatest share of unsupported names in a summary, without and with pictures.
UNSUPPORTED, UNSUPPORTED_WITH_PICTURES = 0.3, 0.5
LEAST_RATIO = 2.5
#: The share of key items a summary must keep, up to so many items, and beyond.
RETENTION, RETENTION_REST = {3: 0.34, 8: 0.50, 15: 0.45}, 0.40


def grounded(output: Column) -> Column:
    """no_think without a think tag; not_seen where a think names what cannot be seen."""
    thinks = F.lower(F.array_join(F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit("(?s)<think>(.*?)</think>"), 1), "\n"))
    none = ~F.coalesce(output.rlike("(?s)<think>.*?</think>"), F.lit(False))
    return F.when(none, "no_think").when(F.exists(F.array(*(F.lit(p) for p in NOT_SEEN)), lambda p: F.contains(thinks, p)), "not_seen")


def strict_answer(answer: Column, form: Column) -> Column:
    """answer_form where a yes/no, letter or number question is answered with anything more."""
    shape = F.when(form == "binary", "^(?:Yes|No)$").when(form == "choice", "^[A-D]$").when(form == "number", r"^-?\d+$")
    return F.when(shape.isNotNull() & ~F.coalesce(F.regexp_like(F.trim(answer), shape), F.lit(False)), "answer_form")


def think_length(think: Column, least: int = 0, most: int = 30) -> Column:
    """think_length where the estimate of tokens lies outside the bounds."""
    n = F.floor(F.length(F.coalesce(think, F.lit(""))) / 4)
    return F.when(~n.between(least, most), "think_length")


def names(c: Column) -> Column:
    """Words of three letters or more with a capital first letter or an underscore, as they occur."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([a-zA-Z0-9_]+)\b"), 1), lambda w: (F.length(w) > 2) & w.rlike("^[A-Z]|_"))


def provenance(summary: Column, source: Column, pictures: Column) -> Column:
    """provenance where too many of the summary's names do not occur in its source; a source without words passes all."""
    known = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(r"\b([a-zA-Z0-9_]+)\b"), 1))
    said = names(summary)
    strange = F.size(F.filter(said, lambda w: ~F.array_contains(known, F.lower(w))))
    most = F.when(pictures, UNSUPPORTED_WITH_PICTURES).otherwise(UNSUPPORTED)
    return F.when((F.size(said) > 0) & (F.size(known) > 0) & (strange / F.size(said) > most), "provenance")


def key_items(source: Column) -> Column:
    """The distinct names (not all in capitals) and numbers of a source, in lower case."""
    s = F.coalesce(source, F.lit(""))
    proper = F.filter(F.regexp_extract_all(s, F.lit(r"\b([A-Z][a-zA-Z0-9_]{2,})\b"), 1), lambda w: w != F.upper(w))
    numbers = F.regexp_extract_all(s, F.lit(r"\b(\d+\.?\d*)\b"), 1)
    return F.array_distinct(F.concat(F.transform(proper, F.lower), numbers))


def retention_threshold(n: Column) -> Column:
    """What share of ``n`` key items a summary must keep."""
    return F.coalesce(*(F.when(n <= k, v) for k, v in RETENTION.items()), F.lit(RETENTION_REST))


def retained_share(summary: Column, source: Column) -> Column:
    """The share of the source's key items that the summary holds; null without any."""
    items, low = key_items(source), F.lower(F.coalesce(summary, F.lit("")))
    return F.try_divide(F.size(F.filter(items, lambda w: F.contains(low, w))), F.size(items))


def retention(summary: Column, source: Column) -> Column:
    """retention where the summary keeps too few of its source's key items."""
    return F.when(retained_share(summary, source) < retention_threshold(F.size(key_items(source))), "retention")


def ratio(summary: Column, source_letters: Column) -> Column:
    """empty_summary, or ratio where the summary is not at least LEAST_RATIO times shorter than its source."""
    n = F.length(F.trim(F.coalesce(summary, F.lit(""))))
    return F.when(n == 0, "empty_summary").when(source_letters / n < LEAST_RATIO, "ratio")


def leak(summary: Column, think: Column, source: Column) -> Column:
    """think_leak where the summary holds a name of the current think (over three letters) that its source does not."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b([a-zA-Z0-9_]+)\b"), 1))
    own = F.array_except(F.transform(F.filter(names(think), lambda w: F.length(w) > 3), F.lower), words(source))
    return F.when(F.size(F.array_intersect(own, words(summary))) > 0, "think_leak")


def in_past(chunk: Column, evidence: Column) -> Column:
    """future_evidence where a recalled chunk lies after the row's own."""
    return F.when(F.exists(evidence, lambda e: e > chunk), "future_evidence")


def reasons(checks: dict[str, Column]) -> Column:
    """The reasons of all checks that fail, in order."""
    return F.array_compact(F.array(*checks.values()))


def with_sources(summaries: DataFrame, thinks: DataFrame, keys: list[str], *, span: int = 64) -> DataFrame:
    """``summaries(keys, lo, hi, ...)`` with ``source``, the thinks ``t`` of chunks ``c`` from lo to hi in order, and their number ``n``.

    Interval containment as an equi-join: a range is listed by the blocks of ``span`` chunks it touches and meets the thinks of
    its blocks only. A range without thinks has an empty source. Rows that are equal in all columns are one summary.
    """
    own = summaries.columns
    rows = summaries.withColumn("_id", F.xxhash64(*own))
    blocks = rows.where("lo <= hi").select("_id", *keys, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))).alias("_b"))
    inside = blocks.join(thinks.withColumn("_b", F.floor(F.col("c") / span)), [*keys, "_b"]).where("c between lo and hi")
    joined = inside.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("_t"))  # the chunks of one range
    source = F.array_join(F.transform("_t", lambda x: x["t"]), " ")
    return rows.join(joined, "_id", "left").select(*own, F.coalesce(source, F.lit("")).alias("source"), F.greatest(F.coalesce(F.size("_t"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
