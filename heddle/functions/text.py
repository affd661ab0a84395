"""Text and answer functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning of their own.
STOP_WORDS = ("a", "an", "the", "is", "are", "was", "were", "be", "to", "of", "in", "on", "at", "by", "for", "with", "and", "or", "what", "which", "where", "when", "who", "how", "does", "do", "did", "it", "this", "that")


def tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words in order of first use; an empty array for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def keywords(c: Column) -> Column:
    return F.array_except(tokens(c), F.array(*(F.lit(w) for w in STOP_WORDS)))


def trigrams(c: Column) -> Column:
    """Distinct letter triples of a name without ``.mp4``, ``_`` and ``-``; empty for names under three letters."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\.mp4$|[_\-]", "")
    at = F.when(F.length(x) >= 3, F.sequence(F.lit(1), F.length(x) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: x.substr(i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 where one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where a norm is under 1e-8."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-8) | (nb < 1e-8), 0.0).otherwise(dot(a, b) / (na * nb))


def tag(c: Column, name: str) -> Column:
    """What stands inside the first ``<name>`` of ``c``; null without it."""
    return F.when(c.rlike(f"(?s)<{name}>.*?</{name}>"), F.regexp_extract(c, f"(?s)<{name}>(.*?)</{name}>", 1))


def normal_answer(c: Column, form: str) -> Column:
    """The canonical answer of a form: Yes/No, an option letter, or a number; an empty string where there is none."""
    x = F.trim(F.coalesce(c, F.lit("")))
    if form == "binary":
        return F.when(x.rlike(r"(?i)^(yes|true)\b"), "Yes").when(x.rlike(r"(?i)^(no|false)\b"), "No").otherwise("")
    if form == "choice":
        return F.upper(F.coalesce(F.regexp_extract(x, r"^\(?([A-Da-d])\)?(?:[.):\s]|$)", 1), F.lit("")))
    if form == "number":
        return F.regexp_extract(x, r"^(-?\d+)(?![\w])", 1)
    raise ValueError(f"no such form: {form}")


def seconds(c: Column) -> Column:
    """``HH:MM:SS``, ``MM:SS`` or a number as seconds; null for anything else."""
    parts = F.transform(F.split(c, ":"), lambda p: p.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p))


def source_ladder(path: Column) -> Column:
    """The kind of source that a path names."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return F.when(p.contains("/ytb_"), "channel").when(p.rlike(r"/v_[^/]+$"), "news").when(p.rlike(r"_clip\d+\.[a-z0-9]+$"), "clip").when(p.rlike(r"_\d+_\d+\.[a-z0-9]+$"), "segment").when(p.isNotNull(), "file").otherwise("none")


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def signed_length(c: Column, visual: Column) -> Column:
    """The number of words, negative where pictures belong to the text."""
    n = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.when(visual, -n).otherwise(n)
