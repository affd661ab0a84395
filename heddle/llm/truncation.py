"""Texts cut off by length limits or broken transfers (problem 3).

Per source a log-normal length distribution is fitted by maximum likelihood, with the surplus at candidate limits taken as
right-censored; that gives each value's censoring posterior at its length. Values at limits are nearly all cut, so they show
how cut texts end, and the other lengths show how the rest ends, a few of them cut in transfer. From both it follows how much
more often cut texts end in one kind of ending than whole ones; each value's posterior and ending are combined as log-odds. A cut that leaves a whole sentence or structure behind is no case, so values with a strong final mark are not named.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import BLANK, clean_dataset, spread_lookup
from heddle.session import stage

#: What a broken transfer or a cutting program leaves at the end.
REMAINS = r"(?:…|\.\.\.|</?[A-Za-z]*|\\u?[0-9a-fA-F]{0,3}|�+|\[\.\.\.\]|\[…\]|\[(?:cut|truncated|more)\]|\(truncated\))$"
TERMINAL = r"[.!?。！？][\"'”’)\]]*$|[)\]}`]$"
#: Final marks that stand inside sentences too: a bracket or tick alone, a dot after a number, letter or abbreviation.
WEAK_MARK = r"(?<![.!?。！？][\"'”’]{0,3})[)\]}`]$|(?:(?<![\p{L}\p{N}])(?:\p{L}|(?i:e\.g|i\.e|approx|ca|cf|dr|mr|mrs|ms|fig|no|nr|vs|st))|\d)\.$"
STRING = r'"(?:[^"\\]++|\\.)*+"'

#: Kinds of ending, remains of a transfer aside. closed: whole structure; ended, weak: a final mark, one that also stands inside
#: sentences; usual: an ending that many replies of the form have; unended: none of these, or structure left open.
KINDS = ("unended", "closed", "ended", "usual", "weak")
#: Log-odds of a reply that ends in remains of a transfer: only a cut leaves these.
LEFTOVER = 10.0
#: Kinds that cannot be a break inside a word, sentence, value or structure.
WHOLE = ("closed", "ended")


def form(body: Column) -> Column:
    """The form of a reply: json, fields (labelled lines), list or prose."""
    return (
        F.when(body.rlike(r"^(?:```|\{|\[\s*[\{\"])"), "json")
        .when(body.rlike(r"^[A-Za-z_ ]{1,24}\s*(?:->|[:=])[^\n]*\n[A-Za-z_ ]{1,24}\s*(?:->|[:=])"), "fields")
        .when(body.rlike(r"^[^\x00-ɏ]"), "other")
        .otherwise("prose")
    )


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, with ``value`` computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def open_structure(body: Column) -> Column:
    """True where brackets, a string or a code fence are left open."""
    plain = F.regexp_replace(F.regexp_replace(body, "```[a-z]*", ""), STRING, "")

    def left(x: Column) -> Column:
        return (F.regexp_count(x, F.lit(r"[\{\[]")) > F.regexp_count(x, F.lit(r"[\}\]]"))) | x.contains('"')

    return bound(plain, left) | (F.regexp_count(body, F.lit("```")) % 2 == 1)


def evidence_of(text: Column) -> Column:
    """What the ending of ``text`` shows, as a struct."""

    def of_body(end: Column, body: Column) -> Column:
        kind = form(F.regexp_replace(body, rf"^{BLANK}+", ""))
        line = F.substring_index(body, "\n", -1)

        def of_kind(k: Column) -> Column:
            def key(x: Column) -> Column:
                label, value = (F.regexp_extract(x, r"^([A-Za-z_ ]{1,24}?)\s*(?:->|[:=])\s*(.*)$", i) for i in (1, 2))
                segment = F.element_at(F.split(x, r"(?<=[.!?。！？])\s+"), -1)
                return F.when(k == "fields", F.concat_ws("|", label, value)).otherwise(F.regexp_replace(F.lower(segment), r"\d+", "#"))

            return F.struct(
                k.alias("form"),
                (F.length(end) > F.length(body)).alias("leftover"),
                ((k == "json") & open_structure(body)).alias("open"),
                body.rlike(TERMINAL).alias("ended"),
                F.right(body, F.lit(16)).rlike(WEAK_MARK).alias("weak"),
                bound(bound(line, key), lambda e: F.when(F.length(e) <= 200, e).otherwise(F.concat(F.substring(e, 1, 100), F.sha2(e, 256)))).alias("ending"),  # whole, or told apart by a hash
            )

        return bound(kind, of_kind)

    def of_end(end: Column) -> Column:
        return bound(F.regexp_replace(F.regexp_replace(end, REMAINS, ""), rf"{BLANK}+$", ""), lambda body: of_body(end, body))

    return bound(F.regexp_replace(text, rf"{BLANK}+$", ""), of_end)


def replies(evidence: DataFrame, text: str = "_raw") -> DataFrame:
    """One row per distinct text of a reply, with what its ending shows. Null and blank texts are no replies."""
    rows = evidence.select("video_id", "chunk_idx", "attempt", F.col(text).alias("t")).where(F.coalesce(F.col("t").rlike(rf"[^{BLANK[1:-1]}]"), F.lit(False)))
    seen = rows.select("video_id", "chunk_idx", "attempt", F.length("t").alias("n"), F.xxhash64("t").alias("h"), evidence_of(F.col("t")).alias("e"))
    return seen.distinct().select("video_id", "chunk_idx", "attempt", "n", "e.*")


def fit_censored(lengths: np.ndarray, counts: np.ndarray, cut_counts: np.ndarray, *, rounds: int = 60) -> tuple[float, float]:
    """(mu, sigma) of a log-normal by expectation maximisation; ``cut_counts`` of each length are right-censored there."""
    x, seen = np.log(lengths), counts - cut_counts
    total = counts.sum()
    mu = float((x * counts).sum() / total)
    sigma = max(0.05, float(np.sqrt(((x - mu) ** 2 * counts).sum() / total)))
    erfc = np.vectorize(math.erfc)
    for _ in range(rounds):
        z = np.clip((x - mu) / sigma, -8, 8)
        hazard = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi) / np.maximum(0.5 * erfc(z / math.sqrt(2)), 1e-15)
        first = mu + sigma * hazard
        second = mu**2 + sigma**2 + sigma * (x + mu) * hazard
        a = float((seen * x + cut_counts * first).sum() / total)
        b = float((seen * x**2 + cut_counts * second).sum() / total)
        mu, sigma, was = a, max(0.05, math.sqrt(max(b - a * a, 0))), (mu, sigma)
        if abs(mu - was[0]) + abs(sigma - was[1]) < 1e-6:
            break
    return mu, sigma


LIMITS = "source string, n int, count long, mu double, sigma double, expected double, posterior double"


def limit_posteriors(lengths: DataFrame, *, reach: int = 12, times: float = 6.0, least: int = 4, chance: float = 0.01) -> DataFrame:
    """LIMITS rows for each source's candidate limits, from ``lengths(source, n, count, endings)``.

    A candidate is a length that holds at least ``least`` values of different endings (a text stored many times with little
    changed is no limit) and ``times`` the mean of the lengths within ``reach``.
    The posterior is the share of values there that the fitted distribution does not account for. A candidate is no limit
    where so many values are to be expected by chance at one of the source's lengths (Chernoff's bound on the Poisson tail,
    times the number of lengths, over ``chance``).
    """
    near = Window.partitionBy("source").orderBy("n").rangeBetween(-reach, reach)
    spikes = lengths.withColumn("around", (F.sum("count").over(near) - F.col("count")) / (2.0 * reach))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n")
        n, c, around = p["n"].to_numpy(float), p["count"].to_numpy(float), p["around"].to_numpy(float)
        e = p["endings"].to_numpy(float)
        at = (e >= least) & (c >= times * np.maximum(around, 0.25)) & (n >= 32)
        mu, sigma = fit_censored(np.maximum(n, 1), c, np.where(at, np.maximum(c - around, 0), 0.0))
        dens = np.exp(-(((np.log(np.maximum(n, 1)) - mu) / sigma) ** 2) / 2) / (np.maximum(n, 1) * sigma * math.sqrt(2 * math.pi)) * c.sum()
        out = pd.DataFrame({"source": p["source"], "n": p["n"], "count": p["count"], "mu": mu, "sigma": sigma, "expected": dens, "posterior": np.clip(1 - np.maximum(dens, around) / c, 0, 1)})
        rate = np.maximum(dens, around)
        tail = np.log(len(n)) - rate + e * (1 + np.log(np.maximum(rate, 1e-9) / e))
        return out[at & (e > rate) & (tail < math.log(chance))]

    return spikes.groupBy("source").applyInPandas(fit, LIMITS)  # a group has one row per distinct length


def kind_of_ending() -> Column:
    """The kind of a reply's ending, one of KINDS."""
    json = F.when(F.col("open"), "unended").otherwise("closed")
    text = F.when(F.col("ended") & ~F.col("weak"), "ended").when(F.col("usual"), "usual").when(F.col("ended"), "weak").otherwise("unended")
    return F.when(F.col("form") == "json", json).otherwise(text)


def fit_endings(counts: pd.DataFrame, *, most: float = 0.25, stray: float = 0.005, carries: float = 0.05, shared: float = 20.0) -> pd.DataFrame:
    """``form, kind, rate, ratio`` from ``counts(form, kind, posterior, n)``: how cut and whole replies of a form end.

    Replies at limits show how cut replies end, after the whole ones that the length fit expects there are taken off. Replies
    of other lengths are a mixture of whole ones and of some cut in transfer. Of the mixtures that explain their endings, that
    with most cuts is taken: the share of cuts ``rate`` grows until a kind of ending that makes up ``carries`` of the cut
    replies is used up, or to ``most``. What is left shows how whole replies end; ``stray`` of them lack a regular ending.
    ``ratio`` is the logarithm of how much more often cut replies end so than whole ones. ``shared`` replies of all forms
    together steady rare forms; without limits every cut reply counts as unended.
    """
    kinds = list(KINDS)
    n = counts.assign(at=counts["posterior"] > 0, chance=(1 - counts["posterior"]) * counts["n"] * (counts["posterior"] > 0))
    table = n.pivot_table(index=["form", "at"], columns="kind", values="n", aggfunc="sum", fill_value=0).reindex(columns=kinds, fill_value=0) if len(n) else None
    unended, out = np.array([k == "unended" for k in kinds], dtype=float), []
    pick = lambda form, at: table.loc[(form, at)].to_numpy(float) if (form, at) in table.index else np.zeros(len(kinds))
    share = lambda x: x / max(x.sum(), 1e-9)

    def fit(limit: np.ndarray, chance: float, off: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        whole, off = share(off), share(off)
        for _ in range(5):
            cut = share(np.maximum(limit - chance * whole, 0) + 1e-6)
            rate = float(np.clip(min([o / c for o, c in zip(off, cut, strict=True) if c >= carries]), 1e-4, most))
            whole = share(np.maximum(off - rate * cut, 0) + stray * unended + 1e-6)
        return rate, cut, whole

    forms = sorted(set(n["form"]))
    limits, others = (sum((pick(f, at) for f in forms), np.zeros(len(kinds))) for at in (True, False))
    _, cut, _ = fit(limits + unended, float(n["chance"].sum()), others)
    for f in forms:
        rate, c, w = fit(pick(f, True) + shared * cut, float(n["chance"][n["form"] == f].sum()), pick(f, False) + shared * share(others))
        out.append(pd.DataFrame({"form": f, "kind": kinds, "rate": rate, "ratio": np.log(c) - np.log(w)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"form": [], "kind": [], "rate": [], "ratio": []})


def judge(evidence: DataFrame, registry: DataFrame, *, usual_share: float = 0.003, usual_field: float = 0.01, fitted: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(replies, limits)``: each distinct reply with ``source, form, n, kind, posterior, log_odds, truncated``, and the limits.

    ``source`` is the dataset of the reply's ``video_id``, ``(unknown)`` where that has none. An ending is usual where it
    makes up ``usual_share`` of its form's replies (``usual_field`` for labelled lines), so there are at most 1 / usual_share
    usual endings a form. ``log_odds`` combine the censoring posterior at the reply's length (the form's rate of cuts at other
    lengths) with what its kind of ending shows. ``fitted=False`` leaves the length fit out, to measure what it contributes.
    Ties and repeated rows count once; empty tables give empty results.
    """
    spark = evidence.sparkSession
    dims = registry.where("video_id is not null").groupBy("video_id").agg(F.min(clean_dataset(F.col("dataset"))).alias("source"))
    rows = spread_lookup(replies(evidence), dims, "video_id", F.struct("video_id", "chunk_idx", "attempt"), keys=evidence.select("video_id")).withColumn("source", F.coalesce("source", F.lit("(unknown)")))
    rows = stage(rows, "replies")
    limits = stage(limit_posteriors(rows.groupBy("source", "n", "ending").agg(F.count("*").alias("c")).groupBy("source", "n").agg(F.sum("c").alias("count"), F.count("*").alias("endings"))).where(F.lit(fitted)), "limits")
    ends = rows.groupBy("form", "ending").agg(F.count("*").alias("c"))
    sums = rows.groupBy("form").agg(F.count("*").alias("all"))
    least = F.greatest(F.lit(5), F.when(F.col("form") == "fields", usual_field).otherwise(usual_share) * F.col("all"))
    labelled = (F.col("form") != "fields") | ~F.col("ending").startswith("|")
    usual = ends.join(F.broadcast(sums), "form").where((F.col("c") >= least) & labelled).select("form", "ending", F.lit(True).alias("usual"))  # sums: 4 forms
    rows = rows.join(F.broadcast(usual), ["form", "ending"], "left").withColumn("kind", kind_of_ending())  # at most 4 / usual_share rows
    at = limits.where("posterior > 0").select("source", "n", "posterior")
    rows = rows.join(F.broadcast(at) if at.limit(100_001).count() <= 100_000 else at, ["source", "n"], "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))
    seen = rows.groupBy("form", "kind", F.round("posterior", 2).alias("posterior")).agg(F.count("*").alias("n"))  # at most 4 forms x 5 kinds x 101
    found = fit_endings(pd.DataFrame([tuple(r) for r in seen.collect()], columns=["form", "kind", "posterior", "n"]))
    shows = spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in found.itertuples(index=False)], "form string, kind string, rate double, ratio double")
    scored = rows.join(F.broadcast(shows), ["form", "kind"], "left")
    prior = F.least(F.greatest("posterior", "rate"), F.lit(0.98))  # a length alone never makes sure
    scored = scored.withColumn("log_odds", F.log(prior / (1 - prior)) + F.col("ratio") + F.when(F.col("leftover"), LEFTOVER).otherwise(0.0))
    return scored.select("video_id", "chunk_idx", "attempt", "source", "form", "n", "kind", "posterior", "log_odds", ((F.col("log_odds") > 0) & (F.col("leftover") | ~F.col("kind").isin(*WHOLE))).alias("truncated")), limits


def truncated_replies(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """``(video_id, chunk_idx, attempt)`` of the incomplete replies."""
    return judge(evidence, registry)[0].where("truncated").select("video_id", "chunk_idx", "attempt").distinct()


def truncation_rates(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """The share of incomplete replies per source."""
    rows = judge(evidence, registry)[0]
    return rows.groupBy("source").agg(F.count("*").alias("n_replies"), F.count_if("truncated").alias("n_truncated"), F.avg(F.col("truncated").cast("int")).alias("share"))
