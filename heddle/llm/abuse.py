"""Abusive, hateful or sexually explicit language (problem 8).

A linear classifier over windows of words is trained from the reviewers' document labels and applied to every text. Labels
hold for whole documents, so training alternates between picking each abusive document's most suspicious windows and fitting
on them. Fitting is counterfactually regularised: in training windows the names of groups are swapped for others and the
squared change of the score is penalised, so that naming a group does not count as abuse.

A window's score is a sum over its words, word pairs, triples and letter groups; sliding windows are therefore differences of
running sums and a document costs time in proportion to its length. Scores follow whole texts, in any mix of languages.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import BLANK, random_key
from heddle.llm.leakage import LOOKALIKES_AND_HIDDEN
from heddle.session import local_file, put_file, stage

BITS = 18
WINDOW, STRIDE = 12, 3

#: Digits and signs that stand for letters.
LEET = str.maketrans("013457@$", "oieastas")

#: Words that name groups of people, in the four languages of the corpus.
GROUPS = (
    "women men girls boys gays lesbians jews muslims christians blacks whites asians immigrants migrants refugees foreigners newcomers gypsies disabled",
    "frauen männer mädchen jungen schwule lesben juden muslime christen schwarze migranten flüchtlinge ausländer zuwanderer",
    "femmes hommes filles gays lesbiennes juifs musulmans chrétiens noirs migrants immigrés réfugiés étrangers",
    "mujeres hombres chicas gais lesbianas judíos musulmanes cristianos negros migrantes inmigrantes refugiados extranjeros",
)
#: Endings of the names of peoples.
PEOPLE = re.compile(r"^\w{3,}(?:ians|ites|rans|eses|iten|ianer|iens|iennes|itas|ianos|ranos|arans)$")
GROUP_WORDS = frozenset(w for line in GROUPS for w in line.split())

_SPACED = re.compile(r"(?<![\w*])(?:[^\W_][ .\-_·]){2,}[^\W_](?![\w*])")
_BLANK = re.compile(f"{BLANK}*")
_RUN = re.compile(r"(\w)\1{2,}")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$'’][^\W_]*)*|[*@$][^\W_*@$]+[^\s.,;!?]*")


def plain(text: str) -> str:
    """Lower case without lookalike letters, hidden characters, letters set apart and letters drawn out."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES_AND_HIDDEN)
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]) if any(c.isalpha() for c in m[0]) else m[0], " ".join(text.lower().split()))
    return _RUN.sub(r"\1", text)


class Words:
    """Turns texts into words; masked, joined and digit-spelled words are resolved by the words of the training texts."""

    def __init__(self, common: Mapping[str, int]) -> None:
        self.count = {w: n for w, n in common.items() if n >= 2}
        self.by_length: dict[int, list] = {}
        for w in sorted(self.count, key=lambda w: -self.count[w]):
            self.by_length.setdefault(len(w), []).append(w)
        self.known: dict[str, list[str]] = {}

    def resolve(self, t: str) -> list[str]:
        if t in self.count or t.isdigit():
            return [t]
        if (got := self.known.get(t)) is None:
            got = self._resolve(t)
            if len(self.known) < 200_000:
                self.known[t] = got
        return got

    def _resolve(self, t: str) -> list[str]:
        t = t.lstrip("@")
        if "*" in t:
            mask = re.compile(re.escape(t).replace(r"\*", "."))
            return [next((w for w in self.by_length.get(len(t), ()) if mask.fullmatch(w)), t.replace("*", ""))]
        if any(c.isdigit() or c in "@$" for c in t) and any(c.isalpha() for c in t):
            a = t.translate(LEET)
            t = next((x for x in (a, t.replace("1", "l").translate(LEET)) if x in self.count), a)
        t = t.replace("’", "'")
        if t not in self.count and len(t) >= 9 and (cut := self.split(t)):
            return cut
        return [t] if t else []

    def split(self, t: str) -> list[str] | None:
        """``t`` as known words, as few and as long as can be; None where it is none."""
        best: list = [(0, [])] + [None] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - 16), j):
                w = t[i:j]
                if best[i] is not None and w in self.count and (len(w) > 2 or w in ("a", "i", "of", "is", "in", "to", "so", "you", "me", "my", "up", "at", "we")):
                    s = best[i][0] + len(w) ** 2
                    if best[j] is None or s > best[j][0]:
                        best[j] = (s, [*best[i][1], w])
        return best[-1][1] if best[-1] and len(best[-1][1]) <= 6 else None

    def of(self, text: str | None) -> list[str]:
        return [w for t in _TOKEN.findall(plain(text or "")) for w in self.resolve(t)]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def _letters(w: str) -> list[str]:
    x = f"<{w}>"
    return [x[i : i + 4] for i in range(len(x) - 3)] if len(w) > 4 and not w.isdigit() else []


class Encoder:
    """Feature ids of words, pairs, triples and letter groups, for a batch of tokenised texts laid end to end."""

    def __init__(self, texts: list[list[str]]) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        flat = np.array(["#" if w.isdigit() else w for t in texts for w in t], dtype=object)
        self.codes, self.vocabulary = pd.factorize(flat) if len(flat) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object))
        self.hash = pd.util.hash_array(np.asarray(self.vocabulary, dtype=object), categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)
        h, n = self.hash[self.codes], len(flat)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        self.one = _mix(self.hash, 1).astype(np.int64)
        self.two = _mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5), 2).astype(np.int64) if n > 1 else np.zeros(0, dtype=np.int64)
        self.three = _mix(h[:-2] * np.uint64(7) + h[1:-1] * np.uint64(11) + h[2:] * np.uint64(13), 3).astype(np.int64) if n > 2 else np.zeros(0, dtype=np.int64)
        self.same2, self.same3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
        grams = [_letters(w) for w in self.vocabulary]
        self.gram_len = np.array([len(g) for g in grams], dtype=np.int64)
        every = np.array([g for x in grams for g in x], dtype=object)
        self.grams = _mix(pd.util.hash_array(every, categorize=False), 4).astype(np.int64) if len(every) else np.zeros(0, dtype=np.int64)
        self.gram_at = np.concatenate([[0], np.cumsum(self.gram_len)]).astype(np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Running sums of what each word adds, its pairs and triples counted at their last word."""
        if not len(self.codes):
            return np.zeros(1)
        letters = np.concatenate([[0.0], np.cumsum(weights[self.grams])])
        per_word = weights[self.one] + 0.3 * (letters[self.gram_at[1:]] - letters[self.gram_at[:-1]])
        add = per_word[self.codes]
        self.add1 = add
        out = np.zeros(len(add) + 1)
        if len(add) > 1:
            add = add.copy()
            add[1:] += weights[self.two] * self.same2
        if len(add) > 2:
            add[2:] += weights[self.three] * self.same3
        np.cumsum(add, out=out[1:])
        return out

    def windows(self, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, end) of all windows."""
        rows = []
        for d, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            if b > a:
                at = np.arange(a, max(a + 1, b - WINDOW + stride), stride)
                rows.append(np.stack([np.full(len(at), d), at, np.minimum(at + WINDOW, b)], axis=1))
        return tuple(np.concatenate(rows).T) if rows else (np.zeros(0, dtype=np.int64),) * 3

    def matrix(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of the given windows."""
        rows, ids, values = [], [], []
        for r, (a, b) in enumerate(zip(first, end, strict=True)):
            c = self.codes[a:b]
            g = np.concatenate([self.grams[self.gram_at[k] : self.gram_at[k + 1]] for k in c])
            two = self.two[a : b - 1] if b - a > 1 else self.two[:0]
            three = self.three[a : b - 2] if b - a > 2 else self.three[:0]
            x = np.concatenate([self.one[c], two, three, g])
            rows.append(np.full(len(x), r))
            ids.append(x)
            values.append(np.concatenate([np.ones(len(x) - len(g)), np.full(len(g), 0.3)]))
        return np.concatenate(rows), np.concatenate(ids), np.concatenate(values)


def _fit(x: tuple, y: np.ndarray, cost: np.ndarray, swap: tuple | None, n_swaps: int, *, l2: float, fairness: float, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad, with ``fairness`` times the mean squared score of the swap differences added."""
    rows, ids, values = x
    w, b, g2, gb2 = np.zeros(2**BITS), -2.0, np.full(2**BITS, 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(rows, values * w[ids], len(y)) + b
        r = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / cost.sum()
        grad = np.bincount(ids, r[rows] * values, 2**BITS) + l2 * w
        if swap is not None:
            d = np.bincount(swap[0], swap[2] * w[swap[1]], n_swaps)
            grad += fairness * np.bincount(swap[1], d[swap[0]] * swap[2], 2**BITS) / n_swaps
        g2 += grad**2
        gb2 += float(r.sum()) ** 2
        w -= 0.5 * grad / np.sqrt(g2)
        b -= 0.5 * float(r.sum()) / np.sqrt(gb2)
    return w, b


def is_group(w: str) -> bool:
    return w in GROUP_WORDS or bool(PEOPLE.match(w))


class AbuseModel:
    """Weights, bias, the share of texts that are abusive and the words needed to apply them."""

    def __init__(self, words: Words, weights: np.ndarray, bias: float, share: float) -> None:
        self.words, self.weights, self.bias, self.share = words, weights.astype(np.float32), bias, share

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """The greatest window probability of each text; 0 for texts without words."""
        e, out = Encoder(texts), np.zeros(len(texts))
        s = e.sums(self.weights.astype(np.float64))
        doc, a, b = e.windows(1)
        if len(doc):
            z = s[b] - s[a]
            # pairs and triples that begin before the window are taken off again
            for k, w, same in ((1, e.two, e.same2), (2, e.three, e.same3)):
                for j in range(1, k + 1):
                    at = a - j
                    ok = (at >= 0) & (at < len(w)) & (at + k < b)
                    ok[ok] = same[at[ok]]
                    z[ok] -= self.weights[w[at[ok]]]
            p = 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))
            np.maximum.at(out, doc, p)
        return out


def true_share(labels: np.ndarray, scores: np.ndarray, weights: np.ndarray) -> float:
    """The share of abusive texts among the reviewed ones, without the wrong labels, from scores of models that did not see them.

    The labels of the least suspicious three tenths show how many harmless texts are labelled abusive; abusive ones labelled
    harmless are not made up for.
    """
    low = scores <= np.quantile(scores, 0.3)
    false = np.average(labels[low], weights=weights[low])
    return float(max(0, np.average(labels, weights=weights) - false) / max(0.1, 1 - false))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None, *, seed: int = 42, alternations: int = 3, l2: float = 2e-6, fairness: float = 0.5, doubt: float = 0.15) -> AbuseModel:
    """Fits on labelled texts, without those whose label a model of the other half of the texts contradicts.

    ``doubt`` is the probability of its label under which a text is left out. ``weights`` say how many reviewed texts each one
    stands for. Without both labels nothing is ever flagged.
    """
    raw = [_TOKEN.findall(plain(t)) for t in texts]
    words = Words(Counter(w for t in raw for w in {*t} if w.isalpha()))
    if not len(labels) or labels.min() == labels.max():
        return AbuseModel(words, np.zeros(2**BITS), -30.0, 0.0)
    tokens = [[w for t in r for w in words.resolve(t)] for r in raw]
    rng = np.random.default_rng(seed)
    fold, other = rng.random(len(tokens)) < 0.5, np.zeros(len(tokens))
    for part in (fold, ~fold):  # what the other half of the reviews says about these
        if len(set(labels[~part])) == 2 and part.any():
            at, rest = np.flatnonzero(part), np.flatnonzero(~part)
            other[at] = AbuseModel(words, *_alternate([tokens[i] for i in rest], labels[rest], rng, 2, l2, fairness), 0.5).score([tokens[i] for i in at])
        else:
            other[part] = labels[part]
    wrong = ((labels == 1) & (other < doubt)) | ((labels == 0) & (other > 1 - doubt))
    good = np.flatnonzero(~wrong) if len(set(labels[~wrong])) == 2 else np.arange(len(tokens))
    share = true_share(labels, other, np.ones(len(labels)) if weights is None else weights)
    return AbuseModel(words, *_alternate([tokens[i] for i in good], labels[good], rng, alternations, l2, fairness), share)


def _alternate(tokens: list[list[str]], labels: np.ndarray, rng: np.random.Generator, alternations: int, l2: float, fairness: float) -> tuple[np.ndarray, float]:
    """Weights and bias, from ``alternations`` rounds of picking windows and fitting on them."""
    e, y = Encoder(tokens), labels.astype(float)
    doc, a, b = e.windows(STRIDE)
    # start from how much more often a feature occurs in abusive documents than in others
    seen = [np.zeros(2**BITS), np.zeros(2**BITS)]
    for d, (s, t) in enumerate(zip(e.starts[:-1], e.starts[1:], strict=True)):
        if t > s:
            ids = np.unique(np.concatenate([e.one[e.codes[s:t]], e.two[s : t - 1], e.three[s : max(s, t - 2)]]))
            seen[int(y[d])][ids] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    weights = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    weights[seen[0] + seen[1] < 2] = 0
    weights, bias = np.clip(weights, 0, 4), 0.0
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(y)))])
    for k in range(alternations):
        s = e.sums(weights)
        z = s[b] - s[a]
        chosen, target = [], []
        for d in range(len(y)):
            i = np.arange(starts[d], starts[d + 1])
            if not len(i):
                continue
            order = i[np.argsort(-z[i], kind="stable")]
            take = list(order[:1]) if y[d] else [*order[:4], *rng.choice(i, min(2, len(i)), replace=False)]
            chosen += take
            target += [y[d]] * len(take)
        chosen, target = np.array(chosen), np.array(target)
        cost = np.ones(len(target))
        if k:  # labels that the model firmly contradicts count less
            p = 1 / (1 + np.exp(-np.clip(z[chosen] + bias, -30, 30)))
            cost = np.where((target == 1) & (p < 0.1), 0.2, np.where((target == 0) & (p > 0.9), 0.2, 1.0))
        swap, n_swaps = _swaps(e, a[chosen], b[chosen], rng)
        weights, bias = _fit(e.matrix(a[chosen], b[chosen]), target, cost, swap, n_swaps, l2=l2, fairness=fairness)
    return weights, bias


def _swaps(e: Encoder, first: np.ndarray, end: np.ndarray, rng: np.random.Generator) -> tuple[tuple | None, int]:
    """Feature differences of training windows and the same windows with each group's name swapped for another."""
    vocabulary = list(e.vocabulary)
    names = sorted(w for w in vocabulary if is_group(w))
    if len(names) < 2:
        return None, 0
    group = np.array([is_group(w) for w in vocabulary])
    hit = [(a, b) for a, b in zip(first, end, strict=True) if group[e.codes[a:b]].any()]
    if not hit:
        return None, 0
    before = [[vocabulary[c] for c in e.codes[a:b]] for a, b in hit]
    after = [[str(rng.choice(names)) if is_group(w) else w for w in t] for t in before]
    rows, ids, values = [], [], []
    for sign, texts in ((1.0, before), (-1.0, after)):
        x = Encoder(texts)
        r, i, v = x.matrix(x.starts[:-1], x.starts[1:])
        rows, ids, values = [*rows, r], [*ids, i], [*values, sign * v]
    return (np.concatenate(rows), np.concatenate(ids), np.concatenate(values)), len(hit)


def labelled_sample(documents: DataFrame, labels: DataFrame, size: int, seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``size`` abusive and twice as many other documents, drawn by smallest random key.

    A document's label is the majority of its non-null labels; even splits and null or blank texts are left out. The ids, three
    times ``size`` at most, are broadcast, so the texts are not shuffled.
    """
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share != 0.5")
    votes = votes.select("doc_id", (F.col("share") > 0.5).cast("int").alias("y"), random_key(seed, F.col("doc_id")).alias("k"))
    voted = {r.y: r.n for r in votes.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = [votes.where(F.col("y") == y).orderBy("k", "doc_id").limit(size * (2 - y)) for y in (0, 1)]
    got = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(rows[0].unionByName(rows[1])), "doc_id").select("k", "doc_id", "text", "y")
    kept = sorted((r.k, r.doc_id, r.text, r.y) for r in got.toLocalIterator() if not _BLANK.fullmatch(r.text))  # three times size at most
    texts, y = [r[2] for r in kept], [r[3] for r in kept]
    y = np.array(y, dtype=np.int64)
    return texts, y, np.array([voted.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])[y] if len(y) else np.zeros(0)


_models: dict[tuple, tuple] = {}


def stored_model(documents: DataFrame, labels: DataFrame, train_size: int, seed: int) -> tuple[str, float]:
    """The file of the model fitted on these tables, and its share; fitted once an application for all its queries."""
    key = (documents.sparkSession.sparkContext.applicationId, documents.semanticHash(), labels.semanticHash(), train_size, seed)
    if key not in _models:
        model = train(*labelled_sample(documents, labels, train_size, seed), seed=seed)
        _models[key] = put_file(documents.sparkSession, "abuse-model", pickle.dumps(model, protocol=5)), model.share
    return _models[key]


def score_documents(documents: DataFrame, labels: DataFrame, *, train_size: int = 4_000, seed: int = 42, least_score: float = 0.02) -> DataFrame:
    """``(doc_id, source, score, abusive)`` for every document; null and blank texts score 0.

    The classifier is fitted on the driver from ``train_size`` abusive and twice as many other documents at most and given to
    the executors as a file; everything else runs over all rows. The threshold is where the share of documents above it equals
    the share of abusive ones among the reviewed, wrong labels taken off (reviewed documents are taken to be a random sample),
    but ``least_score`` at least; it is read from a histogram of all scores in steps of a hundredth of their log-odds. Repeated
    documents are scored alike under each id, extra columns are not read, empty tables give no rows.
    """
    name, share = stored_model(documents, labels, train_size, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(local_file(name), "rb") as f:
            model = pickle.load(f)
        for p in batches:
            for i in range(0, len(p), 500):
                part = p.iloc[i : i + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "score": model.score([model.words.of(t) for t in part["text"]])})

    scores = stage(documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double"), "abuse-scores")
    odds = F.floor(100 * F.log(F.col("score") / (1 - F.least("score", F.lit(1 - 1e-12)))))
    steps = sorted(((r.b, r.n) for r in scores.where("score > 0").groupBy(odds.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 6,000 steps
    room, threshold = share * sum(n for _, n in steps), 2.0
    for b, n in steps:
        if room < n / 2:
            break
        room, threshold = room - n, 1 / (1 + math.exp(-b / 100))
    return scores.withColumn("abusive", F.col("score") >= max(threshold, least_score))


def abusive_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id)`` of the affected documents."""
    return score_documents(documents, labels).where("abusive").select("doc_id")


def abuse_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The share of affected documents per source, spelling aside; ``(unknown)`` where the source is missing."""
    from heddle.llm.common import clean_dataset

    source = F.coalesce(clean_dataset(F.col("source")), F.lit("(unknown)"))
    return score_documents(documents, labels).groupBy(source.alias("source")).agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("share"))
