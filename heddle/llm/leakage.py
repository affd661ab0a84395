"""Evaluation texts inside a training corpus (problem 7).

Every window of a document gets a 64-bit SimHash of its weighted words and is looked up among the windows of all test items.
Windows come in several widths: short ones (``PIECE`` words, at every place of an item) find parts of items, the shortest
(``GRAIN`` words, wherever one of them is rare) parts with a change in their middle, and item-sized ones (the largest width of
``SIZES`` that an item's text fills, at its beginning and its end) whole items with changes spread over them. Fingerprints are cut into ``BLOCKS`` blocks and each block is matched with at most one changed bit, so by the
pigeonhole principle no pair within ``RADIUS`` bits is missed. The weighted word shingles of both windows are then compared
exactly; around the pairs that hold, document and item are aligned to count the words they share.

The items are a stated query set. Their weights, standing instructions and index are computed once over all items; the index
is written in segments of bounded size to the shared folder, and one scan of the corpus, without a shuffle, looks up every
segment. Word weights are inverse frequencies over all test texts, so what test items have in common (names of objects, stock
phrases) counts little and names and numbers of one item count much.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.session import local_file, put_file, stage

#: Widths in bits of the blocks of a fingerprint. Each may differ in one bit, so the radius is one less than twice their number.
BLOCKS = (21, 21, 22)
RADIUS = 2 * len(BLOCKS) - 1

#: Words of a window around a rare word, of a short window and of item-sized ones; powers of two, as sums over a width are
#: made from two of half the width.
GRAIN, PIECE, SIZES = 4, 8, (16, 64)
WIDTHS = (GRAIN, PIECE, *SIZES)

#: Letters of other scripts that look like Latin ones, and characters without width.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "ν": "v", "ο": "o", "α": "a", "ι": "i", "ρ": "p", "τ": "t", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J"}
WIDTHLESS = "​‌‍⁠﻿­͏᠎"
LOOKALIKES_AND_HIDDEN = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in WIDTHLESS}

_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|span|strong|font|mark|small|code|sub|sup)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_STAMP = re.compile(r"\[\d+(?:\.\d+)?s?(?:\s*-\s*\d+(?:\.\d+)?s?)?\]|\(\d+(?:\.\d+)?s\)|\bt=\d+:|\b\d{1,2}:\d\d(?::\d\d)?\b")
_BROKEN = re.compile(r"(?<=\w)[-‐]\n\s*(?=[a-z])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup, escapes, time stamps, lookalike letters and hidden characters."""
    if not text:
        return []
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES_AND_HIDDEN)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if ":" in text or "[" in text or "(" in text:
        text = _STAMP.sub(" ", text)
    return _WORD.findall(text.lower())


def sentences(question: str | None) -> list[str]:
    return re.split(r"(?<=[.?!])\s+", (question or "").strip())


def standing(questions: Iterable[str | None], least: int = 4) -> set[str]:
    """The standing instructions: sentences that end ``least`` or more different questions."""
    ends = Counter(s for p in {tuple(sentences(q)) for q in questions} if len(p) > 1 for s in p[1:])
    return {s for s, n in ends.items() if n >= least}


def question_core(question: str | None, instructions: set[str]) -> str:
    """A question without the standing instructions."""
    return " ".join(s for i, s in enumerate(sentences(question)) if i == 0 or s not in instructions)


class Common:
    """What all items have in common, from ``rows()``: standing instructions, word weights and the least weight of a rare word.

    Words are known by their hashes, in ascending order; a word's code is its place there, -1 for words of no item.
    """

    def __init__(self, rows: Callable[[], Iterable[tuple]], width: int) -> None:
        self.instructions = standing(q for *_, q in rows())
        seen, texts = Counter(), set()
        for _, passage, question in rows():
            for text in (passage, question_core(question, self.instructions)):
                w = words(text)
                if len(w) >= width and (key := hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest()) not in texts:
                    texts.add(key)
                    seen.update(set(w))
        vocabulary = np.array(list(seen), dtype=object)
        hashes = pd.util.hash_array(vocabulary, categorize=False) if len(vocabulary) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = np.array([max(1, round(math.log(len(texts) / seen[w]))) for w in vocabulary[order]], dtype=np.int16)
        self.rare = 0.6 * math.log(max(2, len(texts)))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1).astype(np.int64)


class Texts:
    """Tokenised texts laid end to end: for each word its code (from -2 down for words of no item), for each text its place."""

    def __init__(self, texts: list[list[str]], common: Common) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        flat = np.array([w for t in texts for w in t], dtype=object)
        at, vocabulary = pd.factorize(flat) if len(flat) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object))
        hashes = pd.util.hash_array(np.asarray(vocabulary, dtype=object), categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)
        codes = common.codes(hashes)
        weights = np.where(codes >= 0, common.weights[codes] if len(common.weights) else 1, 1).astype(np.int16)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.signs = (bits.astype(np.int16) * 2 - 1) * weights[:, None]
        self.at = at
        self.codes = np.where(codes < 0, -2 - np.arange(len(codes)), codes)[at]
        self.weights = weights[at].astype(np.int32)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        self.rare = np.concatenate([[0], np.cumsum(self.weights >= common.rare)])  # rare words before each place

    def fingerprints(self, widths: tuple[int, ...], step: int = 16_384) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each width the places of all windows inside a text and their fingerprints; under PIECE, of those with a rare word."""
        out: dict[int, list] = {w: [] for w in widths}
        n, most = len(self.at), max(widths, default=1)
        for a in range(0, n, step):
            sums, width = self.signs[self.at[a : a + step + most - 1]], 1
            for w in sorted(widths):
                while width < w:
                    sums, width = sums[:-width] + sums[width:] if len(sums) > width else sums[:0], 2 * width
                part = sums[:step]
                out[w].append(np.packbits(part > 0, axis=1, bitorder="little").view(np.uint64).ravel())
        found = {}
        for w, prints in out.items():
            p = np.concatenate(prints) if prints else np.zeros(0, dtype=np.uint64)
            inside = self.owner[: len(p)] == self.owner[w - 1 : w - 1 + len(p)]
            if w < PIECE:
                inside &= self.rare[w : w + len(p)] > self.rare[: len(p)]
            found[w] = np.flatnonzero(inside), p[inside]
        return found


class Segment:
    """The index over the texts of some items: their words, the fingerprints of their windows and the tables over these."""

    def __init__(self, rows: list[tuple], common: Common) -> None:
        owners: dict[tuple, set] = {}
        for item, passage, question in rows:
            for text in (passage, question_core(question, common.instructions)):
                if len(w := words(text)) >= PIECE:
                    owners.setdefault(tuple(w), set()).add(item)
        self.owners = [sorted(v) for v in owners.values()]
        t = Texts([list(k) for k in owners], common)
        self.starts, self.codes, self.weights = t.starts, t.codes, t.weights
        prints, at, width = [], [], []
        for w, (where, p) in t.fingerprints(WIDTHS).items():
            if w in SIZES:  # item-sized windows stand at the beginning and the end of the texts of their size
                n = np.diff(t.starts)[t.owner[where]]
                own = (n >= w) & (n < min((s for s in SIZES if s > w), default=np.inf))
                keep = own & ((where == t.starts[t.owner[where]]) | (where + w == t.starts[t.owner[where] + 1]))
                where, p = where[keep], p[keep]
            prints, at, width = [*prints, p], [*at, where], [*width, np.full(len(p), w)]
        self.prints, self.at, self.width = np.concatenate(prints), np.concatenate(at), np.concatenate(width)
        self.owner = t.owner
        self.tabulate()

    def tabulate(self) -> None:
        """The tables over the fingerprints. They are many times as large, so a worker makes them when it opens the segment."""
        self.tables, shift = [], 0
        for bits in BLOCKS:
            key = self.key(self.prints, shift, bits)
            near = np.concatenate([key, *(key ^ (1 << b) for b in range(bits))])
            who = np.tile(np.arange(len(key)), bits + 1)
            starts = np.zeros(2**bits + 1, dtype=np.int32)
            np.cumsum(np.bincount(near, minlength=2**bits), out=starts[1:])
            self.tables.append((starts, who[np.argsort(near, kind="stable")].astype(np.int32)))
            shift += bits

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.tabulate()

    @staticmethod
    def key(prints: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return ((prints >> np.uint64(shift)) & np.uint64(2**bits - 1)).astype(np.int64)

    def neighbours(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all pairs within RADIUS bits, each once or more."""
        left, right, shift = [], [], 0
        for bits, (starts, who) in zip(BLOCKS, self.tables, strict=True):
            key = self.key(prints, shift, bits)
            first, n = starts[key], starts[key + 1] - starts[key]
            a = np.repeat(np.arange(len(prints)), n)
            b = who[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(a))]
            near = np.bitwise_count(prints[a] ^ self.prints[b]) <= RADIUS
            left.append(a[near])
            right.append(b[near])
            shift += bits
        return np.concatenate(left), np.concatenate(right)

    def pairs(self, t: Texts, prints: dict, least: float, long_run: int, step: int = 100_000) -> np.ndarray:
        """Rows (text, item text, first, end, run) for each window of ``t`` whose shingles are ``least`` similar to an item's.

        ``run`` is 1 for windows inside ``long_run`` equal words in sequence, which are as many equal windows on one diagonal.
        """
        out, equal = [], []
        for w, (where, p) in prints.items():
            few = max(1, 4_000_000 // w**2)
            for i in range(0, len(p), step):
                a, b = self.neighbours(p[i : i + step])
                same = self.width[b] == w
                at, item = where[i : i + step][a[same]], self.at[b[same]]
                for k in range(0, len(at), few):
                    x, y = at[k : k + few], item[k : k + few]
                    ok = shingle_similarity(t, x, self, y, w) >= least
                    out.append(np.stack([x[ok], y[ok], np.full(ok.sum(), w)]))
        if not out:
            return np.zeros((0, 5), dtype=np.int64)
        x, y, w = np.concatenate(out, axis=1)
        order = np.lexsort((x, y - x, w))  # equal places found by several blocks stand together
        x, y, w = x[order], y[order], w[order]
        once = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(w) != 0)])
        x, y, w = x[once], y[once], w[once]
        short, span = np.flatnonzero(w == PIECE), np.arange(PIECE)
        for k in range(0, len(short), 500_000):
            i = short[k : k + 500_000]
            equal.append(i[(t.codes[x[i][:, None] + span] == self.codes[y[i][:, None] + span]).all(axis=1)])
        same, run = np.concatenate([np.zeros(0, dtype=np.int64), *equal]), np.zeros(len(x), dtype=np.int64)
        apart = np.concatenate([[True], (np.diff(x[same]) != 1) | (np.diff(y[same]) != 1)]) if len(same) else np.zeros(0, dtype=bool)
        group = np.cumsum(apart) - 1
        run[same] = np.bincount(group)[group] + PIECE - 1 >= long_run if len(same) else 0
        rows = np.stack([t.owner[x], self.owner[y], x, x + w, run], axis=1)
        return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def shingle_similarity(a: Texts | Segment, at: np.ndarray, b: Texts | Segment, item: np.ndarray, width: int) -> np.ndarray:
    """The weighted Jaccard similarity of the shingles of two words in pairs of windows; a shingle weighs as its words do.

    A shingle that occurs more than once in a window counts as often; the common weight is the mean of both sides'.
    """
    place = np.arange(width - 1)
    sides = []
    for s, x in ((a, at), (b, item)):
        i = x[:, None] + place
        sides.append((s.codes[i] * 0x1_0000_0001 + s.codes[i + 1], (s.weights[i] + s.weights[i + 1]).astype(np.float32)))
    (ka, wa), (kb, wb) = sides
    equal = ka[:, :, None] == kb[:, None, :]
    common = ((wa * equal.any(axis=2)).sum(axis=1) + (wb * equal.any(axis=1)).sum(axis=1)) / 2
    return common / (wa.sum(axis=1) + wb.sum(axis=1) - common)


def align(doc: np.ndarray, weight: np.ndarray, item: np.ndarray, item_weight: np.ndarray, rare: float) -> tuple[int, float, int]:
    """Words shared by the best local alignment, the weighted similarity of the two aligned stretches, rare words shared.

    Equal words gain their weight, unequal ones cost 2, a word left out on either side 1.5. Rows are filled as a whole: the
    best way from the left is a running maximum.
    """
    ramp = 1.5 * np.arange(len(item) + 1)
    rows = np.zeros((len(doc) + 1, len(item) + 1))
    for i in range(1, len(doc) + 1):
        up = rows[i - 1]
        row = np.maximum(0.0, up - 1.5)
        np.maximum(row[1:], up[:-1] + np.where(item == doc[i - 1], float(weight[i - 1]), -2.0), out=row[1:])
        rows[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(np.argmax(rows)), rows.shape)
    n, common, both, same = 0, 0.0, 0.0, set()
    while i and j and rows[i, j] > 0:
        s, w, v = rows[i, j], float(weight[i - 1]), float(item_weight[j - 1])
        if doc[i - 1] == item[j - 1] and s == rows[i - 1, j - 1] + w:
            n, common, both = n + 1, common + w, both + w
            if w >= rare:
                same.add(int(doc[i - 1]))
            i, j = i - 1, j - 1
        elif s == rows[i - 1, j - 1] - 2.0:
            both, i, j = both + w + v, i - 1, j - 1
        elif s == rows[i - 1, j] - 1.5:
            both, i = both + w, i - 1
        else:
            both, j = both + v, j - 1
    return n, common / both if both else 0.0, len(same)


class Search:
    """What a worker does with the corpus: fingerprints each batch once and looks it up in every segment of the index."""

    held: dict[str, object] = {}

    def __init__(self, common: str, segments: list[str], least_words: int, least_similarity: float, least_rare: int, long_run: int, least_shingles: float) -> None:
        self.common, self.segments = common, segments
        self.least_words, self.least_similarity, self.least_rare, self.long_run, self.least_shingles = least_words, least_similarity, least_rare, long_run, least_shingles

    @classmethod
    def load(cls, name: str) -> object:
        """A file of the index, kept by the worker's process; at most one segment is held beside what all items share."""
        import pickle

        if name not in cls.held:
            for other in [k for k in cls.held if k.startswith("leak-segment") and name.startswith("leak-segment")]:
                del cls.held[other]
            with open(local_file(name), "rb") as f:
                cls.held[name] = pickle.load(f)
        return cls.held[name]

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = self.load(self.common)
        for p in batches:
            n = p["text"].str.len().cumsum().to_numpy()
            for _, part in p.groupby(n // 8_000_000):
                t = Texts([words(x) for x in part["text"]], common)
                prints, found = t.fingerprints(WIDTHS), {}
                for name in self.segments:
                    for (d, owner), v in self.in_segment(t, prints, common, self.load(name)).items():
                        found[d, owner] = max(found.get((d, owner), (0, 0.0)), v)
                if found:
                    ids = part["doc_id"].to_numpy()
                    yield pd.DataFrame([(ids[d], i, *v) for (d, i), v in found.items()], columns=["doc_id", "item_id", "n_words", "similarity"])

    def in_segment(self, t: Texts, prints: dict, common: Common, s: Segment) -> dict:
        """``{(text, item_id): (n_words, similarity)}`` of the stretches that count."""
        rows, found, margin = s.pairs(t, prints, self.least_shingles, self.long_run), {}, 2 * PIECE
        if not len(rows):
            return found
        # windows of one text and item that touch, or nearly do, are one stretch
        new = np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)])
        group = np.cumsum(new) * (len(t.codes) + 1)
        far = np.maximum.accumulate(group + rows[:, 3]) - group
        new[1:] |= rows[1:, 2] > far[:-1] + PIECE
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(rows)]]) - 1
        d, i, run = rows[first, 0], rows[first, 1], np.maximum.reduceat(rows[:, 4], first)
        lo, hi = np.maximum(t.starts[d], rows[first, 2] - margin), np.minimum(t.starts[d + 1], far[last] + margin)
        for k in np.flatnonzero((run > 0) | (t.rare[hi] - t.rare[lo] >= self.least_rare)):
            doc, weight = t.codes[lo[k] : hi[k]], t.weights[lo[k] : hi[k]]
            item, own = s.codes[s.starts[i[k]] : s.starts[i[k] + 1]], s.weights[s.starts[i[k]] : s.starts[i[k] + 1]]
            if not run[k] and len(set(doc[weight >= common.rare].tolist()).intersection(item.tolist())) < self.least_rare:
                continue
            got = align(doc, weight, item, own, common.rare)
            if run[k] or (got[0] >= self.least_words and got[1] >= self.least_similarity and got[2] >= self.least_rare):
                for owner in s.owners[i[k]]:
                    found[d[k], owner] = max(found.get((d[k], owner), (0, 0.0)), got[:2])
        return found


def build_index(items: DataFrame, block: int, max_items: int) -> tuple[str, list[str]]:
    """The names of the index's files: what all items share, and one file per ``block`` items."""
    import pickle

    spark = items.sparkSession
    rows = stage(items.select("item_id", "passage", "question").where("item_id is not null"), "items")
    if rows.count() > max_items:
        raise ValueError(f"more than {max_items} items; raise max_items if the driver can hold their words")
    common, names, held = Common(rows.toLocalIterator, PIECE), [], []
    kept = put_file(spark, "leak-common", pickle.dumps(common, protocol=5))

    def write() -> None:
        names.append(put_file(spark, "leak-segment", pickle.dumps(Segment(held, common), protocol=5)))
        held.clear()

    for r in rows.toLocalIterator():
        held.append(tuple(r))
        if len(held) >= block:
            write()
    if held:
        write()
    return kept, names


def find_leaks(documents: DataFrame, items: DataFrame, *, least_words: int = 10, least_similarity: float = 0.55, least_rare: int = 2, long_run: int = 12, least_shingles: float = 0.25, block: int = 5_000, max_items: int = 5_000_000) -> DataFrame:
    """``(doc_id, item_id, n_words, similarity)`` for every document that holds material of an item's passage or question.

    Windows whose fingerprints are within RADIUS are compared by their weighted shingles (``least_shingles``). A stretch
    around them counts if it shares ``least_words`` words in order, among them ``least_rare`` that few test texts have, and the
    weighted similarity of its two sides is ``least_similarity``; or if it shares ``long_run`` words in sequence, rare or not
    (standing instructions are no part of the items). ``n_words`` is the number of words the best one shares. The index is
    held in segments of ``block`` items, all looked up in one scan; the outcome does not depend on ``block``. Items that share
    a passage are all reported. More than ``max_items`` items raise ValueError, as the driver holds their vocabulary. Null or
    empty texts hold nothing, texts under ``PIECE`` words are no items. Repeated documents are reported each under its id;
    extra columns are not read.
    """
    common, segments = build_index(items, block, max_items)
    search = Search(common, segments, least_words, least_similarity, least_rare, long_run, least_shingles)
    return documents.select("doc_id", "text").where("text is not null").mapInPandas(search.__call__, "doc_id long, item_id long, n_words long, similarity double")


def leaked_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``."""
    return find_leaks(documents, items).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The test items that leaked, with the number of documents that hold them."""
    return leaked_pairs(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents"))
