"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A document becomes some twenty numbers: densities of a lexicon's words, how near they stand to the second person, shares
of capitals and of punctuation, and rates of obfuscation (a lexicon's word spelt with digits, symbols or marks between its
letters). The lexicon is a few seeds, and the words and stems (beginnings of words, as lexicons list them for their endings)
that the labelled sample holds far more often in toxic documents. Trees are fitted to the larger part of the sample by Newton boosting on quantile bins; the rest calibrates their sum by pooling
adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marlspike.llm.common import flat, held_out, labelled_sample, lowered, slices, sums, words

#: At most so many labelled documents are gathered to fit the model.
SAMPLE = 8000
THRESHOLD = 0.5
#: Lengths in bytes of the beginnings that may be stems.
STEMS = (4, 5, 6, 7, 8)
#: A word belongs to the lexicon from this log-likelihood ratio on.
SURE = 12.0
#: A word is near the second person within so many words.
NEAR = 4
#: Words that insult in English; the sample gives the others.
SEEDS = ["idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "pathetic", "worthless", "disgusting", "scum", "trash", "filth", "vermin", "clown", "jerk", "imbecile", "dumb"]
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "tú", "usted", "ustedes", "vosotros"]

# Letters that digits and symbols stand for.
_READ = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"0134578@$!|+", b"oieastbasilt", strict=True):
    _READ[_a] = _b
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:?!'\"()-#$%&*|/@_")] = True


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, hashes, disguised, low, capital) of each word, read as letters: case, disguises and marks are undone, and a word's own end marks don't count. hashes: of the word and its stems."""
    low, capital = lowered(data)
    letter = _LETTER[low]
    # a digit or symbol reads as a letter where a letter of the same word follows; else it is a mark
    read = _READ[low]
    n = len(data)
    place = np.arange(n + 1, dtype=np.int32)
    stop = np.full(n + 1, n, np.int32)
    np.copyto(stop[:n], place[:n], where=data <= 32)
    stop[offsets] = offsets
    following = np.full(n + 1, n, np.int32)
    np.copyto(following[:n], place[:n], where=letter)
    behind = lambda v: np.minimum.accumulate(v[::-1])[::-1][1:]
    as_letter = letter | (~letter & _LETTER[read] & (behind(following) < behind(stop)))
    row, start, end, *hashes = words(data, offsets, np.where(as_letter, read, low), as_letter, STEMS)
    odd = sums(as_letter & ~letter, start, end)
    # marks between the letters of a word
    first = np.where(letter, np.arange(len(data)), 0)
    inner = np.zeros(len(start))
    if len(start):
        last = np.maximum.accumulate(first)[end - 1]
        mark = ~as_letter & (data != 39) & (data != 45)
        inner = sums(mark, start, np.clip(last, start, end))
    return row, start, end, hashes, (odd + inner) > 0, low, capital


def word_hashes(strings: list[str]) -> np.ndarray:
    return read_words(*flat(pa.array(strings, pa.string())))[3][0]


def _among(hashes: list[np.ndarray], listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, place in listed) of each hash in a sorted list; few are, so most leave by a table of their first bits."""
    table = np.zeros(1 << 16, bool)
    table[(listed >> np.uint64(48)).astype(np.int64)] = True
    words_, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h in hashes if len(listed) else []:
        some = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(listed, h[some]), len(listed) - 1)
        good = listed[at] == h[some]
        words_.append(some[good])
        places.append(at[good])
    return np.concatenate(words_), np.concatenate(places)


def features(data: np.ndarray, offsets: np.ndarray, strong: np.ndarray, strong_odds: np.ndarray, mild: np.ndarray) -> np.ndarray:
    """One line of numbers per row; strong (sorted hashes) and mild are the lexicon."""
    n = len(offsets) - 1
    row, start, end, hashes, disguised, low, capital = read_words(data, offsets)
    h = hashes[0]
    count = lambda weights=None: np.bincount(row, weights, n).astype(np.float64)
    odds = np.zeros(len(h))
    word, place = _among(hashes, strong)
    np.maximum.at(odds, word, strong_odds[place])
    hit = odds > 0
    soft = np.zeros(len(h), bool)
    soft[_among(hashes, mild)[0]] = True
    soft &= ~hit
    you = np.isin(h, _YOU)
    upto = np.concatenate([[0], np.cumsum(you)])
    begin = np.searchsorted(row, np.arange(n + 1))
    place = np.arange(len(h))
    near = upto[np.minimum(place + NEAR + 1, begin[row + 1])] - upto[np.maximum(place - NEAR, begin[row])] > 0 if len(h) else np.zeros(0, bool)
    letters = np.maximum(sums(_LETTER[low], offsets[:-1], offsets[1:]), 1)
    capitals = sums(capital, offsets[:-1], offsets[1:])
    size = np.maximum(offsets[1:] - offsets[:-1], 1)
    w = np.maximum(count(), 1)
    top = np.zeros(n)
    np.maximum.at(top, row, odds)
    shouted = (sums(capital, start, end) >= 3) & (sums(capital, start, end) >= 0.6 * (end - start))
    hits = count(hit)
    return np.stack(
        [
            hits / w,
            np.log1p(hits),
            count(odds) / w,
            top,
            count(soft) / w,
            np.log1p(count(soft)),
            count(you) / w,
            count(hit & near) / w,
            np.log1p(count(hit & near)),
            count(hit & near) / np.maximum(hits, 1),
            count(hit & disguised) / w,
            np.log1p(count(hit & disguised)),
            count(disguised) / w,
            count(hit & shouted) / w,
            capitals / letters,
            count(shouted) / w,
            sums(data == 33, offsets[:-1], offsets[1:]) / w,
            sums(_PUNCT[data], offsets[:-1], offsets[1:]) / size,
            np.log1p(w),
        ],
        1,
    )


_YOU = np.sort(word_hashes(SECOND_PERSON))


def lexicon(texts: pa.ChunkedArray, y: np.ndarray, most: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strong hashes sorted, their log-odds, mild hashes sorted): words in more of the toxic documents than of the others."""
    names, toxic, clean = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for begin in range(0, len(y), 250):
        row, _, _, hashes, *_ = read_words(*flat(texts.slice(begin, 250)))
        parts = [np.unique(np.stack([row[h > 0].astype(np.uint64), h[h > 0]], 1), axis=0) for h in hashes]
        pairs = np.concatenate(parts)
        bad = y[pairs[:, 0].astype(np.int64) + begin]
        names, inverse = np.unique(np.concatenate([names, pairs[:, 1]]), return_inverse=True)
        toxic = np.bincount(inverse, np.concatenate([toxic, bad]), len(names))
        clean = np.bincount(inverse, np.concatenate([clean, 1 - bad]), len(names))
    total = max(1, y.sum()), max(1, len(y) - y.sum())
    odds = np.log((toxic + 0.5) / total[0]) - np.log((clean + 0.5) / total[1])
    # twice the log-likelihood ratio of a word's share in toxic documents against theirs in all: chance words stay out of a small sample
    share, base = toxic / np.maximum(toxic + clean, 1), total[0] / (total[0] + total[1])
    part = lambda n, p, q: np.where(n > 0, n * np.log(np.maximum(p, 1e-12) / q), 0)
    surprise = 2 * (part(toxic, share, base) + part(clean, 1 - share, 1 - base))
    enough = (toxic >= 3) & (odds > 1.0)
    best = np.flatnonzero(enough & (surprise >= SURE))
    best = best[np.argsort(-surprise[best], kind="stable")[:most]]
    found = dict(zip(names[best].tolist(), odds[best].tolist(), strict=True))
    for x in word_hashes(SEEDS).tolist():
        found.setdefault(x, 2.0)
    strong = np.array(sorted(found), np.uint64)
    mild = np.sort(names[enough & (surprise >= SURE / 2) & (surprise < SURE)])
    return strong, np.array([found[int(x)] for x in strong]), mild


@dataclass
class Trees:
    """Complete binary trees: at node i of a tree, rows with x[feature] > cut go right. leaf: by tree and leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (leaf.size - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 3.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on quantile bins."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1)
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    raw = np.full(n, np.log(rate0 / (1 - rate0)))
    base = float(raw[0])
    features_, cuts_, leaves_ = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain = np.full((width, d, bins), -np.inf)
            for j in range(d):
                slot = (node - first) * (bins + 1) + codes[:, j]
                gs = np.bincount(slot, g, width * (bins + 1)).reshape(width, -1)
                hs = np.bincount(slot, h, width * (bins + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gr, hr = gs.sum(1, keepdims=True) - gl, hs.sum(1, keepdims=True) - hl
                v = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                gain[:, j] = np.where((hl >= least) & (hr >= least), v, -np.inf)
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), bins)
                if gain[i, j, c] > 1e-6 and c < len(cuts[j]):
                    feature[first + i], cut[first + i] = j, cuts[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        raw = raw + leaf[at]
        features_.append(feature)
        cuts_.append(cut)
        leaves_.append(leaf)
    return Trees(np.array(features_), np.array(cuts_), np.array(leaves_), base)


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, values): the non-decreasing fit of y on s, by pooling adjacent violators; a prior row at each end keeps values off 0 and 1."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []
    points = [(float(s[order[0]]), 0.0, 0.5), *((float(s[i]), float(y[i]), 1.0) for i in order), (float(s[order[-1]]), 1.0, 0.5)]
    for v, t, w in points:
        blocks.append([v * w, t * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    strong: np.ndarray
    odds: np.ndarray
    mild: np.ndarray
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.trees is None or not n:
            return np.full(max(n, 0), self.values[0])
        raw = self.trees.raw(features(data, offsets, self.strong, self.odds, self.mild))
        # the trees' order among documents of one block shows in a small share
        return 0.98 * np.interp(raw, self.knots, self.values) + 0.02 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(table: pa.Table) -> Model:
    """A model of (text, y). Without both labels in the table every document scores the share of label 1."""
    y = table.column("y").to_numpy().astype(np.float64)
    if len(y) < 8 or y.min() == y.max():
        none = np.zeros(0)
        return Model(none, none, none, None, none, np.array([np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)]))
    # every fourth row only calibrates
    fitted = np.arange(len(y)) % 4 != 0
    strong, odds, mild = lexicon(table.filter(pa.array(fitted)).column("text"), y[fitted])
    x = np.concatenate([features(*flat(t), strong, odds, mild) for t in (table.slice(i, 250).column("text") for i in range(0, len(y), 250))])
    trees = boost(x[fitted], y[fitted])
    knots, values = isotonic(trees.raw(x[~fitted]), y[~fitted])
    return Model(strong, odds, mild, trees, knots, values)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most `sample` labelled documents outside the held-out fifth."""
    return fit(labelled_sample(docs, labels, "toxic", sample))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted. A null text counts as empty; both have a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.documents(*flat(part.column(1))))], ["key", "score"])

    kind = docs.schema[key].dataType
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, StructType([StructField("key", kind), StructField("score", DoubleType())]))
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
