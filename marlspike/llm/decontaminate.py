"""Benchmark decontamination by q-gram lemma filtering.

Each stretch of 80 characters of a benchmark item is a window, at every offset (a shorter item is one window). A document is contaminated by a window if some region of it is within
the window's edit budget, case, punctuation and white space aside. By the q-gram lemma such a region shares at least
m - q + 1 - k q of the window's q-grams (m characters, k edits), all on diagonals within k of each other. So

1. each position of the document is looked up in a bit table of the block's q-grams, and only stretches with enough hits
   for any window go on;
2. their hits are sorted by (item, diagonal band, place in the item); bands are 2k wide and overlap by k, so that one band
   holds all hits of a match; windows that hold the bound's number of hits in a band are regions;
3. each region is verified by an alignment within its band.

The benchmark is the query set: it is read in blocks of a bounded number of characters, and each block goes over all
documents, whole. One character is one byte here: Latin-1 letters are folded to a byte each, others count as their UTF-8
bytes. Punctuation, spaces and invisible format characters of all of Unicode are set aside like those of ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlspike.llm.common import flat, lowered, slices

Q = 8
WINDOW = 80
#: Edits allowed for each hundred characters of a window.
EDITS_PERCENT = 6
#: Items with fewer characters name no passage, and match nothing.
LEAST = 24
#: Benchmark characters in one block, which is what a task holds besides its documents.
BLOCK = 4_000_000
#: Windows aligned at a time.
LANES = 20_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = True
_WORD[97:123] = True
_WORD[0x80:] = True
# by code point, beyond ASCII; other planes have no such characters
_GAP = np.zeros(0x110000, bool)
_GAP[[c for c in (*range(0x80, 0x20000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c))[0] in "PZ" or unicodedata.category(chr(c)) == "Cf"]] = True


def _gap_bytes(data: np.ndarray) -> np.ndarray:
    """Where the bytes of a Unicode gap stand."""
    out = np.zeros(len(data), bool)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b = np.concatenate([data, np.zeros(3, np.uint8)])[lead[:, None] + np.arange(4)].astype(np.int64)
        more = b[:, 1:] & 0x3F
        two = (b[:, 0] & 0x1F) << 6 | more[:, 0]
        three = (b[:, 0] & 0x0F) << 12 | more[:, 0] << 6 | more[:, 1]
        four = (b[:, 0] & 0x07) << 18 | more[:, 0] << 12 | more[:, 1] << 6 | more[:, 2]
        size = 2 + (b[:, 0] >= 0xE0) + (b[:, 0] >= 0xF0)
        found = _GAP[np.where(size == 2, two, np.where(size == 3, three, four))]
        for i in range(4):
            out[lead[found & (size > i)] + i] = True
    return out


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place of each byte in data): lower case, one blank for each run of other than letters and digits, none at a row's ends."""
    low, _ = lowered(data)
    lead = data == 0xC3  # the letter is in the next byte
    word = _WORD[low] & ~lead & ~_gap_bytes(data)
    gap = ~word & ~lead
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    # a blank stands where a gap ends and a word begins, unless at the row's beginning
    place = np.flatnonzero(word)
    row = np.searchsorted(offsets, place, side="right") - 1
    gaps = np.concatenate([[0], np.cumsum(gap)])
    blank = np.zeros(len(place), bool)
    if len(place):
        blank[1:] = (gaps[place[1:]] > gaps[place[:-1]]) & (row[1:] == row[:-1])
    at = np.arange(len(place)) + np.cumsum(blank)
    out = np.full(len(place) + int(blank.sum()), 32, np.uint8)
    out[at] = low[place]
    where = np.empty(len(out), np.int64)
    where[at] = place
    where[at[blank] - 1] = place[blank]
    counts = np.bincount(row, minlength=len(offsets) - 1) + np.bincount(row[blank], minlength=len(offsets) - 1)
    return out, np.concatenate([[0], np.cumsum(counts)]), where


def grams(data: np.ndarray) -> np.ndarray:
    """Each run of eight bytes as a number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - Q + 1,), np.dtype("<u8"), buffer=data.data, strides=(1,)).astype(np.uint64)


def _slot(gram: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Block:
    """Some items, indexed by q-gram. Every stretch of an item with `size` bytes is a window of it."""

    item: np.ndarray  # its id
    text: np.ndarray  # bytes of all items
    begin: np.ndarray  # of each item in text
    length: np.ndarray
    size: np.ndarray  # of the item's windows
    edits: np.ndarray
    table: np.ndarray  # bits
    gram: np.ndarray  # sorted, one for each posting
    owner: np.ndarray  # item of each posting
    place: np.ndarray  # of each posting in its item

    @property
    def bound(self) -> np.ndarray:
        return self.size - Q + 1 - Q * self.edits

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Block:
        data, offsets, _ = normalised(*flat(pa.array(texts, pa.string())))
        length = np.diff(offsets)
        kept = np.flatnonzero(length >= LEAST)
        begin, length = offsets[:-1][kept].astype(np.int64), length[kept].astype(np.int64)
        size = np.minimum(length, WINDOW)
        edits = size * EDITS_PERCENT // 100
        each = length - Q + 1
        owner = np.repeat(np.arange(len(kept)), each)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        gram = grams(data)[begin[owner] + place] if len(owner) else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        bits = int(np.clip(np.ceil(np.log2(max(len(gram), 1) * 16 + 1)), 16, 27))
        table = np.zeros(1 << bits, bool)
        table[_slot(gram, bits)] = True
        return cls(np.array([ids[i] for i in kept], object), data, begin, length, size, edits, table, gram[order], owner[order], place[order])

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first byte, byte after the last, edits) of each region within the budget of a window of the item; bytes as in data. One for each row, window and band."""
        none = (np.zeros(0, np.int64),) * 5
        if not len(self.size):
            return none
        text, bounds, where = normalised(data, offsets)
        gram = grams(text)
        if not len(gram):
            return none
        hit = self.table[_slot(gram, int(np.log2(len(self.table))))]
        across = (bounds[1:-1][:, None] - np.arange(1, Q)).ravel()
        hit[across[(across >= 0) & (across < len(hit))]] = False
        # stretches that hold enough hits for some window
        span, least = int((self.size + self.edits).max()) - Q + 1, int(self.bound.min())
        upto = np.concatenate([[0], np.cumsum(hit)])
        stop = np.minimum(np.arange(len(hit)) + span, len(hit))
        dense = np.flatnonzero(upto[stop] - upto[:-1] >= least)
        if not len(dense):
            return none
        cover = np.zeros(len(hit) + 1, np.int32)
        np.add.at(cover, dense, 1)
        np.add.at(cover, stop[dense], -1)
        at = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
        low, high = np.searchsorted(self.gram, gram[at], side="left"), np.searchsorted(self.gram, gram[at], side="right")
        n = high - low
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = np.repeat(at, n)
        item, place = self.owner[posting], self.place[posting]
        row = np.searchsorted(bounds, at, side="right") - 1
        # the diagonal within its row, from 0 on
        most = int(self.length.max())
        diagonal = at - bounds[row] - place + most
        band = diagonal // np.maximum(self.edits[item], 1)
        # an item's gram counts once in a band, however often the text repeats it
        once = np.stack([np.tile(row, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(place, 2)], 1)
        once = once[np.lexsort(once.T[::-1])]
        once = once[np.concatenate([[True], (once[1:] != once[:-1]).any(1)])] if len(once) else once
        if not len(once):
            return none
        # from each gram on: where the bound is reached within a window, all windows between hold that many
        item, place = once[:, 1], once[:, 3]
        last = np.arange(len(once)) + self.bound[item] - 1
        short = last < len(once)
        last = np.minimum(last, len(once) - 1)
        reach = self.size[item] - Q
        good = np.flatnonzero(short & (once[last, :3] == once[:, :3]).all(1) & (place[last] - place <= reach))
        low = np.maximum(place[last] - reach, 0)[good]
        high = np.minimum(place, self.length[item] - self.size[item])[good]
        # windows of a stretch overlap from gram to gram; each goes on once
        same = np.zeros(len(good), bool)
        same[1:] = (once[good[1:], :3] == once[good[:-1], :3]).all(1)
        low[1:] = np.where(same[1:], np.maximum(low[1:], high[:-1] + 1), low[1:])
        n = np.maximum(high - low + 1, 0)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        row, window, band = once[np.repeat(good, n), :3].T
        first = band * np.maximum(self.edits[window], 1) - most + begin  # of the band's 2 k diagonals
        row, window, begin, end, edits = self._align(text, bounds, row, window, begin, first)
        if not len(row):
            return none
        return row, window, where[begin] - offsets[row], where[end - 1] + 1 - offsets[row], edits

    def _align(self, text: np.ndarray, bounds: np.ndarray, row: np.ndarray, item: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fewest edits between each window and a piece of text that begins on a diagonal of its band, drifting by k at most; those within budget."""
        found = []
        for m in np.unique(self.size[item]):
            k = m * EDITS_PERCENT // 100
            alike = np.flatnonzero(self.size[item] == m)
            for pick in np.split(alike, range(LANES, len(alike), LANES)):
                r, w, d = row[pick], item[pick], first[pick] - k
                source = self.begin[w] + place[pick]
                width = 2 * max(int(k), 1) + 2 * int(k) + 1
                lane = np.arange(width)
                size = bounds[r + 1] - bounds[r]
                far = 10**6
                start = d[:, None] + lane  # text place before which a path stands in each lane
                inside = (start >= 0) & (start <= size[:, None])
                cost = np.where(inside, 0, far)
                origin = start.copy()
                for j in range(int(m)):
                    here = start + j  # the text byte that the diagonal step reads
                    legal = (here >= 0) & (here < size[:, None])
                    byte = np.where(legal, text[np.clip(bounds[r][:, None] + here, 0, len(text) - 1)], 0)
                    step = np.where(legal, cost + (byte != self.text[source + j][:, None]), far)
                    # lane l after j+1 window bytes stands at start + l + j + 1: a deleted window byte comes from lane l+1
                    drop = np.concatenate([cost[:, 1:], np.full((len(r), 1), far)], 1) + 1
                    drop_origin = np.concatenate([origin[:, 1:], origin[:, -1:]], 1)
                    better = drop < step
                    new = np.where(better, drop, step)
                    new_origin = np.where(better, drop_origin, origin)
                    for lane_at in range(1, width):  # an inserted text byte comes from lane l-1
                        left = new[:, lane_at - 1] + 1
                        fits = (left < new[:, lane_at]) & (start[:, lane_at] + j + 1 <= size)
                        new[fits, lane_at] = left[fits]
                        new_origin[fits, lane_at] = new_origin[fits, lane_at - 1]
                    cost, origin = new, new_origin
                best = cost.argmin(1)
                edits = cost[np.arange(len(r)), best]
                ok = edits <= k
                begin = origin[np.arange(len(r)), best]
                end = start[np.arange(len(r)), best] + m
                found.append(np.stack([r, w, bounds[r] + begin, bounds[r] + np.maximum(end, begin + 1), edits])[:, ok])
        return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64),) * 5


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = BLOCK) -> Iterator[Block]:
    """The benchmark in blocks of about `limit` characters, in the order of its rows; nothing if it is empty. Null items and texts match nothing."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
        if size >= limit:
            yield Block.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block.of(ids, texts)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item_id, start, stop, edits): for each row of docs and each benchmark item found in it, the stretch from the
    first to the last region that an item's window matches, in bytes of the UTF-8 text, and the fewest edits of a window.

    Clean documents have no row; nor have null or empty texts. Repeated rows each have their own. Other columns don't matter."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    out = None
    for block in blocks(benchmark, item):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    row, window, start, stop, edits = block.matches(*flat(part.column(1)))
                    best: dict[tuple, list[int]] = {}
                    for r, w, a, b, e in zip(row.tolist(), window.tolist(), start.tolist(), stop.tolist(), edits.tolist(), strict=True):
                        had = best.setdefault((r, block.item[w]), [a, b, e])
                        had[:] = min(had[0], a), max(had[1], b), min(had[2], e)
                    ids = part.column(0).take(pa.array([r for r, _ in best], pa.int64()))
                    columns = [pa.array([v[j] for v in best.values()], pa.int64()) for j in range(3)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in best], item_type), *columns], ["key", "item", "start", "stop", "edits"])


        item_type = to_arrow_type(item_kind)
        found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, item {item_kind.simpleString()}, start long, stop long, edits long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"key {kind}, item {item_kind.simpleString()}, start long, stop long, edits long")
    return out.select(F.col("key").alias(key), F.col("item").alias("item_id"), "start", "stop", "edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """docs without the rows in which a benchmark item is found: the same columns."""
    at = docs.columns.index(text)
    for block in blocks(benchmark, item):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    clean = np.ones(part.num_rows, bool)
                    clean[block.matches(*flat(part.column(at)))[0]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
