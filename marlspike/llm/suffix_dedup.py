"""Repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Every byte is removed that a LENGTH-byte string covers which also starts earlier, in an earlier document or earlier in its
own. Sorting all suffixes would sort mostly text that occurs once, so suffixes are chosen by content first:

1. A window of LENGTH bytes has one anchor, the leftmost of its smallest-hashed GRAM-byte strings. Equal windows have their
   anchors at equal places. Anchors whose gram occurs once in the corpus are dropped; a count with map-side sums and a join
   decide that.
2. An anchor that is left stands for a run of windows. Its key is the text from the anchor to the run's end, then the text
   before the anchor, backwards. Tasks sort their keys into runs, keep of equal keys the earliest place (the others are
   repeats), cut each run at sampled splitters, and exchange it front-coded: common prefix length and rest.
3. Each range merges its pieces with a loser tree that holds, for every key in it, its common prefix with the last key
   taken. Where these differ, they decide; where they are equal, bytes beyond them are compared. No known prefix is read
   again.
4. Equal keys are repeats of the earliest. Keys with one gram that differ further on share l bytes before and r bytes after
   the anchor: where l + r >= LENGTH the later repeats the earlier there. Small groups are compared in pairs. Of a large
   group, or one that a splitter cuts, the windows that can repeat are themselves sorted and merged in the same way.

All decisions compare bytes; hashes only choose what to compare.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import delete, flat, mix64, settled, slices, with_counts, written

LENGTH = 100
GRAM = 32  # a multiple of 8; short strings repeat by chance and would bring most anchors to the sort
#: Bytes of keys that a task sorts at once, and that a range should hold.
RUN_BYTES = 12 << 20
RANGE_BYTES = 6 << 20
#: Sampled keys a range from which splitters are chosen; the driver holds them, some 3 KB a range.
KEYS_A_RANGE = 20
#: Keys with one gram that are compared in pairs.
PAIRS_UP_TO = 16
#: Longer texts are searched in pieces that overlap by LENGTH - 1 bytes.
PIECE = 8 << 20

PLACE = 5  # numbers with each key: order of the document, its row, anchor, bytes before the anchor, bytes from it on


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, gram's hash, anchor, bytes before it, bytes from it on) of each run of windows with one anchor; places within the row."""
    row, name, at, before, after = [], [], [], [], []
    pieces = []
    for begin in range(0, max(len(data), 1), PIECE):
        pieces.append((begin, min(len(data), begin + PIECE + length - 1)))
    for begin, end in pieces:
        text = np.ascontiguousarray(data[begin:end])
        if len(text) < length:
            continue
        n = len(text) - gram + 1
        view = np.ndarray((n + gram - 8,), np.dtype("<u8"), buffer=text.data, strides=(1,))
        with np.errstate(over="ignore"):
            h = np.zeros(n, np.uint64)
            for part in range(0, gram, 8):
                h += view[part : part + n]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            h = mix64(h)
        low = np.uint64(24)
        key = ((h >> low) << low) | np.arange(n, dtype=np.uint64)
        span, least, width = length - gram + 1, key, 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: n - span + 1], least[span - width : span - width + n - span + 1])
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # of the window at each place
        place = np.arange(len(anchor)) + begin
        doc = np.searchsorted(offsets, place, side="right") - 1
        inside = place + length <= offsets[doc + 1]
        place, doc, anchor = place[inside], doc[inside], anchor[inside]
        if not len(place):
            continue
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        tail = np.append(head[1:], len(place)) - 1
        a = anchor[head] + begin
        row.append(doc[head])
        name.append(h[anchor[head]])
        at.append(a - offsets[doc[head]])
        before.append(a - place[head])
        after.append(place[tail] + length - a)
    if not row:
        return (np.zeros(0, np.int64),) * 5
    return np.concatenate(row), np.concatenate(name).view(np.int64), np.concatenate(at), np.concatenate(before), np.concatenate(after)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes needn't be read."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return min(len(a), len(b))
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


class Run:
    """Sorted keys with their places; lcp[i] is what key i shares with key i-1."""

    __slots__ = ("keys", "lcp", "places")

    def __init__(self, keys: list[bytes], lcp: list[int], places: list[tuple]):
        self.keys, self.lcp, self.places = keys, lcp, places

    def encoded(self) -> bytes:
        """Front-coded keys, then the numbers of their places, column by column; compressed."""
        lcp = np.array([0, *self.lcp[1:]], "<u2")
        rest = [k[h:] for k, h in zip(self.keys, lcp.tolist(), strict=True)]
        size = np.array([len(r) for r in rest], "<u2")
        places = np.ascontiguousarray(np.array(self.places, "<i8").reshape(-1, PLACE).T)
        return zstandard.compress(b"".join([np.int64(len(rest)).tobytes(), lcp.tobytes(), size.tobytes(), places.tobytes(), *rest]), 1)

    @classmethod
    def decoded(cls, block: bytes) -> Run:
        block = zstandard.decompress(block)
        n = int(np.frombuffer(block, "<i8", 1)[0])
        lcp = np.frombuffer(block, "<u2", n, 8).tolist()
        size = np.frombuffer(block, "<u2", n, 8 + 2 * n).tolist()
        places = list(map(tuple, np.frombuffer(block, "<i8", n * PLACE, 8 + 4 * n).reshape(PLACE, n).T.tolist()))
        keys, at, last = [], 8 + 4 * n + 8 * PLACE * n, b""
        for h, s in zip(lcp, size, strict=True):
            last = last[:h] + block[at : at + s]
            keys.append(last)
            at += s
        return cls(keys, lcp, places)


def sorted_run(entries: list[tuple]) -> tuple[Run, list[tuple]]:
    """(run of the distinct keys, each at its earliest place; places of the others) of (key, place...) entries."""
    entries.sort()
    keys, lcp, places, repeats = [], [], [], []
    last = b""
    for e in entries:
        key = e[0]
        if keys and key == last:
            repeats.append(e[1:])
            continue
        lcp.append(common(last, key))
        keys.append(key)
        places.append(e[1:])
        last = key
    return Run(keys, lcp, places), repeats


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, tuple]]:
    """(key, what it shares with the key before, place) in order, by a loser tree over the runs."""
    runs = [r for r in runs if r.keys]
    if not runs:
        return
    k = 1
    while k < len(runs):
        k *= 2
    end = b""
    heads = [r.keys[0] for r in runs] + [end] * (k - len(runs))
    # what each head shares with the key taken last, -1 once its run has ended
    shared = [0] * len(runs) + [-1] * (k - len(runs))
    at = [0] * k
    losers = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, c = play(2 * node), play(2 * node + 1)
        if shared[x] < shared[c]:
            x, c = c, x
        elif shared[x] == shared[c] != -1:
            h = common(heads[x], heads[c], shared[x])
            if heads[x][h:] > heads[c][h:]:
                x, c = c, x
            shared[c] = h
        losers[node] = c
        return x

    winner = play(1)
    while shared[winner] >= 0:
        run, i = runs[winner], at[winner]
        yield heads[winner], shared[winner], run.places[i]
        i += 1
        at[winner] = i
        if i < len(run.keys):
            heads[winner], shared[winner] = run.keys[i], run.lcp[i]
        else:
            heads[winner], shared[winner] = end, -1
        x, node = winner, (winner + k) >> 1
        sx = shared[x]
        while node:
            c = losers[node]
            sc = shared[c]
            if sx < sc:
                losers[node] = x
                x, sx = c, sc
            elif sx == sc and sx >= 0:
                a, b = heads[x], heads[c]
                h = common(a, b, sx)
                if a[h : h + 1] <= b[h : h + 1]:
                    shared[c] = h
                else:
                    shared[x] = h
                    losers[node] = x
                    x = c  # shares with the last key what it did
            node >>= 1
        winner = x


def _spans(places: list[tuple]) -> np.ndarray:
    """(row, first byte, byte after the last) of whole runs."""
    p = np.array(places, np.int64).reshape(-1, PLACE)
    return np.stack([p[:, 1], p[:, 2] - p[:, 3], p[:, 2] + p[:, 4]], 1)


class Group:
    """The distinct keys with one gram: pairs are resolved here, large or cut groups as windows."""

    def __init__(self, length: int):
        self.length, self.spans, self.windows = length, [], []

    def close(self, keys: list[bytes], places: list[tuple], cut: bool) -> None:
        if len(keys) < 2 and not cut:
            return
        parts = [(k[: p[4]], k[p[4] : p[4] + p[3]]) for k, p in zip(keys, places, strict=True)]
        if len(keys) <= PAIRS_UP_TO and not cut:
            for i, (a, b) in enumerate(parts):
                for j in range(i):
                    r = common(a, parts[j][0])
                    left = common(b, parts[j][1])
                    if r + left >= self.length:
                        p = max(places[i], places[j])
                        self.spans.append((p[1], p[2] - left, p[2] + r))
            return
        # what a key shares at most with another one, before and after the anchor
        right, left = [self.length] * len(parts), [self.length] * len(parts)
        if not cut:
            for best, side in ((right, 0), (left, 1)):
                order = sorted(range(len(parts)), key=lambda i: parts[i][side])
                near = [0, *(common(parts[i][side], parts[j][side]) for i, j in zip(order, order[1:], strict=False)), 0]
                for n, i in enumerate(order):
                    best[i] = max(near[n], near[n + 1])
        for (a, b), p, r, l in zip(parts, places, right, left, strict=True):
            r, l = min(r, len(a)), min(l, len(b))
            if r + l >= self.length:
                self.windows.append((*p[:3], l, r, b[:l][::-1] + a[:r]))


def _emit_runs(entries: list[tuple], splitters: list[bytes], out: list) -> None:
    """Sort, keep the distinct, cut at the splitters: rows (range, block); the repeats' spans as range -1."""
    run, repeats = sorted_run(entries)
    if repeats:
        out.append((-1, _spans(repeats).tobytes()))
    begin = 0
    while begin < len(run.keys):
        part = bisect_right(splitters, run.keys[begin])
        end = bisect_right(run.keys, splitters[part], begin) if part < len(splitters) else len(run.keys)
        if part < len(splitters):  # keys equal to a splitter belong to the next range
            while end > begin and run.keys[end - 1] == splitters[part]:
                end -= 1
        out.append((part, Run(run.keys[begin:end], run.lcp[begin:end], run.places[begin:end]).encoded()))
        begin = end


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])


def _entries_of_docs(part: pa.RecordBatch) -> Iterator[tuple]:
    """(key, place) of the anchors of rows (order, id, text, [at, before, after]...)."""
    order, ids, texts, lists = (part.column(i) for i in range(4))
    for o, i, text, found in zip(order.to_pylist(), ids.to_pylist(), texts.to_pylist(), lists.to_pylist(), strict=True):
        for f in found:
            a, b, n = f["at"], f["before"], f["after"]
            yield text[a : a + n] + text[a - b : a][::-1] + n.to_bytes(2, "big"), o, i, a, b, n


def _entries_of_windows(part: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(window, place) of the windows of rows (order, id, at, before, after, text around the anchor)."""
    for o, i, a, b, n, text in zip(*(part.column(j).to_pylist() for j in range(6)), strict=True):
        for s in range(b + n - length + 1):
            yield text[s : s + length], o, i, a, b - s, length - (b - s)


def _runs(entries_of, splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, size, out = [], 0, []
        for batch in batches:
            for e in entries_of(batch):
                entries.append(e)
                size += len(e[0])
                if size >= RUN_BYTES:
                    _emit_runs(entries, splitters, out)
                    entries, size = [], 0
                    yield _batch(out)
                    out = []
        if entries:
            _emit_runs(entries, splitters, out)
        if out:
            yield _batch(out)

    return run


def _keys_sample(entries_of, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [e[0] for e in entries_of(batch) if (e[2] * 0x9E3779B1 + e[3] * 0x85EBCA6B) % 0xFFFFFFFB % one_in == 0]
            yield pa.RecordBatch.from_arrays([pa.array(picked, pa.binary())], ["key"])

    return run


_MERGED = "kind int, ord long, id long, start long, before long, stop long, text binary"


def _merge(length: int, gram: int | None):
    """Merge a range's runs: rows of kind 0 are spans (id, start, stop), rows of kind 1 keys whose windows are to be sorted."""

    def run(table: pa.Table) -> pa.Table:
        spans, groups = [], Group(length)
        keys: list[bytes] = []
        places: list[tuple] = []
        last, best, cut = None, None, True  # a range's first group may go on in the range before
        for key, shared, place in merged([Run.decoded(b) for b in table.column("block").to_pylist()]):
            if last is not None and shared == len(key) == len(last):
                if place < best:
                    place, best = best, place
                spans.append(place)
                if keys:
                    places[-1] = best
                continue
            if gram:
                if last is not None and shared < gram:
                    groups.close(keys, places, cut)
                    keys, places, cut = [], [], False
                keys.append(key)
                places.append(place)
            last, best = key, place
        if gram and keys:
            groups.close(keys, places, True)
        found = np.concatenate([_spans(spans), np.array(groups.spans, np.int64).reshape(-1, 3)])
        n, m = len(found), len(groups.windows)
        w = list(zip(*groups.windows, strict=True)) if m else [()] * 6
        column = lambda a, b: pa.array([*a, *b], pa.int64())
        return pa.Table.from_arrays(
            [
                pa.array([0] * n + [1] * m, pa.int32()),
                column([0] * n, w[0]),
                column(found[:, 0].tolist(), w[1]),
                column(found[:, 1].tolist(), w[2]),
                column([0] * n, w[3]),
                column(found[:, 2].tolist(), w[4]),
                pa.array([None] * n + list(w[5]), pa.binary()),
            ],
            names=["kind", "ord", "id", "start", "before", "stop", "text"],
        )

    return run


def _local_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column(0).to_pylist():
            s = np.frombuffer(block, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(s[:, j]) for j in range(3)], ["id", "start", "stop"])


def _sort(rows: DataFrame, entries_of, n_keys: int, n_bytes: int, length: int, gram: int | None) -> tuple[DataFrame, DataFrame]:
    """(spans, windows) of a distributed sort of rows' entries: (id, start, stop) of repeats, and what _merge() leaves to be sorted by windows."""
    ranges = int(max(1, n_bytes // RANGE_BYTES))
    splitters: list[bytes] = []
    if ranges > 1:
        # every eighth entry of a sample of rows comes to the driver
        one_in = max(1, n_keys // (8 * KEYS_A_RANGE * ranges))
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)
        sample = sorted(set(some.mapInArrow(_keys_sample(entries_of, 8), "key binary").limit(4 * KEYS_A_RANGE * ranges).toArrow().column(0).to_pylist()))
        splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    runs = written(rows.mapInArrow(_runs(entries_of, splitters), "part int, block binary"), "suffix-runs")
    merged_rows = written(runs.where("part >= 0").groupBy("part").applyInArrow(_merge(length, gram), _MERGED), "suffix-merged")
    local = runs.where("part < 0").select("block").mapInArrow(_local_spans, "id long, start long, stop long")
    spans = written(local.unionByName(merged_rows.where("kind = 0").select("id", "start", "stop")), "suffix-spans", few=True)
    delete(runs)
    windows = merged_rows.where("kind = 1").select("ord", "id", F.col("start").alias("at"), "before", F.col("stop").alias("after"), "text")
    windows._written_path = merged_rows._written_path
    return spans, windows


def _cut(length_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            ids, removed, spans, shas = [], [], [], []
            for i, text, found in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                kept, at, gone, count, stop = [], 0, 0, 0, -1
                for f in sorted((f["start"], f["stop"]) for f in found):
                    if f[0] > stop:
                        count += 1
                        kept.append(text[at : f[0]])
                        gone += f[1] - f[0]
                        at = stop = f[1]
                    elif f[1] > stop:
                        gone += f[1] - stop
                        at = stop = f[1]
                kept.append(text[at:])
                ids.append(i)
                removed.append(gone)
                spans.append(count)
                shas.append(hashlib.sha256(b"".join(kept)).hexdigest() if length_of < 0 else b"".join(kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], ["id", "n_removed", "n_spans", "kept"])

    return run


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, name, at, before, after = anchors(*flat(part.column(1)), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(name), part.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16))], ["gram", "id", "at", "before", "after"])

    return run


def _repeated_anchors(found: DataFrame) -> DataFrame:
    """(id, found): each document's anchors whose gram occurs elsewhere; a list is bounded by its document's length."""
    twice = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "suffix-grams", few=True)
    place = F.struct("at", "before", "after")
    lists = written(with_counts(found, twice, "gram").groupBy("id").agg(F.collect_list(place).alias("found")), "suffix-lists")
    delete(twice)
    return lists


def repeated_spans(numbered: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): of rows (id, ord, text as bytes) the spans (id, start, stop) to remove, and the written rows (id, text ...) in which they lie.

    Spans overlap; their union is what `length`-byte strings cover that also start earlier, by (ord, id, place)."""
    found = written(numbered.select("id", "text").mapInArrow(_anchor_rows(length, gram), "gram long, id long, at int, before short, after short"), "suffix-anchors")
    lists = _repeated_anchors(found)
    delete(found)
    docs = written(numbered.join(lists, "id").select("ord", "id", "text", "found"), "suffix-docs")
    delete(lists)
    size = F.expr("aggregate(found, 0L, (s, f) -> s + f.before + f.after)")
    n_keys, n_bytes = docs.agg(F.sum(F.size("found")), F.sum(size)).first()
    spans, windows = _sort(docs, _entries_of_docs, n_keys or 0, n_bytes or 0, length, gram)
    n_windows = windows.agg(F.sum(F.col("before") + F.col("after") - length + 1)).first()[0]
    if n_windows:
        more, none = _sort(windows, lambda part: _entries_of_windows(part, length), n_windows, n_windows * length, length, None)
        both = written(spans.unionByName(more), "suffix-spans", few=True)
        delete(spans, more, none)
        spans = both
    delete(windows)
    return spans, docs


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    order = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    return docs.select(F.monotonically_increasing_id().alias("id"), order.alias("ord"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept, the bytes that stay.

    Texts are their UTF-8 bytes; null and empty ones have none, and nothing to remove. The key is an integer; null keys come
    last. Rows with one key, repeated rows too, are documents of their own, in the table's order. Texts shorter than `length`
    bytes stay whole; long ones are searched whole. Other columns don't matter and may have any names. An empty table gives no
    rows."""
    docs = settled(docs, "suffix-input")
    numbered = _numbered(docs, key, text)
    spans, texts = repeated_spans(numbered, length)
    lists = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("found"))  # bounded by the document's length
    mode = 0 if keep_text else -1
    cut = texts.select("id", "text").join(lists, "id").select("id", "text", "found").mapInArrow(_cut(mode), f"id long, n_removed long, n_spans long, kept {'binary' if keep_text else 'string'}")
    cut = written(cut, "suffix-cut")
    delete(texts, spans)
    whole = docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("k"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    whole = whole.select("id", "k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *["text"] * keep_text)
    joined = whole.join(cut, "id", "left")
    sha = F.coalesce(F.sha2("kept", 256) if keep_text else F.col("kept"), F.col("sha"))
    return joined.select(
        F.col("k").alias(key),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        sha.alias("kept_sha256"),
        *([F.coalesce("kept", "text").alias("kept")] if keep_text else []),
    )
