"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, and a check of the multisets.

A document is the multiset of its five-word shingles; words are lower-cased, and without their punctuation. For each shingle
a Poisson process runs over weight and hash value; a document keeps, in each of M components, the smallest hash value among
the points at or below the shingle's count. The weights are discretised into units, and units into blocks (0,1], (1,2],
(2,4], (4,8] ...: each block is one process with the block's rate, and a point falls on a unit below it, so that a high
count costs one process for each doubling. Points come in ascending order, and a process stops at the largest value that the
document's signature still holds; so a long document costs about one point for each shingle. Two documents agree in a
component with probability their weighted Jaccard similarity.

The check matches the two multisets, shingle by shingle, and measures in words: c of them lie in matched shingles, of a and b
that the documents have, and the similarity is c / (a + b - c), the weighted Jaccard similarity of the words. An edited
word spoils five shingles but only one word, so copies with 5 % of their words edited, here and there, stay above 0.8,
as do texts that differ in one passage of a tenth; Jaccard similarity of the shingles themselves would be 0.63 and 0.82.

Documents with equal words are one class from the start. A round compares all documents of a band's bucket with one of it,
its leader; the components of the links found are merged, and buckets left with one component are done. What is apart after
LEADER_ROUNDS = 2
components too: two documents have no more in common than the lesser of their counts. Shingles in up to RARE places make
pairs of their own; documents without one in common share frequent shingles alone, and are paired only where their words in
these can reach the threshold. So a group of n near copies costs about n comparisons a round, documents that share a long
passage and nothing else aren't paired, nor is an outlier with all of a group that it's too far from, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import delete, flat, lowered, mix64, settled, slices, with_counts, words, written
from marlspike.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
#: 36 bands of 4 components: a pair whose shingles have a Jaccard similarity of 0.63 (5 % of the words edited) is missed with
#: probability 0.002, at 0.8 with 1e-8.
BANDS, ROWS = 36, 4
LEADER_ROUNDS = 2
#: Bytes of text whose shingles a task holds at a time; arrays beside them take some 50 times as much.
PART_BYTES = 1 << 19
#: In buckets with more documents than this, words held by others are counted before pairs are made.
PAIRS_UP_TO = 16
#: A shingle with up to so many places among these documents is rare, and makes pairs.
RARE = 16

_TURN = mix64(np.arange(77, 77 + 16, dtype=np.uint64)) | np.uint64(1)
_STEP, _SIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of each word, number of words by row): words in lower case, by their letters and digits alone. Words of punctuation
    don't count, but in a row without others."""
    low = lowered(data)[0]
    row, _, _, h = words(data, offsets, low, _LETTER[data])
    n = np.bincount(row[h != 0], minlength=len(offsets) - 1)
    if (bare := n[row] == 0).any():
        h[bare] = words(data, offsets, low)[3][bare]
    row, h = row[h != 0], h[h != 0]
    return row, h, np.bincount(row, minlength=len(offsets) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(row, hash, first word's number) of each run of k words, and the number of words by row. A row with fewer words has one shingle, of them all; one without words has none."""
    row, h, n = tokens(data, offsets)
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        code = np.zeros(len(h), np.uint64)
        for j in range(k):
            code[: len(h) - j] += h[j:] * _TURN[j] if j else h * _TURN[0]
        at = np.flatnonzero(row[: max(0, len(h) - k + 1)] == row[k - 1 :])
        short = np.flatnonzero((n > 0) & (n < k))
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            extra[has] += h[first[short[has]] + j] * _TURN[j]
    return np.concatenate([row[at], short]), mix64(np.concatenate([code[at], extra])), np.concatenate([at, first[short]]), n


def signatures(row: np.ndarray, code: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """n_rows x m smallest hash values; a row without shingles keeps infinity. Fewer than 2^20 rows at a time."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (code >> np.uint64(20)))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, weight = key[begin], np.diff(begin, append=len(key))
    row, name = (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)
    parts = []
    block = 0
    while len(row):
        floor = 0 if block == 0 else 1 << (block - 1)
        over = weight > floor
        row, name, weight = row[over], name[over], weight[over]
        size = max(1, floor)
        parts.append((row, mix64(name * np.uint64(256) + np.uint64(block)), np.full(len(row), 1.0 / (size * m)), weight - floor, np.full(len(row), size)))
        block += 1
    out = np.full(n_rows * m, np.inf)
    if not parts:
        return out.reshape(n_rows, m)
    row, seed, scale, room, size = (np.concatenate(c) for c in zip(*parts, strict=True))
    x, step, top = np.zeros(len(row)), np.zeros(len(row), np.uint64), np.full(n_rows, np.inf)
    while len(row):
        k = int(np.clip(120_000 // len(row), 1, 64))
        with np.errstate(over="ignore"):
            a = mix64(seed[:, None] + (step[:, None] + np.arange(k, dtype=np.uint64)) * _STEP)
            b = mix64(a ^ _SIDE)
        gap = -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale[:, None]
        gap[:, 0] += x
        at = np.cumsum(gap, 1)
        x = at[:, -1]
        step = step + np.uint64(k)
        component = ((b >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        unit = ((b & np.uint64(0xFFFFFFFF)) * size[:, None].astype(np.uint64)) >> np.uint64(32)
        good = (at < top[row][:, None]) & (unit < room[:, None].astype(np.uint64))
        np.minimum.at(out, ((row * m)[:, None] + component.astype(np.int64))[good], at[good])
        top = out.reshape(n_rows, m).max(1)
        more = x < top[row]
        row, seed, scale, room, size, x, step = (c[more] for c in (row, seed, scale, room, size, x, step))
    return out.reshape(n_rows, m)


def band_codes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit code for each row and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        code = (mix64(bits) * _TURN[:rows]).sum(2, dtype=np.uint64)
        return mix64(code + np.arange(bands, dtype=np.uint64) * _STEP).astype(np.int64)


def _turns(key: np.ndarray) -> np.ndarray:
    """How many equal keys come before each."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else order
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(begin, np.diff(begin, append=len(key)))
    return out


def _covered(row: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words by row that lie in the shingles that begin at the words `at`."""
    total = int(n.sum())
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + np.minimum(n[row], SHINGLE), -1)
    upto = np.concatenate([[0], np.cumsum(np.cumsum(steps[:total]) > 0)])
    end = np.cumsum(n)
    return upto[end] - upto[end - n]


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of each pair of texts c / (n + m - c): n and m words, c of them in shingles that the multisets have in common (the lesser of both counts); 0 where a text has no words."""
    sides = []
    for texts in (a, b):
        row, code, at, n = shingles(*flat(texts))
        with np.errstate(over="ignore"):
            key = mix64(code + row.astype(np.uint64) * _STEP)
            sides.append((row, at, n, mix64(key + _turns(key).astype(np.uint64) * _SIDE)))  # the i-th of one matches the i-th of the other
    counts = []
    for (row, at, n, key), (*_, other) in (sides, sides[::-1]):
        shared = np.isin(key, other)
        counts.append(_covered(row[shared], at[shared], n))
    common = np.minimum(*counts)
    return np.where(common > 0, common / np.maximum(sides[0][2] + sides[1][2] - common, 1), 0.0)


def sequence_digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's sequence of words; 128 bits tell sequences apart."""
    row, h, counts = tokens(data, offsets)
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - np.searchsorted(row, row)).astype(np.uint64)
        out = np.zeros((2, n), np.uint64)
        some = counts > 0
        begin = (np.cumsum(counts) - counts)[some]
        for i, code in enumerate((mix64(h + place * _STEP), mix64((h ^ _SIDE) + place * _TURN[7]))):
            if some.any():
                out[i, some] = np.add.reduceat(code, begin)
    return out.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                data, offsets = flat(part.column(2))
                row, code, _, n = shingles(data, offsets)
                digest = sequence_digests(data, offsets)
                digest[0, n == 0] = part.column(0).to_numpy()[n == 0]  # texts without words are alone
                codes = band_codes(signatures(row, code, part.num_rows, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest[0]), pa.array(digest[1]), pa.array(n.astype(np.int64)), lists], ["id", "k", "d1", "d2", "n_words", "bands"])

    return run


def _check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer in slices(batch, "text_a", 1 << 20):
                for part in slices(outer, "text_b", 1 << 20):
                    alike = overlap(part.column(2), part.column(3))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(alike)], ["a", "b", "similarity"]).filter(pa.array(alike >= threshold))

    return run


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold, written."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return written(with_both.select("a", "b", "text_a", "text_b").mapInArrow(_check(threshold), "a long, b long, similarity double"), "near-links")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, root) with the links taken in: a link between two documents is one between their roots."""
    if roots is None:
        return components(links)
    root_of = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    joined = links.join(root_of, "a", "left").join(root_of.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left")
    top = components(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    over = top.select(F.col("id").alias("root"), F.col("root").alias("over"))
    out = roots.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root"))
    out = written(out.unionByName(top).distinct(), "near-roots", few=True)
    delete(roots, top)
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root, n_words, at, element): each shingle with its first word's number in the document."""
    for batch in batches:
        for part in slices(batch, "text", PART_BYTES):
            row, code, at, n = shingles(*flat(part.column(3)))
            at = at - (np.cumsum(n) - n)[row]
            ids = part.select(["id", "root", "n_words"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(at), pa.array(code.view(np.int64))], ["id", "root", "n_words", "at", "element"])


def _words_held(ids: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, root, n_words): (id, held, common) and (id, element).

    held: how many of a document's words lie in shingles that documents of other roots have too, the most that it has in common
    with one of them. common: those of them in shingles with more than RARE places; two documents that share no rarer one have
    no more in common than these. The second table has the rarer ones. Documents without any have no row. A document's
    words are counted alone; elements meet in map-side combined aggregates."""
    found = written(ids.join(texts, "id").select("id", "root", "n_words", "text").mapInArrow(_places, "id long, root long, n_words long, at long, element long"), "near-elements")
    shared = found.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("places")).where("low < high")
    shared = written(shared.select("element", "places"), "near-shared", few=True)
    within = written(with_counts(found, shared, "element", "places").select("id", "n_words", "at", "element", (F.col("places") <= RARE).alias("rare")), "near-within", few=True)
    earlier = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # of one document
    width = F.least(F.lit(SHINGLE), F.col("n_words"))
    step = F.least(width, F.coalesce(F.col("at") - F.max("at").over(earlier), width))
    own = F.least(width, F.coalesce(F.col("at") - F.max(F.when(~F.col("rare"), F.col("at"))).over(earlier), width))
    stepped = within.select("id", step.alias("step"), F.when(F.col("rare"), 0).otherwise(own).alias("own"))
    held = written(stepped.groupBy("id").agg(F.sum("step").alias("held"), F.sum("own").alias("common")), "near-held", few=True)
    rare = written(within.where("rare").select("id", "element").distinct(), "near-rare", few=True)
    delete(found, shared, within)
    return held, rare


def _near_size(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, carry: list[str] = ()) -> DataFrame:
    """One row per row of docs: key, class_id, class_size, kept, and in `row` the columns of `carry`.

    A class is a connected component of documents of which each is similar enough to another, by overlap(). class_id is the
    smallest key in it, and of rows with that key one is kept. Null keys come last. Texts without words, null or empty, are
    alone in their class; repeated rows are copies of each other. Long texts count whole, in memory one at a time. Other
    columns don't matter and may have any names. An empty table gives no rows."""
    docs = settled(docs, "near-docs")
    numbered = docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    signed = written(numbered.mapInArrow(_sign(bands, rows), f"id long, k {kind}, d1 long, d2 long, n_words long, bands array<long>"), "near-signed")
    same = ["d1", "d2", "n_words"]
    # one document stands for all with the same words
    reps = written(signed.groupBy(*same).agg(F.min("id").alias("rep")), "near-reps", few=True)
    signed_reps = signed.where("n_words > 0").select("id", "n_words", "bands").join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    members = written(signed_reps.select("id", "n_words", F.explode("bands").alias("band")), "near-bands")
    texts, roots, active = numbered.select("id", "text"), None, members.withColumn("root", F.col("id"))
    for turn in range(LEADER_ROUNDS):
        # first one order of all documents: few leaders in all, and most pairs are the same in several buckets; then each bucket its own
        order = F.struct(F.xxhash64("id", F.lit(turn), F.col("band") if turn else F.lit(0)), "id")
        leads = active.groupBy("band").agg(F.min_by(F.struct("id", "n_words", "root"), order).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        leads = written(leads.where("low < high").select("band", "lead", "n"), "near-leads", few=True)  # a bucket of one root is done
        led = written(with_counts(active, leads, "band").drop("n"), "near-led", few=True)
        pairs = led.where((F.col("root") != F.col("lead.root")) & _near_size(F.col("n_words"), F.col("lead.n_words"), threshold))
        links = _links(pairs.select(F.least("lead.id", "id").alias("a"), F.greatest("lead.id", "id").alias("b")).distinct(), texts, threshold)
        roots = _merged(roots, links)
        # a leader is done with its bucket
        left = led.where("id <> lead.id").select("band", "id", "n_words").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        active = written(left.select("band", "id", "n_words", "root"), "near-active", few=True)
        delete(members, leads, led, links)
        members = active
    active = _mixed(active)
    delete(members)
    if not active.isEmpty():
        large = active.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_UP_TO).select("band", F.lit(True).alias("large"))
        sized = written(active.hint("merge").join(large, "band", "left"), "near-sized", few=True)
        large_ids = sized.where("large").select("id", "root", "n_words").distinct()
        held, rare = _words_held(large_ids, texts)
        hot = sized.where("large").hint("merge").join(held, "id").withColumn("most", F.col("common"))
        few = sized.where("large IS NULL").withColumn("most", F.col("n_words"))
        columns = ["id", "root", "n_words", "most"]
        likely = F.col("most") >= threshold * F.col("n_words") - 1e-9
        rest = _mixed(few.select("band", *columns).unionByName(hot.select("band", *columns)).where(likely))
        by_element = written(rare.join(large_ids.join(held, "id"), "id").select("element", "id", "root", "n_words", F.col("held").alias("most")).where(likely), "near-rare", few=True)
        pairs = _in_reach(rest, "band", threshold).unionByName(_in_reach(by_element, "element", threshold)).distinct()
        links = _links(pairs, texts, threshold)
        roots = _merged(roots, links)
        delete(sized, held, rare, rest, by_element, links)
    classes = written(reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("root")), "near-classes", few=True)
    delete(active, reps, roots)
    tagged = signed.select("id", "k", *same).join(classes, same).select("id", "k", "root")
    order = F.struct(F.col("k").isNull().alias("n"), F.col("k").alias("k"), F.col("id").alias("id"))
    heads = tagged.groupBy("root").agg(F.min(order).alias("head"), F.count("*").alias("class_size"))
    out = tagged.join(heads, "root").select("id", "k", F.col("head.k").alias("class_id"), "class_size", (F.col("id") == F.col("head.id")).alias("kept"))
    out = written(out, "near-classes", few=True)
    delete(signed, classes)
    if carry:
        rows_of = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[docs[c] for c in carry]).alias("row"))
        out = rows_of.join(out, "id")
    return out.select(F.col("k").alias(key), "class_id", F.col("class_size").cast("long").alias("class_size"), "kept", *["row"] * bool(carry))


def _in_reach(members: DataFrame, group: str, threshold: float) -> DataFrame:
    """(a, b) of documents of one group and different roots that have enough words in common at most: c / (n + m - c) reaches t where c reaches t (n + m) / (1 + t)."""
    p, q = members.alias("p"), members.alias("q")
    enough = F.least("p.most", "q.most") * (1 + threshold) >= (F.col("p.n_words") + F.col("q.n_words")) * threshold - 1e-9
    apart = (F.col("p.id") < F.col("q.id")) & (F.col("p.root") != F.col("q.root")) & enough
    return p.join(q, (F.col(f"p.{group}") == F.col(f"q.{group}")) & apart).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))


def _mixed(members: DataFrame) -> DataFrame:
    """Of rows (band, id, n_words, root ...) those of bands with several roots, written."""
    mixed = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return written(members.hint("merge").join(mixed, "band", "left_semi"), "near-active", few=True)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the columns of docs, for the rows that stay, as near_groups() has them. Null and empty texts all stay."""
    return near_groups(docs, key, text, carry=docs.columns, **options).where("kept").select("row.*")
