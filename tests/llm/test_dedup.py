import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.llm import common, exact_dedup, near_dedup, suffix_dedup
from marlspike.llm.common import flat
from marlspike.llm.graph import components


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


ODD = ["a  b", "a b", "a\tb", "", None, " ", "a b", "x" * 50_000, "x" * 50_000, "x" * 49_999 + "y", "ä\nö", "ä ö"]


@pytest.mark.parametrize(("first", "growth"), [(64, 64), (1, 2)])
def test_exact(docs, first, growth):
    ids = [9, 3, 5, 1, 2, 4, 3, 7, 6, 8, None, 11]
    got = exact_dedup.exact_groups(docs(ODD, ids), first=first, growth=growth).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, ODD, strict=True):
        groups[squeeze(t)].append(i)
    want = Counter()
    for t, members in groups.items():
        keep = min((i for i in members if i is not None), default=None)
        for i in members:
            want[i, keep, len(members), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}


def test_exact_keeps_rows(docs):
    d = docs(ODD)
    out = exact_dedup.drop_exact_copies(d)
    assert out.columns == d.columns
    assert len(out.collect()) == len({squeeze(t) for t in ODD})
    assert exact_dedup.exact_groups(docs([])).count() == 0


def tokens(t):
    w = (t or "").lower().split()
    return [x for x in (re.sub(r"[!-/:-@\[-`{-~]", "", x) for x in w) if x] or w


def shingles(t):
    w = tokens(t)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def jaccard(a, b):
    x, y = Counter(shingles(a)), Counter(shingles(b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def similarity(a, b):
    n, m = len(tokens(a)), len(tokens(b))
    both = Counter(shingles(a)) & Counter(shingles(b))
    counts = []
    for t in (a, b):
        left, held = Counter(both), set()
        for i, s in enumerate(shingles(t)):
            if left[s]:
                left[s] -= 1
                held |= set(range(i, i + len(s)))
        counts.append(len(held))
    c = min(counts)
    return c / (n + m - c) if c else 0.0


def texts_with_near_copies(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 120))]
        out.append(" ".join(base))
        for edits in (1, 3):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    line = [word() for _ in range(8)]
    out += [" ".join(line * 6), " ".join(line * 7), " ".join(line * 2)]  # many times one shingle
    return out + ["", None, "", "two words", "two  words", "TWO, words!", out[0], "--- !!", "---  !!", "?? --- !!", " ".join(out[3].split()[:5]).replace(" ", ", - ")]


def near_classes(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_match_brute_force(docs, seed):
    texts = texts_with_near_copies(seed)
    want = near_classes(texts)
    got = near_dedup.near_groups(docs(texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id: r.class_size for r in got} == {i: sum(v == c for v in want.values()) for i, c in want.items()}
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_near_hot_group_in_one_bucket(docs):
    """Copies with an edit each, more than the leaders of a bucket: all are one class without all pairs."""
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        copy = list(base)
        copy[i] = f"e{i}"
        texts.append(" ".join(copy))
    assert {r.class_id for r in near_dedup.near_groups(docs(texts)).collect()} == {0}


@pytest.mark.parametrize(("pairs", "rare", "rounds"), [(2, 0, 1), (2, 3, 1), (16, 16, 3)])
def test_near_common_passage(docs, monkeypatch, pairs, rare, rounds):
    """Documents that share most of their text, about the threshold, through each way of making pairs."""
    for name, value in (("PAIRS_UP_TO", pairs), ("RARE", rare), ("LEADER_ROUNDS", rounds)):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage, base = [word() for _ in range(60)], [word() for _ in range(90)]
    texts = [" ".join(passage + [word() for _ in range(r.choice([5, 8, 14, 16, 25]))]) for _ in range(40)]
    for _ in range(40):
        copy = list(base)
        for _ in range(r.choice([3, 6, 9, 12])):
            copy[r.randrange(90)] = r.choice(base[:5])
        texts.append(" ".join(copy))
    assert {x.doc_id: x.class_id for x in near_dedup.near_groups(docs(texts), bands=96, rows=2).collect()} == near_classes(texts)


@pytest.mark.parametrize(("rounds", "rare"), [(0, 0), (0, 4), (1, 4)])
def test_near_pairs_of_one_bucket(docs, monkeypatch, rounds, rare):
    """All documents in one bucket of each band: the pairs, the bounds and the leaders each find every link."""
    monkeypatch.setattr(near_dedup, "band_codes", lambda signature, bands, rows: np.tile(np.arange(bands, dtype=np.int64), (len(signature), 1)))
    for name, value in (("PAIRS_UP_TO", 2), ("RARE", rare), ("LEADER_ROUNDS", rounds)):
        monkeypatch.setattr(near_dedup, name, value)
    texts = texts_with_near_copies(7)
    assert {r.doc_id: r.class_id for r in near_dedup.near_groups(docs(texts), bands=2, rows=2).collect()} == near_classes(texts)


@pytest.mark.parametrize("percent", [2, 3, 4, 5])
def test_near_copies_with_edited_words_are_found(docs, percent):
    """Recall of planted copies, 120 of them, each with so many of its words replaced, dropped or doubled here and there."""
    r = random.Random(percent)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    texts = []
    for _ in range(120):
        base = [word() for _ in range(r.randint(60, 400))]
        copy = list(base)
        for i in sorted(r.sample(range(len(base)), round(len(base) * percent / 100)), reverse=True):
            copy[i : i + 1] = r.choice([[word()], [], [copy[i], word()], [copy[i].upper() + "!"]])
        texts += [" ".join(base), ", ".join(copy[:9]) + " " + " ".join(copy[9:])]
    got = {x.doc_id: x.class_id for x in near_dedup.near_groups(docs(texts)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(120)) >= 0.98 * 120
    assert len(set(got.values())) >= 120


def test_near_copies_with_two_long_texts(docs):
    r = random.Random(1)
    long = [f"w{r.randrange(50_000)}" for _ in range(60_000)]
    got = near_dedup.near_groups(docs([" ".join(long), " ".join([*long, "more"]), "short text of a few words", "x" * 400_000, None])).collect()
    assert {x.doc_id: x.class_id for x in got} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_near_rows_of_a_shuffled_table(docs):
    """Rows without a fixed order are written first, so that the row numbers of all plans agree."""
    texts = texts_with_near_copies(4)
    got = near_dedup.near_groups(docs(texts).repartition(5).sort("n_chars")).collect()
    assert {r.doc_id: r.class_id for r in got} == near_classes(texts)


def test_near_odd_rows(docs):
    d = docs([None, None, "a b c d e f", "a b c d e f"], [None, None, None, 5])
    got = near_dedup.near_groups(d).collect()
    assert Counter((r.class_id, r.class_size) for r in got) == {(None, 1): 2, (5, 2): 2}
    assert sum(r.kept for r in got) == 3
    assert near_dedup.near_groups(docs([])).count() == 0
    assert near_dedup.drop_near_copies(d).columns == d.columns


def test_signatures_are_unbiased():
    r = random.Random(5)
    a, b = [], []
    for _ in range(200):
        w = [f"w{r.randrange(500)}" for _ in range(r.randint(20, 80))] * r.choice([1, 2, 5])
        v = list(w)
        for _ in range(r.randint(0, 6)):
            v[r.randrange(len(v))] = f"x{r.randrange(9)}"
        a.append(" ".join(w))
        b.append(" ".join(v))
    sign = lambda t: near_dedup.signatures(*near_dedup.shingles(*flat(pa.array(t)))[:2], len(t), 128)
    assert np.allclose(near_dedup.overlap(pa.array(a), pa.array(b)), [similarity(x, y) for x, y in zip(a, b, strict=True)])
    exact = np.array([jaccard(x, y) for x, y in zip(a, b, strict=True)])
    assert abs(((sign(a) == sign(b)).mean(1) - exact).mean()) < 0.01


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (3, 1)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 6: 4} | {101 + i: 100 for i in range(20)}


def cut(texts, length=100):
    """(n_bytes, n_removed, n_spans, sha) of each text, in order, by a set of all strings seen."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts(seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdefghij klmnöü") for _ in range(n))
    passages = [some(n) for n in (99, 100, 130, 400)]
    texts = [some(r.randint(0, 300)) + r.choice(passages) + some(r.randint(0, 300)) for _ in range(40)]
    return [*texts, texts[3], passages[3] * 3, "Und " * 200, "x" * 500, "", None, passages[0], passages[1], "Und " * 100 + some(200)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("ranges", "run", "pairs"), [(6 << 20, 12 << 20, 16), (4000, 9000, 2)])
def test_repeated_strings(docs, monkeypatch, seed, ranges, run, pairs):
    """The second set cuts groups at splitters, and sorts windows of groups with more than two keys."""
    for name, value in (("RANGE_BYTES", ranges), ("RUN_BYTES", run), ("PAIRS_UP_TO", pairs)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = repeating_texts(seed)
    got = suffix_dedup.suffix_dedup(docs(texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == cut(texts)


def test_repeated_strings_odd_rows(docs):
    t = "abc " * 10 + "".join(map(chr, range(200, 400)))
    got = suffix_dedup.suffix_dedup(docs([t, t, t], [None, 5, 5]), keep_text=True).collect()
    assert Counter((r.doc_id, r.n_removed == 0) for r in got) == {(5, True): 1, (5, False): 1, (None, False): 1}
    assert {bytes(r.kept) for r in got if r.n_removed == 0} == {t.encode()}
    assert suffix_dedup.suffix_dedup(docs([])).count() == 0


def test_loser_tree_merges_in_order():
    r = random.Random(4)
    keys = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(400)]
    runs = []
    for i in range(7):
        run, _ = suffix_dedup.sorted_run([(k, 0, 0, 0, 0, 0) for k in keys[i::7]])
        runs.append(suffix_dedup.Run.decoded(run.encoded()))
    out = list(suffix_dedup.merged(runs))
    assert [k for k, *_ in out] == sorted(k for run in runs for k in run.keys)
    assert all(s == suffix_dedup.common(a, b) for (a, *_), (b, s, _) in zip(out, out[1:], strict=False))


def test_counts_join_reads_hot_keys_apart_and_each_row_once(spark, tmp_path):
    def put(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def joined(rows):
        counts = put(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), f"n{uuid.uuid4().hex}")
        out = common.with_counts(rows, counts, "g")
        assert "LeftAnti" not in out._jdf.queryExecution().toString()  # all other rows would pass a join more
        return sorted((r.g, r.i, r.n) for r in out.collect())

    groups = [7] * 400 + [i // 3 for i in range(6000, 9000)] + [-1, None]  # one hot key, others of three rows, keys without a count, a null
    rows = put(spark.createDataFrame([(g, i) for i, g in enumerate(groups)], "g long, i long"), "rows")
    size = Counter(groups)
    assert joined(rows) == sorted((g, i, size[g]) for i, g in enumerate(groups) if g is not None and size[g] > 1)
    cold = put(spark.createDataFrame([(i // 2, i) for i in range(4000)], "g long, i long"), "cold")
    assert joined(cold) == [(i // 2, i, 2) for i in range(4000)]
    assert joined(rows.limit(0)) == []
