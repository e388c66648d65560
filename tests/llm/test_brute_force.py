"""Kernels against plain versions of themselves, and rows that are odd."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from marlspike.llm import decontaminate, mixing, pseudonyms, token_counts, toxicity
from marlspike.llm.common import flat


def least_edits(windows, text):
    """By window, the fewest edits to some piece of the text: the whole table of alignments."""
    m = windows.shape[1]
    step = np.arange(m + 1)
    cost = np.tile(step, (len(windows), 1))
    best = cost[:, -1].copy()
    for byte in text:
        new = np.minimum(cost + 1, m + 1)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(new[:, 1:], cost[:, :-1] + (windows != byte))
        cost = np.minimum.accumulate(new - step, 1) + step
        best = np.minimum(best, cost[:, -1])
    return best


def plain(texts):
    data, offsets, _ = decontaminate.normalised(*flat(pa.array(texts)))
    return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def edited(text, edits, r):
    for _ in range(edits):
        at = int(r.integers(len(text)))
        text = text[:at] + ["", "q", text[at] + "z"][int(r.integers(3))] + text[at + 1 :]
    return text


def test_contamination_matches_all_alignments():
    r = np.random.default_rng(5)
    vocabulary = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(300)]
    passage = lambda n: " ".join(vocabulary[int(i)] for i in r.integers(0, 300, n))
    items = [passage(n) for n in (25, 22, 30, 7, 5, 40)] + [passage(1)[:10], ("ab " * 60).strip()]
    texts = []
    for i in range(140):
        item = items[i % len(items)]
        begin = int(r.integers(0, max(1, len(item) - 70)))
        texts.append(f"{passage(6)} {edited(item[begin : begin + int(r.integers(60, 130))], i % 9, r)} {passage(6)}")
    texts += ["", passage(50), items[0] + " " + items[0]]
    rows, found = plain(texts), set()
    for n, item in enumerate(plain(items)):
        if len(item) < decontaminate.LEAST:
            continue
        m = min(len(item), decontaminate.WINDOW)
        windows = np.stack([item[i : i + m] for i in range(len(item) - m + 1)])
        found |= {(i, n) for i, t in enumerate(rows) if least_edits(windows, t).min() <= m * decontaminate.EDITS_PERCENT // 100}
    block = decontaminate.Block.of(list(range(len(items))), items)
    row, item, _, _, edits = block.matches(*flat(pa.array(texts)))
    assert {(int(a), block.item[b]) for a, b in zip(row, item, strict=True)} == found
    assert 40 < len({i for i, _ in found}) < len(texts) - 20 and edits.max() > 0


def feistel(codes, radices, tweak, key):
    half = len(codes) // 2
    a, b, ra, rb = codes[:half], codes[half:], radices[:half], radices[half:]

    def shifted(x, other, radix, k):
        parts = (len(x) - 1) // 32 + 1
        stream = "".join(hashlib.sha512("|".join([key.encode().hex(), tweak, str(k), str(len(x)), ",".join(map(str, other)), str(p)]).encode()).hexdigest() for p in range(parts))
        return [(v + int(stream[4 * j : 4 * j + 4], 16)) % n for j, (v, n) in enumerate(zip(x, radix, strict=True))]

    for k in range(pseudonyms.ROUNDS):
        if k % 2:
            b = shifted(b, a, rb, k)
        elif a:
            a = shifted(a, b, ra, k)
    return a + b


def test_pseudonyms_match_a_plain_network(spark):
    r = np.random.default_rng(2)
    nets = [".".join(map(str, r.integers(0, 256, 4))) for _ in range(20)]
    secrets = ["".join("0123456789abcdef"[int(c)] for c in r.integers(0, 16, n)) for n in (16, 33, 100, 150)]
    texts = [f"from {n}, then" for n in nets] + [f"token={s} end" for s in secrets]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: x.text for x in pseudonyms.pseudonymise(df, "k").collect()}
    for i, n in enumerate(nets):
        assert got[i] == f"from {'.'.join(map(str, feistel([int(x) for x in n.split('.')], [256] * 4, 'ipv4', 'k')))}, then"
    for i, s in enumerate(secrets, len(nets)):
        new = feistel([int(c, 16) for c in s], [16] * len(s), "secret", "k")
        assert got[i] == f"token={''.join('0123456789abcdef'[c] for c in new)} end"


def test_pseudonyms_of_odd_rows(spark):
    long = ("word " * 200_000) + "10.20.30.40"
    rows = [(1, "10.20.30.40", "x", 1), (1, "10.20.30.40", "x", 1), (None, "10.20.30.40", None, None), (2, long, "y", 2), (3, "", "z", 3), (4, None, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, m string, n_replaced int")
    got = pseudonyms.pseudonymise(df, "k").collect()
    (new,) = {x.text for x in got if x.doc_id in (1, None)}
    assert new != "10.20.30.40" and len(got) == 6
    by = {x.doc_id: x for x in got}
    assert by[2].text == "word " * 200_000 + new and (by[3].text, by[3].n_replaced, by[4].text, by[4].n_replaced) == ("", 0, None, 0)
    empty = pseudonyms.pseudonymise(df.where("false"), "k")
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_replaced"]


def test_trees_walk_node_by_node():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 5))
    y = (x[:, 1] * x[:, 2] + 0.3 * r.normal(size=300) > 0).astype(float)
    trees = toxicity.boost(x, y, rounds=6)
    for row, raw in zip(x, trees.raw(x), strict=True):
        want = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            want += leaf[node - len(feature)]
        assert raw == pytest.approx(want)


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(4)
    x = r.integers(0, 8, size=(400, 4)).astype(float)
    y = (r.random(400) < np.where(x[:, 2] > 4, 0.8, 0.2)).astype(float)
    tree = toxicity.boost(x, y, rounds=1, depth=1, ridge=3.0, rate=0.15)
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))

    def gain(j, c):
        left = x[:, j] <= c
        score = lambda some: g[some].sum() ** 2 / (h[some].sum() + 3.0)
        return score(left) + score(~left) - score(np.ones(400, bool))

    best = max(gain(j, c) for j in range(4) for c in range(7))
    (j,), (c,) = tree.feature[0], tree.cut[0]
    assert gain(j, c) == pytest.approx(best)
    right = x[:, j] > c
    assert tree.leaf[0] == pytest.approx([0.15 * g[~right].sum() / (h[~right].sum() + 3.0), 0.15 * g[right].sum() / (h[right].sum() + 3.0)])


def test_long_texts_and_repeated_rows(docs, spark):
    long = "lorem ipsum dolor " * 60_000
    texts, ids = ["a b", "a b", "a b", long, None, ""], [1, 1, 1, 2, 3, None]
    d = docs(texts, ids, ["s"] * 6)
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
    mixed = mixing.mix(d).collect()
    assert sorted(r.size for r in mixed) == sizes and all(r.taken == r.size for r in mixed)
    counted = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(d).collect())
    short = [n for i, n in counted if i == "1"]
    assert len(counted) == 6 and len(short) == 3 and len(set(short)) == 1 and [n for i, n in counted if i in ("3", "None")] == [0, 0]
    assert dict(counted)["2"] > 3 * 60_000 - 1
    items = spark.createDataFrame([(7, "dolor sit amet consectetur adipiscing elit sed do eiusmod tempor")], "item_id long, text string")
    found = decontaminate.contaminated_spans(docs([long + items.first().text, items.first().text, items.first().text], [5, 6, 6]), items).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == [(5, 7, 0), (6, 7, 0), (6, 7, 0)]
    assert {r.start for r in found if r.doc_id == 5} == {len(long)}
