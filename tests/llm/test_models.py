import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlspike.llm import quality, toxicity
from marlspike.llm.common import flat


def auc(s, y):
    rank = np.empty(len(s))
    rank[np.argsort(s, kind="stable")] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    out = module.score(docs, module.train(docs, labels)).join(labels.select("doc_id", label), "doc_id", "left").toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= (0.3 if module is quality else 0.5))).all()
    held = out[out.held_out & out[label].notna()]
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(docs, spark, module):
    texts = ["good text here.", None, "", "\n\n\n", "   ", "x" * 300_000, "a\n" * 5000, "!!!", "ÄÖÜ ß", "good text here."] * 3
    d = docs(texts, [*range(29), None])
    column = "quality" if module is quality else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(29)] + [(3, 0), (None, 1), (4, None)], f"doc_id long, {column} int")
    out = module.score(d, module.train(d, labels)).collect()
    assert len(out) == 30 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 11, 12)}) == 1  # null and empty
    assert module.score(docs([]), module.train(docs([]), labels)).count() == 0
    one = labels.where(f"{column} = 1")
    assert len(module.score(d, module.train(d, one)).collect()) == 30


def test_scores_do_not_depend_on_batches():
    texts = ["One line.\nTWO!! LINES!!\n", "", "x | y | z |", "Und Und Und Und Und"] * 5
    y = [1, 1, 0, 0] * 5
    field = quality.fit(pa.table({"text": texts, "y": y}), steps=10)
    whole = field.documents(*flat(pa.array(texts)))
    each = np.concatenate([field.documents(*flat(pa.array([t]))) for t in texts])
    assert np.allclose(whole, each)


def test_marginals_match_enumeration():
    from itertools import product

    node, pair = np.array([0.3, -1.0, 0.7, 2.0]), np.array([[0.5, -0.2], [0.1, 0.9]])
    total, good = 0.0, np.zeros(4)
    for y in product((0, 1), repeat=4):
        w = np.exp(sum(n for n, v in zip(node, y, strict=True) if v) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    assert np.allclose(quality.marginals(node, np.array([0]), np.array([4]), pair)[0], good / total, atol=1e-6)


def test_disguises_read_as_words():
    plain = toxicity.word_hashes(["idiot"])[0]
    assert (toxicity.word_hashes(["Idiot,", "1d10t", "i.d.i.o.t", "IDIOT!!", "id!ot"]) == plain).all()
    assert toxicity.word_hashes(["idiots"])[0] != plain


def test_isotonic_is_monotone():
    r = np.random.default_rng(1)
    s = r.normal(size=300)
    knots, values = toxicity.isotonic(s, (r.random(300) < 1 / (1 + np.exp(-2 * s))).astype(float))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
