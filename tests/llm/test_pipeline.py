import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_brute_force import least_edits, plain
from test_dedup import near_classes

import corpus_pipeline
from marlspike.llm import decontaminate, exact_dedup, near_dedup, quality
from marlspike.llm.common import flat
from marlspike.llm.queries import ORACLES, QUERIES


def test_stages_keep_columns_and_agree_with_operators(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    ran = corpus_pipeline.run(spark, sf)
    key = lambda rows: sorted((r.doc_id, r.size, r.taken) for r in rows)
    assert key(ran.collect()) == key(mixed)
    # a second pass finds nothing more to drop
    assert exact_dedup.drop_exact_copies(docs).count() == near_dedup.drop_near_copies(docs).count() == docs.count()
    assert decontaminate.contaminated_spans(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert callable(quality.keep_good)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


ITEM = "Seven amber lanterns drift past the old harbour wall while nobody on the pier can say who lit them, or why they never seem to go out."


def fixture(spark, folder):
    """The shorter documents of the smallest table, with copies, near copies and passages planted, and columns with clashing names."""
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").orderBy(F.length("text"), "doc_id").limit(60).collect()
    texts = [(r.doc_id, r.text, r.source) for r in base]
    r = random.Random(3)
    for i, t in enumerate(texts[20:36]):
        words = t[1].split(" ")
        if i % 4 == 0:
            new = "  ".join(words) + "\n"
        elif i % 4 == 1:
            at = r.randrange(len(words))
            new = " ".join([*words[:at], "zebra", *words[at + 1 :]])
        elif i % 4 == 2:
            new = t[1] + " " + ITEM.upper()
        else:
            new = t[1] + " " + ITEM.replace("harbour", "harbor")[: 70 + 10 * i]
        texts.append((10_000 + i, new, t[2]))
    texts += [(20_000, None, "web"), (20_001, "", None), (20_002, None, "web"), texts[3], texts[3], (20_003, " ".join(f"Sentence {i} is {i * i} words long." for i in range(300)), "web")]
    rows = [(i, t, None, s, None, 1, False, "id", "row", 2, [3]) for i, t, s in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, kept boolean, id string, row string, root int, bands array<int>").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_run_matches_brute_force(spark, tmp_path):
    texts = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    field = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [t for t in texts if field.documents(*flat(pa.array([t[1] or ""])))[0] >= quality.THRESHOLD]
    first = {}
    for t in sorted(good, key=lambda t: t[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t[1] or ""), t)
    exact = list(first.values())
    classes = near_classes([t[1] for t in exact])
    apart = [t for i, t in enumerate(exact) if classes[i] == i]
    (item,) = plain([ITEM])
    windows = np.stack([item[i : i + 80] for i in range(len(item) - 79)])
    clean = [t for t, p in zip(apart, plain([t[1] or "" for t in apart]), strict=True) if least_edits(windows, p).min() > 80 * decontaminate.EDITS_PERCENT // 100]
    assert len(texts) > len(good) > len(exact) > len(apart) > len(clean) > 20
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for t in clean:
        sums[t[2]] += size(t[1])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((t[0], size(t[1]), sums[t[2]]) for t in clean)
    largest = max(r.size for r in got)
    for source in sums:
        rows = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * largest and all(r.taken <= 3 * r.size for r in rows)


def test_run_on_an_empty_table(spark, tmp_path):
    fixture(spark, tmp_path / "full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").where("false").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/empty/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/empty")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
