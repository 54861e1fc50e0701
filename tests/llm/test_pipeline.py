"""The pipeline's stages against plain Python, each on what the one before kept."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from reqloom.llm import mixing
from tests.llm.test_operators import SCHEMA, documents, plain_components, strip


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{where}/documents.parquet")
    out, docs = [], spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, str(where)).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return [*out, docs], str(where)


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_order(stages):
    tables, _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_quality_keeps_only_long_enough(stages):
    tables, _ = stages
    before, after = collections.Counter(rows(tables[0])), collections.Counter(rows(tables[1]))
    assert not after - before
    assert all(len((t or "").split()) >= 10 for _, t in after)


def test_near_dedup_keeps_one_of_each_group(stages):
    tables, _ = stages
    given = rows(tables[2])
    want = collections.Counter(r for r, (_, _, _, kept) in zip(given, plain_components(given), strict=True) if kept)
    assert collections.Counter(rows(tables[3])) == want


def test_line_dedup_keeps_rows(stages):
    tables, _ = stages
    assert sorted(str(i) for i, _ in rows(tables[1])) == sorted(str(i) for i, _ in rows(tables[2]))
    holders = collections.defaultdict(set)
    for i, t in rows(tables[2]):
        for line in t.split("\n"):
            if len(strip(line)) >= 10:
                holders[strip(line).lower()].add(i)
    assert all(len(h) == 1 for h in holders.values())
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())


def test_mixing_repeats_rows(stages):
    tables, _ = stages
    times = {(r.doc_id, r.text): r.times for r in mixing.mix(tables[3].withColumn("__words", mixing.words_of()), "__words", identity=["doc_id"]).collect()}
    got = collections.Counter(rows(tables[4]))
    assert {k: n for k, n in got.items()} == {k: n for k, n in times.items() if n}


def test_packing_and_run(stages, spark):
    tables, where = stages
    packed = tables[5].collect()
    per = collections.Counter()
    for r in packed:
        per[r.doc_id] += r.length
    copies = collections.Counter(i for i, _ in rows(tables[4]))
    whole = {r.doc_id: r.doc_tokens for r in packed}
    assert per == {i: whole[i] * n for i, n in copies.items()}
    key = lambda rs: sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in rs)
    assert key(corpus_pipeline.run(spark, where).collect()) == key(packed)
    assert np.all([len(r.tokens) == 4 * r.length for r in packed])


def test_near_dedup_links_from_80_percent(spark):
    import corpus_pipeline

    common = [f"c{i}" for i in range(1004)]
    rows = [(i, " ".join(common + [f"o{i}x{k}" for k in range(own)])) for i, own in enumerate((100, 100))]  # 1000 / 1200
    rows.append((2, " ".join(common[:500] + [f"p{k}" for k in range(600)])))
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
