"""The five stages on planted rows."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)

    def words(n):
        return [f"w{rng.randint(0, 9999)}" for _ in range(n)]

    rows = [(i, " ".join(words(80)), "en", f"s{i % 4}", 0) for i in range(40)]
    near = rows[3][1].split()
    near[40] = "changed"
    rows += [(100, rows[2][1], "en", "s0", 0), (101, " ".join(near), "en", "s0", 0), (102, None, "en", "s0", 0), (103, "123 !?", "en", "s1", 0), rows[5]]
    item = [words(12) for _ in range(3)]
    rows += [(110, " ".join([*words(20), *item[0], *words(20), *item[1]]), "en", "s0", 0), (111, " ".join([*words(30), *item[2], *words(30)]), None, "s9", 0)]
    rows += [(120, " ".join([*words(30), "a.b@example.com", *words(30)]), "en", None, 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{102, 103}, {100, 101}, {110}, set()]
    columns = set(docs.columns)
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        got = stage(spark, docs, folder)
        assert set(got.columns) == columns, name
        before, after = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in got.select("doc_id").collect()}
        assert before - after == lost, name
        docs = spark.createDataFrame(got.collect(), docs.schema)
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count() and "[EMAIL]" in rows[120]["text"] and rows[111]["lang"] == "en"
    assert len(rows[111]["text"].split()) == 60 and rows[111]["n_chars"] == len(rows[111]["text"])


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert len(got) == 42 and (got.taken <= 3 * got["size"]).all() and abs(got.taken.sum() - got.groupby("source", dropna=False).target.first().sum()) < 400


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
