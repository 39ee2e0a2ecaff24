"""The pipeline's stages keep and drop what plain versions do."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from svloom.llm import toxicity  # noqa: E402
from svloom.llm.queries import toxicity_model  # noqa: E402

from .test_jaccard import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(11)

    def text(n):
        return " ".join("".join(rng.choices("klmnopqr", k=rng.randint(2, 6))) for _ in range(n))

    items = [(k, text(20)) for k in range(5)]
    rows = []
    for i in range(400):
        w = text(rng.randint(20, 80)).split()
        if i % 5 == 0:
            w[3:3] = ["gralkish", "vroxen"]
            w.append("gralkish")
        if i % 17 == 1:
            w[5:5] = items[i % 5][1].split()
        rows.append([i, " ".join(w)])
    for i in range(400, 440):
        rows.append([i, rows[i - 399][1]])
    for i in range(440, 460):
        rows.append([i, rows[i - 439][1] + " end"])
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, items


def test_stages(spark, tables):
    sf, rows, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity_model(spark, sf)
    want = [r for r in rows if model.score(r[1].encode()) < toxicity.THRESHOLD]
    assert sum(r[0] % 5 == 0 for r in want if r[0] < 400) <= 4 and len(want) > 340

    def stage(k, docs):
        got = corpus_pipeline.STAGES[k][1](spark, docs, sf)
        if k < 4:
            assert got.columns == docs.columns
            path = f"{sf}/stage{k}"
            got.write.parquet(path)
            return spark.read.parquet(path)
        return got

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    docs = stage(0, docs)
    assert ids(docs) == sorted(r[0] for r in want)
    last = {}
    for r in want:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    want = [r for r in want if last[r[1]] == r[0]]
    docs = stage(1, docs)
    assert ids(docs) == sorted(r[0] for r in want)
    want.sort()
    comp = components([r[1] for r in want], corpus_pipeline.NEAR)
    assert len(set(comp)) < len(want)
    want = [r for k, r in enumerate(want) if comp[k] == k]
    docs = stage(2, docs)
    assert ids(docs) == sorted(r[0] for r in want)
    want = [r for r in want if not any(t in r[1] for _, t in items)]
    docs = stage(3, docs)
    assert ids(docs) == sorted(r[0] for r in want)
    packed = stage(4, docs).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in want}


def test_run_on_an_empty_table(spark, tables):
    sf = tables[0]
    for name, _ in corpus_pipeline.STAGES[:4]:
        stage = dict(corpus_pipeline.STAGES)[name]
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
