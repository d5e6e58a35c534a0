import random

import pytest

import corpus_pipeline
from folioscope.llm import queries
from tests.llm.conftest import ODD
from tests.llm.test_quality import labelled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def tables(spark, documents, tmp_path):
    rows, labels = labelled(240)
    draw = random.Random(8)
    passage = " ".join(f"p{draw.randint(0, 9000)}" for _ in range(60))
    fresh = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n))
    base = fresh(80)
    near = base.split()
    near[40] = "changed"
    special = [(5000, base), (5001, base), (5002, " ".join(near)), (5003, f"{fresh(30)} {passage} {fresh(30)}"), (5004, f"{fresh(30)} {passage} {fresh(30)}"), (5005, f"{fresh(20)} password=abcdefgh12345 {fresh(20)}")]
    every = [*rows, *special, *((i if i is None else i + 9000, t) for i, t in ODD)]
    documents(every).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), dict(special), passage


def test_stages(spark, tables):
    sf_dir, special, passage = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality, near, cut, redact, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, sf_dir)
    assert kept.columns == COLUMNS and set(special) <= {r["doc_id"] for r in kept.collect()}
    one = near(spark, kept, sf_dir)
    ids = {r["doc_id"] for r in one.collect()}
    assert one.columns == COLUMNS and 5000 in ids and not {5001, 5002} & ids and {5003, 5004, 5005} <= ids
    rows = cut(spark, one, sf_dir).collect()
    shorter = {r["doc_id"]: r for r in rows}
    assert len(rows) == one.count()
    assert passage in shorter[5003]["text"] and passage not in shorter[5004]["text"] and shorter[5004]["n_chars"] == len(shorter[5004]["text"]) == len(special[5004]) - len(passage)
    assert shorter[5000]["text"] == special[5000]
    rows = redact(spark, one, sf_dir).collect()
    clean = {r["doc_id"]: r for r in rows}
    assert len(rows) == one.count() and "[SECRET]" in clean[5005]["text"] and "abcdefgh" not in clean[5005]["text"] and clean[5000]["text"] == special[5000]
    packed = pack(spark, one, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_near_copies_of_odd_rows(spark, documents):
    """One of rows that are alike stays, and every row without words."""
    kept = corpus_pipeline.drop_near_copies(spark, documents(ODD), "").collect()
    texts = sorted(str(r["text"])[:20] for r in kept)
    assert texts == sorted(str(t)[:20] for t in [None, "", " \n\t ", "one", "no id", None, dict(ODD)[6], dict(ODD)[7], dict(ODD)[8], dict(ODD)[9]])


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, documents, tmp_path, k):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, documents([]), str(tmp_path)).collect() == [], name


@pytest.mark.parametrize("k", range(5))
def test_extra_columns_with_clashing_names(spark, documents, tmp_path, k):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents([(1, "some text"), (2, "other text")], k1="a", score="b", removed="c", length="d", label="e", rep="f")
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.count() == 2
    if k < 4:
        assert out.columns == docs.columns and {r["k1"] for r in out.collect()} == {"a"}


def test_run(spark, tables):
    sf_dir, _, _ = tables
    rows = queries.QUERIES["pipeline"](spark, sf_dir).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
