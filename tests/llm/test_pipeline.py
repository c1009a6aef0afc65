"""The corpus pipeline, stage by stage, on a small folder of tables."""

import re

import corpus_pipeline
import numpy as np
import pytest
from perimetra.llm import piece_codec
from perimetra.llm.common import materialize

from tests.llm.test_operators import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(300):
        text, quality, toxic = prose(60, i), 1, 0
        if i % 10 == 3:
            text, quality = " ".join(f"{w}***" for w in text.split()), 0
        if i % 10 == 4:
            text, toxic = text + " zztoxic zztoxicb", 1
        if i % 50 == 7:
            text += " password=" + "".join(np.random.default_rng(i).choice(list("0123456789abcdef"), 18))
        if i % 50 == 8:
            text = prose(60, i - 8)
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
        labels.append((i, quality, toxic))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r["doc_id"] for r in v[1].select("doc_id").collect()} for k, v in seen.items()}
    assert not any(i % 10 == 3 for i in ids["quality"]) and len(ids["quality"]) == 270
    assert not any(i % 50 == 8 for i in ids["near_copies"]) and all(i in ids["near_copies"] for i in ids["quality"] if i % 50 != 8)
    assert ids["secrets"] == ids["near_copies"]
    assert not any(re.search("password=", r["text"]) for r in seen["secrets"][1].collect())
    assert all(i in ids["mixture"] for i in ids["secrets"] if i % 10 != 4) and sum(i % 10 == 4 for i in ids["mixture"]) < 15
    texts = {r["doc_id"]: r["text"] for r in seen["token_ids"][0].collect()}
    own = piece_codec.codec(piece_codec.model_path())
    for r in docs.collect():
        assert own.decode(np.array(r["ids"]), np.array([0, len(r["ids"])])) == [texts[r["doc_id"]]]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    from tests.llm.test_operators import awkward

    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, row_key string, posterior string"
    rows = [(r[0], r[1], r[2], r[3], r[4], 0.5, 1, "k", "p") for r in awkward()]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i in (9, 10) else 1, int(i == 16)) for i in range(34)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, str(tmp_path)), name)
        if name != "token_ids":
            assert docs.columns == before.columns
            assert {(r["score"], r["n_tokens"], r["row_key"], r["posterior"]) for r in docs.collect()} <= {(0.5, 1, "k", "p")}
    assert docs.count() == before.count() > 0


def test_empty_tables_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
