"""Index store, embeddings, settings, polled revisions."""

import json

import pandas as pd

from tallyloom.operators import retrieval as rt
from tallyloom.sources.config import RepositoryConfig, load_config


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "id int, t string")
    p = str(tmp_path / "ix")
    rt.save_index(p, rt.postings(docs, "id", "t"), rt.document_stats(docs, "t"), docs)
    ix = rt.load_index(spark, p)
    assert "vectors" not in ix and ix["postings"].count() == 4 and ix["stats"].first().n_docs == 2
    q = spark.createDataFrame([(7, "alpha")], "q int, qt string")
    # a term in one of two documents has idf 0: nothing scores above 0
    assert rt.bm25(ix["postings"], ix["stats"], q, "id", "q", "qt").count() == 0
    more = docs.unionByName(spark.createDataFrame([(3, "delta delta"), (4, "epsilon")], "id int, t string"))
    rt.save_index(p, rt.postings(more, "id", "t"), rt.document_stats(more, "t"), more, more.select("id"))
    ix = rt.load_index(spark, p)
    assert [r.id for r in rt.bm25(ix["postings"], ix["stats"], q, "id", "q", "qt").collect()] == [1] and "vectors" in ix


def test_embed(spark):
    def model(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t)), 0.0])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    assert {r.id: list(r.embedding) for r in rt.embed(df, "t", model).collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_config(tmp_path):
    p = tmp_path / "c.json"
    assert load_config(p) == RepositoryConfig()
    p.write_text("{broken")
    assert load_config(p) == RepositoryConfig()
    p.write_text(json.dumps({"skip_globs": ["*.go"], "min_confidence": 1, "final_k": "five", "odd": 3}))
    assert load_config(p) == RepositoryConfig(skip_globs=["*.go"], min_confidence=1.0)
    p.write_text("[1]")
    assert load_config(p) == RepositoryConfig()


def test_polled_revisions(spark, tmp_path):
    from tallyloom.sources.polling import Revisions

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"key": "r#1", "sha": "s1", "at": "1"}))
    (folder / "b.json").write_text("broken")
    spark.dataSource.register(Revisions)
    seen = []
    stream = spark.readStream.format("revisions").option("path", str(folder)).load()
    for sha in ("s1", "s2"):
        (folder / "a.json").write_text(json.dumps({"key": "r#1", "sha": sha, "at": "1"}))
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.sha for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(60)
    assert seen == ["s1", "s2"]
