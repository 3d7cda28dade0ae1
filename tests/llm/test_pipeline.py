"""Stages take effect one after the other on planted rows."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from __spark_entry__ import queries


def test_stages_on_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert 0 < len(out) < docs.count()
    assert len({r["doc_id"] for r in out}) == len(out)
    for r in out:
        assert r["ids"] == coder.encode(r["decoded"]) and r["n_tokens"] == len(r["ids"])
        assert not any(t in r["decoded"] for t in bench)
    assert "pipeline" in queries()


def test_columns_between_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes


def test_toxic_rows_go(spark, tmp_path):
    """The stage drops what op8 calls toxic, planted rows among it, and no clean row."""
    toxic, clean = "you are a vile stupid creature. ", "the river runs past the old mill. "
    rows = [(i, clean * 3 + (toxic if i % 2 else clean)) for i in range(400)]
    rows += [(1_000 + n, p) for n, p in enumerate(("a mill", "you mill", "vile", "stupid mill", "river mill", "new words only here"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    called = {r["doc_id"]: (r["predicted"], r["score"]) for r in queries()["op8_toxicity"](spark, str(tmp_path)).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert any(0.3 <= s < 0.5 for _, s in called.values())
    assert kept == {i for i, (p, _) in called.items() if not p}
    assert all((i in kept) == (i % 2 == 0) for i in range(400))


def test_a_passage_with_edits_all_over_leaves_the_corpus(spark, tmp_path):
    item = " ".join(f"rain{k} seldom falls" for k in range(9))
    spread = "".join("#" if j % 5 == 4 else c for j, c in enumerate(item))  # no six characters in a row survive
    spark.createDataFrame([(4, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"before it {spread} and behind"), (2, "nothing of it"), (3, f"as it is: {item}")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()] == [2]
