"""The pipeline's stages and run() over a small table, each stage against what its operator must give."""

import sys

import public_tokenizers
import pytest

from tests_llm_helpers import small_corpus

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, bench = small_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in docs.collect()})
    lang, lines, near, clean, coded = kept
    everything = {r[0] for r in rows}
    assert lang == everything - {900, 901} and lines == lang
    assert near == lines - {801, 802} and clean == near - {700} and coded == clean
    final = {r["doc_id"]: r for r in docs.collect()}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/decontamination").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in text.items()} == {k: r["n_tokens"] for k, r in final.items()}
    got = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["ids_sha256"] for r in got.collect()} == {k: r["ids_sha256"] for k, r in final.items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    rows, bench = small_corpus()
    odd = [(*r, "x", i) for i, r in enumerate([*rows[:30], rows[0], (None, rows[1][1], "de", "s", 0), (None, None, None, None, None), (5, "", "en", "s", 0)])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid string, kept long"
    for name, given in (("odd", odd), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == (32 if given else 0)  # all but those without a letter; a copy's lines go, its row stays
        assert {(r["rid"], type(r["kept"])) for r in got} <= {("x", int)} and sorted(r["kept"] for r in got) == [i for i in range(34 if given else 0) if i != 32 and i != 33]


assert sys.modules["tests_llm_helpers"]
