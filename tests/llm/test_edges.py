"""Every operator and every pipeline stage over awkward tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lumenspark.llm import bpe, queries

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000)) + "x" * 300_000
BASE = [
    (1, "A small text. With two lines\nof words.", "en", "s1", 10),
    (2, None, "en", "s1", None),
    (3, "", None, "s2", 0),
    (4, "   \n\t ", "en", None, 6),
    (5, LONG, "en", "s1", len(LONG)),
    (6, LONG, "en", None, len(LONG)),
    (7, "ein Satz ist ein Satz " * 40, "de", "s3", 880),
    (7, "ein Satz ist ein Satz " * 40, "de", "s3", 880),
    (None, "no id here but some words to read", "en", "s2", 33),
    (None, None, None, None, None),
    (8, "é中\U0001f600 ́ naïve <|endoftext|> <|startoftext|> \x00 \x1c \x85", "fr", "", 30),
    (-9, "idiot " * 3 + "word " * 60, "en", "s1", 320),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["_id", "_cuts", "_row", "_size", "_key", "class", "key", "copies", "size", "target", "rank", "part", "ids", "n", "sig", "_range", "first", "end"]
LABELS = [(1, 1, 0), (5, 1, 0), (7, 1, 0), (-9, 0, 1), (2, None, None), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    for name, rows in (("some", BASE), ("none", []), ("clash", BASE)):
        docs = spark.createDataFrame(rows, SCHEMA)
        if name == "clash":
            from pyspark.sql import functions as F

            docs = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
        docs.write.parquet(f"{out}/{name}/documents.parquet")
        spark.createDataFrame(LABELS if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{out}/{name}/labels.parquet")
        vectors = [(0, [0.5, 1.0], 1), (20, [0.5, None], 1), (40, None, 1), (1, [0.5, 1.0], 1), (1, [0.5, 1.0], 1), (60, [], None), (61, [], 0)]
        spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/{name}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_operator(spark, folder, name):
    run = queries.QUERIES[name]
    assert run(spark, f"{folder}/none").count() == 0
    plain, clash = ({str(tuple(r)) for r in run(spark, f"{folder}/{t}").collect()} for t in ("some", "clash"))
    assert plain == clash
    per_row = {"op1_mixing", "op4_toxicity", "op6_token_counts", "op7_jaccard", "op8_token_files", "op9_quality", "op10_bpe"}
    if name in per_row:
        assert run(spark, f"{folder}/some").count() == len(BASE)


@pytest.mark.parametrize("table", ["some", "none", "clash"])
def test_stages(spark, folder, table, tmp_path):
    docs = spark.read.parquet(f"{folder}/{table}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{folder}/{table}")
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if table == "none":
            assert docs.count() == 0
        elif name == "near_copies":
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert ids.count(7) == 1 and ids.count(None) == 2 and 6 not in ids
    assert table == "none" or docs.count() > 0


def test_run_equals_its_stages(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/some").count() > 0


def test_arrays_round_trip(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(BASE, SCHEMA)
    back = bpe.decode_ids(bpe.encode_documents(docs, path), path)
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
