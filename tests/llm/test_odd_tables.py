"""Every registered query and the pipeline on tables of odd cases, and on empty ones."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import queries, spelling
from tests.llm.test_operators import ODD
from tests.llm.test_spelling_secrets_periods import plain_counts

#: Names that operators use for columns of their own.
CLASHING = ["uid", "_bad", "hit", "tie", "rank", "size", "copies", "key", "slot", "shard", "component", "bins", "row", "upto", "y", "file", "digest", "payload", "place", "at"]
NULL_IDS = [(None, "a row without an id " * 9, "en", "a", 1), (None, None, None, None, None), (None, ODD[0][1], "en", "a", 1), (12, None, "en", "d", 1)]
SHAPES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}
ROWS = {
    "documents": [r[:5] for r in ODD] + NULL_IDS,
    "labels": [(i, 1, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (3, 1, 0)],
    "benchmark": [(1, "One, TWO!"), (None, None), (2, "same " * 12), (2, "same " * 12), (3, "")],
    "embeddings": [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 2.0], None), (1, [1.0, 2.0], 1), (7, [], 1)],
    "pages": [(1, "u", "x" * 2000), (2, None, "x" * 2000), (None, "u", "x" * 2000), (3, "u", None), (3, "u", ""), (None, None, None), (4, "u", "é" * 40_000)],
}
TABLE = {"op5_warc_segments": "pages", "op7_product_quantisation": "embeddings"}


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    for name, shape in SHAPES.items():
        rows = ROWS[name] if request.param == "odd" else []
        frame = spark.createDataFrame(rows, shape)
        for k, c in enumerate(CLASHING):
            frame = frame.withColumn(c, F.lit(k if k % 2 else f"{k}"))
        frame.repartition(2).write.parquet(f"{path}/{name}.parquet")
    return request.param, str(path)


#: Its rows are the words of all documents.
WORDS = "op11_spelling_variants"


def test_words_of_odd_tables(spark, folder):
    kind, path = folder
    have = {r["word"]: r["n"] for r in queries.QUERIES[WORDS](spark, path).collect()}
    assert have == plain_counts([r[:2] for r in ROWS["documents"]] if kind == "odd" else [], spelling.EDITED)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {WORDS}))
def test_query_has_a_row_for_each_row(spark, folder, name):
    kind, path = folder
    out = queries.QUERIES[name](spark, path).collect()
    rows = ROWS[TABLE.get(name, "documents")] if kind == "odd" else []
    key = {"op5_warc_segments": "page_id", "op7_product_quantisation": "vec_id"}.get(name, "doc_id")
    assert Counter(r[key] for r in out) == Counter(r[0] for r in rows)


def test_pipeline(spark, folder):
    kind, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, run in corpus_pipeline.STAGES[:-1]:
        docs = run(spark, docs, path)
        assert docs.columns == [*(c.split()[0] for c in SHAPES["documents"].split(", ")), *CLASHING]
    out = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in ROWS["documents"]} and bool(out) == (kind == "odd")
