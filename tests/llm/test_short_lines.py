"""Equal lines go whatever their length, in the registered query and in the pipeline's stage."""

import corpus_pipeline
from tessera.llm import queries


def test_equal_short_lines(spark, tmp_path):
    texts = {0: "Of, edti oner.\nx\n\nfirst", 1: "Of, edti oner.\n\nOf, edti ones.", 2: " x\nx\n\nsecond", 3: None, 4: "\n"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    expected = {0: texts[0], 1: "\nOf, edti ones.", 2: "\nsecond", 3: None, 4: "\n"}
    found = {r["doc_id"]: r for r in queries.op3_line_dedup(spark, f"file://{tmp_path}").collect()}
    assert {i: r["text"] for i, r in found.items()} == expected
    assert {i: (r["n_exact"], r["n_near"]) for i, r in found.items()} == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (0, 0), 4: (0, 0)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == expected
