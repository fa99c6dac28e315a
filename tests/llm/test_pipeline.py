"""The pipeline's stages on a small corpus with planted cases, and the guard of the entry module."""

import corpus_pipeline


def test_stages(spark, tmp_path, prose):
    clean = {i: prose(100, 200 + i) + "\n" + prose(60, 300 + i) for i in range(40)}
    bad = {100 + i: prose(60, 400 + i) + " vermin filth wretch vermin scoundrel " + prose(60, 500 + i) for i in range(30)}
    passage = prose(60, 600)
    docs = {**clean, **bad, 200: clean[0], 201: prose(40, 601) + " " + passage, 202: prose(50, 602) + " " + passage, 203: "", 204: None}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 100)) for i in [*clean, *bad]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf_dir, seen = f"file://{tmp_path}", {}
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf_dir).write.parquet(f"{sf_dir}/{name}")
        now = spark.read.parquet(f"{sf_dir}/{name}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "packing":
            assert now.columns == frame.columns
            assert all(r["n_chars"] == len(r["text"]) for r in seen[name].values() if r["text"] is not None)
    assert not set(bad) & set(seen["toxicity"])
    assert set(clean) <= set(seen["substring_dedup"])
    assert all(seen["substring_dedup"][i]["text"] == clean[i] for i in clean)
    assert 200 not in seen["line_dedup"]
    assert 203 not in seen["simhash"] or 204 not in seen["simhash"]
    assert passage in seen["substring_dedup"][201]["text"]
    assert passage not in seen["substring_dedup"][202]["text"]
    assert corpus_pipeline.run(spark, sf_dir).count() == now.count()


def test_entry_has_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
