"""Rows of one doc_id, rows without one, names that clash, and the registered queries' contracts."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import _shared, line_dedup, queries, substring_dedup

NAMES = ["_gone", "_of", "_lines", "_spans", "gone", "of", "lines", "key", "row", "left", "exact", "spans"]


@pytest.fixture(scope="module")
def mixed(spark, prose):
    shared, passage = "a line that several documents have, word for word", " ".join(f"{w}q" for w in prose(70, 71).split())
    own = [" ".join(f"{w}{k}" for w in prose(200, 60 + k).split()) for k in range(8)]
    texts = [
        (1, f"{own[0]}\n{shared}"),
        (1, f"{own[1]}\n{shared}\n{passage}"),
        (2, f"{own[2]} {passage} {own[2][::-1]}"),
        (None, f"{own[3]}\n{shared}"),
        (None, f"{own[4]} {passage}"),
        (3, own[5]),
        (3, own[5]),
        (1 << 62, own[6]),
        (None, None),
        (None, own[7]),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return docs.select("*", *[F.lit(n).alias(n) for n in NAMES]), own, shared, passage


def test_keys(spark, mixed):
    docs = mixed[0]
    found = [(r["key"], r["row"]["doc_id"], r["text"]) for r in _shared.keyed(docs).collect()]
    assert len(found) == docs.count()
    assert len({k for k, _, _ in found}) == len({(d, t) for _, d, t in found})
    assert all((k == d) == (d in (2, 3)) for k, d, _ in found)
    assert all(k >= 1 << 62 for k, d, _ in found if d not in (2, 3))


def test_lines_of_rows_without_an_id_of_their_own(mixed):
    docs, own, shared, passage = mixed
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_exact", "n_near"]
    data = out.collect()
    assert all(r[n] == n for r in data for n in NAMES)
    assert Counter(r["doc_id"] for r in data) == Counter(r["doc_id"] for r in docs.collect())
    lines = Counter(x for r in data for x in (r["text"] or "").split("\n") if x)
    assert lines[shared] == 1
    assert lines[own[5]] == 2
    assert all(lines[own[k]] == 1 for k in (0, 1, 3, 6, 7))
    assert sum(r["n_exact"] for r in data) == 2
    assert all(r["n_near"] == 0 for r in data)


def test_passages_of_rows_without_an_id_of_their_own(mixed):
    docs, own, _, passage = mixed
    out = substring_dedup.remove_passages(docs)
    assert out.columns == docs.columns
    data = [r["text"] for r in out.collect()]
    assert sum((t or "").count(passage) for t in data) == 1
    assert f"{own[2]} {passage} {own[2][::-1]}" in data  # of an id of its own, so it comes first
    assert all(any(own[k] in (t or "") for t in data) for k in range(8))
    assert data.count(own[5]) == 2
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r["first_doc_id"] for r in found if r["n_words"] >= 70} == {2}
    assert {r["doc_id"] for r in found if r["removed"] and r["n_words"] >= 70} == {1, None}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):
    where = tmp_path_factory.mktemp("contract")
    texts = {i: prose(40, i) + (" vermin filth wretch" if i % 3 == 0 else "") for i in range(60)} | {60: "", 61: None, 62: prose(40, 1)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{where}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{where}/labels.parquet")
    return f"file://{where}", texts


@pytest.mark.parametrize(("name", "modulus", "held", "threshold"), [("op2_toxicity", 3, 1, 0.7), ("op7_quality", 5, 0, 0.3)])
def test_scores(spark, folder, name, modulus, held, threshold):
    found = {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder[0]).collect()}
    assert set(found) == set(folder[1])
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= threshold)
    assert found[60]["score"] == found[61]["score"]
    assert found[62]["score"] == found[1]["score"]


def test_digests(spark, folder):
    path, texts = folder
    encoded = queries.QUERIES["op5_byte_bpe"](spark, path).collect()
    assert all(re.fullmatch("[0-9a-f]{64}", r[c]) for r in encoded for c in ("ids_sha256", "decoded_sha256"))
    prints = {r["doc_id"]: r for r in queries.QUERIES["op6_fingerprints"](spark, path).collect()}
    assert {i: r["n_chars"] for i, r in prints.items()} == {i: len(t or "") for i, t in texts.items()}
    assert prints[62]["fingerprint"] == prints[1]["fingerprint"] != prints[2]["fingerprint"]
    near = {r["doc_id"]: r for r in queries.QUERIES["op9_simhash_near_dedup"](spark, path).collect()}
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in near.values())
    assert near[60]["fingerprint"] == near[61]["fingerprint"] == "0" * 16
    assert (near[61]["component_id"], near[62]["component_id"]) == (60, 1)
    packed = queries.QUERIES["op10_best_fit_packing"](spark, path).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    assert all(0 <= r["ids_crc32"] < 1 << 32 and r["offset"] + r["length"] <= 1024 for r in packed)
    assert queries.QUERIES["op4_token_counts"](spark, path).count() > 0
    kept = {r["doc_id"]: r for r in queries.QUERIES["op3_line_dedup"](spark, path).collect()}
    assert kept[62]["text"] == ""
    assert {(r["doc_id"], r["removed"]) for r in queries.QUERIES["op8_substring_dedup"](spark, path).collect()} == {(1, False), (62, True)}
