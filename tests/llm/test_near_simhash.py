"""The wide SimHash by which the pipeline's near copies are found, and its recall."""

import random

import numpy as np
from tessera.llm import near_documents
from tessera.llm.substring_dedup import _mix


def test_bits_and_segments():
    shingles = np.random.default_rng(3).integers(0, 2**63, 5001, dtype=np.uint64)
    wide = _mix(_mix(shingles[:, None] + near_documents._STEPS))
    ones = np.array([(wide[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).sum() for b in range(64 * near_documents.WORDS)], np.int64)
    balance = near_documents.balances(shingles)
    assert np.array_equal(balance, 2 * ones - 5001)
    for i, x in enumerate(near_documents.segments(balance).tolist()):
        own = balance[24 * i : 24 * i + 24]
        assert x & (1 << 24) - 1 == sum(1 << b for b in range(24) if own[b] > 0)
        weak = [x >> 24 + 5 * j & 31 for j in range(5)]
        assert np.abs(own[weak]).max() <= np.abs(np.delete(own, weak)).min()


def test_pairs_of_similarity_80_share_a_probe_and_stay_close(spark):
    rng, texts, pairs = random.Random(9), [], 0
    for n, more in [(4, 1), (8, 2), (20, 5), (40, 10), (200, 50)] * 60:  # shingles; the longer text has a quarter more
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + more + 4)]
        texts += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(words[: n + 4]))]
        pairs += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r["doc_id"] for r in near_documents.keep_one(docs, similar=0.8).collect()}
    assert set(range(0, 2 * pairs, 2)) <= kept
    assert len(kept) - pairs <= 0.015 * pairs


def test_candidates_come_from_simhash_alone(spark, prose, monkeypatch):
    from tessera.llm import substring_dedup

    def gone(*_, **__):
        raise AssertionError("MinHash bands")

    for name in ("_least", "_functions", "_band_keys", "_fine_bands"):
        monkeypatch.setattr(substring_dedup, name, gone)
        monkeypatch.setattr(near_documents, name, gone, raising=False)
    words = prose(300, 77).split()
    group = [" ".join([*words[:i], f"w{i}", *words[i + 1 :]]) for i in range(0, 300, 10)]
    docs = spark.createDataFrame(list(enumerate([*group, *[prose(300, 900 + i) for i in range(9)]])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_documents.keep_one(docs).collect()) == [0, *range(30, 39)]
