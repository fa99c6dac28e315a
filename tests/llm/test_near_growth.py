"""Rows that the search for near copies makes: of chance, and of a group's size."""

import random

import numpy as np

from tessera.llm import near_documents


def most_rows(spark, docs, names):
    """(kept doc_ids, most rows that a node of the plans with such a name made)."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    kept = {r["doc_id"] for r in near_documents.keep_one(docs).collect()}
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    rows = []
    executions = store.executionsList()
    for i in range(before, executions.size()):
        number = executions.apply(i).executionId()
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for at in range(nodes.size()):
            node = nodes.apply(at)
            if any(x in node.name() for x in names):
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                rows += [int(x.get().replace(",", "")) for x in found if x.isDefined()]
    assert rows
    return kept, max(rows)


def test_unrelated_documents_are_not_paired_by_chance(spark, tmp_path):
    rng, n = random.Random(41), 40_000
    texts = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))) for i in range(n)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents")
    kept, rows = most_rows(spark, spark.read.parquet(f"file://{tmp_path}/documents"), ["Join"])
    assert len(kept) == n
    assert rows <= n  # before, with segments of 24 bits, a join made 1,046,711


def test_a_group_of_near_copies_makes_a_few_rows_a_member(spark, prose):
    rng, n = random.Random(43), 400
    base, texts = prose(150, 44).split(), []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 8, 12])):  # many members are near the base, others near nobody
            words[at] = f"w{rng.randrange(10**9)}"
        texts.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(146)} for w in (t.lower().split() for _, t in texts)]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    kept, rows = most_rows(spark, spark.createDataFrame(texts, "doc_id long, text string"), ["Join", "Generate"])
    assert kept == set(first.values())
    assert 50 < len(kept) < 350
    assert rows <= 10 * n


def test_buckets_are_whole_however_many_probes_are_sorted_at_once(monkeypatch):
    rng = random.Random(47)
    held = np.array([rng.randrange(64) | sum(1 << 32 + b for b in rng.sample(range(32), rng.choice([0, 3, 6]))) for _ in range(300)], np.uint64).view(np.int64)
    probes = {}
    for row, x in enumerate(held.view(np.uint64).tolist()):
        places = [b for b in range(32) if x >> 32 + b & 1]
        for s in range(1 << len(places)):
            key = (x & 0xFFFFFFFF) ^ sum(1 << b for j, b in enumerate(places) if s >> j & 1)
            probes.setdefault(key, []).append(row)
    expected = sorted(rows for rows in probes.values() if len(rows) > 1)
    for most in (1 << 21, 1 << 11):
        monkeypatch.setattr(near_documents, "SORTED", most)
        found = [row[a : a + n].tolist() for row, starts, sizes in near_documents._runs(held) for a, n in zip(starts, sizes, strict=True)]
        assert sorted(found) == expected
        assert len(list(near_documents._runs(held))) == -(-(300 << 6) // most)


def test_result_does_not_depend_on_the_parts(spark, corpus, monkeypatch):
    whole = sorted(map(str, near_documents.keep_one(corpus).collect()))
    monkeypatch.setattr(near_documents, "DEALT", 1)
    assert sorted(map(str, near_documents.keep_one(corpus).collect())) == whole
