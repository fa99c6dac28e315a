"""Near copies of whole documents against exact Jaccard similarities."""

import random

import corpus_pipeline
from tessera.llm import near_documents


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_stage_drops_copies_of_similarity_80(spark, prose):
    rng = random.Random(31)
    texts, likeness = {}, []
    for i in range(20):
        words = prose(200, 800 + i).split()
        texts[i] = " ".join(words)
        for at in range(15, 200, 200 // (1 + i % 4)):  # some 5 shingles of 196 change with each word
            words[at] = f"w{rng.randrange(10**6)}"
        texts[100 + i] = " ".join(words)
        a, b = shingles(texts[i]), shingles(texts[100 + i])
        likeness.append(len(a & b) / len(a | b))
    assert min(likeness) >= 0.8
    assert min(likeness) < 0.83
    for i in range(5):  # and as many that are less alike
        words = texts[i].split()
        for at in range(4, 200, 25):
            words[at] = f"w{rng.randrange(10**6)}"
        texts[200 + i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {*range(20), *range(200, 205)}


def test_keep_one(spark, corpus, empty):
    data = corpus.collect()
    sets = [shingles(r["text"]) for r in data]
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = near_documents.keep_one(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == len(set(group))
    assert near_documents.keep_one(empty).collect() == []
