"""Repeated passages to the word, against all runs of words that an earlier document has."""

import random

from tessera.llm import substring_dedup


def test_common_runs_are_cut_whole_and_exactly(spark, prose):
    rng = random.Random(41)
    texts = []
    for i in range(24):
        own = " ".join(f"{w}{i}" for w in prose(60, 900 + i).split())
        if texts:  # a passage of an earlier text, from any word to any word
            words = texts[rng.randrange(len(texts))].split()
            n = rng.randint(50, min(90, len(words)))
            at = rng.randint(0, len(words) - n)
            own += " " + " ".join(words[at : at + n]) + " " + " ".join(f"{w}x{i}" for w in prose(40, 950 + i).split())
        texts.append(own)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, expected = set(), {}
    for i, text in enumerate(texts):
        words = text.split()
        runs = [tuple(words[k : k + 20]) for k in range(len(words) - 19)]
        gone = {j for k, r in enumerate(runs) if r in seen for j in range(k, k + 20)}
        expected[i] = " ".join(w for j, w in enumerate(words) if j not in gone)
        seen |= set(runs)
    left = {r["doc_id"]: " ".join(r["text"].split()) for r in substring_dedup.remove_passages(docs).collect()}
    assert left == expected
    assert sum(len(t.split()) for t in left.values()) < sum(len(t.split()) for t in texts) - 23 * 50


def test_short_paragraphs(spark, prose):
    line = prose(12, 990)
    edited = " ".join([*line.split()[:-1], "changed"])  # 7 of 9 shingles in common with it: 0.78
    lines = [" ".join(f"{w}{k}" for w in prose(30, 970 + k).split()) for k in range(4)]
    near = [" ".join([*x.split()[:-1], "changed"]) for x in lines]  # 25 of 27 shingles
    texts = {0: "\n".join([prose(50, 980), *lines, line, "two words"]), 1: "\n".join([prose(50, 981), *near]), 2: f"{prose(50, 982)}\n{line}\n\nTwo  words", 3: f"{prose(50, 983)}\n{edited}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r["doc_id"]: r["text"].strip() for r in substring_dedup.remove_passages(docs).collect()}
    first = lambda i: texts[i].split("\n")[0]
    assert left[0] == texts[0]
    assert left[1] == first(1)
    assert left[2] == first(2)
    assert left[3] == texts[3]
