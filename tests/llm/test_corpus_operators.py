"""Each operator against a plain brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import _shared, bpe, fingerprints, line_dedup, packing, quality, simhash, substring_dedup, token_counts, tokens, topk, toxicity

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


# components


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {x: x for e in links if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    found = dict(rows(_shared.components(spark.createDataFrame(links, "u long, v long"))))
    assert found == {x: find(x) for u, v in links if u is not None and u != v for x in (u, v)}
    assert rows(_shared.components(spark.createDataFrame([], "u long, v long"))) == []


# 1


def test_top_k_refuses_scores_that_are_not_exact(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(df, F.col("vec_id") == 0)


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    queries, stock = rng.integers(-9, 9, (12, 16)).astype(float), rng.integers(-9, 9, (16, 9000)).astype(float)
    queries[:6, 2:] = 0  # of these two terms are essential at most
    ids = np.arange(9000)
    found = {i: (names.tolist(), scores.tolist()) for i, names, scores in topk.search_shard(queries, np.full(12, -1), stock, ids, 5)}
    for i, scores in enumerate(queries @ stock):
        best = sorted(zip(-scores, ids, strict=True))[:5]
        assert found[i] == ([n for _, n in best], [-x for x, _ in best])


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    vectors[40] = (40, vectors[20][1])
    vectors += [(400, None), (420, [1.0, None] * 4), (440, [float("nan")] * 8), (None, [0.1] * 8), vectors[60], (460, [0.5, 0.5])]
    clean = {i: np.array([np.floor(64 * x) for x in v] + [0] * (8 - len(v)), np.int64) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    expected = []
    for q, v in clean.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in clean.items() if i != q)[:20]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    assert sorted(rows(topk.top_k(df, F.col("vec_id") % 20 == 0))) == sorted(expected)
    assert rows(topk.top_k(df.limit(0), F.lit(True))) == []


# 2


def test_segments_are_maximal():
    rng = random.Random(4)
    for _ in range(200):
        score = [rng.choice([-2, -1, -0.5, 1, 2]) for _ in range(rng.randint(1, 14))]

        def brute(lo, hi):
            """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
            best = max(((sum(score[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return [*brute(lo, best[3]), (best[3], best[4], best[0]), *brute(best[4], hi)]

        found = toxicity.segments(np.arange(len(score)), np.array(score), 0.0)
        assert sum(s for *_, s in found) == pytest.approx(sum(s for *_, s in brute(0, len(score))))
        assert max((s for *_, s in found), default=0) == pytest.approx(max((s for *_, s in brute(0, len(score))), default=0))


def test_toxicity(spark, prose):
    rng = random.Random(6)
    labelled = []
    for i in range(600):
        text, label = prose(rng.randint(40, 200), 1000 + i).split(" "), int(i % 5 == 0)
        if label:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["scoundrel", "vermin", "filth", "wretch"]) for _ in range(6)]
        labelled.append((" ".join(text), label))
    model = toxicity.fit(labelled[:400])
    right = [(toxicity.score(model, t) >= 0.7) == bool(y) for t, y in labelled[400:]]
    assert np.mean(right) > 0.95
    found, (span, *_) = toxicity.evidence(model, "a quiet meadow " * 20 + "vermin filth wretch " * 3 + "the river " * 30)
    assert found > 0
    assert span[0] == 60
    assert span[1] == 69
    docs = spark.createDataFrame([(1, labelled[0][0]), (2, None), (3, ""), (None, labelled[0][0])], "doc_id long, text string")
    scores = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert scores[1]["predicted"] == 1
    assert scores[2]["score"] == scores[3]["score"] < 0.3
    assert scores[None]["score"] == scores[1]["score"]
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()) == [2, 3]
    assert toxicity.score(toxicity.fit([]), "x") < 0.5


# 3


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = [rng.choice("abé😀") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "😀"])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    found = rows(df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), most)))
    assert all(x == min(most + 1, distance(a, b)) for a, b, x in found)


def test_line_dedup(spark, corpus, empty):
    rng = random.Random(9)
    base = ["a line that is rather long and has number %d in it" % (i * 37) for i in range(20)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice("abcé ")
            lines.append("".join(line))
        texts.append("\n".join([*lines, "short"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, expected = [], {}
    for i, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            cut = line.strip()
            gone = len(cut) >= 20 and any(distance(cut, x) <= 2 for x in before if abs(len(x) - len(cut)) <= 2)
            before += [cut] if len(cut) >= 20 else []
            kept += [] if gone else [line]
        expected[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == expected
    out = line_dedup.dedup_lines(corpus)
    assert out.columns == [*corpus.columns, "n_lines", "n_exact", "n_near"]
    assert out.count() == corpus.count()
    assert line_dedup.dedup_lines(empty).collect() == []


# 4


def test_token_counts(spark, corpus, empty):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks_of(RANKS), special_tokens={})
    lengths = sorted(len(enc.encode_ordinary(r["text"] or "")) for r in corpus.collect())
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(corpus, RANKS, public_tokenizers.PATTERN))
    found = {r["context_limit"]: r for r in histogram.collect()}
    assert {k: r["n_docs"] for k, r in found.items()} == dict(Counter(lengths))
    for k, r in found.items():
        assert r["truncated_tokens"] == sum(min(k, x) for x in lengths)
        assert r["docs_longer"] == sum(x > k for x in lengths)
        assert r["quantile"] == sum(x <= k for x in lengths) / len(lengths)
    limits = [0, 1, 7, 100, 10**6]
    assert dict(rows(token_counts.truncated_totals(histogram, limits))) == {k: sum(min(k, x) for x in lengths) for k in limits}
    assert token_counts.length_quantile(histogram, 0.5) == lengths[(len(lengths) - 1) // 2]
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty, RANKS, public_tokenizers.PATTERN)).collect() == []


# 5


def test_bpe(spark, corpus, empty):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks_of(RANKS), special_tokens={})
    found = bpe.encoded(corpus, RANKS, public_tokenizers.PATTERN, ids=True).collect()
    texts = Counter(r["text"] or "" for r in corpus.collect())
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert Counter(by_digest[r["decoded_sha256"]] for r in found) == texts
    for r in found:
        ids = enc.encode_ordinary(by_digest[r["decoded_sha256"]])
        assert r["ids"] == ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encoded(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_of_many_blocks(spark, corpus):
    spread = corpus.repartition(3)
    whole, cut = (sorted(map(tuple, bpe.encoded(d, RANKS, public_tokenizers.PATTERN, block_chars=n, share_bytes=m).collect()), key=str) for d, n, m in ((corpus, 1 << 23, 1 << 30), (spread, 900, 2_000)))
    assert whole == cut
    blocks = bpe.split(spread, public_tokenizers.PATTERN, 7, 900).collect()
    assert len({r["block"] for r in blocks}) == len(blocks) > 10
    assert sum(len(r["doc_ids"]) for r in blocks) == corpus.count()
    share = {}
    for r in blocks:
        assert len({p["share"] for p in r["parts"]}) == len(r["parts"]) <= 7
        words = []
        for p in r["parts"]:
            sizes, text = bpe.unstrung(bytes(p["words"]))
            ends = np.cumsum(sizes).tolist()
            some = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            assert all(share.setdefault(w, p["share"]) == p["share"] for w in some)
            words += some
        assert len(set(words)) == len(words) == len(bpe.unpacked(bytes(r["dealt"])))


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_pieces_are_replayed_by_share(spark, most):
    ranks = tokens.ranks_of(RANKS)
    words = [b"hello", b" world", b"a" * 500, b"zq", b"\xc3\xa9"]
    some = {(i, i % 4): [words[(i + k) % 5] for k in range(i % 6)] for i in range(100)}
    parts = spark.createDataFrame([(b, s, bytearray(bpe.strung(w))) for (b, s), w in some.items()], "block long, share int, words binary")
    found = {(r["block"], r["share"]): bpe.unstrung(bytes(r["ids"]), 4) for r in bpe.replayed(parts, ranks, tokens.key_of(ranks), most).collect()}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert found.keys() == some.keys()
    for at, (sizes, ids) in found.items():
        expected = [enc._encode_single_piece(w) for w in some[at]]
        assert sizes.tolist() == list(map(len, expected))
        assert np.frombuffer(ids, "<u4").tolist() == [i for e in expected for i in e]


def test_replay_is_tiktoken():
    ranks = tokens.ranks_of(RANKS)
    vocab, enc = bpe.Vocabulary(ranks), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    texts = ["".join(rng.choice("aab \n'sé1!😀the") for _ in range(rng.randint(0, 200))) for _ in range(150)] + ["a" * 999, "<|endoftext|>"]
    find = tokens.splitter(public_tokenizers.PATTERN).findall
    for at in range(0, len(texts), 10):
        some = [find(t) for t in texts[at : at + 10]]
        pieces = sorted({p for found in some for p in found})
        known = dict(zip(pieces, bpe.replay([p.encode() for p in pieces], vocab), strict=True))
        for text, found in zip(texts[at : at + 10], some, strict=True):
            ids = b"".join(known[p] for p in found)
            assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
            assert bpe.decode(ids, vocab) == text.encode()


# 6


def test_fingerprints(spark, corpus, empty):
    found = fingerprints.edited_fingerprints(corpus).collect()
    docs = sorted(corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))

    def sets(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    expected = Counter()
    for r, after in zip(docs, [*docs[1:], docs[0]], strict=True):
        n = len(r["text"])
        edited = r["text"][: n - n // 2] + after["text"][: n // 2]
        expected[r["doc_id"], n, hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(sets(r["text"]), sets(edited)), 9), round(jaccard(sets(r["text"]), sets(after["text"])), 9)] += 1
    long = {r["doc_id"] for r in docs if len(r["text"]) > 3000}
    exact = Counter({k: v for k, v in expected.items() if k[0] not in long})
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found if r["doc_id"] not in long).keys() >= {k for k in exact if jaccard and sum(1 for e in expected if e[0] == k[0]) == 1 and k[1] < 300}
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == Counter({k: sum(v for e, v in expected.items() if e[:3] == k) for k in {e[:3] for e in expected}})
    near = {(r["doc_id"], r["edited_sha256"]): r["near_edited"] for r in found}
    assert all(abs(near[k[0], k[2]] - k[3]) < 0.2 for k in expected)
    text_of = defaultdict(set)
    for r in docs:
        text_of[r["doc_id"]].add(r["text"])
    prints = defaultdict(set)
    for r in found:
        if len(text_of[r["doc_id"]]) == 1:
            prints[next(iter(text_of[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert fingerprints.edited_fingerprints(empty).collect() == []


@pytest.mark.parametrize("far", [[], [1 << 60], [-(1 << 63), (1 << 63) - 1]])
def test_next_of_uneven_ids(spark, far):
    rng = random.Random(5)
    keys = [*range(100), *range(5_000, 5_300), *rng.sample(range(10**6), 50), *far, *[None] * 150, *[7] * 9]
    rows = [(k, rng.getrandbits(63) * rng.choice([1, -1]), i) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, _tie long, v long")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = {a[2]: b[2] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    found = fingerprints.with_next(df, ["v"], size=10).collect()
    assert len(found) == len(rows)
    assert {r["v"]: r["next_v"] for r in found} == expected
    sizes = Counter(r["_bucket"] for r in fingerprints._buckets(df, "doc_id", "_tie", 10)[0].collect())
    assert max(sizes.values()) <= 100


def test_sketch_merge(spark, prose):
    a, b = prose(3000, 21), prose(900, 22)
    df = spark.createDataFrame([(a, b, a + "\n" + b)], "a string, b string, both string")
    for c in ("a", "b", "both"):
        df = fingerprints.with_sketch(df, c, f"s_{c}")
    df = df.withColumn("merged", fingerprints.merge("s_a", "s_b"))
    r = df.select(fingerprints.containment("s_a", "s_both").alias("x"), fingerprints.containment("s_b", "s_both").alias("y"), fingerprints.likeness("merged", "s_both").alias("z")).first()
    assert r["x"] == 1
    assert r["y"] == 1
    assert r["z"] > 0.9


# 7


def test_quality(spark, prose):
    rng = random.Random(12)
    labelled = [(prose(rng.randint(30, 500), 3000 + i), 1) if i % 4 else ((prose(200, 3000 + i) + " " + prose(100, i).upper().replace(" ", "!! ")), 0) for i in range(400)]
    model = quality.fit(labelled[:300])
    score, _ = model.scores([t for t, _ in labelled[300:]])
    assert np.mean((score >= 0.5) == np.array([y for _, y in labelled[300:]])) > 0.93
    docs = spark.createDataFrame([(1, labelled[1][0]), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert len(found) == 4
    assert found[2]["score"] == found[3]["score"]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_quality_sample_is_bounded_in_bytes(spark, prose, monkeypatch):
    assert quality.within([(0, 2, 5, "b"), (0, 1, 8, "a"), (0, 3, 2, "c"), (1, 1, 9, "d"), (1, 2, 11, "e")], 10) == ["a", "c", "d"]
    texts = [(i, prose(5_000 if i == 3 else 30, i)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda rows, share: fitted.append((rows, share)))
    quality.train(docs, labels, F.lit(True), most_bytes=10_000)
    assert sorted(t for t, _ in fitted[0][0]) == sorted(t for i, t in texts if i != 3)
    assert fitted[0][1] == 0.5


def test_quality_gradients():
    rng = np.random.default_rng(5)
    x, first, y = rng.normal(size=(9, 256 + quality.PAIRS + 1)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    model = quality.fit([("good text", 1), ("BAD!!", 0)], rounds=1)
    model.mean, model.scale, weight = 0.0, 1.0, np.array([1.0, 2.0, 0.5])
    grads = model.gradients(x, first, y, weight)

    def loss():
        logit = model.forward(x, first)[-1]
        return float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())

    for name, g in grads.items():
        at = tuple(0 for _ in g.shape)
        w = model.w[name]
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# 8


def test_substring_dedup(spark, prose, empty):
    shared, other = prose(60, 50), prose(70, 51)
    near = other.split(" ")
    near[30] = "changed"
    texts = {
        0: prose(90, 60) + " " + shared + " " + prose(40, 61),
        1: prose(50, 62) + "\n" + prose(30, 63) + " " + shared,
        2: prose(80, 64) + "\n" + other,
        3: " ".join(near) + "\n" + prose(45, 65),
        4: prose(200, 66),
        5: "a " * 500,
        6: "",
        7: None,
    }
    docs = spark.createDataFrame([*texts.items(), (4, texts[4]), (None, prose(70, 67))], "doc_id long, text string")
    found = {(d, f) for d, f, *_ in rows(substring_dedup.repeated_passages(docs))}
    assert found == {(0, 0), (1, 0), (2, 2), (3, 2)}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs).collect()}
    assert left[0] == texts[0]
    assert left[4] == texts[4]
    middle = " ".join(shared.split()[20:40])
    assert middle not in left[1]
    assert texts[1].split("\n")[0] in left[1]
    assert left[3].strip() == texts[3].split("\n")[1]
    assert left[7] is None
    assert substring_dedup.repeated_passages(empty).collect() == []


def test_near_group_without_all_pairs(spark, prose):
    base = prose(120, 70).split(" ")
    rng = random.Random(13)
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    groups = {i: i for i in range(60)}
    for i in range(60):
        for j in range(i):
            a, b = sets(texts[i]), sets(texts[j])
            if len(a & b) >= 0.8 * len(a | b):
                x, y = groups[i], groups[j]
                groups = {k: min(x, y) if g in (x, y) else g for k, g in groups.items()}
    found = {d: f for d, f, _, n, _ in rows(substring_dedup.repeated_passages(docs)) if n == len(base)}
    assert found == {i: g for i, g in groups.items() if list(groups.values()).count(g) > 1}


# 9


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(spark, corpus, empty):
    data = corpus.collect()
    assert all(simhash.simhash(r["text"]) == brute_simhash(r["text"]) for r in data if len(r["text"] or "") < 5000)
    ids = sorted({r["doc_id"] for r in data if r["doc_id"] is not None})
    prints = [(r["doc_id"], simhash.simhash(r["text"])) for r in data]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    expected = Counter((d, f, min((prints[k][0] for k in range(len(prints)) if group[k] == group[i] and prints[k][0] is not None), default=None)) for i, (d, f) in enumerate(prints))
    assert Counter((d, f & (2**64 - 1), c) for d, f, c in rows(simhash.near_duplicates(corpus))) == expected
    kept = simhash.keep_one(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == len(set(group))
    assert {r["doc_id"] for r in kept.collect()} <= {*ids, None}
    assert simhash.near_duplicates(empty).collect() == []


def test_multi_index_pairs(spark):
    rng = random.Random(14)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(4)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    expected = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert set(rows(simhash.near_pairs(df, distance=3, segments=4))) == expected
    assert set(rows(simhash.near_pairs(df, distance=2, segments=2))) == {(a, b) for a, b in expected if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


# 10


def test_packing(spark, corpus, empty):
    tokenizer = Tokenizer.from_file(JSON)
    special = spark.createDataFrame([(900, "hi <|endoftext|> there<|endoftext|><|endoftext|> \n", "x"), (901, "<|endoftext|", "y")], "doc_id long, text string, score string")
    corpus = corpus.unionByName(special, allowMissingColumns=True)
    found = packing.pack_documents(corpus, JSON, public_tokenizers.PATTERN, end_id=2, capacity=64).collect()
    expected = Counter()
    for r in corpus.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        for i, end in enumerate(range(first, len(ids) + 1, 64)):
            start = max(0, end - 64) if i else 0
            expected[r["doc_id"], i, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(k[3] * n for k, n in expected.items()) // 64) + 3
    assert packing.pack_documents(empty, JSON, public_tokenizers.PATTERN).collect() == []


def test_plan_is_no_worse_than_best_fit_decreasing():
    rng = random.Random(15)
    for _ in range(200):
        capacity, n = rng.choice([10, 16, 30, 1024]), rng.randint(0, 200)
        items = [rng.randint(1, capacity) for _ in range(n)]
        plan = packing.plan(dict(Counter(items)), capacity)
        used = Counter()
        for filling, m in plan:
            assert sum(filling) <= capacity
            used.update({x: m * k for x, k in Counter(filling).items()})
        assert used == Counter(items)
        room = []
        for x in sorted(items, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= x]
            if fits:
                room[min(fits, key=room.__getitem__)] -= x
            else:
                room.append(capacity - x)
        assert sum(m for _, m in plan) <= len(room)
