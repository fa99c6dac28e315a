"""Byte-level BPE by corpus-level merge replay, and its inverse."""

from __future__ import annotations

import hashlib
import heapq
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm._shared import shared_dir

_vocabularies: dict[str, Vocabulary] = {}

#: Code points whose pieces are numbered together, bytes of different pieces that are replayed together, ids that are decoded together.
BLOCK_CHARS, REPLAYED, DECODED = 1 << 24, 1 << 20, 1 << 18
#: Bytes of text for each share of the pieces (they are dealt by a hash), and different pieces of a share that a worker holds at once.
SHARE_BYTES, KNOWN = 1 << 25, 2_000_000
#: Ranks below which all positions of a merge are taken at once.
FREQUENT = 1_500


class Vocabulary:
    """Ids of the single bytes, ranks of the pairs of bytes, the merge of each pair of ids, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.first_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first_ranks = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.spelled = {i: token for token, i in ranks.items()}
        # every way to halve a token is a merge of that token's rank: a pair may merge if the joined bytes have a rank
        self.shift = max(ranks.values(), default=0).bit_length()
        self.merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left << self.shift | right] = rank
        self.pairs = np.array(sorted(self.merged), np.int64)
        self.pair_ranks = np.array([self.merged[k] for k in self.pairs.tolist()], np.int64)

    def ranks_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge's rank for each pair of ids, -1 where there is none."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        key = left << self.shift | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], -1)


def _frequent_merges(vocab: Vocabulary, symbol: np.ndarray, after: np.ndarray, before: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> dict[int, list[int]]:
    """Apply the merges of the ranks below FREQUENT, all positions of a rank at once; returns the index that is left.

    These are the merges with the most positions. The three arrays are changed in place. The index holds
    sorted runs of (rank, position) that are split by rank once; pairs that arise are gathered by rank.
    """
    index: dict[int, list[np.ndarray]] = {}

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.nonzero(np.diff(rank))[0] + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            index.setdefault(r, []).append(part)

    if len(places):
        enter(places, ranks)
    for rank in range(FREQUENT):
        parts = index.pop(rank, None)
        if parts is None:
            continue
        at = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        right = after[at]
        live = (symbol[at] >= 0) & (symbol[right] >= 0)
        at, right = at[live], right[live]
        same = vocab.ranks_of_pairs(symbol[at], symbol[right]) == rank
        at, right = at[same], right[same]
        if len(at) > 1 and (at[1:] == right[:-1]).any():
            # overlaps: from the left, a position whose left symbol has just been taken is skipped
            taken, keep = -1, np.ones(len(at), bool)
            for k, (i, j) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                if i == taken:
                    keep[k] = False
                else:
                    taken = j
            at, right = at[keep], right[keep]
        if not len(at):
            continue
        symbol[at], symbol[right] = rank, -2
        behind = after[right]
        after[at] = behind
        before[behind] = at  # a gap ends each word, so there is always one
        ahead = before[at]
        one = symbol[behind] >= 0
        two = ahead >= 0
        two[two] = symbol[ahead[two]] >= 0
        new = np.concatenate([at[one], ahead[two]])
        if len(new):
            new = np.unique(new)
            found = vocab.ranks_of_pairs(symbol[new], symbol[after[new]])
            real = found >= 0
            if real.any():
                enter(new[real], found[real])
    return {r: np.concatenate(parts).tolist() for r, parts in index.items()}


def replay(words: Iterable[bytes], vocab: Vocabulary) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers, all words encoded at once.

    All words lie in one row of symbols with gaps between. An inverted index leads from each pair that
    may merge to the positions where it stands. Merges are taken in rank order; each visits just its own
    positions, joins the two symbols there, and enters the two pairs that arise with the neighbours into
    the index. A pair holds tokens that earlier merges made, so all its positions are known when its
    turn comes. Within a merge positions go from left to right, which settles overlaps.
    """
    merged, shift = vocab.merged, vocab.shift
    words = list(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    row = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
    gap = np.zeros(len(row), bool)
    gap[ends - 1] = True
    symbols = np.where(gap, -1, vocab.first_ids[row])
    n = len(symbols)
    follows, precedes = np.arange(1, n + 1), np.arange(-1, n - 1)
    # rank of the merge: positions of the left symbol
    ranks = np.where(gap[:-1] | gap[1:], -1, vocab.first_ranks[row[:-1], row[1:]]) if n else np.empty(0, np.int64)
    places_of = np.nonzero(ranks >= 0)[0]
    index = _frequent_merges(vocab, symbols, follows, precedes, places_of, ranks[places_of])
    symbol: list[int] = symbols.tolist()
    after: list[int] = follows.tolist()
    before: list[int] = precedes.tolist()
    get = merged.get
    due = list(index)
    heapq.heapify(due)
    while due:
        rank = heapq.heappop(due)
        places = index.pop(rank)
        places.sort()
        for i in places:
            left = symbol[i]
            if left < 0:
                continue
            j = after[i]
            right = symbol[j]
            if right < 0 or get(left << shift | right) != rank:
                continue
            symbol[i], symbol[j] = rank, -2
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if symbol[k] >= 0:
                    new = get(rank << shift | symbol[k])
                    if new is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(due, new)
            h = before[i]
            if h >= 0 and symbol[h] >= 0:
                new = get(symbol[h] << shift | rank)
                if new is not None:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(due, new)
    done = np.array(symbol, np.int64)
    kept = done[done != -2]
    cuts = np.nonzero(kept == -1)[0].tolist()
    ids = kept.astype("<u4").tobytes()
    return [ids[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts[:-1])], cuts, strict=True)] if cuts else []


class Numbers(dict):
    """Numbers the different pieces of a block in the order in which they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, small ones mostly, compressed: all lowest bytes first, then the next ones."""
    return bundled(numbers.astype("<u4").tobytes(), 4)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(unbundled(data, 4), "<u4")


def bundled(data: bytes, width: int) -> bytes:
    """The bytes compressed, after their number; the k-th ones of every ``width`` stand together."""
    planes = np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()
    return struct.pack("<Q", len(data)) + (pa.compress(planes, "zstd", asbytes=True) if data else b"")


def unbundled(data: bytes, width: int) -> bytes:
    (n,) = struct.unpack_from("<Q", data)
    return np.frombuffer(pa.decompress(data[8:], n, "zstd"), np.uint8).reshape(width, -1).T.tobytes() if n else b""


def strung(words: list[bytes], width: int = 1) -> bytes:
    """Byte strings of multiples of ``width`` bytes as one."""
    sizes = packed(np.fromiter(map(len, words), np.int64, len(words)) // width)
    return struct.pack("<Q", len(sizes)) + sizes + bundled(b"".join(words), width)


def unstrung(data: bytes, width: int = 1) -> tuple[np.ndarray, bytes]:
    """(size of each in units of ``width`` bytes, all of them joined)."""
    (n,) = struct.unpack_from("<Q", data)
    return unpacked(data[8 : 8 + n]).astype(np.int64), unbundled(data[8 + n :], width)


def joined(first: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The runs ids[first : first + size] one after another."""
    before = np.cumsum(sizes) - sizes
    return ids[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))]


def decode(ids: bytes, vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _vocabulary(ranks: dict[bytes, int], key: str) -> Vocabulary:
    """One a worker process and vocabulary."""
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(ranks)
    return _vocabularies[key]


def split(docs: DataFrame, pattern: str, shares: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of about ``block_chars`` code points (or one longer text): what its texts are made of.

    ``block`` is the block's number. Its different matches of ``pattern`` are numbered; ``uses`` are the
    numbers of all pieces of all its texts, ``dealt`` each piece's share (by a hash, see ``packed``), and
    ``parts`` the pieces themselves by share, in order of their numbers (see ``strung``). ``doc_ids``
    and ``sizes`` are the texts' doc_ids and how many pieces they have.
    """
    kind = dict(docs.dtypes)["doc_id"]
    part = pa.list_(pa.struct([("share", pa.int32()), ("words", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = tokens.splitter(pattern).findall
        block = TaskContext.get().partitionId() << 31
        numbers, uses, doc_ids, sizes, held, of = Numbers(), [], [], [], 0, None

        def row() -> pa.RecordBatch:
            words = [p.encode() for p in numbers]
            dealt = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shares
            by_share: dict[int, list[bytes]] = {}
            for k, w in zip(dealt.tolist(), words, strict=True):
                by_share.setdefault(k, []).append(w)
            parts = [{"share": k, "words": strung(some)} for k, some in by_share.items()]
            columns = [
                pa.array([block], pa.int64()),
                pa.array([doc_ids], pa.list_(of)),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([packed(np.concatenate(uses))], pa.binary()),
                pa.array([packed(dealt)], pa.binary()),
                pa.array([parts], part),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "uses", "dealt", "parts"])

        for b in batches:
            of = b["doc_id"].type
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                text = text.as_py() or ""
                if doc_ids and held + len(text) > block_chars:
                    yield row()
                    block += 1
                    numbers, uses, doc_ids, sizes, held = Numbers(), [], [], [], 0
                found = find(text)
                uses.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                doc_ids.append(doc_id)
                sizes.append(len(found))
                held += len(text)
        if doc_ids:
            yield row()

    schema = f"block long, doc_ids array<{kind}>, sizes array<long>, uses binary, dealt binary, parts array<struct<share: int, words: binary>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def replayed(parts: DataFrame, ranks: dict[bytes, int], key: str, most: int = KNOWN) -> DataFrame:
    """(block, share, ids) of rows (block, share, words): each word's ids, in order, as ``strung`` of width 4.

    All rows of a share come together, one share after another, so that each different piece of the whole
    corpus is replayed once, with the new ones of its share, REPLAYED bytes of them (or one longer piece)
    at a time. Only of a share with more than ``most`` different pieces some are replayed again.
    """
    shipped = parts.sparkSession.sparkContext.broadcast((ranks, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(*shipped.value)
        known: dict[bytes, bytes] = {}
        last = None

        def learn(new: list[bytes]) -> None:
            at = 0
            while at < len(new):
                end, size = at, 0
                while end < len(new) and (end == at or size + len(new[end]) <= REPLAYED):
                    size += len(new[end])
                    end += 1
                known.update(zip(new[at:end], replay(new[at:end], vocab), strict=True))
                at = end

        for b in batches:
            out = []
            for share, data in zip(b["share"].to_pylist(), b["words"], strict=True):
                if share != last or len(known) > most:
                    known.clear()
                    last = share
                sizes, text = unstrung(data.as_py())
                ends = np.cumsum(sizes).tolist()
                words = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
                learn([w for w in words if w not in known])
                out.append(strung([known[w] for w in words], 4))
            yield pa.RecordBatch.from_arrays([b["block"], b["share"], pa.array(out, pa.binary())], ["block", "share", "ids"])

    together = parts.repartition("share").sortWithinPartitions("share", "block")
    return together.select("block", "share", "words").mapInArrow(run, "block long, share int, ids binary")


def _bucketed(df: DataFrame, column: str, n: int) -> DataFrame:
    """``df`` written to the shared folder in n buckets of the column and read again, so that joins by it need no shuffle of it."""
    spark, name = df.sparkSession, f"bpe_blocks_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved, so that the name is no longer needed; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def encoded(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False, block_chars: int = BLOCK_CHARS, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids`` (array<long>).

    Every match of ``pattern`` is encoded separately and without special tokens; null text counts as
    empty, and an empty text has no ids. The ids are decoded again and the bytes' digest returned. Rows
    stay as they are: repeated rows give repeated results, an empty table none, other columns of docs
    are not read.

    Three steps: texts are split once, and a block of texts is written as its different pieces and
    their order (``split``); pieces of all blocks meet by shares and are replayed (``replayed``); each
    block gets its pieces' ids back and joins them. What is shuffled is a block's different pieces,
    compressed by share, not every token; shares follow the size of all texts, and memory the block
    and the share, not the corpus.
    """
    ranks = tokens.ranks_of(vocabulary)
    key = tokens.key_of(ranks)
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, key))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-size // share_bytes))
    blocks = _bucketed(split(docs, pattern, shares, block_chars), "block", max(partitions, min(shares, 100_000)))
    found = replayed(blocks.select("block", F.explode("parts").alias("p")).select("block", "p.share", "p.words"), ranks, key)
    digests = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int64())} if ids else {})

    def run(block: pa.Table, parts: pa.Table) -> pa.Table:
        vocab = _vocabulary(*shipped.value)
        dealt = unpacked(block["dealt"][0].as_py())
        by_share = dict(zip(parts["share"].to_pylist(), parts["ids"].to_pylist(), strict=True))
        runs = [unstrung(by_share[k], 4) for k in sorted(by_share)]
        length = np.concatenate([np.empty(0, np.int64), *(sizes for sizes, _ in runs)])
        every = np.frombuffer(b"".join(x for _, x in runs), "<u4")
        of = np.empty(len(dealt), np.int64)  # where each piece stands in the shares
        of[np.argsort(dealt, kind="stable")] = np.arange(len(dealt))
        first, length = (np.cumsum(length) - length)[of], length[of]
        uses = unpacked(block["uses"][0].as_py())
        out: list[tuple] = []
        at = 0
        for n in block["sizes"][0].as_py():
            some = uses[at : at + n]
            at += n
            mine = joined(first[some], length[some], every)
            text = hashlib.sha256()
            for i in range(0, len(mine), DECODED):
                text.update(decode(mine[i : i + DECODED].tobytes(), vocab))
            row = (len(mine), hashlib.sha256(mine.tobytes()).hexdigest(), text.hexdigest())
            out.append((*row, mine.astype(np.int64)) if ids else row)
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(digests.values())]
        return pa.Table.from_arrays([block["doc_ids"].combine_chunks().flatten(), *columns], ["doc_id", *digests])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids
    return blocks.drop("parts").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)
