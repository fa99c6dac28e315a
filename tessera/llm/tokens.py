"""Byte-level vocabularies of public tokenizers and the splitting of text into pieces."""

from __future__ import annotations

import base64
import hashlib
import json

import regex
import tiktoken

_encoders: dict[str, tiktoken.Encoding] = {}


def byte_of_char() -> dict[str, int]:
    """The printable characters under which byte-level vocabularies in JSON spell the 256 bytes.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    table.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return table


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to ids: of a rank file, or of a byte-level BPE in tokenizers' JSON without its special tokens."""
    with open(path, "rb") as f:
        raw = f.read()
    if not path.endswith(".json"):
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
    kept = json.loads(raw)
    special = {t["content"] for t in kept.get("added_tokens", ())}
    byte = byte_of_char()
    return {bytes(byte[c] for c in token): i for token, i in kept["model"]["vocab"].items() if token not in special}


def added_of(path: str) -> dict[str, int]:
    """The added tokens of tokenizers' JSON, which it finds in a text before anything is split; none in a rank file."""
    if not path.endswith(".json"):
        return {}
    with open(path, "rb") as f:
        added = json.loads(f.read()).get("added_tokens", ())
    for t in added:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
            raise ValueError(f"added token {t['content']!r} has a flag that is not supported")
    return {t["content"]: t["id"] for t in added}


def key_of(ranks: dict[bytes, int], added: dict[str, int] | None = None) -> str:
    digest = hashlib.sha256(repr(sorted((added or {}).items())).encode())
    for token, rank in ranks.items():
        digest.update(b"%d %d " % (rank, len(token)) + token)
    return digest.hexdigest()


def encoder(ranks: dict[bytes, int], pattern: str, key: str, added: dict[str, int] | None = None) -> tiktoken.Encoding:
    """One encoder a worker process and vocabulary; ``encode(text, allowed_special="all")`` finds the added tokens, too."""
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return _encoders[key]


def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)
