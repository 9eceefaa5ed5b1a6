"""Reads a public byte-level BPE vocabulary: symbols, merge ranks and special strings.

The path is a parameter. On a worker the parsed form is kept per path for later tasks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    #: bytes of each id
    token_bytes: dict[int, bytes]
    #: id of each single byte
    byte_ids: np.ndarray
    #: (left id, right id) -> (rank, merged id)
    merges: dict[tuple[int, int], tuple[int, int]]
    #: strings matched in raw text before anything else -> id
    special: dict[str, int]
    #: splits ordinary text into pretokens
    pattern: regex.Pattern
    special_pattern: regex.Pattern | None


#: Pretokens of byte-level vocabularies: contractions, then words, numbers and other runs with one leading space, then white space.
#: White space here is Unicode's property, without the ASCII separators 1C to 1F that Python adds.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ids: dict[str, int] = spec["model"]["vocab"]
    token_bytes = {i: bytes(alphabet[c] for c in token) for token, i in ids.items()}
    byte_ids = np.zeros(256, np.int64)
    for char, byte in alphabet.items():
        byte_ids[byte] = ids[char]
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[ids[left], ids[right]] = rank, ids[left + right]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes |= {i: s.encode() for s, i in special.items()}
    longest_first = sorted(special, key=len, reverse=True)
    return Vocabulary(
        token_bytes,
        byte_ids,
        merges,
        special,
        regex.compile(PRETOKENS),
        regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if special else None,
    )


def segments(vocabulary: Vocabulary, text: str) -> list[str]:
    """Ordinary text at even places, special strings at odd ones."""
    if vocabulary.special_pattern is None or not any(s in text for s in vocabulary.special):
        return [text]
    return vocabulary.special_pattern.split(text)
