"""Splitting text the way byte-level BPE vocabularies expect it."""

from __future__ import annotations

import json
import re

import regex

# Fixed values of the byte-level vocabularies: split pattern, white space, special string.
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"\t-\r \x85\xa0  -     　"
SPECIAL = "<|endoftext|>"

_FULL = regex.compile(
    _LETTERS.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
    .replace(r"\s+(?!\S)", rf"[{_SPACE}]+(?![^{_SPACE}])")
    .replace(r"|\s+", rf"|[{_SPACE}]+")
)
# The same split by the quicker standard module, right for these characters alone:
# ASCII but for the separators 0x1c-0x1f, and the Latin letters.
_UNSAFE = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ſ’–—“”¿¡«»€]")
_QUICK = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def pretokens(text: str) -> list[str]:
    """The pieces within which byte pairs merge; joined, they are the text."""
    return (_FULL if _UNSAFE.search(text) else _QUICK).findall(text)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_merges(path: str) -> tuple[list[int], dict[int, int], list[int], list[int], list[int], int]:
    """From a byte-level BPE file: the symbol of each byte; the rank of a pair
    (left << 20 | right); the left, right and merged symbol of each rank; the
    number of symbols."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    first = [vocab[c] for c in byte_alphabet()]
    rank: dict[int, int] = {}
    left, right, merged = [], [], []
    for i, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        left.append(vocab[a])
        right.append(vocab[b])
        merged.append(vocab[a + b])
        rank.setdefault(left[-1] << 20 | right[-1], i)
    return first, rank, left, right, merged, len(vocab)
