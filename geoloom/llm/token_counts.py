"""Operator 6: exact token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from geoloom.llm.common import map_rows, vocabulary_path
from geoloom.llm.pretokens import SPECIAL, pretokens, read_merges

#: Distinct pieces remembered by a worker, and the longest one remembered.
CACHE_PIECES, CACHE_CHARS = 400_000, 48


class MergeCounter(dict):
    """piece -> number of tokens, computed on the first miss.

    A piece starts as one symbol per byte, in a doubly linked list. A heap holds
    the ranks of adjacent pairs; the lowest rank (leftmost on a tie) merges
    first, and entries that no longer describe a live pair are skipped. The
    count is the initial symbols minus the merges: no identifier is emitted.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        super().__init__()
        self.first, self.rank, self.left, self.right, self.merged, _ = read_merges(path)
        self.limit = limit

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = n
        return n

    def count(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        symbol = [self.first[b] for b in data]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << 20 | symbol[i + 1])
            if r is not None:
                heap.append(r << 40 | i)
        heapify(heap)
        merges = 0
        low = (1 << 40) - 1
        while heap:
            entry = heappop(heap)
            r, i = entry >> 40, entry & low
            j = after[i]
            if symbol[i] != left[r] or j >= n or symbol[j] != right[r]:
                continue
            new = symbol[i] = merged[r]
            symbol[j] = -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                r = rank.get(new << 20 | symbol[k])
                if r is not None:
                    heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbol[h] << 20 | new)
                if r is not None:
                    heappush(heap, r << 40 | h)
        return n - merges

    def tokens(self, text: str) -> int:
        total = -1
        for part in text.split(SPECIAL):
            total += 1 + sum(map(self.__getitem__, pretokens(part)))
        return total


_COUNTERS: dict[str, MergeCounter] = {}


def counter(vocabulary: str) -> MergeCounter:
    """One counter per vocabulary and worker process."""
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = MergeCounter(vocabulary_path(vocabulary))
    return _COUNTERS[vocabulary]


def count_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    A null text counts as empty (0 bytes, 0 tokens, not over). Repeated rows
    give repeated results; an empty table an empty one; other columns are not
    read, whatever their names. The special string of the vocabulary counts as
    one token, as its library has it by default. One narrow pass: no shuffle.
    """

    def fn(ids: list, texts: list) -> dict:
        c = counter(vocabulary)
        texts = [t or "" for t in texts]
        n = [c.tokens(t) for t in texts]
        return {id_col: ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_rows(docs, [id_col, text_col], fn, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
