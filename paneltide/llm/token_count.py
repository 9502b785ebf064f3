"""Exact token counts by byte-pair merging, without building any identifiers.

A pre-token of n bytes starts as n symbols in a linked list. A heap holds the ranks of adjacent
pairs; the lowest rank is popped, leftmost first among equals, and its pair merged while it is
still current. The count is the number of initial symbols less the number of merges.

Defined results: null counts as the empty text, which has no tokens; special strings of the
vocabulary are one token each, as in the library's default; repeated rows each give their result.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from paneltide.llm.common import Memo, map_texts, per_partition

#: Code points with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space decides where a piece may end, so it can be cut first, and coarse chunks remembered.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> list[str]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(256 + extra), extra + 1
    return [letters[b] for b in range(256)]


def is_word(chunk: str) -> bool:
    """Whether the chunk is ASCII letters behind at most one space: always one piece."""
    return chunk.isascii() and chunk.removeprefix(" ").isalpha()


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        number = {letter: b for b, letter in enumerate(byte_letters())}
        #: Two symbols' numbers in one -> rank and number of the merged symbol in one.
        self.merge: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[number[a] << 20 | number[b]] = r << 20 | number.setdefault(a + b, len(number))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # Half a million chunks and a sixth of other pieces, about: the distinct ones of a usual partition.
        self.piece = Memo(self._merged, 32 << 20)
        self.chunk = Memo(self._chunk, 112 << 20)

    def _merged(self, piece: str) -> int:
        symbols = list(piece.encode("utf-8", "surrogatepass"))
        n = len(symbols)
        if n == 1:
            return 1
        merge = self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        best = [-1] * n  # the merge of a symbol with its right neighbour, if there is one
        heap = []
        for i in range(n - 1):
            m = merge(symbols[i] << 20 | symbols[i + 1])
            if m is not None:
                best[i] = m
                heap.append(m >> 20 << 32 | i)
        heapify(heap)
        left = n
        while heap:
            lowest = heappop(heap)
            i = lowest & 0xFFFFFFFF
            m = best[i]
            if m < 0 or m >> 20 != lowest >> 32:
                continue  # one side was merged meanwhile
            j = after[i]
            k = after[i] = after[j]
            best[j] = best[i] = -1
            symbol = symbols[i] = m & 0xFFFFF
            left -= 1
            if k < n:
                before[k] = i
                m = merge(symbol << 20 | symbols[k])
                if m is not None:
                    best[i] = m
                    heappush(heap, m >> 20 << 32 | i)
            h = before[i]
            if h >= 0:
                m = merge(symbols[h] << 20 | symbol)
                if m is None:
                    best[h] = -1
                else:
                    best[h] = m
                    heappush(heap, m >> 20 << 32 | h)
        return left

    def _chunk(self, chunk: str) -> int:
        if is_word(chunk):
            return self._merged(chunk)
        # A word is a piece by itself, so it shares its entry with chunks that are only this word.
        return sum((self.chunk if is_word(p) else self.piece)[p] for p in PIECE.findall(chunk))

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.chunk.__getitem__, CHUNK.findall(p))) for p in parts)
        return sum(map(self.chunk.__getitem__, CHUNK.findall(text)))


@per_partition
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count is over the limit, for every row."""

    def kernel(ids, texts):
        count = counter(public_tokenizers.path(vocabulary)).count
        texts = [t or "" for t in texts]
        tokens = [count(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_texts(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
