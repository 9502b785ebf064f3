"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Only a histogram of piece lengths (at most `capacity` rows) is planned on the driver: a bin is
filled greedily with the longest piece that still fits, then its smallest piece is replaced by
the two unpacked ones that fill the widened gap most tightly. The pattern found is used as many
times as the counts allow. Pieces then take their place by their rank among equal lengths, which
Spark computes over salted groups, so a length shared by a third of all rows is spread out.

Defined results: a null text is empty and still ends with the closing id; only documents longer
than the capacity are cut; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paneltide.llm.common import Memo, map_texts, per_partition, written
from paneltide.llm.token_count import byte_letters

#: Outside of these, lower case and composition are left to the library.
PLAIN = re.compile("[^\x00-\x1b\x20-\u024f]")
#: The vocabulary's own pattern: fixed value.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_LETTERS = dict(enumerate(byte_letters()))
#: Rows of one length that are ranked in one group, about.
RANKED_TOGETHER = 20_000


class WordIds:
    """Token ids of whole texts, by remembering the library's ids of each space-separated word.

    The vocabulary drops white space, and its pattern never joins across it, so the ids of a
    text are those of its words in order. A word of plain letters goes to the library's merge model
    piece by piece; other words, and texts with unusual controls, go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.piece = Memo(self._piece, 8 << 20)
        self.word = Memo(self._word, 40 << 20)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._piece(word.lower())
        if "<|" in word or PLAIN.search(word) or not word.isprintable():
            return self._whole(word)
        return b"".join(map(self.piece.__getitem__, PIECE.findall(word.lower())))

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids = self.word.__getitem__
        return [self._whole(t) if (words := self._words(t)) is None else b"".join(map(ids, words)) for t in texts]

    def _words(self, text: str) -> list[str] | None:
        if "<|" in text or PLAIN.search(text):
            return None if re.search("[\x1c-\x1f]", text) else text.split()
        return text.lower().split()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@per_partition
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenised(df: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids)."""

    def kernel(ids, texts):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        closing = np.array([end_id], "<u4").tobytes()
        for doc, made in zip(ids, word_ids(public_tokenizers.path(vocabulary)).encoded([t or "" for t in texts])):
            made += closing
            for k in range(0, len(made), 4 * capacity):
                part = made[k : k + 4 * capacity]
                for name, value in zip(out, (doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None)):
                    out[name].append(value)
        return out

    return map_texts(df, kernel, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def best_pair(have: np.ndarray, count: np.ndarray, gap: int) -> tuple[int, int]:
    """Two lengths in stock with the largest sum up to gap, or (0, 0)."""
    have = have[have < gap]
    if not len(have):
        return 0, 0
    room = np.minimum(have, gap - have)
    at = np.searchsorted(have, room, side="right") - 1
    alone = (at >= 0) & (have[at] == have) & (count[have] < 2)
    at = np.where(alone, at - 1, at)
    total = np.where(at >= 0, have + have[at], 0)
    k = int(np.argmax(total))
    return (int(have[k]), int(have[at[k]])) if total[k] else (0, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, ranks per sequence, first sequence, first offset) of each slot.

    The rows are bounded by the distinct lengths, not by the documents: each use of a pattern
    exhausts a length to below its number in the pattern.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    placed = np.zeros_like(count)
    slots, sequence = [], 0
    while True:
        have = np.flatnonzero(count)
        if not len(have):
            return slots
        left = count.copy()
        used = [int(have[-1])]
        left[used[0]] -= 1
        gap = capacity - used[0]
        while gap:
            stock = have[: np.searchsorted(have, gap, side="right")]
            stock = stock[left[stock] > 0]
            if not len(stock):
                break
            best = int(stock[-1])
            n = min(int(left[best]), gap // best)
            used += [best] * n
            left[best] -= n
            gap -= n * best
        if gap and len(used) > 1:
            smallest = used[-1]
            left[smallest] += 1
            a, b = best_pair(have[left[have] > 0], left, gap + smallest)
            if a + b > smallest:
                used[-1:] = [a, b]
        lengths, each = np.unique(used, return_counts=True)
        times = int((count[lengths] // each).min())
        offset = 0
        for length, n in zip(lengths[::-1].tolist(), each[::-1].tolist()):
            slots.append((length, int(placed[length]), times * n, n, sequence, offset))
            placed[length] += times * n
            count[length] -= times * n
            offset += n * length
        sequence += times


def assign(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table: it is read more than once)."""
    spark = parts.sparkSession
    by_length = parts.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in by_length.collect()}  # at most `capacity` rows
    n = sum(histogram.values())
    slots = spark.createDataFrame(
        plan(histogram, capacity), T.StructType.fromDDL("slot_length long, first_rank long, ranks long, per long, first_sequence long, first_offset long")
    )
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, n // RANKED_TOGETHER))))
    before = (
        salted.groupBy("length", "salt").count()
        .withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    )
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))
    step = F.col("rank") - F.col("first_rank")
    # The slots are bounded by the distinct lengths (see plan), so they may be broadcast.
    placed = ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (step >= 0) & (step < F.col("ranks"))
    )
    return placed.select(
        *parts.columns,
        (F.col("first_sequence") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(step, F.col("per")) * F.col("length")).alias("offset"),
    )


def pack(df: DataFrame, capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return assign(written(tokenised(texts, vocabulary, capacity, end_id), "pieces"), capacity)


def sequences(df: DataFrame, capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the length of each piece in order."""
    texts = df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    placed = assign(written(tokenised(texts, vocabulary, capacity, end_id, with_ids=True), "pieces"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # one sequence: `capacity` ids at most
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths")
    )
