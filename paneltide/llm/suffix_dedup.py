"""Removes every byte of a text that lies in a 200-byte string which starts anywhere else as well.

The suffixes are sorted by a distributed difference-cover algorithm, over a shorter string than the
bytes. Of the 80 blocks of 121 bytes in any 200 bytes, the one with the lowest hash (all of them on
a tie) is an anchor, whatever stands around the 200 bytes; so two equal strings hold equal anchors
at equal places. Only strings around an anchor that is there twice can be repeated. Maximal
stretches of such starts ("runs", kept once each, with how often they occur) are the strings to
sort; their symbols are the anchors, each with the distance to the next.

Sorting (ranks): the triples of symbols at places 1 and 2 modulo 3 are sorted and named by how many
come before them; the strings of names are ranked by recursion; the remaining suffixes, and all
others again, are merged by two keys of fixed size, (symbol, rank of the next) against places 1 and
(symbol, symbol, rank of the one after) against places 2. Every sort is a range partitioning in which
equal keys may be split over tasks; a task counts on its own, and the driver adds up one row per task.
The recursion ends when names cover as many symbols as nine in ten of the comparisons below read.

Then adjacent prefixes are compared. Where the anchors around a start are the same as those of a
neighbour in suffix order, its 200 bytes are repeated: the blocks overlap and cover them. What the
anchors leave open, some 80 starts at the ends of each run, is compared by 128-bit digests of
the 200 bytes themselves, among each other and with one representative of each settled stretch (sent
only where a filter of fixed size has its digest among the open ones). A cut of a run, of the sorted
order or of the recursion only moves starts into that second comparison, so long texts are cut into
chunks, and no result depends on how tasks are cut.

Defined results: a null text is empty; texts under 200 bytes lose nothing; rows with one id, or none,
are texts of their own; equal texts of at least 200 bytes are removed whole, all of them; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.common import batches_of, discard, map_texts, mix64, pieces, release, written

LENGTH = 200
#: Blocks that compete for an anchor, and bytes of a block: together they span LENGTH.
WINDOW = 80
BLOCK = LENGTH - WINDOW + 1
#: Starts of a text that are worked on at once; a longer text is cut, with LENGTH - 1 bytes of overlap.
CHUNK = 1 << 20
#: Bytes whose hashes are made together: what is worked on at once fits a processor's cache.
GROUP = 1 << 18
#: Bits of the filters of anchors and digests; their 32 MB do not grow. A full filter costs time, not results.
FILTER_BITS = 1 << 28
#: The recursion covers the symbols that this share of the comparisons reads.
COVERED = 0.9
GAP_BITS = 7
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NUMBERS = "string long, pos int, kind int, own long, a long, b long, c long"


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64."""
    return _powers(base, 1 << max(16, int(n).bit_length()))[: n + 1]


class Rolling:
    """Hashes of any stretch of the bytes, from prefix sums of two polynomials modulo 2**64."""

    def __init__(self, raw: np.ndarray, which: int):
        value = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000 * which + 77))
        n, base = len(raw), BASES[which]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(value[raw] * powers(base, n)[:n], out=self.total[1:])
        self.back = powers(pow(base, -1, 1 << 64), n)

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix64((self.total[start + length] - self.total[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.total) - length
        return mix64((self.total[length:] - self.total[:n]) * self.back[:n])


def slide(x: np.ndarray, width: int, extreme: np.ufunc, backwards: bool) -> np.ndarray:
    """The extreme of `width` values from each place on, or up to it."""
    x, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if backwards:
            x[step:] = extreme(x[step:], x[:-step])
        else:
            x[:-step] = extreme(x[:-step], x[step:])
        have += step
    return x


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start, the lowest block hash of its 200 bytes (0: they cross an end); the places and hashes of anchors.

    ends: for each byte, where its text ends.
    """
    low, hashes = lowest(raw, ends)
    at = np.flatnonzero(slide(low, WINDOW, np.maximum, backwards=True) == hashes)
    return low, at, hashes[at]


def lowest(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start, the lowest block hash of its 200 bytes; the hash of each block (above all others where none fits)."""
    n = len(raw)
    hashes = np.full(n, np.uint64(2**64 - 1))
    if n < LENGTH:
        return np.zeros(n, np.uint64), hashes
    hashes[: n - BLOCK + 1] = np.maximum(Rolling(raw, 0).all(BLOCK), np.uint64(1))
    low = slide(hashes, WINDOW, np.minimum, backwards=False)
    low[np.arange(n) + LENGTH > ends] = 0
    return low, hashes


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each text begins, and the end of the text of each byte."""
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), stops - sizes, np.repeat(stops, sizes)


def chunks(texts: list[bytes | None], chunk: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) of stretches of `chunk` starts, in groups of about GROUP bytes; texts too short are left out."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text or b"") - LENGTH + 1), chunk):
            group.append((row, at, text[at : at + chunk + LENGTH - 1]))
            size += len(group[-1][2])
            if size >= GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


def repeated_anchors(texts: DataFrame, chunk: int, filter_bits: int) -> np.ndarray:
    """A bit for each slot that a repeated anchor falls to."""

    def kernel(texts):
        found = []
        for group in chunks(texts, chunk):
            raw, _, ends = joined([t for _, _, t in group])
            found.append(anchors(raw, ends)[2])
        value, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return {"anchor": value.view(np.int64), "twice": n > 1}

    each = map_texts(texts, kernel, "anchor long, twice boolean", ["text"])
    several = each.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("twice OR n > 1")
    return bits_of(several, ["anchor"], filter_bits)


def bits_of(hashes: DataFrame, columns: list[str], filter_bits: int) -> np.ndarray:
    """A bit for each slot (a power of two of them) that a hash of one of the columns falls to, on the driver."""
    slot = lambda c: F.col(c).bitwiseAND(F.lit(filter_bits - 1)) + 1
    slots = hashes.select(F.explode(F.array(*map(slot, columns))).alias("slot")) if len(columns) > 1 else hashes.select(slot(columns[0]).alias("slot"))
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = np.zeros(filter_bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal stretches of True begin and end."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def runs(texts: DataFrame, bits: np.ndarray, chunk: int) -> DataFrame:
    """key, first start, digest and bytes of each maximal stretch of starts that may be repeated."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def kernel(keys, texts):
        out = {"key": [], "first": [], "digest": [], "bytes": []}
        for group in chunks(texts, chunk):
            raw, begins, ends = joined([t for _, _, t in group])
            low, _ = lowest(raw, ends)
            start, stop = stretches((low > 0) & marked(sent.value, low))
            for a, b, g in zip(start.tolist(), stop.tolist(), (np.searchsorted(begins, start, side="right") - 1).tolist()):
                row, offset, text = group[g]
                a, b = a - int(begins[g]), b - int(begins[g]) + LENGTH - 1
                out["key"].append(keys[row])
                out["first"].append(offset + a)
                out["bytes"].append(text[a:b])
                out["digest"].append(hashlib.blake2b(text[a:b], digest_size=16).digest())
        return out

    return map_texts(texts, kernel, "key binary, first long, digest binary, bytes binary", ["key", "text"])


def anchored(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of runs laid end to end: bytes, begins, lowest blocks, places and hashes of anchors, first anchor of each run (and the end)."""
    raw, begins, ends = joined(parts)
    low, at, own = anchors(raw, ends)
    return raw, begins, low, at, own, np.append(np.searchsorted(at, begins), len(at))


def symbols(stored: DataFrame) -> DataFrame:
    """string, its symbols, and how many of them each place's comparisons read."""

    def kernel(batch):
        parts = batch.column(1).to_pylist()
        _, _, _, at, own, cut = anchored(parts)
        run = np.repeat(np.arange(len(parts)), np.diff(cut))
        after = np.append(at[1:], 0)
        final = np.append(run[1:] != run[:-1], True)[: len(at)]
        gap = np.where(final, 0, after[: len(at)] - at).astype(np.uint64)
        symbol = np.maximum((own >> np.uint64(GAP_BITS + 1)) << np.uint64(GAP_BITS) | gap, np.uint64(1)).view(np.int64)
        last = np.searchsorted(at, np.where(final, at, after[: len(at)] - 1) + WINDOW - 1)
        need = np.minimum(last + 1, cut[run + 1]) - np.arange(len(at))
        return {"string": batch.column(0), "symbols": lists(symbol, cut), "need": lists(need, cut)}

    return exploded(stored.select("string", "bytes"), kernel, "string long, symbols array<long>, need array<long>")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the offsets of each list in them."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def exploded(df: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(record batch) -> lists or arrays by name; it gets slices of about GROUP bytes of the last column."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[f.strip().split(" ")[1]] for f in schema.split(",")]

    def slices(batch):
        last = batch.column(batch.num_columns - 1)
        if pa.types.is_binary(last.type):
            yield from pieces(batch, batch.num_columns - 1, GROUP)
            return
        ends = (last.offsets.to_numpy()[1:] - last.offsets[0].as_py()) // (GROUP // 8)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start], side="right")))
            yield batch.slice(start, stop - start)
            start = stop

    def run(batches):
        try:
            for batch in batches:
                for part in slices(batch) if batch.num_rows else ():
                    made = kernel(part)
                    arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((made[n], t) for n, t in zip(names, types))]
                    yield pa.RecordBatch.from_arrays(arrays, names)
        finally:
            release()

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    """values[cuts[i]:cuts[i + 1]] for each i."""
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))


def following(values: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """The value `step` places on in the same list (stop: where that ends), or 0 behind its end."""
    at = np.arange(len(values)) + step
    return np.where(at < stop, values[np.minimum(at, max(len(values) - 1, 0))], 0) if len(values) else values


def triples(batch: pa.RecordBatch) -> dict:
    """The sample: triples of symbols at places 1 and 2 modulo 3."""
    values, cut = flat(batch.column(1))
    size = np.diff(cut)
    stop, place = np.repeat(cut[1:], size), np.arange(len(values)) - np.repeat(cut[:-1], size)
    keep = place % 3 != 0
    zero = np.zeros(int(keep.sum()), np.int64)
    return {
        "string": np.repeat(batch.column(0).to_numpy(), size)[keep], "pos": place[keep].astype(np.int32), "kind": zero.astype(np.int32), "own": zero,
        "a": values[keep], "b": following(values, stop, 1)[keep], "c": following(values, stop, 2)[keep],
    }


def merge_keys(batch: pa.RecordBatch) -> dict:
    """Rows of the two merges. Kinds: 0, 1 are places 0 and 1 of the first; 2, 3 are places 0 and 2 of the second.

    Columns: string, symbols, ranks of its sample in order of place (null where there is none).
    """
    values, cut = flat(batch.column(1))
    size = np.diff(cut)
    stop, place = np.repeat(cut[1:], size), np.arange(len(values)) - np.repeat(cut[:-1], size)
    rank = np.zeros(len(values), np.int64)
    rank[place % 3 != 0] = batch.column(2).flatten().to_numpy(zero_copy_only=False) + 1  # 0 stands behind the end
    next1, next2, symbol1 = following(rank, stop, 1), following(rank, stop, 2), following(values, stop, 1)
    string = np.repeat(batch.column(0).to_numpy(), size)
    out = {k: [] for k in ("string", "pos", "kind", "own", "a", "b", "c")}
    for kind, keep in enumerate((place % 3 == 0, place % 3 == 1, place % 3 == 0, place % 3 == 2)):
        one = kind < 2
        columns = {
            "string": string, "pos": place, "kind": np.full(len(values), kind), "own": np.maximum(rank - 1, 0), "a": values,
            "b": next1 if one else symbol1, "c": np.zeros_like(values) if one else next2,
        }
        for name, column in columns.items():
            out[name].append(column[keep])
    made = {k: np.concatenate(v) for k, v in out.items()}
    return made | {"pos": made["pos"].astype(np.int32), "kind": made["kind"].astype(np.int32)}


#: What a row of each kind adds up of the rows before it, by kind.
NAMING = np.array([[1]], np.int64)
MERGING = np.array([[1, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]], np.int64)


def counted(rows: DataFrame, adds: np.ndarray, tag: str) -> DataFrame:
    """string and one number per place: for each row, how many with a lower key are before it, of the kinds that it adds up.

    The key is (kind // 2, a, b, c). Rows are dealt by ranges of the key, with their place behind it, so that one frequent
    key goes to several tasks. A task counts from 0 and says in an extra row what it has seen; what it must add follows
    from the tasks before it.
    """
    kinds = len(adds)

    def count(batches):
        seen, start = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
        first = last = None
        part = TaskContext.get().partitionId()
        names = ["string", "pos", "kind", "value", "begin", "part", "summary"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            string, pos, kind, own, *abc = (c.to_numpy() for c in batch.columns)
            key = np.stack([kind // 2, *abc], axis=1)
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            if last is not None:
                new[0] = bool((key[0] != last).any())
            one = np.zeros((n + 1, kinds), np.int64)
            one[np.arange(n) + 1, kind] = 1
            before = np.cumsum(one, axis=0) + seen  # before[i]: rows of each kind before row i
            group = np.cumsum(new)
            starts = np.concatenate([start[None, :], before[:-1][new]])
            lower = starts[group]
            first = key[0] if first is None else first
            begin = (key == first).all(axis=1)
            seen, start, last = before[-1], starts[-1], key[-1]
            value = (lower * adds[kind]).sum(axis=1) + own
            columns = [string, pos, kind, value, begin, np.full(n, part, np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.nulls(n, types[-1])], names)
        if last is not None:
            said = [*first, *last, *seen, *start]
            row = [None, None, None, None, None, part, [int(x) for x in said]]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names)

    order = [F.expr("kind div 2"), "a", "b", "c"]
    sorted_rows = rows.repartitionByRange(*order, "string", "pos").sortWithinPartitions(*order)
    schema = "string long, pos int, kind int, value long, begin boolean, part int, summary array<long>"
    stored = written(sorted_rows.mapInArrow(count, schema), tag, "zstd")
    base: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per task: what rows add, and what those of its first key add
    seen, start, last = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64), None
    for r in stored.where("summary IS NOT NULL").select("part", "summary").orderBy("part").collect():  # one per task
        said = np.array(r["summary"], np.int64)
        first, final, number, local = said[:4], said[4:8], said[8 : 8 + kinds], said[8 + kinds :]
        opening = start if last is not None and (first == last).all() else seen
        base[r["part"]] = (adds @ seen, adds @ opening)
        start = opening if (first == final).all() else seen + local
        seen, last = seen + number, final
    plain = np.zeros((max(base, default=0) + 1, kinds), np.int64)
    at_begin = plain.copy()
    for part, (x, y) in base.items():
        plain[part], at_begin[part] = x, y

    def add(batch: pa.RecordBatch) -> np.ndarray:
        kind, value, begin, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
        return value + np.where(begin, at_begin[part, kind], plain[part, kind])

    made = written(gathered(stored.where("summary IS NULL").drop("summary"), add), tag + "-strings", "zstd")
    discard(stored)
    return made


def gathered(rows: DataFrame, number) -> DataFrame:
    """string and its numbers in order of pos, added up where a pos is there twice. A string is a chunk of a text at most."""

    def run(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def cut(string, pos, value):
            new = np.ones(len(string), bool)
            new[1:] = (string[1:] != string[:-1]) | (pos[1:] != pos[:-1])
            at = np.flatnonzero(new)
            string, total = string[at], np.add.reduceat(value, at) if len(at) else value
            ends = np.flatnonzero(np.append(string[1:] != string[:-1], True))[: len(string)]
            offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total))
            return pa.RecordBatch.from_arrays([pa.array(string[ends]), numbers], ["string", "numbers"])

        for batch in batches:
            if batch.num_rows:
                mine = [batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), number(batch)]
                held = [np.concatenate([a, b]) for a, b in zip(held, mine)]
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last string may go on
                if whole:
                    yield cut(*(x[:whole] for x in held))
                    held = [x[whole:] for x in held]
        if len(held[0]):
            yield cut(*held)

    return rows.repartition("string").sortWithinPartitions("string", "pos").mapInArrow(run, "string long, numbers array<long>")


def ranks(strings: DataFrame, need: int) -> DataFrame:
    """string and the rank of each of its suffixes among all of them, by their first `need` symbols at least.

    strings: string and symbols, stored. Equal suffixes have equal ranks; a rank says how many are lower.
    """
    named = counted(exploded(strings.select("string", "symbols"), triples, NUMBERS), NAMING, "names")
    if need > 3:  # names of three symbols each: two strings of every one, ranked by recursion
        every = lambda k: F.transform(F.sequence(F.lit(k), F.size("numbers") - 1, F.lit(2)), lambda i: F.col("numbers")[i] + 1)
        one = named.select((F.col("string") * 2).alias("string"), every(0).alias("symbols"))
        two = named.where("size(numbers) > 1").select((F.col("string") * 2 + 1).alias("string"), every(1).alias("symbols"))
        deeper = written(one.unionByName(two), "deeper", "zstd")
        discard(named)
        found = ranks(deeper, -(-need // 3))
        discard(deeper)
        sides = found.select(F.shiftright("string", 1).alias("string"), F.struct(F.col("string") % 2, "numbers").alias("side"))
        both = sides.groupBy("string").agg(F.array_sort(F.collect_list("side")).alias("sides"))  # two of them
        pairs = F.zip_with(F.col("sides")[0]["numbers"], F.coalesce(F.get("sides", F.lit(1))["numbers"], F.array().cast("array<long>")), lambda a, b: F.array(a, b))
        named = both.select("string", F.filter(F.flatten(pairs), lambda x: x.isNotNull()).alias("numbers"))
    else:
        found = None
    with_ranks = strings.select("string", "symbols").join(named, "string", "left").select(
        "string", "symbols", F.coalesce("numbers", F.array().cast("array<long>")).alias("numbers")
    )
    made = counted(exploded(with_ranks, merge_keys, NUMBERS), MERGING, "ranks")
    discard(found if found is not None else named)
    return made


def lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, twice the number of equal leading symbols, and one more if the next has the same block."""
    same = a == b
    whole = np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))
    at = np.minimum(whole, a.shape[1] - 1)[:, None]
    block = (np.take_along_axis(a, at, 1) >> GAP_BITS == np.take_along_axis(b, at, 1) >> GAP_BITS)[:, 0] & (whole < a.shape[1])
    return 2 * whole + block


def neighbours(strings: DataFrame, ranked: DataFrame) -> DataFrame:
    """string and per place 4096 * (what it shares with the suffix before it) + the most it shares with either neighbour."""

    def prefixes(batch):
        values, cut = flat(batch.column(1))
        need, _ = flat(batch.column(2))
        rank, _ = flat(batch.column(3))
        size, ends = np.diff(cut), np.cumsum(need)
        place = np.arange(len(values)) - np.repeat(cut[:-1], size)
        return {
            "rank": rank, "string": np.repeat(batch.column(0).to_numpy(), size), "pos": place.astype(np.int32),
            "prefix": lists(values[np.repeat(np.arange(len(values)) - ends + need, need) + np.arange(int(need.sum()))], np.append(0, ends)),
        }

    rows = exploded(strings.join(ranked, "string").select("string", "symbols", "need", "numbers"), prefixes, "rank long, string long, pos int, prefix array<long>")

    def compare(batches):
        held = None  # the last row so far: string, pos, prefix, what it shares with the row before

        def out(string, pos, before, after):
            value = before * 4096 + np.maximum(before, after)
            return pa.RecordBatch.from_arrays([pa.array(string), pa.array(pos, pa.int32()), pa.array(value)], ["string", "pos", "value"])

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                values, cut = flat(part.column(3))
                size = np.diff(cut)
                string, pos, before0 = part.column(1).to_numpy(), part.column(2).to_numpy(), 0
                if held is not None:
                    string, pos, before0 = np.append(held[0], string), np.append(held[1], pos), held[3]
                    values, size = np.concatenate([held[2], values]), np.append(len(held[2]), size)
                # What fills up differs from one row to the next, also without its low bits.
                table = np.repeat((-(np.arange(len(size)) % 2 + 1) << GAP_BITS)[:, None], int(size.max()), axis=1)
                table[np.arange(table.shape[1]) < size[:, None]] = values
                shared = lcp(table[1:], table[:-1])
                before = np.append(before0, shared)
                if len(size) > 1:
                    yield out(string[:-1], pos[:-1], before[:-1], shared)
                held = (string[-1], pos[-1], values[len(values) - size[-1] :].copy(), int(before[-1]))
        if held is not None:
            yield out(np.array([held[0]]), np.array([held[1]]), np.array([held[3]]), np.array([0]))

    ordered = rows.repartitionByRange("rank", "string", "pos").sortWithinPartitions("rank")
    return gathered(ordered.mapInArrow(compare, "string long, pos int, value long"), lambda batch: batch.column(2).to_numpy())


class Settled:
    """Of runs laid end to end: which starts are known to be repeated, and which of them stand for others."""

    def __init__(self, times: pa.Array, shares: pa.ListArray, parts: pa.Array):
        self.raw, self.begins, low, at, _, cut = anchored(parts.to_pylist())
        self.starts = np.flatnonzero(low)
        self.run = np.searchsorted(self.begins, self.starts, side="right") - 1
        share, _ = flat(shares)
        here = np.searchsorted(at, self.starts, side="right") - 1
        beyond = np.searchsorted(at, self.starts + WINDOW - 1)
        inner = (here >= cut[self.run]) & (beyond < cut[self.run + 1])
        asked = 2 * (beyond - here) + 1
        mine = share[np.maximum(here, 0)] if len(share) else np.zeros(len(here), np.int64)
        copied = times.to_numpy()[self.run] > 1
        self.known = copied | inner & (mine % 4096 >= asked)
        self.stands = self.known & ~(inner & (mine // 4096 >= asked))

    def digests(self, chosen: np.ndarray, half: int) -> np.ndarray:
        return Rolling(self.raw, half).at(self.starts[chosen], LENGTH).view(np.int64)


def open_starts(judged: DataFrame) -> DataFrame:
    """Per string: known starts as stretches, and the others with both halves of a digest."""

    def kernel(batch):
        s = Settled(*batch.columns[1:])
        known = np.zeros(len(s.raw), bool)
        known[s.starts[s.known]] = True
        start, stop = stretches(known)
        rest = np.flatnonzero(~s.known)
        a = np.searchsorted(start, np.append(s.begins, len(s.raw)))
        begin = np.repeat(s.begins, np.diff(a))  # of the run of each stretch
        b = np.searchsorted(s.run[rest], np.arange(batch.num_rows + 1))
        return {
            "string": batch.column(0), "known_from": lists(start - begin, a), "known_to": lists(stop - begin, a),
            "place": lists(s.starts[rest] - s.begins[s.run[rest]], b), "one": lists(s.digests(rest, 0), b), "two": lists(s.digests(rest, 1), b),
        }

    kinds = ", ".join(f"{c} array<long>" for c in ("known_from", "known_to", "place", "one", "two"))
    return exploded(judged.select("string", "times", "shares", "bytes"), kernel, f"string long, {kinds}")


def stand_ins(judged: DataFrame, bits: np.ndarray) -> DataFrame:
    """Digests of the starts that stand for all repeated ones, where an open start may have the same."""
    sent = judged.sparkSession.sparkContext.broadcast(bits)

    def kernel(batch):
        s = Settled(*batch.columns)
        chosen = np.flatnonzero(s.stands)
        one = s.digests(chosen, 0)
        asked = marked(sent.value, one.view(np.uint64))
        chosen, one = chosen[asked], one[asked]
        two = s.digests(chosen, 1)
        asked = marked(sent.value, two.view(np.uint64))
        return {"one": one[asked], "two": two[asked]}

    return exploded(judged.select("times", "shares", "bytes"), kernel, "one long, two long")


def asked_again(opened: DataFrame, bits: np.ndarray) -> DataFrame:
    """The open starts (string, place, one, two) whose digest may be among the repeated ones."""
    sent = opened.sparkSession.sparkContext.broadcast(bits)

    def kernel(batch):
        place, cut = flat(batch.column(1))
        (one, _), (two, _) = flat(batch.column(2)), flat(batch.column(3))
        keep = marked(sent.value, one.view(np.uint64)) & marked(sent.value, two.view(np.uint64))
        return {"string": np.repeat(batch.column(0).to_numpy(), np.diff(cut))[keep], "place": place[keep], "one": one[keep], "two": two[keep]}

    return exploded(opened.select("string", "place", "one", "two"), kernel, "string long, place long, one long, two long")


def covered(texts: DataFrame, chunk: int, filter_bits: int) -> DataFrame:
    """key, and per run of the text: where it starts, and its removed stretches (relative to that)."""
    with batches_of(texts.sparkSession, 2000):  # whole texts
        stored = written(runs(texts, repeated_anchors(texts, chunk, filter_bits), chunk), "runs", "zstd")
    kept = written(
        stored.groupBy("digest").agg(F.any_value("bytes").alias("bytes"), F.count("*").alias("times"))
        .withColumn("string", F.monotonically_increasing_id()), "distinct-runs", "zstd",
    )
    places = written(stored.select("key", "first", "digest").distinct(), "places")
    discard(stored)
    strings = written(symbols(kept), "symbols", "zstd")
    need = strings.select(F.explode("need").alias("n")).agg(F.percentile_approx("n", F.lit(COVERED), F.lit(100))).first()[0] or 1
    ranked = ranks(strings, need)
    shares = neighbours(strings, ranked)
    judged = written(
        kept.join(shares.withColumnRenamed("numbers", "shares"), "string").select("string", "digest", "times", "shares", "bytes"), "judged", "zstd"
    )
    discard(kept, strings, ranked)
    opened = written(open_starts(judged), "open")
    each = opened.select("string", F.explode(F.arrays_zip("place", "one", "two")).alias("o")).select("string", "o.*")
    others = stand_ins(judged, bits_of(each, ["one", "two"], filter_bits))
    twice = each.select("one", "two").unionByName(others).groupBy("one", "two").count().where("count > 1")
    twice = written(twice.select("one", "two"), "twice")
    # Most open starts are not repeated: a filter keeps them from being dealt out once more.
    again = asked_again(opened, bits_of(twice, ["one", "two"], filter_bits))
    late = again.join(twice, ["one", "two"], "left_semi").groupBy("string").agg(F.collect_list("place").alias("late"))  # places in one run

    def spans(batch):
        out = {"digest": [], "span_from": [], "span_to": []}
        for row in batch.to_pylist():
            begin = np.array([*row["known_from"], *(row["late"] or [])], np.int64)
            end = np.array([*row["known_to"], *(p + 1 for p in row["late"] or [])], np.int64) + LENGTH - 1
            begin, end = merged(begin, end)
            if len(begin):
                for name, value in zip(out, (row["digest"], begin, end)):
                    out[name].append(value)
        return out

    found = judged.select("string", "digest").join(opened.select("string", "known_from", "known_to"), "string").join(late, "string", "left")
    removed = written(exploded(found, spans, "digest binary, span_from array<long>, span_to array<long>"), "spans")
    discard(judged, opened, twice)
    return places.join(removed, "digest").groupBy("key").agg(F.collect_list(F.struct("first", "span_from", "span_to")).alias("runs"))  # of one text


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that overlap or touch as one, in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(end)) - 1] if len(at) else end


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, chunk: int = CHUNK, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept: the bytes that are left (binary: a cut may halve a character)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), text.cast("binary").alias("text"))
    removed = covered(texts, chunk, filter_bits)

    def kernel(ids, runs, texts):
        out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for runs_of, text in zip(runs, texts):
            spans = [(r["first"] + a, r["first"] + b) for r in runs_of or () for a, b in zip(r["span_from"], r["span_to"])]
            begin, end = merged(*np.array(spans, np.int64).reshape(-1, 2).T)
            cuts = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(text)]
            left = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            made = (len(text), len(text) - len(left), len(begin), hashlib.sha256(left).hexdigest(), left if with_text else None)
            for name, value in zip(list(out)[1:], made):
                out[name].append(value)
        return out

    both = texts.join(removed.hint("shuffle_hash"), "key", "left")
    return map_texts(both, kernel, RESULT + ", kept binary", ["doc_id", "runs", "text"])


def dedup(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text."""
    return kept_texts(df, with_text=False).drop("kept")


#: The same in DuckDB, from every 200-byte string of every text (ids must be unique).
SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, s, substring(h, 2 * s + 1, 400) AS w
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS s FROM docs)
), twice AS (SELECT w FROM starts GROUP BY w HAVING count(*) > 1),
hits AS (SELECT doc_id, s FROM starts WHERE w IN (FROM twice)),
marked AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200, true) AS fresh FROM hits
), numbered AS (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 200 AS b FROM numbered GROUP BY ALL),
kept AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, coalesce(max(b), 0), length(h) // 2 FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id, h
), texts AS (
  SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS left_over FROM kept JOIN docs USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(left_over)) AS kept_sha256
FROM docs JOIN texts USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
