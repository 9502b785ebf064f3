"""Near-duplicate documents by weighted Jaccard similarity of their five-word shingles.

Each document is a bag of shingles. BagMinHash gives it one register per hash: an element with
weight w owns the Poisson points below w on its own line, drawn interval by interval on a dyadic
grid (0,1], (1,2], (2,4], ..., and each register keeps the earliest point that falls to it. Points
later than a time that fills all registers are never drawn, so a signature costs about as many
points as there are registers, whatever the weights. Two registers agree with a probability of
sum(min)/sum(max) of the weights.

Registers are banded. A bucket of the bands compares its documents with one of them (a star), so
a group of n copies costs n comparisons; the centre is the document that shares most buckets. Of
what still lies in one bucket but in different classes, documents outside the centre's class meet
all others, unless an exact bound from both's comparison with their centre rules the pair out;
large buckets are cut into a grid of cells for this, so no task holds a whole one.
Every comparison that counts is on the bags themselves.

Defined results: words are runs of ASCII letters, digits and other code points above 127, in lower
case; a text of one to four words is one shingle; texts without words are copies only if equal;
a null text is a class of its own; rows with one id are one document; a class is named by its
lowest id, and the classes are those of the links at or above the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.llm.common import batches_of, discard, map_texts, mix64, release, written
from paneltide.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Expected points per register that are drawn at first; registers still empty get more time.
FILL = 9.0
THRESHOLD = 0.8
#: Bits of the filter by which documents are chosen for comparison: 8 MB, a fixed size.
FILTER_BITS = 1 << 26
#: Words of 64 bits that sketch what a document has beyond its bucket's centre.
SKETCH = 16
#: Rows of one side that meet in one cell of a bucket; larger buckets are cut into a grid of cells.
CELL = 1024
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
ODD = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n, modulo 2 to the 64."""
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle, in order of the text."""
    joined = "\x00".join(t.lower().replace("\x00", " ") for t in texts).encode("utf-8", "surrogatepass") + b"\x00"
    raw = np.frombuffer(joined, np.uint8)
    edge = np.diff(np.concatenate([[False], WORD_BYTE[raw]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(raw)
    power, inverse = powers(int(ODD), n), powers(pow(int(ODD), -1, 1 << 64), n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    word = mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    doc = np.searchsorted(np.flatnonzero(raw == 0), start, side="left")
    count = np.bincount(doc, minlength=len(texts))
    hashes = word.copy()
    for k in range(1, SHINGLE):  # a text's last words run on with those that are left of it
        follows = np.zeros(len(word), np.uint64)
        follows[: len(word) - k] = np.where(doc[k:] == doc[: len(doc) - k], word[k:], np.uint64(0))
        hashes = mix64(hashes * ODD + follows)
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    whole = place <= np.maximum(0, count[doc] - SHINGLE)
    return doc[whole], hashes[whole]


def bags(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) and their number of times."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def signatures(n_docs: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Earliest point per document and register; infinite for a document without elements.

    The doubles agree exactly where the points are the same, and only there.
    """
    out = np.full(n_docs * registers, np.inf)
    size = np.bincount(doc, weights=weight, minlength=n_docs)
    until = FILL / np.maximum(size, 1)
    todo = size > 0
    while todo.any():
        mine = todo[doc]
        d0, e0, w0 = doc[mine], element[mine], weight[mine]
        level = 0
        while len(d0):
            low, length = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            has = w0 > low
            d0, e0, w0 = d0[has], e0[has], w0[has]
            d, w = d0, w0
            state = mix64(e0 + np.uint64(level * int(ODD) & 0xFFFFFFFFFFFFFFFF))
            time, rate = np.zeros(len(d)), 1.0 / (registers * length)
            while len(d):
                state = mix64(state + ODD)
                time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
                soon = time <= until[d]
                d, w, state, time = d[soon], w[soon], state[soon], time[soon]
                draw = mix64(state ^ ODD)
                register = ((draw >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
                if level < 2:
                    np.minimum.at(out, d * registers + register, time)
                else:  # where on the interval the point lies, to the unit
                    unit = low + 1 + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(length) >> np.uint64(32)).astype(np.int64)
                    under = unit <= w
                    np.minimum.at(out, (d * registers + register)[under], time[under])
            level += 1
        late = np.isinf(out.reshape(n_docs, registers)).any(axis=1) & todo
        until[late] *= 3
        todo = late
    return out.reshape(n_docs, registers)


def band_values(signature: np.ndarray) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    value = np.zeros(bits.shape[:2], np.uint64)
    for k in range(ROWS):
        value = mix64(value * ODD + bits[:, :, k])
    return value.view(np.int64)


def signed(rows: DataFrame) -> DataFrame:
    """doc_id, digest of the bag, its size, and the values of its bands (none without words)."""

    def kernel(ids, texts):
        n = len(texts)
        doc, hashes = shingles([t or "" for t in texts])
        doc, element, weight = bags(doc, hashes)
        bands = band_values(signatures(n, doc, element, weight))
        size = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
        cut = np.searchsorted(doc, np.arange(n + 1))
        digests = []
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if a < b:
                made = hashlib.blake2b(element[a:b].tobytes() + weight[a:b].tobytes(), digest_size=16)
            else:
                made = hashlib.blake2b(b"text" + texts[i].encode("utf-8", "surrogatepass") if texts[i] is not None else f"row{ids[i]}".encode(), digest_size=16)
            digests.append(made.digest())
        return {"doc_id": ids, "digest": digests, "size": size, "bands": [b if s else [] for b, s in zip(bands, size)]}

    return map_texts(rows, kernel, "doc_id long, digest binary, size long, bands array<long>", step=1 << 19)


def slot_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def flagged(ids: DataFrame) -> np.ndarray:
    """A bit per slot that one of the ids falls to: FILTER_BITS bits, however many ids there are."""
    slot = ids.select((slot_of("doc_id") + 1).alias("slot"))
    rows = slot.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    flags = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        flags[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return flags


def bag_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and its bag as distinct numbers (the same shingle again is another number).

    Rows are chosen by the bits of the wanted ids, so texts are not shuffled; a document that only
    shares a bit with a wanted one gets its bag for nothing, and none is missed.
    """
    flags = rows.sparkSession.sparkContext.broadcast(flagged(wanted))

    def kernel(ids, slots, texts):
        slots = np.array(slots, np.int64)
        keep = np.flatnonzero(flags.value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).tolist()
        doc, element, weight = bags(*shingles([texts[i] or "" for i in keep]))
        nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        numbers = mix64(np.repeat(element, weight) + nth.astype(np.uint64) * ODD).view(np.int64)
        cut = np.cumsum(np.concatenate([[0], np.bincount(doc, weights=weight, minlength=len(keep))])).astype(np.int64)
        return {"doc_id": [ids[i] for i in keep], "bag": [numbers[a:b] for a, b in zip(cut[:-1], cut[1:])]}

    return map_texts(rows.select("doc_id", slot_of("doc_id").alias("slot"), "text"), kernel, "doc_id long, bag array<long>", ["doc_id", "slot", "text"], step=1 << 19)


def alike_in_size(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * threshold


def compared(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b, weight) with both sizes, what they share, and a bit sketch of what a has alone."""
    spark = found.sparkSession
    pairs = written(pairs, "pairs")
    both = pairs.join(found.toDF("a", "bag_a"), "a").join(found.toDF("b", "bag_b"), "b")
    names = ["a", "b", "weight", "bag_a", "bag_b"]

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("shared", "size_a", "size_b")}
            bits = np.zeros((batch.num_rows, SKETCH), np.uint64)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(4))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                alone = x[~np.isin(x, y)].view(np.uint64)
                np.bitwise_or.at(bits[i], (alone >> np.uint64(6)) % np.uint64(SKETCH), np.uint64(1) << (alone & np.uint64(63)))
                for k, v in zip(out, (len(x) - len(alone), len(x), len(y))):
                    out[k].append(v)
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), SKETCH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v, pa.int64()) for v in out.values()), sketch], ["a", "b", "weight", *out, "sketch"])
        release()

    made = both.select(*names).mapInArrow(run, "a long, b long, weight long, shared long, size_a long, size_b long, sketch array<long>")
    with batches_of(spark, 256):  # a row holds two whole bags
        stored = written(made, "compared")
    discard(pairs)
    return stored


def links_of(compared_pairs: DataFrame, threshold: float) -> DataFrame:
    return compared_pairs.where(F.col("shared") >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * threshold).select("a", "b")


def may_reach(threshold: float) -> Column:
    """Whether two documents of one bucket can be similar at all: an exact upper bound.

    Both were compared with the bucket's centre c. With a = what x and c have in common, X what x has beyond c (and so for y), x and y share at most
    min(a, b) within c, and of X and Y no more than their sketches have in common.
    """
    common = sum((F.bit_count(F.col("sketch_a")[i].bitwiseAND(F.col("sketch_b")[i])) for i in range(SKETCH)), F.lit(0))
    hidden = F.least(F.col("alone_a") - F.col("bits_a"), F.col("alone_b") - F.col("bits_b"))
    beyond = F.least(F.col("alone_a"), F.col("alone_b"), common + hidden)
    most = F.least(F.col("size_a") - F.col("alone_a"), F.col("size_b") - F.col("alone_b")) + beyond
    return most >= (F.col("size_a") + F.col("size_b") - most) * threshold


def classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id of every row; the class is named by its lowest id."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(signed(rows), "signed")
    # Copies with one bag are one node. Only ids and digests are grouped, and before the shuffle.
    firsts = written(marked.groupBy("digest").agg(F.min("doc_id").alias("node")), "firsts")
    nodes = written(
        marked.join(firsts.select(F.col("digest"), F.col("node").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("node"), "size", F.posexplode("bands").alias("band", "value")), "bands"
    )
    inside = _open_buckets(nodes, None)
    discard(nodes)
    # Bags are made once, for the documents that share a bucket with another.
    shared = inside.select(F.col("node").alias("doc_id")).distinct()
    found = written(bag_rows(rows, shared).dropDuplicates(["doc_id"]), "bags")
    # The centre of a bucket is the document with most others around it: what copies were made from.
    counts = written(inside.groupBy("band", "value").agg(F.count("*").alias("n")), "counts")
    weights = written(inside.join(counts, ["band", "value"]).groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    weighted = written(inside.join(weights, "node"), "weighted")
    discard(inside, counts, weights)
    centre = F.max_by(F.struct("node", "size", "weight"), F.struct(F.col("weight"), -F.col("node")))
    centres = written(weighted.groupBy("band", "value").agg(centre.alias("centre")), "centres")
    spokes = weighted.join(centres, ["band", "value"]).where(F.col("node") != F.col("centre.node"))
    star = compared(spokes.select(F.col("node").alias("a"), F.col("centre.node").alias("b"), F.col("centre.weight").alias("weight")).distinct(), found)
    links = links_of(star, threshold)

    # What is left in one bucket and different classes: those outside of the centre's class with all.
    labels = connected_components(links)
    inside = _open_buckets(weighted.drop("component"), labels)
    discard(weighted, labels)
    most = written(inside.groupBy("band", "value").agg(
        F.max_by("component", F.struct(F.col("weight"), -F.col("node"))).alias("most"), F.count("*").alias("n")
    ), "most")
    outside = inside.join(most, ["band", "value"]).groupBy("band", "value", "most", "n").agg(F.count_if(F.expr("component <> most")).alias("m"))
    hubs = outside.select("band", "value", "most", F.ceil(F.col("m") / CELL).alias("across"), F.ceil(F.col("n") / CELL).alias("down"))
    hubs = written(hubs.join(centres.select("band", "value", F.col("centre.node").alias("hub")), ["band", "value"]), "hubs")
    beyond = star.select(F.col("a").alias("node"), F.col("b").alias("hub"), (F.col("size_a") - F.col("shared")).alias("alone"), "sketch")
    blank = F.array_repeat(F.lit(0).cast("long"), SKETCH)  # of the centre itself
    apart = inside.join(hubs, ["band", "value"]).join(beyond, ["node", "hub"], "left")
    placed = written(apart.select(
        "band", "value", "most", "across", "down", "node", "size", "component", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("sketch", blank).alias("sketch")
    ).withColumn("bits", F.aggregate("sketch", F.lit(0), lambda n, w: n + F.bit_count(w))), "placed")
    discard(inside, centres, most, hubs)
    # A cell of the grid holds some of the documents outside (by row) and some of all (by column).
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "component", "alone", "sketch", "bits")]
    spot = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    left = placed.where("component <> most").select("band", "value", "most", spot("across").alias("row"), every("down").alias("column"), *side("a"))
    others = placed.select("band", "value", every("across").alias("row"), spot("down").alias("column"), *side("b"))
    rest = left.join(others, ["band", "value", "row", "column"]).where("component_a <> component_b AND (component_b = most OR node_a < node_b)")
    rest = rest.where(alike_in_size(F.col("size_a"), F.col("size_b"), threshold)).where(may_reach(threshold))
    rest = rest.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.lit(0).cast("long").alias("weight")).distinct()
    more = compared(rest, found)
    discard(placed, found)
    labels = connected_components(links.unionByName(links_of(more, threshold)))
    named = written(firsts.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id")), "named")
    discard(star, more, labels, firsts)
    return marked.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")


def _open_buckets(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the buckets that hold more than one class so far, with the class of each row."""
    stored = None
    if labels is None:
        labelled = nodes.withColumn("component", F.col("node"))
    else:
        labelled = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = stored = written(labelled, "labelled")
    mixed = labelled.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = written(mixed.select("band", "value"), "mixed")
    opened = written(labelled.join(mixed, ["band", "value"], "left_semi"), "open")
    discard(stored, mixed)
    return opened


def keep_first(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose id names their class; repeated rows are kept once.

    A row without an id goes by a digest of its text, above any usual id, and is kept where its class has no other.
    """
    digest = F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = df.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), digest))
    named = classes(keyed, threshold, "_key", text_col).where("doc_id = class_id").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(named, "_key", "left_semi").dropDuplicates(["_key"]).select(*df.columns)
