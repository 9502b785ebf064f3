"""Winnowing fingerprints, in built-in functions only.

Words (runs of letters and digits, folded to lower case) are hashed; hashes of `K` words in a row
are built by doubling (one of two words, one of four, and so on), so each is a rolling hash of its
k-gram; of every `WINDOW` such hashes in a row the smallest is kept, the rightmost among equals,
with its position. Two texts that share a run of K + WINDOW - 1 words share a fingerprint entry.

Hash and position sit in one long, the hash in the upper bits and the position counted down in
the lower ones: the smallest long is the smallest hash, and the rightmost of equal ones.

Defined results: null counts as the empty text, whose fingerprint is empty; a text with fewer than
K words has one gram of all of them; two empty fingerprints are alike with 1, an empty and another
with 0; equal texts have equal fingerprints; repeated rows are neighbours in the order (id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

K, WINDOW = 5, 8
#: Bits of a position; the hash has the other 33 of 63. A string holds fewer words than this.
POSITION_BITS = 30
POSITIONS = (1 << POSITION_BITS) - 1
#: Rows of one bucket of neighbours, about, and buckets that are numbered together.
BUCKET_ROWS, NUMBERED_TOGETHER = 200, 5000
#: The first rows of so many buckets (16 bytes each) are broadcast at most; beyond, they are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Stretches of ids, each with about as many rows, within which ids are spread evenly enough.
STRETCHES = 64


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), "")


def paired(a: Column, step: int, join) -> Column:
    """join(a[i], a[i + step]) for all i that have both."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), join)


def grams(hashes: Column) -> Column:
    """Hashes of five in a row: of two, of two such, and one more."""
    two = lambda a: paired(a, 1, lambda x, y: F.xxhash64(x, y))
    four = lambda a: paired(a, 2, lambda x, y: F.xxhash64(x, y))

    def five(a: Column, h: Column) -> Column:
        n = F.greatest(F.size(a) - (K - 1), F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(h, F.lit(K), n), lambda x, y: F.xxhash64(x, y))

    return F.when(F.size(hashes) >= K, let(two(hashes), lambda b: let(four(b), lambda a: five(a, hashes)))).when(
        F.size(hashes) > 0, F.array(F.xxhash64(hashes))
    ).otherwise(F.array().cast("array<long>"))


def minima(packed: Column) -> Column:
    """Smallest of each window of eight, by halves of it; of all when there are fewer."""
    low = lambda step: lambda a: paired(a, step, lambda x, y: F.least(x, y))
    of_eight = let(low(1)(packed), lambda a: let(low(2)(a), lambda b: low(4)(b)))
    return F.when(F.size(packed) >= WINDOW, of_eight).when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(packed)


def entries(text: Column) -> Column:
    """The fingerprint of a text: distinct (hash, position) longs in order of position."""

    def packed(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 31), POSITION_BITS).bitwiseOR(F.lit(POSITIONS) - i))

    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(grams(h), lambda g: let(packed(g), lambda p: F.array_distinct(minima(p)))))


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry, POSITION_BITS)


def position_of(entry: Column) -> Column:
    return F.lit(POSITIONS) - entry.bitwiseAND(F.lit(POSITIONS))


def hash_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, hash_of))


def written_out(fingerprint: Column) -> Column:
    """hash@position, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda e: F.concat(F.hex(hash_of(e)), F.lit("@"), position_of(e).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two hash sets."""
    shared = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - shared
    return F.when(all_ == 0, F.lit(1.0)).otherwise(shared / all_)


def buckets(rows: DataFrame) -> tuple[Column, int]:
    """A bucket number that grows with doc_id, and the last bucket in use.

    Ids fall into stretches of about equally many rows, and evenly into buckets within a stretch.
    What the driver sees is the bounds of the stretches.
    """
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    n, low, high, cuts = rows.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", shares, 10_000)).first()
    if not n:
        return F.lit(0).cast("long"), 0
    bounds = sorted({low, *cuts})
    per = max(1, n // (BUCKET_ROWS * len(bounds)))
    bucket, last = F.lit(0), 0
    for i, (a, b) in enumerate(zip(bounds, [*bounds[1:], high + 1])):
        width = -(-(b - a) // per)
        bucket = F.when(F.col("doc_id") >= a, F.lit(i * per) + F.floor((F.col("doc_id") - F.lit(a)) / F.lit(width))).otherwise(bucket)
        last = i * per + (high - a) // width
    return bucket.cast("long"), last


def first_rows(rows: DataFrame, last: int) -> DataFrame:
    """The lowest id of each bucket, and the bucket in use before it (before the first: the last)."""
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).withColumn("together", F.floor(F.col("bucket") / NUMBERED_TOGETHER))
    # One row for about a million rows of the table.
    ends = firsts.groupBy("together").agg(F.max("bucket").alias("end"))
    ends = ends.select("together", F.lag("end", 1, last).over(Window.orderBy("together")).alias("before"))
    into = F.coalesce(F.lag("bucket").over(Window.partitionBy("together").orderBy("bucket")), F.col("before"))
    return firsts.join(F.broadcast(ends) if last < MOST_BROADCAST else ends, "together").select("doc_id", into.alias("into"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, WindowSpec]:
    """Rows (doc_id, text, bucket, copy) and the window in which the next row by id is one ahead.

    Rows are dealt by buckets of neighbouring ids, and each bucket also gets a copy (copy = 1) of
    the first row behind it, the last one that of the very first. So texts are shuffled once, and
    no task holds more than a bucket.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bucket, last = buckets(rows)
    rows = rows.withColumn("bucket", bucket)
    firsts = first_rows(rows, last)
    if last < MOST_BROADCAST:
        firsts = F.broadcast(firsts)
    copies = (
        rows.join(firsts, "doc_id")
        .withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("n = 1")
        .select("doc_id", "text", F.col("into").alias("bucket"), F.lit(1).alias("copy"))
    )
    return rows.withColumn("copy", F.lit(0)).unionByName(copies), Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row; see the module for what its columns mean."""
    both, order = with_next(df, id_col, text_col)
    own = both.repartition("bucket").withColumn("own", entries(F.col("text")))
    behind = F.lead(F.struct("text", "own")).over(order)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left("next.text", half))
    made = (
        own.withColumn("next", behind).where("copy = 0")
        .withColumn("edited", edited)
        .withColumn("edited_entries", entries(F.col("edited")))
        .withColumn("own_set", hash_set(F.col("own")))
    )
    return made.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(F.col("own")).alias("fingerprint"),
        written_out(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), hash_set(F.col("edited_entries"))).alias("near_edited"),
        likeness(F.col("own_set"), hash_set(F.col("next.own"))).alias("near_next"),
    )
