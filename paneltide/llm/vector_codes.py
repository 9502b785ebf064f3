"""Product codes of vectors: one byte for each of four parts, with codebooks learnt over all vectors.

Components become integers, so all distances, sums and means are exact. The distinct parts of each
position are kept once, in lexicographic order and with their number of times, dealt by ranges: a
task then holds neighbours in that order, which are a trie over the dimensions. The trie is walked
depth first. A node hands the distances to all 256 entries, summed over the dimensions so far, to
its children, so a common prefix is measured once; children that are leaves add their last
dimensions together. A leaf takes the nearest entry (the lower index on a tie) and adds its part,
times its weight, to that entry's sum.

A round sends codebooks of a fixed size to the tasks and gets back one sum per position and entry.
Codes are given by the same walk over each batch of vectors, so vectors are never joined to parts.

Defined results: a null vector, and one with null or non-finite components, is dropped; an empty
table, or one without a vector that is kept, gives no rows. The first kept vector by id (null ids
come last, then by vector) sets the length, which is cut down to a multiple of four by leaving out
the last components; a vector with fewer components than that stays as a row without code and
error (NULL), and takes no part in learning; further components of a longer one are not coded. With
fewer than 256 vectors there are as many entries. Rows with one id are coded each for itself. An error,
or a sum of them, that does not fit 64 bits is NULL. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.common import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of distances that are worked on at once; a row holds one number per entry.
BLOCK = 512
#: Components below this have squared distances that fit 64 bits at any usual length; others are Python's integers.
SMALL = 1 << 26


def floors(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), exact in doubles as the factor is a power of two; 0 has no sign."""
    return np.floor(values.astype(np.float64) * SCALE) + 0.0


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as exact integers: 64 bits where all are small, Python's own otherwise."""
    if not values.size or np.abs(values).max() < SMALL:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def squared(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared differences of n numbers with a column of the codebook: n rows, one number per entry."""
    apart = values[:, None] - entries[None, :]
    return apart * apart


def walk(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of distinct parts in lexicographic order, depth first."""
    n, dims = parts.shape
    entry, error = np.zeros(n, np.int64), np.zeros(n, np.result_type(parts, codebook))
    if parts.dtype == object or codebook.dtype == object:
        parts, codebook, error = parts.astype(object), codebook.astype(object), error.astype(object)

    # Products of doubles are exact where all sums of squares stay below 2**53.
    exact = error.dtype != object and dims <= 1024 and max((np.abs(a).max() for a in (parts, codebook) if a.size), default=0) < 1 << 20
    quick_parts, quick_book = (a.astype(np.float64) if exact else None for a in (parts, codebook))

    def leaves(at: np.ndarray, so_far: np.ndarray, depth: int) -> None:
        if exact:  # (x - c)**2 over the last dimensions, as x**2 - 2xc + c**2
            x, c = quick_parts[at, depth:], quick_book[:, depth:]
            so_far = so_far + (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        else:
            for d in range(depth, dims):
                so_far = so_far + squared(parts[at, d], codebook[:, d])
        best = np.argmin(so_far, axis=1)  # the first of equal ones
        entry[at], error[at] = best, so_far[np.arange(len(at)), best]

    stack = [(0, n, 0, np.zeros((1, len(codebook)), error.dtype))]  # rows from, to; depth; distances so far
    while stack:
        low, high, depth, so_far = stack.pop()
        if depth == dims or high - low == 1:
            leaves(np.arange(low, min(high, low + 1)), so_far, depth)
            continue
        values = parts[low:high, depth]
        first = low + np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        last = np.append(first[1:], high)
        inner = []
        for k in range(0, len(first), BLOCK):
            mine, stop = first[k : k + BLOCK], last[k : k + BLOCK]
            reached = so_far + squared(parts[mine, depth], codebook[:, depth])
            alone = stop - mine == 1
            if alone.any():
                leaves(mine[alone], reached[alone], depth + 1)
            inner += [(int(mine[i]), int(stop[i]), depth + 1, reached[i : i + 1].copy()) for i in np.flatnonzero(~alone)]
        stack += inner[::-1]
    return entry, error


def coded(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts in any order, with repeats: each distinct one is walked to once."""
    if parts.dtype == object:
        rows = [tuple(r) for r in parts]
        distinct = sorted(set(rows))
        place = {r: i for i, r in enumerate(distinct)}
        inverse = np.array([place[r] for r in rows], np.int64)
        known = np.array(distinct, object).reshape(len(distinct), parts.shape[1])
    else:
        known, inverse = np.unique(parts, axis=0, return_inverse=True)
    entry, error = walk(known, codebook)
    return entry[inverse.ravel()], error[inverse.ravel()]


def matrices(batch: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floors of the components) of the rows with at least `dims` components."""
    lists = batch.column(column)
    long_enough = np.flatnonzero(pc.list_value_length(lists).to_numpy(zero_copy_only=False) >= dims)
    for k in range(0, len(long_enough), 4096):
        rows = long_enough[k : k + 4096]
        taken = lists.take(pa.array(rows))
        offsets = taken.offsets.to_numpy()[:-1]
        flat = taken.values.to_numpy(zero_copy_only=False)
        yield rows, floors(flat[offsets[:, None] + np.arange(dims)])


def distinct_parts(kept: DataFrame, dims: int) -> DataFrame:
    """position, part and weight of the distinct parts, stored by ranges in lexicographic order."""
    width = dims // PARTS

    def run(batches):
        for batch in batches:
            for _, values in matrices(batch, 0, dims):
                ends = pa.array(np.arange(0, len(values) * width + 1, width, dtype=np.int32))
                for p in range(PARTS):
                    part = pa.ListArray.from_arrays(ends, pa.array(values[:, p * width : (p + 1) * width].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, np.int32)), part], ["position", "part"])

    cut = kept.select("vector").mapInArrow(run, "position int, part array<double>")
    counted = cut.groupBy("position", "part").agg(F.count("*").alias("weight"))
    return written(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")


def sums(parts: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """position, entry, number of parts and componentwise sums (as text: they may pass 64 bits)."""
    width = codebooks[0].shape[1]

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            position = batch.column(0).to_numpy()
            weight = batch.column(2).to_numpy()
            for p in np.unique(position).tolist():
                rows = np.flatnonzero(position == p)
                taken = batch.column(1).take(pa.array(rows))
                values = integers(taken.flatten().to_numpy().reshape(len(rows), width))
                entry, _ = walk(values, codebooks[p])
                n, times = weight[rows], weight[rows]
                if values.dtype == object or int(times.sum()) > 1 << 36:  # sums may pass 64 bits
                    times, values = times.astype(object), values.astype(object)
                number, total = np.zeros(ENTRIES, np.int64), np.zeros((ENTRIES, width), values.dtype)
                np.add.at(number, entry, n)
                np.add.at(total, entry, times[:, None] * values)
                for e in np.flatnonzero(number).tolist():
                    old = held.setdefault((p, e), [0, [0] * width])
                    old[0] += int(number[e])
                    old[1] = [a + int(b) for a, b in zip(old[1], total[e])]
        if held:
            rows = [(p, e, n, [str(x) for x in total]) for (p, e), (n, total) in held.items()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["position", "entry", "n", "total"])

    made = parts.mapInArrow(run, "position int, entry int, n long, total array<string>")
    total = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    return made.groupBy("position", "entry").agg(F.sum("n").alias("n"), *total)


def learnt(kept: DataFrame, dims: int, rounds: int) -> list[np.ndarray]:
    """The final codebooks. The driver gets one row per position and entry a round, 1,024 at most."""
    width = dims // PARTS
    first = kept.where(F.size("vector") >= dims).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    start = integers(floors(np.array([r[0][:dims] for r in first], np.float64)))
    codebooks = [start[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    parts = distinct_parts(kept, dims)
    for _ in range(rounds):
        fresh = [c.astype(object) for c in codebooks]
        for row in sums(parts, codebooks).collect():
            fresh[row["position"]][row["entry"]] = [int(row[f"s{d}"]) // row["n"] for d in range(width)]
        codebooks = [c if max(abs(x) for x in c.ravel()) >= SMALL else c.astype(np.int64) for c in fresh]
    discard(parts)
    return codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel()).encode()).hexdigest()


RESULT = "vec_id long, label string, code string, error long"


def compress(vectors: DataFrame, rounds: int = ROUNDS, vector_col: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept."""
    vector = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").cast("string").alias("label")
    )
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    dims = first[0]["n"] // PARTS * PARTS if first else 0
    codebooks = learnt(kept, dims, rounds) if dims else []
    width = dims // PARTS

    def run(batches):
        for batch in batches:
            code: list = [None] * batch.num_rows
            error: list = [None] * batch.num_rows
            for rows, values in matrices(batch, 1, dims) if dims else ():
                made = [coded(integers(values[:, p * width : (p + 1) * width]), codebooks[p]) for p in range(PARTS)]
                for i, row in enumerate(rows.tolist()):
                    code[row] = "".join(f"{int(entry[i]):02x}" for entry, _ in made)
                    total = sum(int(far[i]) for _, far in made)
                    error[row] = total if total < 1 << 63 else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    rows = written(kept.select("vec_id", "vector", "label").mapInArrow(run, RESULT), "codes")
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebooks) if codebooks else None).alias("codebooks_sha256")
    )


def _assigned(parts: str, codebook: str) -> str:
    """The nearest entry of each part, by all distances."""
    far = f"list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    return (
        f"SELECT vec_id, position, x, entry, far FROM (SELECT p.vec_id, p.position, p.x, c.entry, ({far})::BIGINT AS far, "
        f"row_number() OVER (PARTITION BY p.vec_id, p.position ORDER BY ({far}), c.entry) AS r "
        f"FROM {parts} p JOIN {codebook} c USING (position)) WHERE r = 1"
    )


def _sql() -> str:
    """The same in DuckDB for ids that are unique and vectors of one length, all distances measured."""
    with_ = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, p AS position, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS x "
        "FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p))",
        "book0 AS MATERIALIZED (SELECT position, entry, x FROM (SELECT position, x, "
        "row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry FROM parts) WHERE entry < 256)",
    ]
    for k in range(ROUNDS):
        with_ += [
            f"near{k} AS MATERIALIZED ({_assigned('parts', f'book{k}')})",
            f"mean{k} AS (SELECT position, entry, list(m ORDER BY i) AS x FROM (SELECT position, entry, i, "
            f"floor(sum(v)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT position, entry, unnest(x) AS v, "
            f"unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY position, entry, i) GROUP BY position, entry)",
            f"book{k + 1} AS MATERIALIZED (SELECT position, entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (position, entry))",
        ]
    last = f"book{ROUNDS}"
    with_ += [
        f"near AS MATERIALIZED ({_assigned('parts', last)})",
        "coded AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY position) AS code, sum(far)::BIGINT AS error FROM near GROUP BY vec_id)",
        f"digest AS (SELECT sha256(string_agg(t, ',' ORDER BY position, entry)) AS d FROM (SELECT position, entry, array_to_string(x, ',') AS t FROM {last}))",
    ]
    return (
        "WITH " + ",\n".join(with_) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, "
        "d AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"
    )


SQL = _sql()
