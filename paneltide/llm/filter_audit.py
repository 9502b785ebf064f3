"""What each of five text filters removes, alone, in every order, and by its fair share.

The texts are read once. Each document becomes a mask of the filters that it fails; grouped by part
and mask that is at most 32 rows a part. From them come the removals of all 32 coalitions of
filters, v(S): documents that fail a filter of S. Everything else is a difference of coalitions: a
filter i that comes after S removes v(S + i) - v(S), and what only it would have caught is
v(all) - v(all - i). The Shapley values are the exact solution of the constrained least squares
problem: over the coalitions that are neither empty nor whole, weighted by the Shapley kernel, fit
v(S) by a sum of one value per filter, under the condition that all values add up to v(all). The
normal equations with their multiplier are solved in rationals, part by part.

Defined results: a null text is empty, and an empty text fails A alone (no words, so B and C are
0 > 0 or 0 < 0); a null lang is the part ''; a document without an id is no copy of another and no
other is a copy of it; rows with one id and one text are not copies of each other (no id is the
smaller); several labels of one id count as 1 where any is 1; labels of no document count nowhere;
an empty table has no parts and no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the filters, by letter, as the audit defines them.
LETTERS = "ABCDE"
WORD_BREAK = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"

N = len(LETTERS)
WHOLE = (1 << N) - 1
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether the text fails A, B, C, D. All of it runs inside the JVM."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    number, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (
        number < MIN_WORDS,
        distinct * 100 < number * MIN_DISTINCT_PERCENT,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MAX_CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    )
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and the number of documents, good ones and toxic ones that have it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        text_mask(text).alias("abcd"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    # Most texts are there once: only digests of several ids are joined back, and they are small rows.
    copied = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    copied = copied.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = copied.where("first < last").select("digest", "first")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return (
        rows.join(copied, "digest", "left").join(known, "doc_id", "left")
        .groupBy("part", (F.col("abcd") + later * 16).alias("mask"))
        .agg(
            F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def removals(counts: dict[int, int]) -> list[int]:
    """v(S) of all 32 coalitions: how many have a mask that meets S."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(WHOLE + 1)]


def solved(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of a square system, given with its right side, by elimination in rationals."""
    rows = [list(r) for r in rows]
    for k in range(len(rows)):
        at = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [r[-1] for r in rows]


def shapley(v: list[int]) -> list[Fraction]:
    """One value per filter from the 32 coalition removals, by constrained weighted least squares."""
    normal = [[Fraction(0)] * (N + 2) for _ in range(N + 1)]
    for s in range(1, WHOLE):
        size = s.bit_count()
        weight = Fraction(N - 1, comb(N, size) * size * (N - size))
        inside = [i for i in range(N) if s >> i & 1]
        for i in inside:
            for j in inside:
                normal[i][j] += weight
            normal[i][-1] += weight * v[s]
    for i in range(N):  # the multiplier of the condition, and the condition itself
        normal[i][N] = normal[N][i] = Fraction(1)
    normal[N][-1] = Fraction(v[WHOLE] - v[0])
    return solved(normal)[:N]


def audit_of(part: str, counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """The 600 rows of a part, from (documents, good, toxic) by mask."""
    total = sum(n for n, _, _ in counts.values())
    every, good, toxic = (removals({m: c[k] for m, c in counts.items()}) for k in range(3))
    orders = 120
    shares = [x * orders for x in shapley(every)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("the Shapley values of whole numbers are whole 120ths")
    out = []
    for order in permutations(range(N)):
        before, name = 0, "".join(LETTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = every[after] - every[before]
            out.append((
                part, name, step, total - every[after], gone, every[1 << i] - gone, every[WHOLE] - every[WHOLE & ~(1 << i)],
                good[after] - good[before], toxic[after] - toxic[before], int(shares[i]),
            ))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what is kept, removed, redundant and lost."""
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # 32 of them at most
    tables = masks(docs, labels).groupBy("part").agg(cells.alias("cells"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = audit_of(row["part"], {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in row["cells"]})
                names = [f.split(" ")[0] for f in RESULT.split(", ")]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    return tables.mapInArrow(run, RESULT)


#: The same in DuckDB: every order is walked document by document, without coalitions.
SQL = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
known AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
  FROM labels GROUP BY 1
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f
  FROM words w JOIN firsts USING (text) LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
walked AS (
  SELECT part, filter_order, step, o[step] AS i, n, good, toxic, f[o[step]] AS fails,
         len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 AS earlier,
         len(list_filter(f, lambda x: x)) = 1 AND f[o[step]] AS sole
  FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, i,
         sum(n) FILTER (NOT fails AND NOT earlier) AS kept, sum(n) FILTER (fails AND NOT earlier) AS removed,
         sum(n) FILTER (fails AND earlier) AS redundant, sum(n) FILTER (sole) AS unique_fails,
         sum(good) FILTER (fails AND NOT earlier) AS good_lost, sum(toxic) FILTER (fails AND NOT earlier) AS toxic_lost
  FROM walked GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, i), 0)::BIGINT AS shapley
FROM summed
"""
