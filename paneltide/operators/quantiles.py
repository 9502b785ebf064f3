"""Exact quantiles of moving windows from counts that add up.

Rows are counted once by part (what windows are made of) and by cell of the value; a window's counts
are sums of its parts' counts, and tell in which cell each order statistic lies. Only the rows of
those cells are looked at again. So no row is copied into the windows that it belongs to, and no
task holds all values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 4096


def cell(x: Column, cells: int = CELLS) -> Column:
    """A cell that rises with the value, for any finite value."""
    return F.floor((x / (1 + F.abs(x)) + 1) * (cells / 2)).cast("long")


def order_statistics(rows: DataFrame, spans: DataFrame, shares: Sequence[float], cells: int = CELLS) -> DataFrame:
    """Per block and share: the quantile, and the number and sum of y of the rows up to it.

    rows: part, x, y (none NULL); spans: block and each part that it is made of. Quantiles lie between neighbours in
    proportion, as percentile() has them. Columns: block, q (from 0), cut, n_upto, y_upto, n, y (of the whole block).
    """
    placed = rows.withColumn("cell", cell(F.col("x"), cells))
    parts = placed.groupBy("part", "cell").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    by_cell = spans.join(parts, "part").groupBy("block", "cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    upto = Window.partitionBy("block").orderBy("cell")  # as many rows as cells, at most
    whole = Window.partitionBy("block")
    counted = by_cell.select(
        "block", "cell", "n", (F.sum("n").over(upto) - F.col("n")).alias("n_before"), (F.sum("y").over(upto) - F.col("y")).alias("y_before"),
        F.sum("n").over(whole).alias("n_all"), F.sum("y").over(whole).alias("y_all"),
    )
    # Each share asks for the two order statistics around it; a cell answers those that fall to it.
    at = [F.lit(float(s)) * (F.col("n_all") - 1) for s in shares]
    asked = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(high).alias("high"), (F.ceil(p) if high else F.floor(p)).cast("long").alias("rank"), (p - F.floor(p)).alias("rest"))
                      for q, p in enumerate(at) for high in (False, True)))
    mine = F.filter(asked, lambda a: (a["rank"] >= F.col("n_before")) & (a["rank"] < F.col("n_before") + F.col("n")))
    located = counted.withColumn("a", F.explode(mine)).select("block", "cell", "n_before", "y_before", "n_all", "y_all", "a.*")
    wanted = located.select("block", "cell").distinct().join(spans, "block")
    inside = placed.join(wanted, ["part", "cell"]).groupBy("block", "cell", "x").agg(F.count("*").alias("vn"), F.sum("y").alias("vy"))
    values = Window.partitionBy("block", "cell").orderBy("x")
    inside = inside.select("block", "cell", "x", "vn", F.sum("vn").over(values).alias("vn_upto"), F.sum("vy").over(values).alias("vy_upto"))
    place = F.col("rank") - F.col("n_before")
    found = located.join(inside, ["block", "cell"]).where((place < F.col("vn_upto")) & (place >= F.col("vn_upto") - F.col("vn")))
    one = F.struct("x", (F.col("n_before") + F.col("vn_upto")).alias("n"), (F.col("y_before") + F.col("vy_upto")).alias("y"))
    pairs = found.groupBy("block", "q").agg(
        F.max(F.when(~F.col("high"), one)).alias("low"), F.max(F.when(F.col("high"), one)).alias("top"), F.max("rest").alias("rest"),
        F.max("n_all").alias("n"), F.max("y_all").alias("y"),
    )
    cut = F.col("low.x") + (F.col("top.x") - F.col("low.x")) * F.col("rest")
    return pairs.withColumn("cut", cut).select(
        "block", "q", "cut", *(F.when(F.col("cut") >= F.col("top.x"), F.col(f"top.{c}")).otherwise(F.col(f"low.{c}")).alias(f"{c}_upto") for c in ("n", "y")),
        "n", "y",
    )


def bins(statistics: DataFrame) -> DataFrame:
    """Per block: its distinct cuts in order, and the number and mean of y of the rows in each bin between them; n and mean of all."""
    marks = F.array_sort(F.collect_set(F.struct("cut", F.col("n_upto").alias("n"), F.col("y_upto").alias("y"))))
    made = statistics.groupBy("block").agg(marks.alias("marks"), F.max("n").alias("n"), F.max("y").alias("y"))
    edges = F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("y"))), F.transform("marks", lambda m: F.struct(m["n"].alias("n"), m["y"].alias("y"))),
        F.array(F.struct("n", F.col("y").cast("double").alias("y"))),
    )
    between = lambda k: F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.col("edges")[i][k] - F.col("edges")[i - 1][k])
    made = made.withColumn("edges", edges).select("block", F.col("marks.cut").alias("cuts"), between("n").alias("ns"), between("y").alias("ys"), "n", (F.col("y") / F.col("n")).alias("mean"))
    return made.withColumn("rates", F.zip_with("ys", "ns", lambda y, n: y / F.nullif(n, F.lit(0)))).drop("ys")


def bin_of(x: Column, cuts: Column) -> Column:
    """How many of the cuts lie below a value."""
    return F.size(F.filter(cuts, lambda c: c < x)).cast("long")
