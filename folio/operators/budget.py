"""Letter and line budgets of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators.places import numbered, written
from folio.operators.structure import pack

LINE = 60


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(t.text(c), r"[^\p{L}]", ""))


def virtual_lines(c: Column, width: int = LINE) -> Column:
    """Lines of at most `width` characters, words whole."""
    words = F.filter(F.split(t.normalize(c), " "), lambda w: w != "")
    return F.size(pack(words, width))


def reduction(source: Column, summary: Column) -> Column:
    """By how many percent of letters the summary is shorter."""
    n = letters(source)
    return F.when(n > 0, F.round(100.0 - letters(summary) * 100.0 / n, 3)).otherwise(0.0)


def band(percent: Column, low: float = 60.0, high: float = 70.0, slack: float = 5.0) -> Column:
    return F.when(percent.between(low, high), "in").when(percent.between(low - slack, high + slack), "near").otherwise("out")


#: Copies of a group's totals; a group's rows meet them in as many tasks.
COPIES = 64
#: Remainders are whole billionths, found by two digits of at most 32,768 values.
DIGIT = 1 << 15


def _beside(df: DataFrame, groups: DataFrame, by, order: str) -> DataFrame:
    """`df` with the columns of its group's one row in `groups` (null where it has none); a hot group is COPIES tasks."""
    copies = groups.withColumnsRenamed({c: f"_at_{c}" for c in by}).withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = df.withColumn("_copy", F.pmod(F.xxhash64(order), F.lit(COPIES)).cast("int"))
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in by]
    return dealt.join(copies, [*same, F.col("_copy") == F.col("_of")], "left").drop("_copy", "_of", *[f"_at_{c}" for c in by])


def _crossing(counts: DataFrame, by, digit: str) -> DataFrame:
    """by, digit, _left of each group of (by, digit, _n, _left): the digit, from high to low, at which _left rows are reached, and how many of its own are still to take."""
    before = Window.partitionBy(*by).orderBy(F.desc(digit)).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.where("_before < _left AND _left <= _before + _n").select(*by, digit, (F.col("_left") - F.col("_before")).alias("_left"))


def line_budget(units: DataFrame, by, order: str, total: int, weight: str = "weight") -> DataFrame:
    """`units` with lines: at least 1 each, `total` for each group in proportion to weight (null: 0), by largest remainders, ties to smaller `order`, an integer column.

    No group is ranked: counts of remainders by their high, then low digit give the least one that still gets a line, and
    rows that have just that one are numbered by ranges. Units are written once to the shared folder. Null is a group of
    its own; among rows alike in remainder and `order` any get the lines.
    """
    share = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    sums = units.groupBy(*by).agg(F.count("*").alias("_rows"), F.sum(F.coalesce(weight, F.lit(0))).alias("_all"))
    spare = F.when(F.col("_all") > 0, F.greatest(F.lit(0), F.lit(total) - F.col("_rows"))).otherwise(0)
    exact = F.when(F.col("_all") > 0, F.col("_spare") * share / F.col("_all")).otherwise(0.0)
    cut = _beside(units, sums.withColumn("_spare", spare), by, order).withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    cut = cut.withColumn("_r", F.round(F.round(F.col("_x") - F.col("_f"), 9) * 1_000_000_000).cast("long"))
    cut = written(cut.withColumns({"_high": F.shiftright("_r", 15), "_low": F.col("_r") % DIGIT}).drop("_x", "_r", "_rows", "_all"))

    # a group's lines left over, on each of its counts by the high digit
    high = cut.groupBy(*by, "_high").agg(F.count("*").alias("_n"), F.sum("_f").alias("_f"), F.first("_spare").alias("_spare"))
    high = high.withColumn("_left", F.first("_spare").over(Window.partitionBy(*by)) - F.sum("_f").over(Window.partitionBy(*by)))
    top = _crossing(high, by, "_high").withColumnRenamed("_high", "_top")
    low = _beside(cut, top, by, order).where(F.col("_high") == F.col("_top")).groupBy(*by, "_top", "_low").agg(F.count("*").alias("_n"), F.first("_left").alias("_left"))
    least = _crossing(low, [*by, "_top"], "_low").withColumnRenamed("_low", "_least")

    judged = _beside(cut, least, by, order).withColumn("_over", F.coalesce((F.col("_high") > F.col("_top")) | ((F.col("_high") == F.col("_top")) & (F.col("_low") > F.col("_least"))), F.lit(False)))
    tied = F.coalesce((F.col("_high") == F.col("_top")) & (F.col("_low") == F.col("_least")), F.lit(False))
    lines = lambda more: (1 + F.col("_f") + more.cast("int")).cast("long").alias("lines")
    first = numbered(judged.where(tied), by, order, "_place").select(*units.columns, lines(F.col("_place") < F.col("_left")))
    return judged.where(~tied).select(*units.columns, lines(F.col("_over"))).unionByName(first)
