"""Mixing sources to target weights by Pareto order sampling.

A source gets its share of the rows to draw (largest remainders).  Within it a
document's expected number of copies is in proportion to its measure.  The whole
part of that number is allotted for certain; the fraction is an inclusion
probability, and as many documents as the fractions add up to are chosen: those of
smallest rank, the odds of a random number divided by the odds of inclusion
(Rosen's Pareto sampling).  The sample has a fixed size and unequal probabilities.

The random number is a hash of seed and id, so a document keeps it from run to
run.  The rank at which a source's sample ends is found exactly: ranks are counted
in narrow ranges, then only the range that holds the end is sorted.  No source is
ever brought to one task.

Defined results
* null source: a source of its own; null text: measure 0, never drawn; empty text: measure 1
* equal ranks (repeated ids): by measure, then as many of the equal rows as the size asks for
* without target weights a source's weight is the square root of its total measure
* a source without a target weight is not drawn if weights are given; weights need not add up to 1; what the weight of a source without rows asks for is shared out among the others
* an empty table gives an empty result; extra columns are passed through
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, join_small, written

SEED = 7
#: Ranges in which ranks are counted before the one that holds a sample's end is sorted.
RANGES = 4096


def random_unit(id_col: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) made of 52 bits of md5 of seed and id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_key() -> Column:
    """Column s as the key of joins: null is a key like any other, and no source's name is like it."""
    return F.coalesce(F.concat(F.lit("="), F.col("s")), F.lit(""))


def bit_length(text: Column) -> Column:
    """Number of binary digits of the text's length: the default measure, gentle to long texts; 0 for null."""
    return F.coalesce(F.length(F.bin(F.length(text))), F.lit(0)).cast("long")


def _targets(narrow: DataFrame, total: int | None, weights: dict[str | None, float] | None) -> tuple[DataFrame, int]:
    """(source, target, measure) and its number of rows."""
    sums = narrow.groupBy("s").agg(F.sum("a").alias("measure"), F.count(F.lit(1)).alias("rows"))
    if weights is None:
        sums = sums.withColumn("weight", F.sqrt(F.col("measure").cast("double")))
    else:
        spark = narrow.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
        sums = sums.join(F.broadcast(given), sums["s"].eqNullSafe(given["s"]), "left").select(sums["s"], "measure", "rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = written(sums.withColumn("weight", F.when(F.col("measure") > 0, F.col("weight")).otherwise(0.0)), "mixing-sources")
    sources, rows, weight = sums.agg(F.count(F.lit(1)), F.sum("rows"), F.sum("weight")).first()
    wanted = (rows or 0) if total is None else total
    exact = F.col("weight") * F.lit(float(wanted)) / F.lit(float(weight or 1.0))
    shares = sums.select("s", "measure", F.floor(exact).alias("low"), (exact - F.floor(exact)).alias("part"), (F.col("weight") > 0).alias("some"))
    left = (wanted if weight else 0) - (shares.agg(F.sum("low")).first()[0] or 0)
    # One row for each source: few, and already summed.
    order = F.row_number().over(Window.orderBy(F.col("some").desc(), F.col("part").desc(), F.col("s").asc_nulls_first()))
    return shares.select("s", "measure", (F.col("low") + F.when((order <= left) & F.col("some"), 1).otherwise(0)).alias("target")), sources


def _ranked(df: DataFrame, targets: DataFrame, sources: int) -> DataFrame:
    joined = join_small(df, targets.withColumn("s_", source_key()).drop("s"), ["s_"], "inner", sources)
    expected = F.col("target").cast("double") * F.col("a").cast("double") / F.when(F.col("measure") > 0, F.col("measure").cast("double"))
    rows = joined.withColumn("e", F.coalesce(expected, F.lit(0.0))).withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.floor("e"))
    odds = F.col("u") / (1 - F.col("u"))
    return rows.withColumn("q", F.when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p")))))


def drawn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None, weights: dict[str | None, float] | None = None, measure: Column | None = None, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the drawn rows (all by default) with ``whole``, ``sampled`` and ``copies`` (their sum, 1 at least)."""
    kept = df.columns if columns is None else columns
    size = bit_length(F.col(f"`{text_col}`")) if measure is None else measure.cast("long")
    core = [F.col(f"`{source_col}`").cast("string").alias("s"), F.col(f"`{id_col}`").alias("i"), F.coalesce(size, F.lit(0)).alias("a")]
    narrow = written(df.select(*core), "mixing-measures")
    targets, sources = _targets(narrow, total, weights)
    targets = written(targets, "mixing-targets")
    # A null id has the random number of the empty string.
    small = narrow.withColumn("u", random_unit(F.coalesce(F.col("i").cast("string"), F.lit("")), seed)).withColumn("s_", source_key())
    ranks = _ranked(small, targets, sources)
    squeezed = F.floor(F.col("q") / (1 + F.col("q")) * RANGES)
    counts = ranks.groupBy("s_").agg(F.first("target").alias("target"), F.sum("whole").alias("whole"))
    cells = ranks.where("q is not null").withColumn("cell", squeezed).groupBy("s_", "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("s_").orderBy("cell")))
    ends = upto.join(counts.select("s_", (F.col("target") - F.col("whole")).alias("size")), "s_").where("upto >= size and upto - n < size")
    ends = written(ends.select("s_", "cell", (F.col("size") - F.col("upto") + F.col("n")).alias("more")), "mixing-ends")
    last = join_small(ranks.withColumn("cell", squeezed), ends, ["s_", "cell"], "inner", sources)
    place = Window.partitionBy("s_").orderBy("q", "i", "a")
    edge = last.withColumn("k", F.row_number().over(place)).where("k = more").select("s_", F.col("q").alias("q_end"), F.col("i").alias("i_end"), F.col("a").alias("a_end"))
    same = last.join(edge, "s_").withColumn("low", F.struct("q", "i", "a") < F.struct("q_end", "i_end", "a_end")).withColumn("tied", F.struct("q", "i", "a").eqNullSafe(F.struct("q_end", "i_end", "a_end")))
    edge = same.groupBy("s_").agg(F.first("q_end").alias("q_end"), F.first("i_end").alias("i_end"), F.first("a_end").alias("a_end"), (F.first("more") - F.sum(F.col("low").cast("long"))).alias("take"), F.sum(F.col("tied").cast("long")).alias("ties"))
    edge = written(edge, "mixing-edges")
    split = edge.where("take < ties").limit(1).count() > 0

    inner = [f"k{j}" for j in range(len(kept))]
    rows = df.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, inner)), *core).withColumn("u", random_unit(F.coalesce(F.col("i").cast("string"), F.lit("")), seed)).withColumn("s_", source_key())
    rows = join_small(_ranked(rows, targets, sources), edge, ["s_"], "left", sources)
    here, end = F.struct("q", "i", "a"), F.struct("q_end", "i_end", "a_end")
    tied = F.col("q").isNotNull() & F.col("take").isNotNull() & here.eqNullSafe(end)
    below = F.col("q").isNotNull() & F.col("take").isNotNull() & (here < end)
    if split:
        # Equal rows astride the end, which only repeated ids can be: count them off among themselves.
        few = rows.where(tied).withColumn("k", F.row_number().over(Window.partitionBy("s_").orderBy(*inner)))
        chosen = rows.where(~tied).withColumn("hit", below).unionByName(few.withColumn("hit", F.col("k") <= F.col("take")).drop("k"))
    else:
        chosen = rows.withColumn("hit", below | tied)
    added: list[str] = []
    for wanted in ("whole", "sampled", "copies"):
        added.append(free_name([*kept, *added], wanted))
    out = chosen.select(*(F.col(x).alias(c) for c, x in zip(kept, inner)), F.col("whole").alias(added[0]), F.col("hit").cast("long").alias(added[1]), (F.col("whole") + F.col("hit").cast("long")).alias(added[2]))
    return out.where(F.col(f"`{added[2]}`") > 0)


def mixed(df: DataFrame, **how: object) -> DataFrame:
    """The drawn rows, each as often as it was drawn, with the columns of ``df``."""
    out = drawn(df, **how)
    copies = out.columns[-1]
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`").cast("int")))).select(*(F.col(f"`{c}`") for c in df.columns))
