"""Values at given ranks, exactly and without a sort: histograms over the ordered bits of doubles, refined.

A double's bits, taken as a whole number with the sign's meaning undone, have the order of the doubles. The first
pass counts values by group and their leading bits, and finds for each wanted rank the leading bits of its value; each
further pass counts only the values that share those, by the bits that follow. A pass is one aggregation that adds up
before its shuffle, so a group may hold any number of values; what is sorted are bins, at most 2^16 of a group and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartoflux.functions.settle import settled

#: Bits that a pass settles.
BITS = 16
#: Groups times ranks that are broadcast.
BROADCAST_ROWS = 100_000

_LEAST_EXPONENT, _MANTISSA = -1022, 52


def ordered_bits(value: Column) -> Column:
    """The bits of a double's magnitude as a long, negative for negative doubles: in the order of the doubles. Both
    zeros are 0; infinities stand at the ends. Not for NaN."""
    size = F.abs(value)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(_LEAST_EXPONENT)), F.lit(1023))  # a rounded logarithm may be one off
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when(size < power(guess), guess - 1).when((guess < 1023) & (size / 2 >= power(guess)), guess + 1).otherwise(guess)
    fraction = size / power(exponent) - 1
    normal = (exponent - _LEAST_EXPONENT + 1) * F.lit(2**_MANTISSA) + (fraction * float(2**_MANTISSA)).cast("long")
    small = (size * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 * 2**_MANTISSA)).when(size < 2.0**_LEAST_EXPONENT, small).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits)


def at_ranks(rows: DataFrame, value: str, ranks: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, lo, hi, ranks): for each group the number of its values, the extremes, and the values at ranks (from 0)
    that are expressions of ``n``. Null and NaN don't count; a rank beyond a group's values gives null, and a group
    without any value is left out, also where there is only one group."""
    # a struct as the key: nulls in it are equal to each other, and no name of it can clash with those used here
    key = F.struct(F.lit(1).alias("one"), *by).alias("key")
    own = rows.select(key, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    own = settled(own.withColumn("bits", ordered_bits(F.col("value"))))  # each pass reads them, whatever work they took
    leads = settled(own.groupBy("key", F.shiftright("bits", 64 - BITS).alias("lead")).agg(F.count("*").alias("count"), F.min("value").alias("found"), F.max("value").alias("most")))
    sizes = leads.groupBy("key").agg(F.sum("count").alias("n"), F.min("found").alias("lo"), F.max("most").alias("hi"))
    # the wanted values go to all tasks if there are so few, which is checked; else they are joined
    few = leads.select("key").distinct().count() * len(ranks) <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    found = sizes.select("key", wanted.alias("want")).select("key", "want.name", "want.rank", F.lit(0).cast("long").alias("lead")).filter("rank >= 0")
    for shift in range(64 - BITS, -1, -BITS):
        if shift == 64 - BITS:
            counted = leads.select("key", F.lit(0).cast("long").alias("above"), "lead", "count", "found", "most")
        else:  # only what shares the leading bits of a wanted value: a few of the values
            inside = own.select("key", "value", F.shiftright("bits", shift + BITS).alias("above"), F.shiftright("bits", shift).alias("lead"))
            inside = inside.join(sent(found.select("key", F.col("lead").alias("above")).distinct()), ["key", "above"], "left_semi")
            counted = inside.groupBy("key", "above", "lead").agg(F.count("*").alias("count"), F.min("value").alias("found"), F.max("value").alias("most"))
        met = counted.join(sent(found.select("key", "name", "rank", F.col("lead").alias("above"))), ["key", "above"])
        met = met.withColumn("before", F.sum("count").over(W.partitionBy("key", "name").orderBy("lead")) - F.col("count"))
        met = met.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("count")))
        found = settled(met.select("key", "name", (F.col("rank") - F.col("before")).alias("rank"), "lead", "found", "most"))
        if not found.filter("found <> most").take(1):
            break  # every wanted value is known
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in ranks])
    return sizes.join(wide, "key", "left").select(*[F.col(f"key.{k}") for k in by], "n", "lo", "hi", *ranks)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, lo, hi, shares): percentiles, between two values by a straight line."""
    place = {name: (F.col("n") - 1) * F.lit(q) for name, q in shares.items()}
    ranks = {f"{name}_{side}": half(at) for name, at in place.items() for side, half in (("below", F.floor), ("above", F.ceil))}
    found = at_ranks(rows, value, ranks, by)

    def between(name: str) -> Column:
        low, high, part = F.col(f"{name}_below"), F.col(f"{name}_above"), place[name] - F.floor(place[name])
        return F.when(low == high, low).otherwise(low + (high - low) * part)

    return found.select(*by, "n", "lo", "hi", *[between(name).alias(name) for name in shares])
