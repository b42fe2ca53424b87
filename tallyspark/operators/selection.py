"""Exact order statistics and ranks without a task that holds all rows.

`select_ranks` finds values by their place in order: a round counts the rows of each bin of a range, for all keys and places at once,
and each place goes on with the bin that holds it. The first bins are signs and powers of two, the later ones equal parts between
the least and the greatest value of a bin, so every round splits a range of unequal values, and the number of rounds is bounded by the
digits of a double. A range of few rows is sorted as it is. A task holds the bins of a place, never its rows.

`ordered` gives each row its place by range partitions, places inside them and prefix sums of their counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.shared import stored

#: Equal parts of a range, and the distinct values of a range that are sorted at once.
BINS, FEW = 512, 4096


def _power(value: Column) -> Column:
    """A bin by sign and power of two, in order of the values; NaN comes last."""
    size = lambda v: F.floor(F.least(F.log2(v), F.lit(2000.0))).cast("int") + 2000
    finite = F.when(value > 0, size(value)).when(value < 0, -size(-value)).otherwise(F.lit(0))
    return F.when(F.isnan(value), F.lit(5000)).otherwise(finite)


def select_ranks(rows: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, weight: str | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """ranks: keys, place (0 for the least, under the key's number of rows). keys, place, value of each distinct place.

    Null values are not rows; null keys are keys. weight: number of rows that a row stands for.
    """
    keys = list(keys)
    own = rows.select(*keys, F.col(value).cast("double").alias("_v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_w")).where("_v is not null and _w > 0")
    own = stored(own.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w")), "values")
    asked = ranks.select(*keys, F.col("place").cast("long").alias("place")).distinct()

    def narrowed(binned: DataFrame, state: DataFrame) -> DataFrame:
        """binned: keys, place, _bin, _n, _rows, _low, _high. The bin of each place, with the rows below it."""
        cells = F.array_sort(F.collect_list(F.struct("_bin", "_n", "_rows", "_low", "_high")))
        rows = binned.groupBy(*keys, "place").agg(cells.alias("_cells"))
        start = F.struct(F.col("_below").alias("below"), F.lit(None).cast("struct<_bin:int,_n:bigint,_rows:bigint,_low:double,_high:double>").alias("cell"))
        # the first cell whose rows reach over the place stays
        step = lambda a, c: F.when(a["cell"].isNotNull(), a).when(a["below"] + c["_n"] > F.col("place"), F.struct(a["below"].alias("below"), c.alias("cell"))).otherwise(F.struct((a["below"] + c["_n"]).alias("below"), a["cell"].alias("cell")))
        both = rows.join(state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("place").alias("_p"), "_below"), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("place") == F.col("_p")))
        found = both.withColumn("_x", F.aggregate("_cells", start, step)).where("_x.cell is not null")
        return found.select(*keys, "place", F.col("_x.below").alias("_below"), F.col("_x.cell._low").alias("_low"), F.col("_x.cell._high").alias("_high"), F.col("_x.cell._rows").alias("_rows"))

    counted = [F.sum("_w").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    powers = stored(own.groupBy(*keys, _power(F.col("_v")).alias("_bin")).agg(*counted), "powers")  # few rows to a key
    first = asked.withColumn("_below", F.lit(0).cast("long"))
    p, a = powers.alias("p"), asked.alias("a")
    on = reduce(lambda x, y: x & y, [F.col(f"p.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys], F.lit(True))
    state = stored(narrowed(p.join(a, on).select("p.*", "a.place"), first), "ranges")
    done = []
    while True:
        # places whose range is one value, or few, are settled; the others are halved on
        one = F.col("_low").eqNullSafe(F.col("_high"))
        done.append(state.where(one).select(*keys, "place", F.col("_low").alias("value")))
        small = state.where(~one & (F.col("_rows") <= few))
        inside = _within(own, small, keys).groupBy(*keys, "place", "_below").agg(F.array_sort(F.collect_list(F.struct("_v", "_w"))).alias("_cells"))
        start = F.struct(F.col("_below").alias("below"), F.lit(None).cast("double").alias("value"))
        step = lambda a, c: F.when(a["value"].isNotNull(), a).when(a["below"] + c["_w"] > F.col("place"), F.struct(a["below"].alias("below"), c["_v"].alias("value"))).otherwise(F.struct((a["below"] + c["_w"]).alias("below"), a["value"].alias("value")))
        done.append(inside.select(*keys, "place", F.aggregate("_cells", start, step)["value"].alias("value")))
        state = stored(state.where(~one & (F.col("_rows") > few)), "ranges")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
        part = F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * bins).cast("int"), F.lit(bins - 1))
        binned = _within(own, state, keys).withColumn("_bin", part).groupBy(*keys, "place", "_bin").agg(*counted)
        state = stored(narrowed(binned, state), "ranges")


def _within(own: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of each place's range: keys, place, _below, _low, _high, _v, _w."""
    other = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "place", "_below", "_low", "_high")
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    return own.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], weight: str | None = None, between: bool = True) -> DataFrame:
    """keys and, for each name in `shares`, the value at that share of the way through the key's rows in order.

    between: places between two rows are interpolated; else the lower row counts. Keys without values have no row.
    """
    keys = list(keys)
    n = F.sum(weight).cast("long") if weight else F.count("*")
    sizes = stored(rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(n.alias("_all")).where("_all > 0"), "sizes")
    at = {name: F.lit(float(p)) * (F.col("_all") - 1) for name, p in shares.items()}
    low, high = {n: F.floor(x) for n, x in at.items()}, {n: F.ceil(x) for n, x in at.items()}
    places = [x for n in shares for x in ((low[n], high[n]) if between else (low[n],))]
    asked = sizes.withColumn("place", F.explode(F.array_distinct(F.array(*places))))
    found = select_ranks(rows, keys, value, asked, weight)
    lists = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("_m"))  # a few places to a key
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    out = sizes.join(lists.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_m"), on)
    get = lambda c: F.try_element_at("_m", c)

    def pick(name: str) -> Column:
        if not between:
            return get(low[name])
        return F.when(low[name] == high[name], get(low[name])).otherwise((high[name] - at[name]) * get(low[name]) + (at[name] - low[name]) * get(high[name]))

    return out.select(*keys, *[pick(n).alias(n) for n in shares])


def ordered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], place: str = "place") -> DataFrame:
    """`rows` with their place (from 1) in their group by `order`; rows that `order` does not tell apart follow in any order."""
    groups = list(groups)
    by = [*[F.col(g).asc() for g in groups], *order]
    dealt = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    parts = dealt.groupBy(*groups, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    if not groups:
        held = {r["_part"]: r["_n"] for r in parts.collect()}  # one number for each partition
        below, bases = 0, []
        for k in range(max(held, default=-1) + 1):
            bases.append(below)
            below += held.get(k, 0)
        base = F.element_at(F.array(*map(F.lit, bases)).cast("array<bigint>"), part.cast("int") + 1) if bases else F.lit(0).cast("long")
        return dealt.withColumn(place, base + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at")
    # a group has at most one row for each partition
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    other = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_part", "_first", "_below")
    on = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], part == F.col("_part"))
    return dealt.join(other, on).withColumn(place, F.col("_below") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_below", *[f"_g{i}" for i in range(len(groups))])
