"""Order-dependent building blocks that stay distributed when one key holds most rows.

A window over a key sorts all its rows in one task. Here every key is cut in
slices of its order column; windows run inside a slice, and only one small row
per slice is ordered across slices. Slices are functions of the row itself, so
any recomputed task gives the same cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talentloom.functions.values import let


def next_in_order(df: DataFrame, keys: list[str], slice_: Column, order: list[str], values: list[str],
                  prefix: str = "next_") -> DataFrame:
    """Add ``next_<value>`` columns: the values of the following row per key, null at the end of a key.

    ``slice_`` must grow with ``order``.
    """
    cut = df.withColumn("_slice", slice_)
    here = Window.partitionBy(*keys, "_slice").orderBy(*order)
    row = F.struct(*values)
    heads = cut.groupBy(*keys, "_slice").agg(F.min_by(row, F.struct(*order)).alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    following = heads.select(*keys, "_slice", F.lead("_head").over(across).alias("_next_head"))
    following = following.select(*[F.col(c).alias(f"_at_{c}") for c in (*keys, "_slice")], "_next_head")
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*keys, "_slice")]  # null keys and null places in the order are values too
    joined = cut.withColumn("_next", F.lead(row).over(here)).join(following, same, "inner")
    found = F.coalesce("_next", "_next_head")
    return joined.select(*df.columns, *[found[v].alias(f"{prefix}{v}") for v in values])


#: Slices of a key at most, and how many of their bounds are passed over at once in looking up the slice of a value.
SLICES, STRIDE = 1024, 32
#: Values of a key that its bounds are drawn from, about; slices differ in size by that, results do not.
DRAWN = 16_384


def equal_slices(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``_slice``: which of up to ``SLICES`` stretches of about equally many distinct values of its key a value lies in.

    The bounds are values drawn by their hash, all of them where a key has few. So they do not depend on the order in which tasks end, as those of a
    merged summary do: a histogram of the slices and the rows of the slices come from two passes, which must cut alike. Each value looks its slice up
    in two steps. Null keys go.
    """
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("_distinct"))
    place_of_hash = F.pmod(F.xxhash64(value), F.lit(1 << 40)).cast("double") / (1 << 40)
    drawn = F.when(place_of_hash < F.lit(float(DRAWN)) / F.col("_distinct"), F.col(value))
    bounds = counts.join(sizes, keys, "inner").groupBy(*keys).agg(F.array_sort(F.collect_list(drawn)).alias("_drawn"))
    step = F.ceil(F.size("_drawn") / SLICES)
    bounds = bounds.select(*keys, F.filter("_drawn", lambda v, k: k % step == 0).alias("_bounds"))
    bounds = bounds.withColumn("_marks", F.filter("_bounds", lambda b, k: k % STRIDE == 0))
    here = F.col(value)
    start = F.greatest(F.size(F.filter("_marks", lambda b: b < here)) - 1, F.lit(0)) * STRIDE
    place = let(start, lambda at: at + F.size(F.filter(F.slice("_bounds", at + 1, STRIDE), lambda b: b < here)))
    return counts.join(bounds, keys, "inner").withColumn("_slice", place.cast("bigint")).drop("_bounds", "_marks")


def value_positions(df: DataFrame, keys: list[str], value: str, width: float | None = None, weight: str | None = None) -> DataFrame:
    """Per key and distinct value: ``n`` rows, ``below`` rows with a smaller value, ``total`` rows of the key.

    ``weight`` is a column of row counts when the input is counted already.
    Equal values are counted before the first shuffle. The counts are ordered
    inside slices, of equal depth unless a ``width`` is given; a histogram of the
    slices gives each its offset.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    )
    counts = equal_slices(counts, keys, value) if width is None else counts.withColumn("_slice", F.floor(F.col(value) / width).cast("bigint"))
    coarse = counts.groupBy(*keys, "_slice").agg(F.sum("n").alias("_slice_n"))
    by_key = Window.partitionBy(*keys)
    coarse = coarse.select(
        *keys, "_slice",
        (F.sum("_slice_n").over(by_key.orderBy("_slice")) - F.col("_slice_n")).alias("_base"),
        F.sum("_slice_n").over(by_key).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    return (
        counts.join(coarse, [*keys, "_slice"], "inner")
        .withColumn("below", F.col("_base") + F.sum("n").over(inside) - F.col("n"))
        .select(*keys, value, "n", "below", "total")
    )


def running_sum(counts: DataFrame, keys: list[str], value: str, term: str, to: str) -> DataFrame:
    """Add ``to``: the sum of a term over the rows of a key up to each value, from rows of distinct values per key."""
    cut = equal_slices(counts, keys, value)
    coarse = cut.groupBy(*keys, "_slice").agg(F.sum(term).alias("_slice_sum"))
    before = F.sum("_slice_sum").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_slice_sum")
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    summed = cut.join(coarse.select(*keys, "_slice", before.alias("_base")), [*keys, "_slice"], "inner")
    return summed.withColumn(to, F.col("_base") + F.sum(term).over(inside)).drop("_slice", "_base")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], width: float | None = None,
                    weight: str | None = None) -> DataFrame:
    """Interpolated quantiles per key, one column per entry of ``probs``, and ``n_rows``.

    Same result as ``percentile``, which keeps all distinct values of a group in
    one task; here no task holds more than a slice.
    """
    places = value_positions(df, keys, value, width, weight)
    total, below, n = F.col("total"), F.col("below"), F.col("n")

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position < below + n), F.col(value)))

    aggs = [F.max("total").alias("n_rows")]
    for name, p in probs.items():
        spot = F.lit(float(p)) * (total - 1)
        aggs += [at(F.floor(spot)).alias(f"_{name}_lo"), at(F.ceil(spot)).alias(f"_{name}_hi")]
    out = places.groupBy(*keys).agg(*aggs)

    def blend(name: str, p: float) -> Column:
        spot = F.lit(float(p)) * (F.col("n_rows") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return lo + (hi - lo) * (spot - F.floor(spot))

    return out.select(*keys, "n_rows", *[blend(name, p).alias(name) for name, p in probs.items()])
