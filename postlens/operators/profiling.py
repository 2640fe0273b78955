"""Profiling: summary statistics, null counts, distinct counts, histograms,
binned density, pair bins and grouped means.  Every operator is one
aggregate (partial + final) whose output is bounded by its parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

_SQRT_2PI = math.sqrt(2.0 * math.pi)


def summary_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count / mean / stddev (sample) / min / max per column, in long form
    (column_name, n, mean, stddev, min_value, max_value).

    Numeric and string columns only (timestamp and boolean columns are
    skipped, as ``describe`` does).  mean/stddev are null for strings.
    min/max are rendered as strings.  One pass: a single global aggregate
    over all columns, then an unpivot of its one row.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or df.columns)
            if isinstance(types[c], (NumericType, StringType))]
    aggs = []
    for i, c in enumerate(cols):
        num = isinstance(types[c], NumericType)
        aggs += [
            F.count(c).alias(f"n{i}"),
            (F.avg(c) if num else F.lit(None).cast("double")).alias(f"a{i}"),
            (F.stddev_samp(c) if num else F.lit(None).cast("double")).alias(f"s{i}"),
            F.min(c).cast("string").alias(f"lo{i}"),
            F.max(c).cast("string").alias(f"hi{i}"),
        ]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"),
                     F.col(f"s{i}").alias("stddev"), F.col(f"lo{i}").alias("min_value"),
                     F.col(f"hi{i}").alias("max_value"))
            for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row, one bigint column per input column: its number of nulls."""
    return df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in (cols or df.columns)])


def distinct_count(df: DataFrame, col: str, approx: bool = False, name: str = "n_distinct") -> DataFrame:
    """Exact (or HyperLogLog++ approximate) number of distinct values."""
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(f.cast("bigint").alias(name))


def group_distinct_count(df: DataFrame, by: str, col: str = "post_id", name: str = "n_distinct") -> DataFrame:
    """Distinct ``col`` per group of ``by``.  Spark plans a single distinct
    aggregate as two aggregations keyed by (by, col) then by ``by``, so a hot
    group is spread over tasks by its distinct values first."""
    return df.groupBy(by).agg(F.count_distinct(col).cast("bigint").alias(name))


def non_null_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows where ``col`` is present (the filter reaches the scan)."""
    return df.where(F.col(col).isNotNull())


def histogram(df: DataFrame, col: str, width: float | None = None, lo: float = 0.0,
              bins: int | None = None) -> DataFrame:
    """Equal-width bin counts: bin = floor((x - lo) / width); nulls skipped.
    (bin, bin_lo, bin_hi, n).

    With ``bins`` instead of ``width``, the range comes from one min/max
    aggregate (two numbers to the driver) and is cut into ``bins`` bins; the
    maximum falls in the last bin."""
    if bins is not None:
        mn, mx = df.agg(F.min(col), F.max(col)).first()
        if mn is None:
            return df.sparkSession.createDataFrame([], "bin bigint, bin_lo double, bin_hi double, n bigint")
        lo, width = float(mn), (float(mx) - float(mn)) / bins or 1.0
        b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
        return (df.where(F.col(col).isNotNull()).select(b.alias("bin"))
                .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
                .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_lo"),
                        (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_hi"), "n"))
    b = F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("bigint")
    return (df.where(F.col(col).isNotNull()).select(b.alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_hi"), "n"))


def kde(df: DataFrame, col: str, bandwidth: float | None = None, step: float | None = None, lo: float | None = None,
        grid: int = 128, margin: float = 3.0) -> DataFrame:
    """Gaussian kernel density on the grid lo + g * step, as (grid, x, density).

    Values are counted per grid cell first (map-side combined).  Every occupied cell
    contributes to every point of the grid, which reaches ``margin`` bandwidths past
    the occupied cells; no contribution is cut.  By default the bandwidth follows
    Scott's rule, sd * n^(-1/5), lo is the minimum, and step divides the range into
    ``grid`` cells.  The work is bounded by the square of the grid's length,
    whatever the number of rows.
    """
    known = df.where(F.col(col).isNotNull())
    n, sd, mn, mx = known.agg(F.count(F.lit(1)), F.stddev_samp(col), F.min(col), F.max(col)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "grid bigint, x double, density double")
    mn, mx = float(mn), float(mx)
    lo = mn if lo is None else lo
    step = step or (mx - mn) / grid or 1.0
    bandwidth = bandwidth or (float(sd) if sd else 0.0) * n ** -0.2 or step
    reach = int(math.ceil(margin * bandwidth / step))
    cell = F.round((F.col(col) - F.lit(lo)) / F.lit(step)).cast("bigint")
    cells = known.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    ends = cells.agg(F.min("cell"), F.max("cell")).first()
    points = F.explode(F.sequence(F.lit(ends[0] - reach).cast("bigint"), F.lit(ends[1] + reach).cast("bigint"))).alias("grid")
    z = (F.col("grid") - F.col("cell")) * F.lit(step) / F.lit(bandwidth)
    dens = F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z)) / F.lit(n * bandwidth * _SQRT_2PI)
    return (cells.select("cell", "n", points).groupBy("grid").agg(dens.alias("density"))
            .select("grid", (F.lit(lo) + F.col("grid") * step).alias("x"), "density"))


def pair_density(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    """2-D equal-width bin counts (bx, by, n) of two columns."""
    bx = F.floor(F.col(x) / F.lit(wx)).cast("bigint").alias("bx")
    by = F.floor(F.col(y) / F.lit(wy)).cast("bigint").alias("by")
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(bx, by)
            .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")))


def pair_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation and row count of two columns."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.corr(x, y).alias("corr"), F.count(F.lit(1)).alias("n"))


def mean_by(df: DataFrame, by: Sequence[str], y: str, z: float = 1.96) -> DataFrame:
    """Mean of ``y`` with a normal-approximation confidence interval per value
    of each column in ``by``, in long form (dimension, value, n, mean, sd,
    ci_lo, ci_hi).  One scan: each row is unpivoted to one row per dimension,
    then a single grouped aggregate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("bigint").alias("value"))
                                for c in by])).alias("d")
    long = df.select(pairs, F.col(y).alias("_y")).select("d.dimension", "d.value", "_y")
    g = long.groupBy("dimension", "value").agg(
        F.count("_y").alias("n"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("sd"))
    half = F.lit(z) * F.col("sd") / F.sqrt(F.col("n"))
    return g.select("dimension", "value", "n", "mean", "sd",
                    (F.col("mean") - half).alias("ci_lo"), (F.col("mean") + half).alias("ci_hi"))


#: Hex digits of an md5 that one replicate's weight is drawn from, and replicates an md5 serves.
DRAW_DIGITS, DRAWS = 5, 6


def poisson_cuts() -> list[int]:
    """Rising cuts of a 20-bit number at which a Poisson(1) variable takes its next value."""
    cuts, mass, k = [], math.exp(-1.0), 0
    below = mass
    while (cut := math.floor(below * 16 ** DRAW_DIGITS)) < 16 ** DRAW_DIGITS - 1:
        cuts.append(cut)
        k += 1
        mass /= k
        below += mass
    return cuts


def poisson_weights(id_col: str, replicates: int, seed: int = 0) -> Column:
    """array<double>: one Poisson(1) weight a replicate, from md5(seed:block:id), so the same row
    has the same weights in every run and partitioning."""
    cuts = poisson_cuts()

    def weight(digits: Column) -> Column:
        u = F.conv(digits, 16, 10).cast("int")
        out = F.lit(float(len(cuts)))
        for k in range(len(cuts) - 1, -1, -1):
            out = F.when(u < cuts[k], F.lit(float(k))).otherwise(out)
        return out

    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1))
    hashes = F.transform(blocks, lambda b: F.md5(F.concat_ws(":", F.lit(seed), b, F.col(id_col)).cast("binary")))
    digits = F.flatten(F.transform(hashes, lambda h: F.array(
        *[F.substring(h, 1 + DRAW_DIGITS * k, DRAW_DIGITS) for k in range(DRAWS)])))
    return F.transform(F.slice(digits, 1, replicates), weight)


def percentile_of(values: Column, q: float) -> Column:
    """Percentile of a sorted array, interpolated between neighbours; null for an empty one."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(values, low + 1), F.try_element_at(values, F.least(low + 2, F.size(values)))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def bootstrap_mean_by(df: DataFrame, by: Sequence[str], y: str, id_col: str, replicates: int = 200,
                      level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean of ``y`` with a resampled percentile interval per value of each column in ``by``:
    (dimension, value, n, mean, ci_lo, ci_hi).

    Poisson bootstrap: in each replicate a row counts Poisson(1) times, drawn from a hash of its
    id, which needs no second scan and no exchange of rows.  The weights and weighted values of
    all replicates are one vector a row, added up by group in a single map-side combined aggregate.  Replicates
    in which a group has no rows are left out of its interval; null ``y`` counts nowhere, rows without
    an id share their weights.
    """
    w = poisson_weights(id_col, replicates, seed)
    rows = df.where(F.col(y).isNotNull()).select(*by, F.col(y).cast("double").alias("_y"), w.alias("_w")) \
        .select(*by, "_y", array_to_vector(F.concat("_w", F.transform("_w", lambda x: x * F.col("_y")))).alias("_v"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("bigint").alias("value"))
                                for c in by])).alias("d")
    sums = rows.select(pairs, "_y", "_v").select("d.dimension", "d.value", "_y", "_v").groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), vector_to_array(Summarizer.sum(F.col("_v"))).alias("_s"))
    means = F.sort_array(F.filter(F.zip_with(
        F.slice("_s", 1, replicates), F.slice("_s", replicates + 1, replicates),
        lambda n, s: F.when(n > 0, s / n)), lambda m: m.isNotNull()))
    tail = (1.0 - level) / 2
    return sums.withColumn("_m", means).select(
        "dimension", "value", "n", "mean", percentile_of(F.col("_m"), tail).alias("ci_lo"),
        percentile_of(F.col("_m"), 1.0 - tail).alias("ci_hi"))
