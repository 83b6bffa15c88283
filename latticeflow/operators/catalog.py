"""Selections, sums and set operations on tracer catalogues."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.functions.scalars import EDGE_DENSITY

WEIGHTS = ("weight_fkp", "weight_cp", "weight_noz", "weight_systot", "weight_all_nofkp", "veto", "comp")


def conform(catalogue: DataFrame) -> DataFrame:
    """``catalogue`` with lower-case names, ``z`` read as redshift where the sky position is given, and missing weights 1."""
    out = catalogue.toDF(*(c.lower() for c in catalogue.columns))
    if {"ra", "dec", "z"} <= set(out.columns) and "redshift" not in out.columns:
        out = out.withColumnRenamed("z", "redshift")
    if "redshift" in out.columns:
        out = out.withColumn("redshift", F.col("redshift").cast("double"))
    if "comp" not in out.columns and "comp_boss" in out.columns:
        out = out.withColumnRenamed("comp_boss", "comp")
    missing = {w: F.lit(1.0) for w in WEIGHTS if w not in out.columns}
    return out.withColumns(missing) if missing else out


def survey_cut(catalogue: DataFrame, low: float, high: float) -> DataFrame:
    """Unvetoed rows strictly between two redshifts."""
    return catalogue.where((F.col("veto") == 1) & (F.col("redshift") > low) & (F.col("redshift") < high))


def unvetoed(catalogue: DataFrame) -> DataFrame:
    """Rows that no mask vetoes, whatever their redshift."""
    return catalogue.where(F.col("veto") == 1)


def weighted_only(catalogue: DataFrame, weight: str = "weight_systot") -> DataFrame:
    return catalogue.where(F.col(weight) > 0)


def redshift_trim(catalogue: DataFrame, low: float, high: float) -> DataFrame:
    """Strict trim, but only if some row lies outside the closed range: bounds are kept otherwise."""
    z = F.col("redshift")
    outside = catalogue.agg(F.max(((z < low) | (z > high)).cast("int")).alias("some_outside"))
    return catalogue.join(F.broadcast(outside), how="cross").where((F.coalesce("some_outside", F.lit(0)) == 0) | ((z > low) & (z < high))).drop("some_outside")


def extents(catalogue: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return catalogue.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def mean_weights(tracers: DataFrame, randoms: DataFrame, w_tracer: Column, w_random: Column, cells: int) -> DataFrame:
    """``(sum_gal, sum_ran, alpha, ran_min)``: the ratio of summed weights, and a hundredth of the mean random weight a cell."""
    g = tracers.agg(F.sum(w_tracer).alias("sum_gal"))
    r = randoms.agg(F.sum(w_random).alias("sum_ran"))
    return g.join(F.broadcast(r), how="cross").select("sum_gal", "sum_ran", (F.col("sum_gal") / F.col("sum_ran")).alias("alpha"), (0.01 * F.col("sum_ran") / cells).alias("ran_min"))


def equal_volume_bins(r_low: float, r_high: float, bins: int) -> list[float]:
    """Distances that cut a shell into shells of equal volume."""
    step = (r_high**3 - r_low**3) / bins
    return [(r_low**3 + i * step) ** (1.0 / 3) for i in range(bins)] + [r_high]


def radial_counts(catalogue: DataFrame, r: str, edges: list[float]) -> DataFrame:
    """``(bin, low, high, n)`` with every bin, the last one closed: an interval join to a table of fixed size."""
    spark = catalogue.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    inside = (F.col(r) >= F.col("low")) & ((F.col(r) < F.col("high")) | ((F.col("bin") == len(edges) - 2) & (F.col(r) == F.col("high"))))
    counted = catalogue.select(r).join(F.broadcast(table), inside).groupBy("bin").agg(F.count("*").alias("n"))
    return table.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def selection_function(counts: DataFrame, mean_density: float, f_sky: float) -> DataFrame:
    """Density of each bin over the mean density."""
    volume = f_sky * 4 * math.pi / 3 * (F.pow("high", 3) - F.pow("low", 3))
    return counts.withColumn("f", F.col("n") / volume / mean_density)


def numbered(catalogue: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Distinct rows in lexicographic order of ``by``, with ``particle`` counting from 0.

    Ranks come from a range partitioning and counts per partition, so the order is total
    without any single task seeing all rows.
    """
    rows = catalogue.dropDuplicates(list(by)).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    from latticeflow.operators.stage import kept

    rows = kept(rows)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    return rows.withColumn("__k", rank).join(F.broadcast(before), "__part").withColumn("particle", (F.col("__k") + F.col("__before")).cast("long")).drop("__part", "__k", "__before")


def border_flags(edges: DataFrame, particles: DataFrame) -> DataFrame:
    """``particles (id, is_mock)`` with ``is_edge``: a mock neighbour, or fewer than four neighbours."""
    near = edges.join(particles.select(F.col("id").alias("dst"), F.col("is_mock").alias("near_mock")), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_adj"), F.max("near_mock").alias("near_mock"))
    flag = F.coalesce(F.col("near_mock"), F.lit(False)) | (F.coalesce(F.col("n_adj"), F.lit(0)) < 4)
    return particles.join(near, "id", "left").select(*particles.columns, F.coalesce("n_adj", F.lit(0)).alias("n_adj"), flag.alias("is_edge"))


def guarded_volume(volume: Column) -> Column:
    return F.when((volume < 1e-30) | (volume > 1e30), F.lit(1.0)).otherwise(volume)


def reweighted_volume(volume: Column, is_edge: Column, density_ratio: float, selection: Column | None = None, weight: Column | None = None, completeness: Column | None = None) -> Column:
    """Cell volumes in units of the mean per tracer, corrected for selection; edge cells stay as they are."""
    out = volume * density_ratio
    out = out * selection if selection is not None else out
    out = out / weight if weight is not None else out
    out = out * completeness if completeness is not None else out
    return F.when(is_edge, volume).otherwise(out)


def assert_positive(volumes: DataFrame, volume: str = "volume", is_edge: str = "is_edge") -> None:
    """Raises if an inner cell has no volume."""
    bad = volumes.where(~F.col(is_edge) & (F.col(volume) == 0)).limit(1).count()
    if bad:
        raise ValueError("a cell inside the survey has zero volume")


def edge_density(density: Column, is_edge: Column) -> Column:
    return F.when(is_edge, F.lit(EDGE_DENSITY)).otherwise(density)


def top(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The ``n`` largest values, ties in the original order."""
    return rows.orderBy(F.desc(value), F.asc(order)).limit(n)
