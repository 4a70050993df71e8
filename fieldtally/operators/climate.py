"""Rainfall by area and month from a pixel table, and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import lookup, with_dictionary

# Fixed value: pixel values below this mean no data.
NO_DATA_BELOW = -9000.0


def zonal_rainfall(pixels: DataFrame, polygon_cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """Mean of valid pixels per polygon and month for all months at once.

    ``pixels`` has ``cell, year, month, value``; ``polygon_cells`` says which
    cells lie in which polygon ``id``; ``polygons`` has ``id``,
    ``centroid_cell`` and any names. Polygons without a valid pixel take the
    pixel under their centroid; ``fill_method`` tells which.
    """
    good = pixels.withColumn("value", F.when(F.col("value") >= NO_DATA_BELOW, F.col("value")))
    zonal = (
        good.join(polygon_cells.select("id", "cell"), "cell")
        .groupBy("id", "year", "month")
        .agg(F.avg("value").alias("_mean"), F.count("value").alias("_n"))
    )
    calendar = pixels.agg(F.collect_set(F.struct("year", "month"))).scalar()
    at_centre = good.select(F.col("cell").alias("centroid_cell"), "year", "month", F.col("value").alias("_centre"))
    frame = polygons.withColumn("_t", F.explode(calendar)).select(
        *polygons.columns, F.col("_t.year").alias("year"), F.col("_t.month").alias("month")
    )
    inside = F.col("_n") > 0
    return (
        frame.join(zonal, ["id", "year", "month"], "left")
        .join(at_centre, ["centroid_cell", "year", "month"], "left")
        .select(
            *[c for c in polygons.columns if c != "centroid_cell"],
            "year",
            "month",
            F.when(inside, F.col("_mean")).otherwise(F.col("_centre")).alias("mean_rain"),
            F.coalesce("_n", F.lit(0)).alias("valid_pixels"),
            F.when(inside, "zonal").otherwise("centroid").alias("fill_method"),
        )
    )


def flat_rainfall(rain: DataFrame, source: str = "", level_label: str = "") -> DataFrame:
    """Add the month name and the labels of the run, in report order."""
    first = ["source", "level_label", "year", "month", "month_name"]
    out = (
        rain.withColumn("source", F.lit(source))
        .withColumn("level_label", F.lit(level_label))
        .withColumn("month_name", F.date_format(F.make_date("year", "month", F.lit(1)), "MMM"))
    )
    last = ["mean_rain", "valid_pixels"]
    middle = [c for c in rain.columns if c not in {*first, *last}]
    return out.select(*first, *middle, *last)


def annual_means(rain: DataFrame) -> DataFrame:
    return rain.groupBy("id", "year").agg(F.avg("mean_rain").alias("mean_rain"))


def anomalies(annual: DataFrame) -> DataFrame:
    """Distance of each year from the polygon's mean over years, in units and
    in SDs (0 where the SD is 0 or unknown)."""
    w = W.partitionBy("id")  # one row per year
    sd = F.stddev_samp("mean_rain").over(w)
    gap = F.col("mean_rain") - F.avg("mean_rain").over(w)
    return annual.withColumns({"anomaly": gap, "anomaly_z": F.when(sd > 0, gap / sd).otherwise(F.lit(0.0))})


def monthly_stats(rain: DataFrame) -> DataFrame:
    v = F.col("mean_rain")
    return (
        rain.filter(v.isNotNull())
        .groupBy("year", "month")
        .agg(
            F.round(F.avg(v), 1).alias("mean_mm"),
            F.round(F.stddev_samp(v), 1).alias("sd_mm"),
            F.round(F.min(v), 1).alias("min_mm"),
            F.round(F.max(v), 1).alias("max_mm"),
            F.count(v).alias("valid_areas"),
        )
    )


def monthly_by_parent(rain: DataFrame) -> DataFrame:
    return (
        rain.filter(F.col("mean_rain").isNotNull())
        .groupBy("month", "parentName")
        .agg(F.avg("mean_rain").alias("mean_rain"))
    )


def monthly_band(rain: DataFrame) -> DataFrame:
    """Mean per month with one SD around it, not below 0."""
    m, s = F.col("mean_mm"), F.col("sd_mm")
    return (
        rain.groupBy("month")
        .agg(F.avg("mean_rain").alias("mean_mm"), F.stddev_samp("mean_rain").alias("sd_mm"))
        .withColumns({"ymin": F.when(s.isNotNull(), F.greatest(m - s, F.lit(0.0))), "ymax": m + s})
    )


def reference_bands(rain: DataFrame, by_month: bool = False) -> DataFrame:
    """Yearly (or year by month) means with the mean over years and bands of
    one and two SDs, not below 0. The SD of a single year is 0."""
    keys = ["year", "month"] if by_month else ["year"]
    means = rain.filter(F.col("mean_rain").isNotNull()).groupBy(*keys).agg(F.avg("mean_rain").alias("mean_mm"))
    w = W.partitionBy("month") if by_month else W.partitionBy(F.lit(1))  # one row per year
    out = means.withColumns(
        {
            "ref_mean": F.avg("mean_mm").over(w),
            "ref_sd": F.coalesce(F.stddev_samp("mean_mm").over(w), F.lit(0.0)),
        }
    )
    m, s = F.col("ref_mean"), F.col("ref_sd")
    floor0 = lambda c: F.greatest(c, F.lit(0.0))
    return out.withColumns({"ymin": floor0(m - s), "ymax": m + s, "ymin2": floor0(m - 2 * s), "ymax2": m + 2 * s})


def attach_rainfall(facts: DataFrame, rain: DataFrame, area_col: str) -> DataFrame:
    """Rainfall of the area and month of each fact row; the average over all
    areas for every row when no area name matches at all."""
    by_area = rain.select(
        F.col("name").alias(area_col), F.col("year").alias("_y"), F.col("month").alias("_m"), "mean_rain"
    )
    national = rain.groupBy((F.col("year") * 12 + F.col("month")).alias("_at")).agg(F.avg("mean_rain").alias("_nat"))
    national = lookup(national, "_at", "_nat")
    keyed = facts.withColumns({"_y": F.year("Month"), "_m": F.month("Month")})
    seen = keyed.select(area_col, "_y", "_m").distinct()
    n_match = (
        seen.join(by_area.filter(F.col("mean_rain").isNotNull()), [area_col, "_y", "_m"], "left_semi")
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    return (
        with_dictionary(keyed, by_area, [area_col, "_y", "_m"])
        .withColumn("_nat", F.try_element_at(national, F.col("_y") * 12 + F.col("_m")))
        .withColumn("mean_rain", F.when(n_match > 0, F.col("mean_rain")).otherwise(F.col("_nat")))
        .drop("_y", "_m", "_nat")
    )


def rainfall_lags(rain: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rainfall of earlier rows of the same area."""
    w = W.partitionBy("id").orderBy("year", "month")  # one row per month
    return rain.withColumns({f"rain_lag{k}": F.lag("mean_rain", k).over(w) for k in lags})
