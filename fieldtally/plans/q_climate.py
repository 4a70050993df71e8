"""Rainfall queries: suppliers stand for pixels, nations for polygons."""

import uuid

from pyspark.sql import functions as F

from ..operators import climate as cl
from ..sources import tables
from ..sources.staging import shared_folder
from . import fixtures as fx
from .fixtures import SQL
from .registry import query

SQL["pixels"] = """
SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS "year", CAST(month(l_shipdate) AS INTEGER) AS "month",
       CASE WHEN (l_suppkey + month(l_shipdate)) % 11 = 0 THEN -9999.0 ELSE avg(l_extendedprice) / 100 END AS "value"
FROM lineitem GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)
"""
# Every sixth nation is smaller than a pixel: it has no cells of its own.
SQL["cells"] = "SELECT 'D' || s_nationkey AS id, s_suppkey AS cell FROM supplier"
SQL["polys"] = """
SELECT 'D' || n_nationkey AS id, n_name AS name, r_name AS parentName, min(s_suppkey) AS centroid_cell
FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL
"""
SQL["rain"] = """
SELECT p.id, name, parentName, m."year", m."month", CASE WHEN z.n > 0 THEN z.v ELSE c."value" END AS mean_rain, coalesce(z.n, 0) AS valid_pixels,
       CASE WHEN z.n > 0 THEN 'zonal' ELSE 'centroid' END AS fill_method
FROM polys p CROSS JOIN (SELECT DISTINCT "year", "month" FROM pixels) m
LEFT JOIN (SELECT id, "year", "month", avg(v) AS v, count(v) AS n FROM (SELECT *, CASE WHEN "value" >= -9000 THEN "value" END AS v FROM pixels) x JOIN cells ON x.cell = cells.cell GROUP BY ALL) z
  ON z.id = p.id AND z."year" = m."year" AND z."month" = m."month"
LEFT JOIN (SELECT cell, "year", "month", CASE WHEN "value" >= -9000 THEN "value" END AS "value" FROM pixels) c ON c.cell = p.centroid_cell AND c."year" = m."year" AND c."month" = m."month"
"""


def rain(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    pixels = (
        li.groupBy(
            F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
        )
        .agg(F.avg("l_extendedprice").alias("p"))
        .select(
            "cell",
            "year",
            "month",
            F.when((F.col("cell") + F.col("month")) % 11 == 0, F.lit(-9999.0)).otherwise(F.col("p") / 100).alias("value"),
        )
    )
    s, n, r = (fx.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    cells = s.select(
        F.concat(F.lit("D"), "s_nationkey").alias("id"), F.col("s_suppkey").alias("cell")
    )
    polys = (
        n.join(r, n.n_regionkey == r.r_regionkey)
        .join(s, s.s_nationkey == n.n_nationkey)
        .groupBy(
            F.concat(F.lit("D"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parentName")
        )
        .agg(F.min("s_suppkey").alias("centroid_cell"))
    )
    return cl.zonal_rainfall(pixels, cells, polys)


@query("zonal_rainfall", "SELECT * FROM rain", nums="mean_rain")
def zonal_rainfall(spark, sf):
    return rain(spark, sf)


@query("write_rainfall", 'SELECT id, "year", "month", mean_rain, 3 AS "level" FROM rain', nums="mean_rain")
def write_rainfall(spark, sf):
    """Rainfall written to the shared folder, read back from two copies as one."""
    path = f"{shared_folder(spark)}/rain-{uuid.uuid4().hex}"
    tables.write_rainfall(rain(spark, sf).select("id", "year", "month", "mean_rain", F.lit(3).alias("level")), path)
    return tables.read_rainfall(spark, [path, path])


@query(
    "flat_rainfall",
    """SELECT 'grid' AS source, 'Level 3' AS level_label, "year", "month", strftime(make_date("year", "month", 1), '%b') AS month_name, id, name, parentName,
       fill_method, mean_rain, valid_pixels FROM rain""",
    nums="mean_rain",
)
def flat_rainfall(spark, sf):
    return cl.flat_rainfall(rain(spark, sf), "grid", "Level 3")


SQL["rain_annual"] = 'SELECT id, "year", avg(mean_rain) AS mean_rain FROM rain GROUP BY ALL'


@query("annual_rainfall", "SELECT * FROM rain_annual", nums="mean_rain")
def annual_rainfall(spark, sf):
    return cl.annual_means(rain(spark, sf))


@query(
    "rainfall_anomalies",
    """SELECT id, "year", mean_rain, mean_rain - avg(mean_rain) OVER w AS anomaly, CASE WHEN stddev_samp(mean_rain) OVER w > 0
       THEN (mean_rain - avg(mean_rain) OVER w) / stddev_samp(mean_rain) OVER w ELSE 0 END AS anomaly_z FROM rain_annual WINDOW w AS (PARTITION BY id)""",
    nums="mean_rain anomaly anomaly_z",
)
def rainfall_anomalies(spark, sf):
    return cl.anomalies(cl.annual_means(rain(spark, sf)))


@query(
    "rainfall_stats",
    """SELECT "year", "month", round(avg(mean_rain), 1) AS mean_mm, round(stddev_samp(mean_rain), 1) AS sd_mm, round(min(mean_rain), 1) AS min_mm,
       round(max(mean_rain), 1) AS max_mm, count(*) AS valid_areas FROM rain WHERE mean_rain IS NOT NULL GROUP BY ALL""",
    nums="mean_mm sd_mm min_mm max_mm",
)
def rainfall_stats(spark, sf):
    return cl.monthly_stats(rain(spark, sf))


@query(
    "rainfall_by_parent",
    'SELECT "month", parentName, avg(mean_rain) AS mean_rain FROM rain WHERE mean_rain IS NOT NULL GROUP BY ALL',
    nums="mean_rain",
)
def rainfall_by_parent(spark, sf):
    return cl.monthly_by_parent(rain(spark, sf))


@query(
    "rainfall_band",
    """SELECT "month", m AS mean_mm, s AS sd_mm, greatest(m - s, 0) AS ymin, m + s AS ymax FROM (
       SELECT "month", avg(mean_rain) AS m, stddev_samp(mean_rain) AS s FROM rain GROUP BY 1)""",
    nums="mean_mm sd_mm ymin ymax",
)
def rainfall_band(spark, sf):
    return cl.monthly_band(rain(spark, sf))


def _bands(keys, part):
    return f"""SELECT *, greatest(ref_mean - ref_sd, 0) AS ymin, ref_mean + ref_sd AS ymax, greatest(ref_mean - 2 * ref_sd, 0) AS ymin2, ref_mean + 2 * ref_sd AS ymax2 FROM (
      SELECT *, avg(mean_mm) OVER ({part}) AS ref_mean, coalesce(stddev_samp(mean_mm) OVER ({part}), 0) AS ref_sd FROM (
        SELECT {keys}, avg(mean_rain) AS mean_mm FROM rain WHERE mean_rain IS NOT NULL GROUP BY ALL))"""


_BN = "mean_mm ref_mean ref_sd ymin ymax ymin2 ymax2"


@query("rainfall_reference_annual", _bands('"year"', ""), nums=_BN)
def rainfall_reference_annual(spark, sf):
    return cl.reference_bands(rain(spark, sf))


@query("rainfall_reference_monthly", _bands('"year", "month"', 'PARTITION BY "month"'), nums=_BN)
def rainfall_reference_monthly(spark, sf):
    return cl.reference_bands(rain(spark, sf), by_month=True)


SQL["cases_by_district"] = "SELECT District, Month, sum(original) AS total FROM fact GROUP BY ALL"


def cases(spark, sf, level):
    return fx.fact(spark, sf).groupBy(level, "Month").agg(F.sum("original").alias("total"))


@query(
    "attach_rainfall",
    """SELECT f.*, mean_rain FROM cases_by_district f LEFT JOIN rain r ON r.name = f.District AND r."year" = year(f.Month) AND r."month" = month(f.Month)""",
    dates="Month",
    nums="total mean_rain",
)
def attach_rainfall(spark, sf):
    return cl.attach_rainfall(cases(spark, sf, "District"), rain(spark, sf), "District")


@query(
    "attach_rainfall_national",
    """SELECT f.*, mean_rain FROM (SELECT "National", Month, sum(original) AS total FROM fact GROUP BY ALL) f
       LEFT JOIN (SELECT "year", "month", avg(mean_rain) AS mean_rain FROM rain GROUP BY ALL) r ON r."year" = year(f.Month) AND r."month" = month(f.Month)""",
    dates="Month",
    nums="total mean_rain",
)
def attach_rainfall_national(spark, sf):
    return cl.attach_rainfall(cases(spark, sf, "National"), rain(spark, sf), "National")


@query(
    "rainfall_lags",
    """SELECT id, "year", "month", mean_rain, lag(mean_rain, 1) OVER w AS rain_lag1, lag(mean_rain, 2) OVER w AS rain_lag2, lag(mean_rain, 3) OVER w AS rain_lag3
       FROM rain WINDOW w AS (PARTITION BY id ORDER BY "year", "month")""",
    nums="mean_rain rain_lag1 rain_lag2 rain_lag3",
)
def rainfall_lags(spark, sf):
    return cl.rainfall_lags(rain(spark, sf).select("id", "year", "month", "mean_rain"))
