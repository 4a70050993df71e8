"""SQL of the models in ``operators.series_fits``: regression by solved normal equations,
autoregression by a self-join of neighbouring months, smoothing by recursion over months."""

from __future__ import annotations

from ..operators.series_fits import WEIGHTS


def sql_fits(source: str, keys: list[str], cut: str, horizon: int, transform: str | None = None, covariate: str | None = None) -> str:
    k = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in keys)
    of = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    year, month = int(cut[:4]), int(cut[5:7])
    first = year * 12 + month
    y = {"log1p": "CASE WHEN y > -1 THEN ln(1 + y) END", "sqrt": "CASE WHEN y >= 0 THEN 2 * (sqrt(y) - 1) END"}.get(transform, "y")
    grid = ", ".join(f"({i}, {a}, {b}, {g})" for i, (a, b, g) in enumerate(WEIGHTS))
    return f"""
WITH RECURSIVE raw_rows AS (SELECT {k}, year(Month) * 12 + month(Month) - {first} AS t, CAST(total AS DOUBLE) AS y, CAST({covariate or 0} AS DOUBLE) AS x FROM {source}
    UNION ALL SELECT DISTINCT {k}, h, NULL, NULL FROM {source}, (SELECT unnest(generate_series(0, {horizon - 1})) AS h)),
merged AS (SELECT {k}, t, max(y) AS y, max(x) AS x FROM raw_rows GROUP BY ALL),
l AS (SELECT {k}, t, CASE WHEN t < 0 THEN {y} END AS y, (t + {first + 1200 - 1}) % 12 AS m,
    coalesce(x, avg(x) OVER (PARTITION BY {k}, (t + {first + 1200 - 1}) % 12), avg(x) OVER (PARTITION BY {k}), 0) AS x FROM merged),
s AS (SELECT {k}, -min(t) FILTER (y IS NOT NULL) AS months, count(y) AS n_values FROM l GROUP BY ALL),
c AS (SELECT *, CASE WHEN y IS NOT NULL THEN t END AS kt, CASE WHEN y IS NOT NULL THEN x END AS kx FROM l),
d AS (SELECT *, coalesce(avg(y) OVER g, avg(y) OVER r) AS my, t - coalesce(avg(kt) OVER g, avg(kt) OVER r) AS ct, x - coalesce(avg(kx) OVER g, avg(kx) OVER r) AS cx
    FROM c WINDOW g AS (PARTITION BY {k}, m), r AS (PARTITION BY {k})),
sums AS (SELECT {k}, sum(ct * ct) AS tt, sum(ct * (y - my)) AS ty, sum(cx * cx) AS xx, sum(ct * cx) AS tx, sum(cx * (y - my)) AS xy, count(*) AS n, count(DISTINCT m) AS seasons FROM d WHERE y IS NOT NULL GROUP BY ALL),
lines AS (SELECT *, CASE WHEN tt > 0 THEN xx - tx * tx / tt ELSE xx END > 1e-9 * xx AND xx > 0 AS two FROM sums),
coefs AS (SELECT *, CASE WHEN two AND tt > 0 THEN (xy * tt - ty * tx) / (tt * xx - tx * tx) WHEN two THEN xy / xx ELSE 0 END AS cb FROM lines),
fitted AS (SELECT d.*, seasons + CAST(tt > 0 AS INTEGER) + CAST(two AS INTEGER) AS p, e.n,
    my + cb * cx + CASE WHEN tt > 0 THEN (ty - cb * tx) / tt ELSE 0 END * ct AS fit FROM d JOIN coefs e ON {same("d", "e")}),
rests AS (SELECT *, y - fit AS r FROM fitted),
near AS (SELECT {of("b")}, a.r AS a, b.r AS b FROM rests a JOIN rests b ON {same("a", "b")} AND a.t = b.t + 1 WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
phis AS (SELECT {k}, CASE WHEN sum(b * b) > 0 THEN greatest(least(sum(a * b) / sum(b * b), 0.95), -0.95) ELSE 0 END AS phi FROM near GROUP BY ALL),
noises AS (SELECT {of("p")}, any_value(phi) AS phi, stddev_pop(a - phi * b) AS noise FROM near n JOIN phis p ON {same("n", "p")} GROUP BY {of("p")}),
ends AS (SELECT {k}, arg_max(r, t) AS last, max(t) AS seen_at, sum(r * r) AS q FROM rests WHERE r IS NOT NULL GROUP BY ALL),
lin AS (SELECT {of("f")}, f.t, fit, sqrt(q / greatest(n - p, 1)) AS plain, coalesce(phi, 0) AS phi, coalesce(noise, sqrt(q / n)) AS noise, last, f.t - seen_at AS steps
    FROM fitted f JOIN ends e ON {same("f", "e")} LEFT JOIN noises o ON {same("f", "o")} WHERE f.t BETWEEN 0 AND {horizon - 1}),
changes AS (SELECT {of("a")}, stddev_pop(a.y - b.y) AS sd FROM l a JOIN l b ON {same("a", "b")} AND a.t = b.t + 12 AND a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL),
spreads AS (SELECT {k}, stddev_pop(y) AS sd FROM l GROUP BY ALL),
latest AS (SELECT {k}, m, max(t) AS seen_at, arg_max(y, t) AS y FROM l WHERE y IS NOT NULL GROUP BY ALL),
naive AS (SELECT {of("h")}, h.t, z.y AS mean, coalesce(c.sd, v.sd) * sqrt((h.t - z.seen_at) / 12) AS sd FROM l h LEFT JOIN latest z ON {same("h", "z")} AND h.m = z.m
    LEFT JOIN changes c ON {same("h", "c")} JOIN spreads v ON {same("h", "v")} WHERE h.t BETWEEN 0 AND {horizon - 1}),
long AS (SELECT {k}, months FROM s WHERE months >= 24),
cells AS (SELECT {of("g")}, g.i, months, l.y FROM (SELECT {k}, months, unnest(generate_series(0, months - 1)) AS i FROM long) g LEFT JOIN l ON {same("g", "l")} AND l.t = g.i - g.months),
begun AS (SELECT {k}, any_value(months) AS months, avg(y) FILTER (i < 12) AS one, avg(y) FILTER (i >= 12 AND i < 24) AS two,
    list(coalesce(y, 0) ORDER BY i) FILTER (i < 12) AS ys, list(CAST(y IS NOT NULL AS INTEGER) ORDER BY i) FILTER (i < 12) AS seen FROM cells GROUP BY {k}),
run AS (
    SELECT {k}, months, w.*, 0 AS i, one AS lev, (two - one) / 12 AS tr, list_transform(generate_series(1, 12), lambda j: CASE WHEN seen[j] = 1 THEN ys[j] - one ELSE 0.0 END) AS q,
        0.0::DOUBLE AS sse, 0.0::DOUBLE AS se, 0 AS n FROM begun, (VALUES {grid}) w(o, a, b, g) WHERE one IS NOT NULL AND two IS NOT NULL
    UNION ALL
    SELECT {of("r")}, r.months, o, a, b, g, r.i + 1,
        CASE WHEN y IS NULL THEN lev + tr ELSE a * (y - q[1]) + (1 - a) * (lev + tr) END,
        CASE WHEN y IS NULL THEN tr ELSE b * (a * (y - q[1]) + (1 - a) * (lev + tr) - lev) + (1 - b) * tr END,
        list_append(q[2:], CASE WHEN y IS NULL THEN q[1] ELSE g * (y - (a * (y - q[1]) + (1 - a) * (lev + tr))) + (1 - g) * q[1] END),
        sse + CASE WHEN y IS NULL OR r.i < 12 THEN 0 ELSE (y - lev - tr - q[1]) * (y - lev - tr - q[1]) END,
        se + CASE WHEN y IS NULL OR r.i < 12 THEN 0 ELSE y - lev - tr - q[1] END,
        n + CASE WHEN y IS NULL OR r.i < 12 THEN 0 ELSE 1 END
    FROM run r JOIN cells ON {same("r", "cells")} AND cells.i = r.i),
best AS (SELECT * FROM run WHERE i = months QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY sse, o) = 1),
smooth AS (SELECT {k}, h AS t, lev + (h + 1) * tr + q[1 + h % 12] AS mean, sqrt(greatest(sse / n - (se / n) * (se / n), 0)) * sqrt(1 + h * a * a) AS sd
    FROM best, (SELECT unnest(generate_series(0, {horizon - 1})) AS h)),
heads AS (SELECT s.*, h AS t, model FROM s, (SELECT unnest(generate_series(0, {horizon - 1})) AS h), (SELECT unnest(['a', 'e', 's', 't']) AS model)),
told AS (SELECT h.*, CASE model WHEN 'a' THEN fit + last * power(phi, steps) WHEN 't' THEN fit WHEN 's' THEN v.mean ELSE o.mean END AS mean,
        CASE model WHEN 'a' THEN noise * sqrt((1 - power(phi, 2 * steps)) / (1 - phi * phi)) WHEN 't' THEN plain WHEN 's' THEN v.sd ELSE o.sd END AS sd
    FROM heads h LEFT JOIN lin i ON {same("h", "i")} AND h.t = i.t LEFT JOIN naive v ON {same("h", "v")} AND h.t = v.t LEFT JOIN smooth o ON {same("h", "o")} AND h.t = o.t),
marked AS (SELECT *, CASE WHEN n_values < 3 THEN 'too few values' WHEN model = 's' AND months < 13 THEN 'less than 13 months'
        WHEN model = 'e' AND NOT EXISTS (SELECT 1 FROM best x WHERE {same("x", "told")}) THEN 'less than 24 months'
        WHEN min(CAST(mean IS NOT NULL AND sd IS NOT NULL AND isfinite(mean) AND isfinite(sd) AS INTEGER)) OVER (PARTITION BY {k}, model) = 0 THEN 'not finite' ELSE 'ok' END AS status FROM told)
SELECT {k}, CAST(DATE '{cut}' + to_months(CAST(t AS INTEGER)) AS DATE) AS Month, model, CASE WHEN status = 'ok' THEN mean END AS mean, CASE WHEN status = 'ok' THEN sd END AS sd, status FROM marked
"""
