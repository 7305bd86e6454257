"""Temporal queries on ``events``: a user's events in order are that user's frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import frames as T
from tessera.operators import histogram as H
from tessera.plans.common import IMG, images, table
from tessera.plans.registry import register

K, O = ["user_id"], ["ts", "event_id"]
_EV = lambda s, d: table(s, d, "events").select("event_id", "user_id", "ts", F.round("value", 6).alias("v"))
_E = "e AS (SELECT event_id, user_id, ts, round(value, 6) AS v FROM events)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_r = lambda c: F.round(c, 5).alias(c)
register("frame_diff", lambda s, d: T.frame_difference(_EV(s, d), K, O, "v").select("event_id", _r("diff")), f"WITH {_E}, f AS (SELECT event_id, abs(v - lag(v) OVER w) AS diff FROM e {_W}) SELECT event_id, round(diff, 5) AS diff FROM f WHERE diff IS NOT NULL")
register("three_frame_diff", lambda s, d: T.three_frame_difference(_EV(s, d), K, O, "v").select("event_id", _r("diff")), f"WITH {_E}, f AS (SELECT event_id, v, lag(v) OVER w AS p, lead(v) OVER w AS n FROM e {_W}) SELECT event_id, round(least(abs(v - p), abs(n - v)), 5) AS diff FROM f WHERE p IS NOT NULL AND n IS NOT NULL")
register("moving_avg", lambda s, d: T.moving_average(_EV(s, d), K, O, "v", 5).select("event_id", _r("mean")), f"WITH {_E} SELECT event_id, round(avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS mean FROM e")
register("smooth_trajectory", lambda s, d: T.smooth(_EV(s, d), K, O, "v", 3).select("event_id", _r("smooth")), f"WITH {_E} SELECT event_id, round(avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS smooth FROM e")
register("cumulative_path", lambda s, d: T.cumulative_path(_EV(s, d), K, O, "v").select("event_id", _r("path")), f"WITH {_E} SELECT event_id, round(sum(v) OVER w, 5) AS path FROM e {_W}")
_N = "n AS (SELECT *, row_number() OVER w AS i FROM e {w})".format(w=_W)
register("ema", lambda s, d: T.ema(_EV(s, d), K, O, "v", 0.25).select("event_id", _r("ema")), f"WITH RECURSIVE {_E}, {_N}, r AS (SELECT user_id, i, event_id, v AS ema FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, r.ema + 0.25 * (n.v - r.ema) FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) SELECT event_id, round(ema, 5) AS ema FROM r")
register("kalman_1d", lambda s, d: T.kalman_1d(_EV(s, d), K, O, "v", 0.01, 1.0).select("event_id", _r("filtered")), f"WITH RECURSIVE {_E}, {_N}, r AS (SELECT user_id, i, event_id, v AS x, 1.0::DOUBLE AS p FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, r.x + (r.p + 0.01) / (r.p + 1.01) * (n.v - r.x), (1 - (r.p + 0.01) / (r.p + 1.01)) * (r.p + 0.01) FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) SELECT event_id, round(x, 5) AS filtered FROM r")
_NEXT = "r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1"
_KV = "r.a + 2 * r.b + r.c + 0.01"  # the predicted variance of the place; a, b, c: variances of place, both, speed
register("kalman_velocity", lambda s, d: T.kalman_velocity(_EV(s, d), K, O, "v", 0.01, 1.0).select("event_id", _r("filtered")), f"WITH RECURSIVE {_E}, {_N}, r AS (SELECT user_id, i, event_id, v AS x, 0.0::DOUBLE AS speed, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, r.x + r.speed + ({_KV}) / ({_KV} + 1) * (n.v - r.x - r.speed), r.speed + (r.b + r.c) / ({_KV} + 1) * (n.v - r.x - r.speed), ({_KV}) / ({_KV} + 1), (r.b + r.c) / ({_KV} + 1), r.c + 0.01 - (r.b + r.c) * (r.b + r.c) / ({_KV} + 1) FROM {_NEXT}) SELECT event_id, round(x, 5) AS filtered FROM r")
register("running_background", lambda s, d: T.running_background(_EV(s, d), K, O, "v", 0.125, 20.0).select("event_id", "foreground"), f"WITH RECURSIVE {_E}, {_N}, r AS (SELECT user_id, i, event_id, v AS m, 0 AS foreground FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, r.m + 0.125 * (n.v - r.m), CASE WHEN abs(n.v - r.m) > 20 THEN 255 ELSE 0 END FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) SELECT event_id, foreground FROM r")
_FAR = "(n.v - r.m) * (n.v - r.m) > 6.25::DOUBLE * r.var"
register("gaussian_background", lambda s, d: T.gaussian_background(_EV(s, d), K, O, "v", 0.1, 2.5).select("event_id", "foreground"), f"WITH RECURSIVE {_E}, {_N}, r AS (SELECT user_id, i, event_id, v AS m, 225.0::DOUBLE AS var, 0 AS foreground FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN {_FAR} THEN r.m ELSE r.m + 0.1::DOUBLE * (n.v - r.m) END, CASE WHEN {_FAR} THEN r.var ELSE greatest(4.0::DOUBLE, r.var + 0.1::DOUBLE * ((n.v - r.m) * (n.v - r.m) - r.var)) END, CASE WHEN {_FAR} THEN 255 ELSE 0 END FROM {_NEXT}) SELECT event_id, foreground FROM r")
_UP = "CASE WHEN r.seen > 0 THEN greatest(0.0::DOUBLE, r.up + n.v - r.mean - 5) ELSE 0.0::DOUBLE END"
register("cusum_alarms", lambda s, d: T.cusum(_EV(s, d), K, O, "v", 5.0, 60.0).select("event_id", "alarm"), f"WITH RECURSIVE {_E}, {_N}, r AS (SELECT user_id, i, event_id, 1 AS seen, v AS mean, 0.0::DOUBLE AS up, 0 AS alarm FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN {_UP} > 60 THEN 0 ELSE r.seen + 1 END, CASE WHEN {_UP} > 60 THEN 0 ELSE (r.mean * r.seen + n.v) / (r.seen + 1) END, CASE WHEN {_UP} > 60 THEN 0 ELSE {_UP} END, CASE WHEN {_UP} > 60 THEN 1 ELSE 0 END FROM {_NEXT}) SELECT event_id, alarm FROM r")
register("motion_history", lambda s, d: T.motion_history(_EV(s, d).withColumn("t", F.unix_timestamp("ts").cast("double")), K, O, "t", F.col("v") > 50, 86400.0).select("event_id", "mhi"), f"WITH {_E}, f AS (SELECT event_id, floor(epoch(ts)) AS t, max(CASE WHEN v > 50 THEN floor(epoch(ts)) END) OVER w AS l FROM e {_W}) SELECT event_id, CAST(CASE WHEN l >= t - 86400 THEN l ELSE 0 END AS DOUBLE) AS mhi FROM f")


def _shots(s, d):
    ev = table(s, d, "events").select(F.to_date("ts").alias("frame"), H.bin_of(F.col("value"), 8, 0, 100).alias("b"))
    return T.shot_boundaries(H.histogram(ev, ["frame"], F.col("b"), 8), "frame", "bin", "n", 0.1).select(F.col("frame").cast("string").alias("frame"), F.round("change", 6).alias("change"))


register("shot_boundaries", _shots, "WITH e AS (SELECT CAST(ts AS DATE) AS frame, CAST(greatest(0, least(7, floor(value * 0.08::DOUBLE))) AS INT) AS b FROM events), h AS (SELECT f.frame, k.range AS bin, count(e.b) AS n FROM (SELECT DISTINCT frame FROM e) f CROSS JOIN range(8) k LEFT JOIN e ON e.frame = f.frame AND e.b = k.range GROUP BY ALL), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY frame) AS DOUBLE) AS s FROM h), p AS (SELECT *, lag(s) OVER (PARTITION BY bin ORDER BY frame) AS p FROM s) SELECT CAST(frame AS VARCHAR) AS frame, round(sum(abs(s - p)), 6) AS change FROM p WHERE p IS NOT NULL GROUP BY p.frame HAVING sum(abs(s - p)) > 0.1")
register("as_of_join", lambda s, d: T.as_of(_EV(s, d), _EV(s, d).join(table(s, d, "events").where("event_type = 'purchase'").select("event_id"), "event_id", "left_semi").withColumnRenamed("v", "prior"), K, "ts", ["prior"]).select("event_id", "prior"), f"WITH {_E}, b AS (SELECT user_id, ts, arg_max(v, event_id) AS prior FROM e WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase') GROUP BY 1, 2) SELECT a.event_id, b.prior FROM e a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
register("resample_frames", lambda s, d: T.resample(_EV(s, d), K, "ts", "v", 21600), f"WITH {_E}, l AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, lead(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), ts) AS nx FROM e), g AS (SELECT user_id, v, unnest(range(CAST(ceil(s / 21600.0) AS BIGINT), CAST(ceil(nx / 21600.0) AS BIGINT))) AS k FROM l WHERE nx IS NOT NULL) SELECT user_id, k * 21600 AS tick, v FROM g")
_T = lambda s, d: images(s, d).select((F.col("img_id") % 10).alias("clip"), F.posexplode("img").alias("p", "v")).groupBy("clip", "p")
register("temporal_stats", lambda s, d: _T(s, d).agg(F.floor(F.avg("v") + 0.5).cast("int").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.median("v").alias("mid")), f"WITH {IMG} SELECT CAST(img_id % 10 AS BIGINT) AS clip, y * 8 + x AS p, CAST(floor(avg(v) + 0.5) AS INT) AS mean, min(v) AS low, max(v) AS high, median(v) AS mid FROM img GROUP BY 1, 2")
