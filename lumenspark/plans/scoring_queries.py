"""Scoring and baseline comparison over pairs of rasters and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspark.operators import scoring as S
from lumenspark.operators.raster import overlap
from lumenspark.plans.raster_queries import W, filtered_sql, height
from lumenspark.plans.registry import DEM, dem, query, table

PAIR = f"{DEM}, pa AS (SELECT r, c, CASE WHEN (r * 31 + c * 17) % 23 = 0 THEN 128 WHEN z > 0 THEN 255 ELSE 0 END AS obs, least(1.0, greatest(0.0, 0.5 + z / 20)) AS frac, least(1.0, greatest(0.0, 0.5 + sin(z) / 2)) AS sim FROM dem)"


def pair(spark, sf):
    z = F.col("z")
    half = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + x))
    obs = F.when((F.col("r") * 31 + F.col("c") * 17) % 23 == 0, 128).when(z > 0, 255).otherwise(0)
    return dem(spark, sf).select("r", "c", obs.alias("obs"), half(z / 20).alias("frac"), half(F.sin(z) / 2).alias("sim"))


COUNTS = """co AS (SELECT count_if(obs <> 128)::BIGINT AS n_valid, count_if(obs = 255 AND sim >= 0.5)::BIGINT AS agree_lit, count_if(obs = 0 AND sim < 0.5)::BIGINT AS agree_dark, count_if(obs = 0 AND sim >= 0.5)::BIGINT AS missed, count_if(obs = 255 AND sim < 0.5)::BIGINT AS over,
avg((sim - frac) ** 2) FILTER (WHERE obs <> 128) AS mse, avg(abs(sim - frac)) FILTER (WHERE obs <> 128) AS mae, avg(sim - frac) FILTER (WHERE obs <> 128) AS bias, quantile_cont(abs(sim - frac), 0.99) FILTER (WHERE obs <> 128) AS p99 FROM pa)"""


@query("a4_agreement", f"""WITH {PAIR}, {COUNTS} SELECT n_valid, agree_lit, agree_dark, missed, over, round((agree_lit + agree_dark) / greatest(n_valid, 1), 9) AS pixel_agree, round(agree_dark / greatest(agree_dark + missed + over, 1), 9) AS iou_shadow, round(agree_lit / greatest(agree_lit + missed + over, 1), 9) AS iou_lit,
round(missed / greatest(missed + agree_dark, 1), 9) AS missed_rate, round(over / greatest(over + agree_lit, 1), 9) AS over_rate, round(0.5 * (missed / greatest(missed + agree_dark, 1) + over / greatest(over + agree_lit, 1)), 9) AS ber, round(mse, 9) AS mse, round(sqrt(mse), 9) AS rmse, round(mae, 9) AS mae, round(bias, 9) AS bias, round(p99, 9) AS p99_abs_err FROM co""")
def _(spark, sf):
    out = S.agreement(pair(spark, sf))
    whole = {"n_valid", "agree_lit", "agree_dark", "missed", "over"}
    return out.select(*(F.col(c) if c in whole else F.round(c, 9).alias(c) for c in out.columns))


def _ssim_sql(x: str, y: str, name: str) -> str:
    return f"{name}_p AS (SELECT r, c, {x} AS x, {y} AS y, {x} * {x} AS xx, {y} * {y} AS yy, {x} * {y} AS xy FROM ps), {filtered_sql('x,y,xx,yy,xy', name + '_p', name + '_f')}, {name} AS (SELECT r, c, (2 * x * y + 0.0001) * (2 * (xy - x * y) * 49 / 48 + 0.0009) / ((x * x + y * y + 0.0001) * ((xx - x * x) * 49 / 48 + (yy - y * y) * 49 / 48 + 0.0009)) AS s FROM {name}_f)"


@query("a8_similarity", f"""WITH {PAIR}, hw AS (SELECT count(*)::BIGINT AS h, {W} AS w FROM embeddings), ps AS (SELECT r, c, obs <> 128 AS v, (sim >= 0.5)::INT::DOUBLE AS sb, CASE WHEN obs <> 128 THEN (obs = 255)::INT::DOUBLE ELSE (sim >= 0.5)::INT::DOUBLE END AS ob, sim AS sc, CASE WHEN obs <> 128 THEN frac ELSE sim END AS oc FROM pa),
{_ssim_sql('ob', 'sb', 'sx')}, {_ssim_sql('oc', 'sc', 'sy')}, k AS (SELECT a.i, b.i AS j FROM (SELECT unnest(range(-3, 4)) AS i) a, (SELECT unnest(range(-3, 4)) AS i) b WHERE abs(a.i) + abs(b.i) <= 3),
st AS (SELECT o.r, o.c FROM ps o, k JOIN ps n ON n.r = o.r + k.i AND n.c = o.c + k.j WHERE o.v AND n.v GROUP BY ALL HAVING count(*) = 25)
SELECT count(*)::BIGINT AS n_strict_valid, round(avg(sx.s), 6) AS ssim_binary, round(avg(sy.s), 6) AS ssim_continuous FROM st JOIN sx USING (r, c) JOIN sy USING (r, c)""")
def _(spark, sf):
    out = S.similarity(pair(spark, sf), height(spark, sf), W)
    return out.select("n_strict_valid", F.round("ssim_binary", 6).alias("ssim_binary"), F.round("ssim_continuous", 6).alias("ssim_continuous"))


@query("j5_overlap", f"WITH {DEM}, b AS (SELECT r - 40 AS r, c - 10 AS c, z + 1 AS z FROM dem WHERE r >= 40 AND c >= 10) SELECT a.r, a.c, round(b.z - a.z, 6) AS d FROM dem a JOIN b ON b.r = a.r - 40 AND b.c = a.c - 10")
def _(spark, sf):
    """Two rasters on one grid, joined where they overlap by a shift found from their corners."""
    a = dem(spark, sf)
    b = a.where("r >= 40 and c >= 10").select((F.col("r") - 40).alias("r"), (F.col("c") - 10).alias("c"), (F.col("z") + 1).alias("z2"))
    h = height(spark, sf)
    ar, ac, br, bc, rows, cols = overlap((0.0, 0.0, 20.0, 20.0, h, W), (200.0, -800.0, 20.0, 20.0, h - 40, W - 10))
    inside = a.where((F.col("r") >= ar) & (F.col("r") < ar + rows) & (F.col("c") >= ac) & (F.col("c") < ac + cols))
    moved = b.select((F.col("r") - br + ar).alias("r"), (F.col("c") - bc + ac).alias("c"), "z2")
    return inside.join(moved, ["r", "c"]).select("r", "c", F.round(F.col("z2") - F.col("z"), 6).alias("d"))


METRICS = """me AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS ber, 1 - p_size / 60.0::DOUBLE AS iou_shadow, (p_partkey % 97) / 97.0::DOUBLE AS ssim_continuous, CASE WHEN p_partkey % 41 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice / 2500 END AS mae, (p_partkey % 13) / 13.0::DOUBLE AS p99_abs_err FROM part),
cu AS (SELECT id, ber * (1 + (id % 3 - 1) / 100.0::DOUBLE) AS ber, iou_shadow * (1 + (id % 5 - 2) / 100.0::DOUBLE) AS iou_shadow, ssim_continuous AS ssim_continuous, CASE WHEN id % 82 = 0 THEN 0.5 ELSE mae * 0.99 END AS mae, p99_abs_err + (id % 2) / 50.0::DOUBLE AS p99_abs_err FROM me),
ml AS (SELECT id, unnest(['ber', 'iou_shadow', 'ssim_continuous', 'mae', 'p99_abs_err']) AS metric, unnest([ber, iou_shadow, ssim_continuous, mae, p99_abs_err]) AS v FROM me), cl AS (SELECT id, unnest(['ber', 'iou_shadow', 'ssim_continuous', 'mae', 'p99_abs_err']) AS metric, unnest([ber, iou_shadow, ssim_continuous, mae, p99_abs_err]) AS v FROM cu),
de AS (SELECT ml.id, ml.metric, ml.v AS b, cl.v AS k, CASE WHEN ml.metric IN ('iou_shadow', 'ssim_continuous') THEN 1 ELSE -1 END AS sg FROM ml JOIN cl ON ml.id = cl.id AND ml.metric = cl.metric),
kd AS (SELECT *, CASE WHEN isnan(b) OR isnan(k) THEN CASE WHEN isnan(b) = isnan(k) THEN 'unchanged' ELSE 'regression' END WHEN abs(k - b) <= 1e-10 THEN 'unchanged' WHEN (k - b) * sg > 0 THEN 'improvement' ELSE 'regression' END AS kind FROM de)"""


def metric_tables(spark, sf):
    k, c = F.col("p_partkey"), F.col
    base = table(spark, sf, "part").select(k.alias("id"), (c("p_size") / 50.0).alias("ber"), (1 - c("p_size") / 60.0).alias("iou_shadow"), ((k % 97) / 97.0).alias("ssim_continuous"), F.when(k % 41 == 0, F.lit(float("nan"))).otherwise(c("p_retailprice") / 2500).alias("mae"), ((k % 13) / 13.0).alias("p99_abs_err"))
    i = c("id")
    now = base.select("id", (c("ber") * (1 + (i % 3 - 1) / 100.0)).alias("ber"), (c("iou_shadow") * (1 + (i % 5 - 2) / 100.0)).alias("iou_shadow"), "ssim_continuous", F.when(i % 82 == 0, 0.5).otherwise(c("mae") * 0.99).alias("mae"), (c("p99_abs_err") + (i % 2) / 50.0).alias("p99_abs_err"))
    names = list(S.CORE)
    return S.deltas(S.melt(base, "id", names), S.melt(now, "id", names), "id")


@query("j7_deltas", f"WITH {METRICS} SELECT id, metric, round(b, 9) AS baseline, round(k, 9) AS current, CASE WHEN isnan(b) OR isnan(k) THEN 'NaN'::DOUBLE ELSE round(k - b, 9) END AS delta, CASE WHEN sg > 0 THEN 'higher_is_better' ELSE 'lower_is_better' END AS direction, kind AS classification FROM kd")
def _(spark, sf):
    return metric_tables(spark, sf).select("id", "metric", *(F.round(x, 9).alias(x) for x in ("baseline", "current", "delta")), "direction", "classification")


@query("a9_summaries", f"""WITH {METRICS}, f AS (SELECT metric, CASE WHEN NOT isnan(b) THEN b END AS b, CASE WHEN NOT isnan(k) THEN k END AS k FROM de)
SELECT metric, 'median' AS summary, round(median(b), 9) AS baseline, round(median(k), 9) AS current FROM f GROUP BY metric UNION ALL SELECT metric, 'mean', round(avg(b), 9), round(avg(k), 9) FROM f GROUP BY metric""")
def _(spark, sf):
    return S.summaries(metric_tables(spark, sf)).select("metric", "summary", F.round("baseline", 9).alias("baseline"), F.round("current", 9).alias("current"))


@query("a10_quality_score", f"WITH {METRICS}, s AS (SELECT metric, any_value(sg) AS sg, median(CASE WHEN NOT isnan(b) THEN b END) AS b, median(CASE WHEN NOT isnan(k) THEN k END) AS k FROM de GROUP BY metric) SELECT round(avg((k - b) * sg / abs(b)) FILTER (WHERE b <> 0), 9) AS score FROM s")
def _(spark, sf):
    return S.quality_score(S.summaries(metric_tables(spark, sf))).select(F.round("score", 9).alias("score"))


@query("a11_change_counts", f"WITH {METRICS} SELECT kind AS classification, count(*)::BIGINT AS n, list_sort(list(DISTINCT id)) AS ids FROM kd GROUP BY kind")
def _(spark, sf):
    return metric_tables(spark, sf).groupBy("classification").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("id")).alias("ids"))
