"""Queries on evaluation statistics and routing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ratios import ratio
from ..operators import metrics, routing, summaries
from ..sources.tables import clips, predictions, table
from .registry import CLIPS, PREDICTIONS, query


@query(f"WITH {PREDICTIONS} SELECT model, truth, count(*) AS n, count(*) FILTER (WHERE pred = truth) AS n_right, CAST(count(*) FILTER (WHERE pred = truth) AS DOUBLE) / count(*) AS accuracy FROM predictions GROUP BY 1, 2")
def accuracy_by_class(spark, sf_dir):
    return metrics.accuracy(predictions(spark, sf_dir), "model", "truth")


@query(f"WITH {PREDICTIONS} SELECT truth, pred, count(*) AS n FROM predictions GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query(f"""WITH {PREDICTIONS}, c AS (SELECT truth, pred, count(*) AS n FROM predictions GROUP BY 1, 2), l AS (SELECT DISTINCT unnest([truth, pred]) AS label FROM c),
s AS (SELECT label, CAST(coalesce(sum(n) FILTER (WHERE truth = label AND pred = label), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (WHERE truth = label), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (WHERE pred = label), 0) AS BIGINT) AS predicted FROM l, c GROUP BY 1)
SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS prec, CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (support + predicted) END AS f1 FROM s""")
def macro_weighted_f1(spark, sf_dir):
    return metrics.class_scores(predictions(spark, sf_dir))


@query(f"""WITH {PREDICTIONS}, c AS (SELECT truth, pred, count(*) AS n FROM predictions GROUP BY 1, 2), l AS (SELECT DISTINCT unnest([truth, pred]) AS label FROM c),
s AS (SELECT label, coalesce(sum(n) FILTER (WHERE truth = label AND pred = label), 0) AS tp, coalesce(sum(n) FILTER (WHERE truth = label), 0) AS support, coalesce(sum(n) FILTER (WHERE pred = label), 0) AS predicted FROM l, c GROUP BY 1),
f AS (SELECT support, CAST(round(CASE WHEN support + predicted = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(support + predicted AS DOUBLE) END * 1e9) AS BIGINT) AS f1 FROM s)
SELECT count(*) AS labels, CAST(sum(support) AS BIGINT) AS support, CAST(sum(f1) AS DOUBLE) / count(*) / 1e9 AS macro_f1, CAST(sum(f1 * support) AS DOUBLE) / CAST(sum(support) AS DOUBLE) / 1e9 AS weighted_f1 FROM f""")
def f1_averages(spark, sf_dir):
    return metrics.f1_averages(predictions(spark, sf_dir))


@query("""WITH p AS (SELECT a.l_returnflag AS a, b.l_returnflag AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM p), x AS (SELECT a AS v, count(*) AS x FROM p GROUP BY 1), y AS (SELECT b AS v, count(*) AS y FROM p GROUP BY 1),
c AS (SELECT CAST(sum(x * y) AS BIGINT) AS chance FROM x JOIN y USING (v)), k AS (SELECT n, same, CAST(same AS DOUBLE) / n AS observed, CAST(chance AS DOUBLE) / (n * n) AS expected FROM t, c)
SELECT *, CASE WHEN expected = 1 THEN CASE WHEN observed = 1 THEN 1.0 END ELSE (observed - expected) / (1 - expected) END AS kappa FROM k""")
def cohen_kappa(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a, b = (rows.filter(F.col("l_linenumber") == n).select("l_orderkey", F.col("l_returnflag").alias(v)) for n, v in ((1, "a"), (2, "b")))
    return metrics.kappa(a.join(b, "l_orderkey"), "a", "b")


Z = 1.959963984540054


@query(f"""WITH {PREDICTIONS}, s AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE pred = truth) AS n_right FROM predictions GROUP BY 1),
p AS (SELECT *, CAST(n_right AS DOUBLE) / n AS accuracy, CAST(n AS DOUBLE) AS m FROM s),
w AS (SELECT *, (accuracy + {Z * Z} / (2 * m)) / (1 + {Z * Z} / m) AS centre, {Z} * sqrt(accuracy * (1 - accuracy) / m + {Z * Z} / (4 * m * m)) / (1 + {Z * Z} / m) AS half FROM p)
SELECT model, n, n_right, CAST(round(accuracy * 1e9) AS BIGINT) AS accuracy_e9, CAST(round(greatest(0, centre - half) * 1e9) AS BIGINT) AS low_e9, CAST(round(least(1, centre + half) * 1e9) AS BIGINT) AS high_e9 FROM w""")
def wilson_intervals(spark, sf_dir):
    nine = lambda c: F.round(F.col(c) * 1e9).cast("long").alias(f"{c}_e9")
    return metrics.intervals(predictions(spark, sf_dir), "model").select("model", "n", "n_right", nine("accuracy"), nine("low"), nine("high"))


TWO = """two AS (SELECT a.clip_id, a.truth, a.pred AS base, b.pred AS strong, a.conf FROM predictions a JOIN predictions b ON a.clip_id = b.clip_id AND a.line = 1 AND b.line = 2)"""


def two_models(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    a = rows.filter("line = 1").select("clip_id", "truth", F.col("pred").alias("base"), "conf")
    return a.join(rows.filter("line = 2").select("clip_id", F.col("pred").alias("strong")), "clip_id")


@query(f"""WITH {PREDICTIONS}, {TWO}, d AS (SELECT count(*) FILTER (WHERE base = truth AND strong <> truth) AS only_a, count(*) FILTER (WHERE base <> truth AND strong = truth) AS only_b FROM two)
SELECT only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE CAST(greatest(abs(only_a - only_b) - 1, 0) AS DOUBLE) * CAST(greatest(abs(only_a - only_b) - 1, 0) AS DOUBLE) / (only_a + only_b) END AS chi2 FROM d""")
def mcnemar_pairs(spark, sf_dir):
    return metrics.mcnemar(two_models(spark, sf_dir), "base", "strong")


@query(f"""WITH {PREDICTIONS}, b AS (SELECT CASE WHEN conf < 0.2 THEN 0 WHEN conf < 0.4 THEN 1 WHEN conf < 0.6 THEN 2 WHEN conf < 0.8 THEN 3 ELSE 4 END AS bin, pred = truth AS hit FROM predictions)
SELECT bin, count(*) AS n, count(*) FILTER (WHERE hit) AS n_right, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS accuracy FROM b GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    return metrics.calibration(predictions(spark, sf_dir), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


@query(f"""WITH {PREDICTIONS}, {TWO}, g AS (SELECT threshold, count(*) AS n, count(*) FILTER (WHERE conf < threshold) AS n_escalated, count(*) FILTER (WHERE CASE WHEN conf < threshold THEN strong ELSE base END = truth) AS n_right
  FROM two, (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7)) t(threshold) GROUP BY 1)
SELECT *, CAST(n_escalated AS DOUBLE) / n AS rate, CAST(n_right AS DOUBLE) / n AS accuracy FROM g""")
def cascade_threshold_sweep(spark, sf_dir):
    return metrics.cascade(two_models(spark, sf_dir), "base", "strong", [0.1, 0.3, 0.5, 0.7])


@query(f"""WITH {PREDICTIONS}, {TWO}, e AS (SELECT count(*) AS n, count(*) FILTER (WHERE conf < 0.3) AS up FROM two), r AS (SELECT unnest([3.0::DOUBLE, 5.0, 10.0]) AS price)
SELECT price, n, up, 1 - (n + up * price) / (n * price) AS saved FROM e, r""")
def cost_model(spark, sf_dir):
    """Share of cost saved when only some rows go to a model that costs `price` times as much."""
    out = two_models(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("conf") < 0.3).alias("up"))
    return out.select(F.explode(F.array(*[F.lit(p) for p in (3.0, 5.0, 10.0)])).alias("price"), "n", "up").withColumn("saved", 1 - (F.col("n") + F.col("up") * F.col("price")) / (F.col("n") * F.col("price")))


@query(f"""WITH {PREDICTIONS}, c AS (SELECT clip_id, pred, count(*) AS n, sum(CAST(conf AS DECIMAL(18, 6))) AS w FROM predictions GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, w DESC, pred) AS nth FROM c)
SELECT clip_id, CAST(sum(n) AS BIGINT) AS n_votes, max(n) AS n_most, count(*) AS n_labels, max(pred) FILTER (WHERE nth = 1) AS voted FROM r GROUP BY 1 HAVING sum(n) >= 2""")
def ensemble_votes(spark, sf_dir):
    return metrics.votes(predictions(spark, sf_dir), "clip_id")


@query(f"""WITH {PREDICTIONS}, {TWO}, t AS (SELECT CASE WHEN base = truth AND strong = truth THEN 'held' WHEN base <> truth AND strong = truth THEN 'recovered' WHEN base = truth THEN 'broken' WHEN base = strong THEN 'wrong_same' ELSE 'wrong_changed' END AS change FROM two)
SELECT change, count(*) AS n FROM t GROUP BY 1""")
def five_way_transition(spark, sf_dir):
    change = metrics.transition(F.col("base"), F.col("strong"), F.col("truth"))
    return two_models(spark, sf_dir).groupBy(change.alias("change")).agg(F.count("*").alias("n"))


MEANS, PEAKS, SECONDS = [5, 10, 20, 30, 35, 40, 45], [0, 10000, 20000, 30000, 45000], [1, 10, 20, 30, 40]
GRID = [(m, p, s) for m in MEANS for p in PEAKS for s in SECONDS]

@query(f"""WITH {PREDICTIONS}, g(place, mean_at, peak_at, seconds_at) AS (VALUES {", ".join(f"({i}, {m}::DOUBLE, {p}::DOUBLE, {s}::DOUBLE)" for i, (m, p, s) in enumerate(GRID))}),
t AS (SELECT place, mean_at, peak_at, seconds_at, count(*) AS n, count(*) FILTER (WHERE quantity >= mean_at AND price >= peak_at AND line * 10 >= seconds_at) AS n_auto,
  count(*) FILTER (WHERE quantity >= mean_at AND price >= peak_at AND line * 10 >= seconds_at AND pred <> truth) AS n_false FROM predictions, g GROUP BY 1, 2, 3, 4),
r AS (SELECT *, CAST(n_auto AS DOUBLE) / n AS auto_rate, CASE WHEN n_auto = 0 THEN 0.0 ELSE CAST(n_false AS DOUBLE) / n_auto END AS false_rate FROM t)
SELECT * FROM r WHERE false_rate <= 0.75 AND n_auto > 0 ORDER BY auto_rate DESC, false_rate, place LIMIT 1""")
def calibrate_rule_grid(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(F.col("quantity").alias("mean"), F.col("price").alias("peak"), (F.col("line") * 10).alias("seconds"), (F.col("pred") == F.col("truth")).alias("good"))
    return routing.best_rule(rows, MEANS, PEAKS, SECONDS, 0.75)


@query(f"""WITH {PREDICTIONS}, u AS (SELECT truth, 'quantity' AS feature, quantity AS v, 10.0 AS a, 25.0 AS b, 40.0 AS c FROM predictions UNION ALL SELECT truth, 'price', price, 10000.0, 35000.0, 60000.0 FROM predictions),
s AS (SELECT feature, CASE WHEN v < a THEN 'very_low' WHEN v < b THEN 'low' WHEN v >= c THEN 'high' ELSE 'mid' END AS bucket, truth FROM u)
SELECT feature, bucket, count(*) AS n, count(*) FILTER (WHERE truth = 'R') AS n_urgent, CAST(count(*) FILTER (WHERE truth = 'R') AS DOUBLE) / count(*) AS rate FROM s GROUP BY 1, 2""")
def separability_buckets(spark, sf_dir):
    edges = {"quantity": (10.0, 25.0, 40.0), "price": (10000.0, 35000.0, 60000.0)}
    bucket = lambda n: F.when(F.col(n) < edges[n][0], "very_low").when(F.col(n) < edges[n][1], "low").when(F.col(n) >= edges[n][2], "high").otherwise("mid")
    rows = predictions(spark, sf_dir).select("truth", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), bucket(n).alias("bucket")) for n in edges])).alias("x"))
    out = rows.groupBy("x.feature", "x.bucket").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == "R").alias("n_urgent"))
    return out.withColumn("rate", ratio(F.col("n_urgent"), F.col("n")))


@query(f"WITH {PREDICTIONS} SELECT model, truth, count(*) AS n, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.95) AS p95, max(price) AS most, 3600 / quantile_cont(price, 0.95) AS capacity FROM predictions GROUP BY 1, 2")
def latency_percentiles(spark, sf_dir):
    rows, by = predictions(spark, sf_dir), ["model", "truth"]
    out = summaries.interpolated(rows, "price", by, {"p50": 0.5, "p95": 0.95})
    return out.join(rows.groupBy(*by).agg(F.max("price").alias("most")), by).withColumn("capacity", 3600 / F.col("p95"))


@query(f"WITH {PREDICTIONS}, w AS (SELECT sample_id, conf, truth, pred, row_number() OVER (ORDER BY conf DESC, sample_id) AS nth FROM predictions WHERE pred <> truth) SELECT sample_id, conf, truth, pred FROM w WHERE nth <= 50")
def confident_mistakes(spark, sf_dir):
    return predictions(spark, sf_dir).filter("pred <> truth").orderBy(F.desc("conf"), "sample_id").limit(50).select("sample_id", "conf", "truth", "pred")


@query("""WITH s AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS q, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS p FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2)
SELECT flag, status, n, CAST(q AS DOUBLE) AS quantity, CAST(p AS DOUBLE) AS price, CAST(q AS DOUBLE) / n AS mean_quantity FROM s""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    out = rows.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"))
    return out.withColumn("mean_quantity", F.col("quantity") / F.col("n"))
