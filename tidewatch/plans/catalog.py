"""All queries of the engine, by name, with their DuckDB twins where SQL can express them.

Names begin with the inventory number of the operator that a query shows. Doubles are rounded to six digits in
both, as the order of sums is free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.functions.rules import ThresholdRule
from tidewatch.operators import detectors, graph, neighbours, recurrent, scoring, supervised, survival, windows
from tidewatch.operators.ordering import quantiles, running
from tidewatch.sources import io
from tidewatch.sources.scratch import new_path
from tidewatch.streaming import maintenance, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") == "error").cast("int").alias("label"))


def cycles(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a maintenance panel: a user is an asset, an event a cycle."""
    return events(spark, d).withColumn("cycle", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Line items as messages between suppliers."""
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("sender_id"), F.pmod("l_partkey", "n").alias("receiver_id"), F.col("l_shipdate").alias("timestamp"))


def roster(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days to a customer's next order; the last one is censored at the last order date of all."""
    o = table(spark, d, "orders")
    end = o.agg(F.max("o_orderdate").alias("end"))
    nxt = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.crossJoin(F.broadcast(end)).select("o_orderkey", "o_custkey", "o_totalprice", F.datediff(F.coalesce(nxt, F.col("end")), "o_orderdate").cast("double").alias("duration"), nxt.isNotNull().cast("int").alias("event"))


E_SQL = "e AS (SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"
C_SQL = E_SQL + ", c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM e)"
M_SQL = "m AS (SELECT l_suppkey AS sender_id, l_partkey % (SELECT count(*) FROM supplier) AS receiver_id, l_shipdate AS ts FROM lineitem)"
EDGES_SQL = M_SQL + ", edges AS (SELECT least(sender_id, receiver_id) AS u, greatest(sender_id, receiver_id) AS v, count(*) AS weight FROM m WHERE sender_id <> receiver_id GROUP BY 1, 2), ends AS (SELECT u AS node, weight FROM edges UNION ALL SELECT v, weight FROM edges)"
G_SQL = "g AS (SELECT o_orderkey, o_custkey, o_totalprice, date_diff('day', o_orderdate::DATE, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), (SELECT max(o_orderdate) FROM orders))::DATE)::DOUBLE AS duration, CASE WHEN lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL THEN 0 ELSE 1 END AS event FROM orders)"
Z_SQL = E_SQL + ", z AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS med FROM e), y AS (SELECT *, abs(value - med) AS dev FROM z), x AS (SELECT *, median(dev) OVER (PARTITION BY user_id) AS mad FROM y), s AS (SELECT event_id, user_id, ts, label, value, abs((value - med) / (mad + 1e-8)) AS score FROM x), f AS (SELECT *, CASE WHEN score >= quantile_cont(score, 0.95) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS flag FROM s)"


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return scoring.detect_anomalies(events(spark, d), scoring.RobustZScore(partition=("user_id",)), ThresholdRule("quantile", quantile=0.95), ("user_id",))


@query("o4_detect_anomalies", f"WITH {Z_SQL} SELECT event_id, user_id, round(score, 6) AS score, flag FROM f")
def _(spark, d):
    return rounded(flagged(spark, d).select("event_id", "user_id", "score", "flag"), "score")


@query("a2_robust_zscore_global", f"WITH {E_SQL}, m AS (SELECT median(value) AS med FROM e), k AS (SELECT median(abs(value - med)) AS mad FROM e, m) SELECT event_id, round(abs((value - med) / (mad + 1e-8)), 6) AS score FROM e, m, k")
def _(spark, d):
    return rounded(scoring.RobustZScore().transform(events(spark, d)).select("event_id", "score"), "score")


@query("a3_zscore", "WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(abs((l_quantity - mq) / sq), abs((l_extendedprice - mp) / sp)), 6) AS score FROM lineitem, s")
def _(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(scoring.ZScore(("l_quantity", "l_extendedprice")).fit(df).transform(df).select("l_orderkey", "l_linenumber", "score"), "score")


@query("a4_iqr", f"WITH {E_SQL}, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e) SELECT event_id, round(greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1), 0.0) / (q3 - q1 + 1e-10), 6) AS score FROM e, q")
def _(spark, d):
    df = events(spark, d)
    return rounded(scoring.InterquartileRange().fit(df).transform(df).select("event_id", "score"), "score")


@query("a5_seasonal", f"WITH {E_SQL}, k AS (SELECT *, hour(ts) AS season FROM e), s AS (SELECT season, avg(value) AS m, stddev_samp(value) AS sd FROM k GROUP BY season) SELECT event_id, round(abs(value - m) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6) AS score FROM k JOIN s USING (season)")
def _(spark, d):
    df = events(spark, d)
    return rounded(scoring.seasonal_score(df, df, "ts", "value", "hour").select("event_id", "score"), "score")


@query("p2_quantile_threshold", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.9) AS t FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice >= t THEN 1 ELSE 0 END AS flag FROM orders, q")
def _(spark, d):
    return rules.apply_threshold(table(spark, d, "orders"), ThresholdRule("quantile", quantile=0.9), "o_totalprice").select("o_orderkey", "flag")


RUL_SQL = C_SQL + ", r AS (SELECT *, greatest(max(cycle) OVER (PARTITION BY user_id) - cycle, 0) AS RUL FROM c)"


@query("p3_health_states", f"WITH {RUL_SQL} SELECT event_id, RUL, CASE WHEN RUL <= 10 THEN 2 WHEN RUL <= 30 THEN 1 ELSE 0 END AS health_state FROM r")
def _(spark, d):
    return windows.remaining_life(cycles(spark, d), "user_id", "cycle").select("event_id", F.col("RUL").cast("long").alias("RUL"), rules.health_from_rul(F.col("RUL")).alias("health_state"))


@query("p4_rul_labels", f"WITH {RUL_SQL}, l AS (SELECT event_id, CASE WHEN RUL > 30 THEN 'healthy' WHEN RUL > 15 THEN 'warning' WHEN RUL > 0 THEN 'critical' WHEN RUL = 0 THEN 'failed' ELSE 'unknown' END AS health_label FROM r) SELECT event_id, health_label, CASE WHEN health_label <> 'healthy' THEN 1 ELSE 0 END AS binary_label, CASE health_label WHEN 'healthy' THEN 0 WHEN 'warning' THEN 1 WHEN 'critical' THEN 2 WHEN 'failed' THEN 3 ELSE -1 END AS multi_class_label FROM l")
def _(spark, d):
    df = windows.remaining_life(cycles(spark, d), "user_id", "cycle")
    return df.withColumns(rules.rul_labels(F.col("RUL"))).select("event_id", "health_label", "binary_label", "multi_class_label")


POLICY_SQL = RUL_SQL + ", h AS (SELECT *, CASE WHEN RUL <= 10 THEN 2 WHEN RUL <= 30 THEN 1 ELSE 0 END AS st FROM r), b AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY user_id ORDER BY cycle), 0) AS pr FROM h), a AS (SELECT event_id, st AS health_state, CASE WHEN st = 2 THEN 2 WHEN pr = 0 AND st = 1 THEN 1 ELSE 0 END AS action FROM b), p AS (SELECT *, CASE action WHEN 2 THEN 100.0 WHEN 1 THEN 30.0 ELSE 0.0 END::DOUBLE AS cost, (CASE health_state WHEN 2 THEN 0.3 WHEN 1 THEN 0.1 ELSE 0.01 END * CASE action WHEN 2 THEN 0.5 WHEN 1 THEN 0.75 ELSE 1.0 END)::DOUBLE AS risk FROM a)"


def policy(spark: SparkSession, d: str) -> DataFrame:
    df = windows.remaining_life(cycles(spark, d), "user_id", "cycle").withColumn("health_state", rules.health_from_rul(F.col("RUL")))
    df = df.withColumn("previous", F.coalesce(F.lag("health_state").over(Window.partitionBy("user_id").orderBy("cycle")), F.lit(0)))
    return rules.apply_policy(df, previous="previous")


@query("p7_policy", f"WITH {POLICY_SQL} SELECT event_id, health_state, action, cost, round(risk, 6) AS risk FROM p")
def _(spark, d):
    return rounded(policy(spark, d).select("event_id", "health_state", "action", "cost", "risk"), "risk")


@query("p8_evaluate_policy", f"WITH {POLICY_SQL} SELECT sum(cost) AS total_cost, round(sum(risk), 6) AS total_risk, count(*) FILTER (action = 2) AS interventions, count(*) FILTER (action = 1) AS reviews, count(*) FILTER (action = 0) AS waits FROM p")
def _(spark, d):
    return rounded(rules.evaluate_policy(policy(spark, d)), "total_risk")


@query("p9_min_max", "WITH s AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 6) AS scaled FROM supplier, s")
def _(spark, d):
    return rounded(rules.min_max(table(spark, d, "supplier"), "s_acctbal", "scaled").select("s_suppkey", "scaled"), "scaled")


@query("p12_alerts", f"WITH {E_SQL}, q AS (SELECT event_id, user_id, value, CASE WHEN value >= 100 THEN 'failure' WHEN value >= 60 THEN 'critical' WHEN value >= 40 THEN 'warning' END AS level FROM e) SELECT event_id, user_id, level, CASE level WHEN 'failure' THEN 100.0 WHEN 'critical' THEN 60.0 ELSE 40.0 END::DOUBLE AS threshold FROM q WHERE level IS NOT NULL")
def _(spark, d):
    found = maintenance.alerts(events(spark, d), "user_id", "event_id", {"value": {"warning": 40, "critical": 60, "failure": 100}})
    return found.select("event_id", "user_id", "level", "threshold")


@query("p13_time_bins", "SELECT date_trunc('day', ts) AS bin, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy(rules.time_bin(F.col("ts")).cast("timestamp_ntz").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_seasonal_keys", "SELECT event_id, week(ts)::INT AS w, month(ts)::INT AS m, dayofyear(ts)::INT AS y, hour(ts)::INT AS h FROM events")
def _(spark, d):
    ts = F.col("ts")
    return events(spark, d).select("event_id", *[rules.seasonal_key(ts, s).alias(k) for k, s in (("w", "week"), ("m", "month"), ("y", "day"), ("h", "hour"))])


RATES_SQL = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END::DOUBLE AS recall"
F1_SQL = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"
COUNTS_SQL = "count(*) FILTER (flag = 1 AND label = 1) AS tp, count(*) FILTER (flag = 1 AND label = 0) AS fp, count(*) FILTER (flag = 0 AND label = 0) AS tn, count(*) FILTER (flag = 0 AND label = 1) AS fn"


@query("a6_performance", f"WITH {Z_SQL}, u AS (SELECT flag, CASE WHEN flag = 1 AND coalesce(lag(flag) OVER (ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS s FROM f), k AS (SELECT {COUNTS_SQL}, avg(flag) AS anomaly_rate, avg(score) AS score_mean, max(score) AS score_max, min(score) AS score_min, stddev_pop(score) AS score_std FROM f), r AS (SELECT *, {RATES_SQL} FROM k) SELECT tp, fp, tn, fn, round(anomaly_rate, 6) AS anomaly_rate, round(score_mean, 6) AS score_mean, round(score_max, 6) AS score_max, round(score_min, 6) AS score_min, round(score_std, 6) AS score_std, (SELECT round(sum(flag) / sum(s), 6) FROM u) AS avg_run_length, round(precision, 6) AS precision, round(recall, 6) AS recall, round({F1_SQL}, 6) AS f1 FROM r")
def _(spark, d):
    return rounded(scoring.performance_metrics(flagged(spark, d), order=("ts", "event_id")), "avg_run_length", "anomaly_rate", "score_mean", "score_max", "score_min", "score_std", "precision", "recall", "f1")


@query("a9_evaluate_by_user", f"WITH {Z_SQL}, k AS (SELECT user_id, {COUNTS_SQL} FROM f GROUP BY user_id), r AS (SELECT *, {RATES_SQL} FROM k) SELECT user_id, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({F1_SQL}, 6) AS f1, round((tp + tn) * 1.0 / (tp + fp + tn + fn), 6)::DOUBLE AS accuracy FROM r")
def _(spark, d):
    return rounded(scoring.detection_metrics(flagged(spark, d), by=("user_id",)), "precision", "recall", "f1", "accuracy")


@query("a9_roc_auc", f"WITH {E_SQL}, r AS (SELECT label, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM e), n AS (SELECT sum(label) AS p, count(*) - sum(label) AS q, sum(CASE WHEN label = 1 THEN k END) AS s FROM r) SELECT round((s - p * (p + 1) / 2.0) / (p * q), 6)::DOUBLE AS roc_auc FROM n")
def _(spark, d):
    return rounded(scoring.roc_auc(events(spark, d), "value"), "roc_auc")


@query("a12_top_anomalies", f"WITH {Z_SQL} SELECT event_id, round(score, 6) AS score FROM f WHERE flag = 1 ORDER BY score DESC, event_id LIMIT 10")
def _(spark, d):
    return rounded(flagged(spark, d).where("flag = 1").orderBy(F.desc("score"), "event_id").limit(10).select("event_id", "score"), "score")


@query("a11_report", f"WITH {Z_SQL} SELECT count(*) FILTER (flag = 1) AS n_anomalies, count(*) AS n_total, round(avg(flag), 6) AS anomaly_rate, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, (SELECT string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY score DESC, ts) FROM (SELECT ts, score FROM f WHERE flag = 1 ORDER BY score DESC, ts LIMIT 10)) AS top_anomalies FROM f")
def _(spark, d):
    return rounded(scoring.report_detection(flagged(spark, d), "ts").withColumn("top_anomalies", F.array_join(F.transform("top_anomalies", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ",")), "anomaly_rate", "mean_score", "max_score", "min_score")


@query("a13_concept_drift", f"WITH {E_SQL}, h AS (SELECT value, ts >= (SELECT quantile_disc(ts, 0.5) FROM e) AS r FROM e), s AS (SELECT avg(value) FILTER (r) AS recent_mean, avg(value) FILTER (NOT r) AS historical_mean, stddev_pop(value) FILTER (NOT r) AS historical_std FROM h), g AS (SELECT value, count(*) FILTER (r) AS k1, count(*) FILTER (NOT r) AS k0 FROM h GROUP BY value), q AS (SELECT max(abs(c1 / n1 - c0 / n0)) AS ks, any_value(n1) AS n1, any_value(n0) AS n0 FROM (SELECT sum(k1) OVER (ORDER BY value)::DOUBLE AS c1, sum(k0) OVER (ORDER BY value)::DOUBLE AS c0, sum(k1) OVER ()::DOUBLE AS n1, sum(k0) OVER ()::DOUBLE AS n0 FROM g)), t AS (SELECT *, sqrt(n1 * n0 / (n1 + n0)) * ks AS t FROM q) SELECT round(ks, 6) AS ks_statistic, (SELECT round(CASE WHEN t.t < 0.2 THEN 1.0 ELSE greatest(least(sum(2.0 * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * t.t * t.t)), 1.0), 0.0) END, 6) FROM range(1, 101) AS x(k)) AS ks_pvalue, round(recent_mean, 6) AS recent_mean, round(historical_mean, 6) AS historical_mean, round(historical_std, 6) AS historical_std, round(abs(recent_mean - historical_mean) / historical_std, 6) AS drift_score, CASE WHEN abs(recent_mean - historical_mean) / historical_std > 2 THEN 1 ELSE 0 END AS drift_detected FROM s, t")
def _(spark, d):
    df = events(spark, d)
    times = running(df.groupBy("ts").agg(F.count(F.lit(1)).alias("n")), [F.col("ts")], {"upto": F.col("n")})
    middle = times.where(2 * F.col("upto") >= df.count()).agg(F.min("ts").alias("middle"))
    df = df.crossJoin(F.broadcast(middle))
    out = scoring.concept_drift(df.where("ts >= middle"), df.where("ts < middle"), "value")
    return rounded(out.select("recent_mean", "historical_mean", "historical_std", "drift_score", "drift_detected", "ks_statistic", "ks_pvalue"), "ks_statistic", "ks_pvalue", "recent_mean", "historical_mean", "historical_std", "drift_score")


@query("a15_sweep", "WITH " + Z_SQL + ", t AS (SELECT unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS threshold), k AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM f, t GROUP BY threshold), r AS (SELECT *, " + RATES_SQL + " FROM k) SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(" + F1_SQL + ", 6) AS f1 FROM r")
def _(spark, d):
    return rounded(scoring.sweep_thresholds(flagged(spark, d), [0.5, 1.0, 2.0, 3.0]), "precision", "recall", "f1")


@query("a16_concordance", f"WITH {G_SQL}, n AS (SELECT duration, event, o_totalprice AS r, count(*) AS n FROM g GROUP BY ALL) SELECT round(sum(CASE WHEN a.r > b.r THEN a.n * b.n * 1.0 WHEN a.r = b.r THEN a.n * b.n * 0.5 ELSE 0 END)::DOUBLE / sum(a.n * b.n), 6) AS concordance_index, sum(a.n * b.n)::BIGINT AS pairs FROM n a JOIN n b ON a.duration < b.duration WHERE a.event = 1")
def _(spark, d):
    return rounded(survival.concordance(gaps(spark, d), risk="o_totalprice"), "concordance_index")


ROLL = "OVER (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("w1_rolling", f"WITH {C_SQL} SELECT event_id, round(avg(value) {ROLL}, 6) AS value_rolling_mean, round(stddev_samp(value) {ROLL}, 6) AS value_rolling_std, round(min(value) {ROLL}, 6) AS value_rolling_min, round(max(value) {ROLL}, 6) AS value_rolling_max, round(quantile_cont(value, 0.5) {ROLL}, 6) AS value_rolling_median FROM c")
def _(spark, d):
    made = [f"value_rolling_{s}" for s in ("mean", "std", "min", "max", "median")]
    df = windows.rolling_statistics(cycles(spark, d), ["value"], ["user_id"], ["cycle"], 5, ("mean", "std", "min", "max", "median"))
    return rounded(df.select("event_id", *made), *made)


@query("w2_rolling_quantiles", f"WITH {C_SQL} SELECT event_id, round(quantile_cont(value, 0.25) {ROLL}, 6) AS value_rolling_q25, round(quantile_cont(value, 0.75) {ROLL}, 6) AS value_rolling_q75 FROM c")
def _(spark, d):
    df = windows.rolling_statistics(cycles(spark, d), ["value"], ["user_id"], ["cycle"], 5, ("q25", "q75"))
    return rounded(df.select("event_id", "value_rolling_q25", "value_rolling_q75"), "value_rolling_q25", "value_rolling_q75")


def half_up(x: str, digits: int = 6) -> str:
    """SQL's round by the decimal digits of a double, halves up, as Spark rounds: round() in DuckDB leaves ties to the binary digits.

    From 1e16 on a double has no digits to round; infinity and NaN stay.
    """
    return f"CASE WHEN abs({x}) < 1e16 THEN CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, {digits}))::DOUBLE ELSE {x} END"


#: ``c`` whose values have null for NaN.
V_SQL = C_SQL + ", v AS (SELECT * REPLACE (CASE WHEN isnan(value) THEN NULL ELSE value END AS value) FROM c)"


def filled_sql(rows: int = 0) -> str:
    """The last value that is not null up to so many rows before."""
    upto = f"{rows} PRECEDING" if rows else "CURRENT ROW"
    return f"last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"


def change_sql(filled: str, before: str) -> str:
    """The relative change of a value: infinite from zero, null from zero to zero."""
    return f"CASE WHEN {before} = 0 THEN CASE WHEN {filled} > 0 THEN 'inf'::DOUBLE WHEN {filled} < 0 THEN '-inf'::DOUBLE END ELSE {filled} / {before} - 1 END"


def std_sql(rows: str) -> str:
    """The sample's deviation over a window, taken value by value in its order (Welford), so that no digit is left to the order of sums."""
    held = f"list({{'n': 1.0::DOUBLE, 'm': value, 'q': 0.0::DOUBLE}}) FILTER (value IS NOT NULL) {rows}"
    step = "lambda a, b: {'n': a.n + 1, 'm': a.m + (b.m - a.m) / (a.n + 1), 'q': a.q + (b.m - a.m) * ((b.m - a.m) - (b.m - a.m) / (a.n + 1))}"
    return f"list_transform([list_reduce({held}, {step})], lambda s: CASE WHEN s.n > 1 THEN sqrt(s.q / (s.n - 1)) END)[1]"


@query("w3_rates", f"WITH {V_SQL}, l AS (SELECT event_id, {filled_sql()} AS x, {filled_sql(1)} AS a, {filled_sql(3)} AS b FROM v), r AS (SELECT event_id, {change_sql('x', 'a')} AS ra, {change_sql('x', 'b')} AS rb FROM l) SELECT event_id, {half_up('ra')} AS value_rate_1, {half_up('rb')} AS value_rate_3 FROM r")
def _(spark, d):
    df = windows.degradation_rates(cycles(spark, d), ["value"], ["user_id"], ["cycle"], (1, 3))
    return rounded(df.select("event_id", "value_rate_1", "value_rate_3"), "value_rate_1", "value_rate_3")


@query("w4_changes", f"WITH {C_SQL}, l AS (SELECT event_id, value, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 5) OVER w AS f FROM c WINDOW w AS (PARTITION BY user_id ORDER BY cycle)) SELECT event_id, round(value - a, 6) AS value_diff, round(value - 2 * a + b, 6) AS value_diff2, round(abs(value - a), 6) AS value_abs_diff, round((value - f) / 5, 6) AS value_roc_5 FROM l")
def _(spark, d):
    names = ["value_diff", "value_diff2", "value_abs_diff", "value_roc_5"]
    return rounded(windows.change_features(cycles(spark, d), ["value"], ["user_id"], ["cycle"], (5,)).select("event_id", *names), *names)


def _features_sql() -> str:
    """Rolling and change features of ``value``, back-filled, over all window lengths."""
    made, names = [], []
    for n in (5, 10, 20, 50, 100):
        w = f"OVER (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        q25, q75 = f"quantile_cont(value, 0.25) {w}", f"quantile_cont(value, 0.75) {w}"
        each = {"mean": f"avg(value) {w}", "std": std_sql(w), "min": f"min(value) {w}", "max": f"max(value) {w}", "median": f"quantile_cont(value, 0.5) {w}", "q25": q25, "q75": q75, "iqr": f"{q75} - {q25}"}
        for k, x in each.items():
            made.append(f"CASE WHEN count(*) OVER (PARTITION BY user_id) >= {n} THEN {x} END AS value_{k}_{n}")
            names.append(f"value_{k}_{n}")
    lag = lambda k: f"lag(value, {k}) OVER (PARTITION BY user_id ORDER BY cycle)"
    changes = {"diff": f"value - {lag(1)}", "diff2": f"value - 2 * {lag(1)} + {lag(2)}", "abs_diff": f"abs(value - {lag(1)})", "abs_diff2": f"abs(value - 2 * {lag(1)} + {lag(2)})"}
    changes["pct_change"] = change_sql(filled_sql(), filled_sql(1))
    changes |= {f"roc_{k}": f"(value - {lag(k)}) / {k}" for k in (5, 10, 20)}
    for k, x in changes.items():
        made.append(f"{x} AS value_{k}")
        names.append(f"value_{k}")
    filled = ", ".join(f"coalesce(first_value(CASE WHEN isnan({c}) THEN NULL ELSE {c} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS {c}" for c in names)
    made_up = ", ".join(f"{half_up(c, 9)} AS {c}" for c in names)
    return f"WITH {V_SQL}, x AS (SELECT event_id, user_id, cycle, {', '.join(made)} FROM v), f AS (SELECT event_id, {filled} FROM x) SELECT event_id, {made_up} FROM f"


@query("w6_features", _features_sql())
def _(spark, d):
    df = windows.extract_features(cycles(spark, d), ["value"], ["user_id"], ["cycle"])
    # Means of 50 values have up to seven digits, so that six would be ties.
    return df.select("event_id", *[F.round(c, 9).alias(c) for c in df.columns if c.startswith("value_")])


@query("w7_spectral")
def _(spark, d):
    return windows.spectral_features(cycles(spark, d), ["value"], ["user_id"], ["cycle"])


@query("w8_change_points", f"WITH {C_SQL}, s AS (SELECT event_id, value, avg(value) OVER p AS m, stddev_pop(value) OVER p AS sd, avg(value) OVER r AS lm, stddev_samp(value) OVER r AS ls FROM c WINDOW p AS (PARTITION BY user_id), r AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), t AS (SELECT event_id, greatest(abs(value - m) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, abs(value - lm) / CASE WHEN ls > 0 THEN ls ELSE 1.0 END) AS score FROM s) SELECT event_id, round(score, 6) AS score, CASE WHEN score >= 3.0 THEN 1 ELSE 0 END AS flag FROM t")
def _(spark, d):
    return rounded(windows.change_points(cycles(spark, d), "value", ["user_id"], ["cycle"]).select("event_id", "score", "flag"), "score")


@query("w9_run_length", f"WITH {C_SQL}, r AS (SELECT user_id, label, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY user_id ORDER BY cycle), 0) = 0 THEN 1 ELSE 0 END AS s FROM c) SELECT user_id, round(CASE WHEN sum(s) = 0 THEN 0.0 ELSE sum(label) * 1.0 / sum(s) END, 6)::DOUBLE AS average_run_length FROM r GROUP BY user_id")
def _(spark, d):
    return rounded(windows.run_lengths(cycles(spark, d), "label", ["user_id"], ["cycle"]), "average_run_length")


@query("w10_lead_times", f"WITH {C_SQL}, w AS (SELECT user_id, cycle, CASE WHEN value >= 60 THEN 1 ELSE 0 END AS pred, label FROM c), x AS (SELECT user_id, cycle, label, lag(label) OVER (PARTITION BY user_id ORDER BY cycle) AS b, max(CASE WHEN pred = 1 THEN cycle END) OVER (PARTITION BY user_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS seen FROM w), y AS (SELECT user_id, (cycle - seen)::DOUBLE AS lead FROM x WHERE label = 1 AND b = 0) SELECT user_id, round(avg(lead) FILTER (lead > 0), 6) AS mean_lead, median(lead) FILTER (lead > 0) AS median_lead, min(lead) FILTER (lead > 0) AS min_lead, max(lead) FILTER (lead > 0) AS max_lead, count(*) FILTER (lead > 0) AS early, count(*) FILTER (lead < 0) AS late FROM y GROUP BY user_id")
def _(spark, d):
    df = cycles(spark, d).withColumn("pred", (F.col("value") >= 60).cast("int"))
    return rounded(windows.lead_times(df, "pred", "label", "cycle", ["user_id"]), "mean_lead")


BACKTEST_SQL = f"WITH {E_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM e), k AS (SELECT unnest(range(0, 5)) AS fold), f AS (SELECT fold, 10 + fold * ((n - 10) // 5) AS edge, value, label, pos FROM o, k), t AS (SELECT fold, avg(value) AS m, stddev_pop(value) AS s FROM f WHERE pos < edge GROUP BY fold), z AS (SELECT f.fold, label, pos, abs(value - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END AS score FROM f JOIN t ON f.fold = t.fold WHERE pos >= edge), g AS (SELECT *, CASE WHEN score >= quantile_cont(score, 0.95) OVER (PARTITION BY fold) THEN 1 ELSE 0 END AS flag FROM z), u AS (SELECT fold, coalesce(sum(flag) / sum(s), 0) AS runs FROM (SELECT fold, flag, CASE WHEN flag = 1 AND coalesce(lag(flag) OVER (PARTITION BY fold ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS s FROM g) GROUP BY fold), c AS (SELECT fold, {COUNTS_SQL} FROM g GROUP BY fold), r AS (SELECT *, {RATES_SQL} FROM c JOIN u USING (fold)) SELECT fold::INT AS fold, round(runs, 6) AS avg_run_length, round(precision, 6) AS precision, round(recall, 6) AS recall, round({F1_SQL}, 6) AS f1 FROM r"


@query("w13_backtest", BACKTEST_SQL)
def _(spark, d):
    return rounded(scoring.backtest(events(spark, d), "value", ["ts", "event_id"], ThresholdRule("quantile", quantile=0.95)), "precision", "recall", "f1", "avg_run_length")


@query("w16_sequences", f"WITH {C_SQL}, s AS (SELECT event_id, label, sum(value) OVER w AS total, row_number() OVER (PARTITION BY user_id ORDER BY cycle) AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT event_id, label, 30 AS length, round(total, 6) AS total FROM s WHERE n > 30")
def _(spark, d):
    rows = windows.sequences(cycles(spark, d), ["value"], "label", ["user_id"], ["cycle", "event_id"])
    return rounded(rows.select("event_id", "label", F.size("sequence").alias("length"), F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("s10_metric_rows", "WITH l AS (SELECT 'o_totalprice' AS n, o_totalprice::DOUBLE AS v FROM orders), k AS (SELECT n, avg(v) AS m, min(v) AS lo, max(v) AS hi FROM l GROUP BY n) SELECT n AS MetricName, round(m, 6) AS Value FROM k UNION ALL SELECT n || '_Min', round(lo, 6) FROM k UNION ALL SELECT n || '_Max', round(hi, 6) FROM k")
def _(spark, d):
    return rounded(scoring.metric_rows(table(spark, d, "orders").select("o_totalprice")).select("MetricName", "Value"), "Value")


@query("j12_rank_by_risk", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def _(spark, d):
    return scoring.rank_by_risk(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", 5)


@query("g1_edges", f"WITH {EDGES_SQL} SELECT u, v, weight FROM edges")
def _(spark, d):
    return graph.undirected_edges(messages(spark, d))


@query("g2_degrees", f"WITH {EDGES_SQL}, k AS (SELECT node, sum(weight)::DOUBLE AS weighted_degree, count(*) AS neighbor_count FROM ends GROUP BY node) SELECT s_suppkey AS node, coalesce(weighted_degree, 0.0) AS weighted_degree, coalesce(neighbor_count, 0) AS neighbor_count FROM supplier LEFT JOIN k ON node = s_suppkey")
def _(spark, d):
    return graph.degrees(graph.undirected_edges(messages(spark, d)), roster(spark, d))


def _pagerank_sql(turns: int = 40) -> str:
    """The iterates one after the other; the last before a change below the tolerance is returned."""
    start = f"WITH {EDGES_SQL}, both_ends AS (SELECT u AS node, v AS other, weight FROM edges UNION ALL SELECT v, u, weight FROM edges), strength AS (SELECT node, sum(weight) AS s FROM both_ends GROUP BY node), links AS MATERIALIZED (SELECT b.node, other, weight * 1.0::DOUBLE / s AS share FROM both_ends b JOIN strength USING (node)), n AS MATERIALIZED (SELECT s_suppkey AS node, s IS NULL AS isolated, (SELECT count(*) FROM supplier)::DOUBLE AS n FROM supplier LEFT JOIN strength ON node = s_suppkey), r0 AS MATERIALIZED (SELECT node, isolated, n, 1.0 / n AS r FROM n)"
    for k in range(1, turns + 1):
        start += f", r{k} AS MATERIALIZED (SELECT p.node, p.isolated, p.n, 0.15 / p.n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r) FILTER (isolated), 0) FROM r{k - 1}) / p.n) AS r FROM r{k - 1} p LEFT JOIN (SELECT other AS node, sum(r * share) AS got FROM links JOIN r{k - 1} USING (node) GROUP BY other) g ON g.node = p.node)"
    every = " UNION ALL ".join(f"SELECT {k} AS k, node, r FROM r{k}" for k in range(turns + 1))
    start += f", every AS MATERIALIZED ({every}), changes AS (SELECT a.k, sum(abs(a.r - b.r)) AS change FROM every a JOIN every b ON a.node = b.node AND b.k = a.k - 1 GROUP BY a.k)"
    start += f", last AS (SELECT node, r FROM every WHERE k = (SELECT coalesce(min(k) FILTER (change < 1e-8) - 1, {turns}) FROM changes))"
    return start + " SELECT node, round(r / (SELECT sum(r) FROM last), 6) AS pagerank FROM last"


@query("g3_pagerank", _pagerank_sql())
def _(spark, d):
    return rounded(graph.pagerank(graph.undirected_edges(messages(spark, d)), roster(spark, d)), "pagerank")


@query("g4_edge_features", f"WITH {EDGES_SQL}, k AS (SELECT node, sum(weight) AS volume FROM ends GROUP BY node) SELECT u, v, weight, round(2.0 * weight / (a.volume + b.volume), 6)::DOUBLE AS share_of_endpoint_volume, round(ln(1 + weight), 6) AS log1p_weight FROM edges JOIN k a ON u = a.node JOIN k b ON v = b.node")
def _(spark, d):
    return rounded(graph.edge_features(graph.undirected_edges(messages(spark, d))), "share_of_endpoint_volume", "log1p_weight")


@query("g5_touch_counts", f"WITH {M_SQL}, t AS (SELECT sender_id AS node, ts FROM m UNION ALL SELECT receiver_id, ts FROM m), k AS (SELECT node, date_trunc('day', ts) AS bin, count(*) AS touches FROM t JOIN supplier ON node = s_suppkey GROUP BY 1, 2), b AS (SELECT DISTINCT bin FROM k) SELECT s_suppkey AS node, b.bin AS bin, coalesce(touches, 0) AS touches FROM supplier CROSS JOIN b LEFT JOIN k ON k.node = s_suppkey AND k.bin = b.bin")
def _(spark, d):
    return graph.touch_counts(messages(spark, d), roster(spark, d)).withColumn("bin", F.col("bin").cast("timestamp_ntz"))


@query("g6_centralities")
def _(spark, d):
    return rounded(graph.centralities(graph.undirected_edges(messages(spark, d)), roster(spark, d)), "betweenness", "closeness", "eigenvector")


@query("g7_node_anomalies")
def _(spark, d):
    return graph.node_anomalies(graph.undirected_edges(messages(spark, d)), roster(spark, d))


@query("g8_edge_anomalies")
def _(spark, d):
    return graph.edge_anomalies(graph.undirected_edges(messages(spark, d))).select("u", "v", "score", "flag")


@query("g9_temporal_anomalies")
def _(spark, d):
    return graph.temporal_anomalies(messages(spark, d), roster(spark, d)).select("node", "score", "flag")


def _curve_sql(by: str = "") -> str:
    """k: Kaplan-Meier curves of g, one for each value of a column."""
    part, key = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    w, reached = f"OVER ({part}ORDER BY t ROWS UNBOUNDED PRECEDING)", f"OVER ({part}ORDER BY t DESC ROWS UNBOUNDED PRECEDING)"
    return f"counts AS (SELECT {key}duration AS t, sum(event)::BIGINT AS deaths, count(*) AS n FROM g GROUP BY ALL), risks AS (SELECT *, sum(n) {reached}::BIGINT AS at_risk FROM counts), k AS (SELECT *, CASE WHEN at_risk = deaths THEN 0.0 ELSE exp(sum(CASE WHEN at_risk > deaths THEN ln((at_risk - deaths)::DOUBLE / at_risk) END) {w}) END AS survival, sqrt(coalesce(sum(CASE WHEN at_risk > deaths THEN deaths::DOUBLE / (at_risk * (at_risk - deaths)) END) {w}, 0)) AS spread FROM risks)"


@query("u2_kaplan_meier", f"WITH {G_SQL}, {_curve_sql()} SELECT t, deaths, at_risk, round(survival, 6) AS survival, round(survival * spread, 6) AS std_error, round(greatest(survival - 1.959963984540054 * survival * spread, 0), 6) AS lower, round(least(survival + 1.959963984540054 * survival * spread, 1), 6) AS upper FROM k")
def _(spark, d):
    return rounded(survival.kaplan_meier(gaps(spark, d)), "survival", "std_error", "lower", "upper")


@query("w14_time_to_failure", f"WITH {G_SQL.replace('AS (SELECT', 'AS (SELECT o_custkey % 10 AS key,', 1)}, {_curve_sql('key')} SELECT key, coalesce(min(t) FILTER (round(survival, 9) < 0.5), max(t)) AS time FROM k GROUP BY key")
def _(spark, d):
    return survival.time_to_failure(survival.kaplan_meier(gaps(spark, d).withColumn("key", F.pmod("o_custkey", F.lit(10))), by=("key",)), ("key",))


@query("u3_piecewise", f"WITH {G_SQL}, x AS (SELECT 0 AS interval, least(duration, 40) AS x, CASE WHEN duration <= 40 THEN event ELSE 0 END AS d FROM g UNION ALL SELECT 1, greatest(least(duration, 60) - 40, 0), CASE WHEN duration > 40 AND duration <= 60 THEN event ELSE 0 END FROM g UNION ALL SELECT 2, greatest(duration - 60, 0), CASE WHEN duration > 60 THEN event ELSE 0 END FROM g) SELECT interval, sum(d)::BIGINT AS events, sum(x)::DOUBLE AS exposure, round(sum(d) / sum(x), 6) AS hazard FROM x GROUP BY interval")
def _(spark, d):
    return rounded(survival.piecewise_hazards(gaps(spark, d)), "hazard")


@query("u3_parametric")
def _(spark, d):
    df = gaps(spark, d)
    return rounded(survival.ParametricSurvival("weibull").fit(df).curve(df, [10.0, 50.0, 100.0, 300.0]), "survival")


@query("u3_exponential", f"WITH {G_SQL}, m AS (SELECT sum(greatest(duration, 1e-6)) / greatest(sum(event), 1) AS mean FROM g) SELECT t, round(exp(-t / mean), 4) AS survival FROM m, (VALUES (10.0::DOUBLE), (50.0), (100.0), (300.0)) v(t)")
def _(spark, d):
    df = gaps(spark, d)
    curve = survival.ParametricSurvival("exponential").fit(df).curve(df, [10.0, 50.0, 100.0, 300.0])
    return curve.withColumn("survival", F.round("survival", 4))


TD_GRID = 100.0  # days between the points at which curves are compared


@query("a17_time_dependent", f"""WITH {G_SQL.replace('AS (SELECT', 'AS (SELECT o_custkey % 10 AS key,', 1)}, {_curve_sql('key')}, grid AS (SELECT x.c * {TD_GRID}::DOUBLE AS mark FROM range(0, 25) x(c)),
    c AS (SELECT p.key, mark, coalesce((SELECT min(round(survival, 9)) FROM k WHERE k.key = p.key AND k.t <= mark), 1.0) AS s FROM grid, (SELECT DISTINCT key FROM g) p),
    n AS (SELECT key, duration AS t, event AS e, least(floor(duration / {TD_GRID}), 24) * {TD_GRID} AS mark, count(*) AS n FROM g GROUP BY ALL),
    m AS (SELECT a.t AS t_i, b.t AS t_j, a.e AS e_i, b.e AS e_j, x.s AS s_i, y.s AS s_j, CASE WHEN a.t = b.t AND a.e = b.e AND a.key = b.key THEN a.n * (a.n - 1) ELSE a.n * b.n END AS n
        FROM n a JOIN n b ON a.t < b.t AND a.e = 1 OR a.t = b.t AND a.e + b.e > 0 JOIN c x ON x.key = a.key AND x.mark = a.mark JOIN c y ON y.key = b.key AND y.mark = a.mark)
    SELECT round(sum(n * CASE WHEN t_i = t_j AND e_i = 1 AND e_j = 1 THEN CASE WHEN s_i = s_j THEN 1.0 ELSE 0.5 END
        WHEN s_i = s_j THEN 0.5 WHEN (s_i < s_j) = (e_i = 1) THEN 1.0 ELSE 0.0 END)::DOUBLE / sum(n), 6) AS concordance_td, sum(n)::BIGINT AS pairs FROM m""")
def _(spark, d):
    df = gaps(spark, d).withColumn("key", F.pmod("o_custkey", F.lit(10)))
    curve = survival.kaplan_meier(df, by=("key",)).select("key", F.col("t").alias("own"), F.round("survival", 9).alias("s"))
    grid = spark.range(0, 25).select((F.col("id") * TD_GRID).alias("t"))
    steps = curve.join(F.broadcast(grid), F.col("own") <= F.col("t")).groupBy("key", "t").agg(F.min("s").alias("s"))
    steps = curve.select("key").distinct().join(F.broadcast(grid)).join(steps, ["key", "t"], "left").select("key", "t", F.coalesce("s", F.lit(1.0)).alias("survival"))
    each = df.select("o_orderkey", "key").join(F.broadcast(steps), "key").select("o_orderkey", "t", "survival")  # 250 rows of curves
    return rounded(survival.time_dependent_concordance(each, df, "o_orderkey"), "concordance_td")


@query("u4_elastic_net")
def _(spark, d):
    df = gaps(spark, d).withColumn("group", F.pmod("o_custkey", F.lit(10)).cast("double"))
    return rounded(survival.CoxModel(["o_totalprice", "group"], penalty=0.01, l1_ratio=0.5).fit(df).risk(df).select("o_orderkey", "risk_score"), "risk_score")


@query("u4_cox")
def _(spark, d):
    df = gaps(spark, d)
    return rounded(survival.CoxModel(["o_totalprice"]).fit(df).risk(df).select("o_orderkey", "risk_score"), "risk_score")


@query("u5_logistic_hazard")
def _(spark, d):
    df = gaps(spark, d)
    return survival.LogisticHazard(["o_totalprice"]).fit(df).curve(df, "o_orderkey")


@query("u6_deepsurv")
def _(spark, d):
    df = gaps(spark, d)
    return rounded(survival.DeepSurv(["o_totalprice"]).fit(df).risk(df).select("o_orderkey", "risk_score"), "risk_score")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(WIDTH)])


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """The same with all dimensions in one array."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


#: The dimensions of the vectors.
WIDTH = 64
X = tuple(f"x{i}" for i in range(WIDTH))


def detector_query(name: str, made: Callable[[], scoring.Scorer], rows: Callable[[SparkSession, str], DataFrame] = embedded) -> None:
    @query(name)
    def _(spark, d):
        df = rows(spark, d)
        return made().fit(df).transform(df).select("vec_id", "score", "flag")


detector_query("d1_isolation_forest", lambda: detectors.IsolationForest(("x",)))
@query("d2_outliers_by_cells", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.id, b.id AS other, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM p QUALIFY k <= 20), o AS (SELECT id, max(d) AS radius FROM r GROUP BY id),
    f AS (SELECT r.id, 1 / (avg(greatest(d, radius)) + 1e-10) AS density FROM r JOIN o ON o.id = r.other GROUP BY r.id)
    SELECT r.id AS vec_id, round(avg(n.density) / any_value(m.density), 6) AS lof FROM r JOIN f n ON n.id = r.other JOIN f m ON m.id = r.id GROUP BY r.id""")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return rounded(neighbours.outliers(rows, 20).select(F.col("id").alias("vec_id"), "lof"), "lof")


detector_query("d2_local_outlier_factor", lambda: detectors.LocalOutlierFactor(("x",)))
detector_query("d3_robust_covariance", lambda: detectors.RobustCovariance(("x",)))
detector_query("d4_pca", lambda: detectors.PCADetector(("x",), method="both"))
detector_query("d8_voting", lambda: detectors.Ensemble([detectors.IsolationForest(("x",)), detectors.PCADetector(("x",))], "vote"))
detector_query("d9_score_combining", lambda: detectors.Ensemble([detectors.IsolationForest(("x",)), detectors.PCADetector(("x",))], "median"))

SCORES_SQL = "l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY i), r AS (SELECT vec_id, max(abs((x - m) / sd)) AS z, max(greatest(q1 - 1.5 * (q3 - q1) - x, x - q3 - 1.5 * (q3 - q1), 0)) / ((SELECT max(q3 - q1) FROM s) + 1e-10) AS q FROM l JOIN s USING (i) GROUP BY vec_id), v AS (SELECT vec_id, (z + q) / 2 AS mean, greatest(z, q) AS top, CASE WHEN z > (SELECT quantile_cont(z, 0.95) FROM r) THEN 1 ELSE 0 END + CASE WHEN q > (SELECT quantile_cont(q, 0.95) FROM r) THEN 1 ELSE 0 END AS votes FROM r)"


def _both() -> list[scoring.Scorer]:
    return [scoring.ZScore(X), scoring.InterquartileRange(X)]


@query("d8_vote_of_two", f"WITH {SCORES_SQL} SELECT vec_id, round(mean, 6) AS score, votes::INT AS votes, CASE WHEN votes >= 2 THEN 1 ELSE 0 END AS flag FROM v")
def _(spark, d):
    df = vectors(spark, d)
    return rounded(detectors.Ensemble(_both(), "vote").fit(df).transform(df).select("vec_id", "score", "votes", "flag"), "score")


@query("d9_largest_of_two", f"WITH {SCORES_SQL} SELECT vec_id, round(top, 6) AS score, CASE WHEN top > (SELECT quantile_cont(top, 0.95) FROM v) THEN 1 ELSE 0 END AS flag FROM v")
def _(spark, d):
    df = vectors(spark, d)
    return rounded(detectors.Ensemble(_both(), "max").fit(df).transform(df).select("vec_id", "score", "flag"), "score")


COMPARED_SQL = f"WITH {E_SQL}, a AS (SELECT 'z' AS detector, label, abs(value - (SELECT avg(value) FROM e)) / (SELECT stddev_pop(value) FROM e) AS score FROM e UNION ALL SELECT 'iqr', label, greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1), 0.0) / (q3 - q1 + 1e-10) FROM e, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e)), p AS (SELECT *, CASE WHEN score >= quantile_cont(score, 0.9) OVER (PARTITION BY detector) THEN 1 ELSE 0 END AS flag, rank() OVER (PARTITION BY detector ORDER BY score) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0 AS k FROM a), n AS (SELECT detector, {COUNTS_SQL}, (sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM p GROUP BY detector), r AS (SELECT *, {RATES_SQL} FROM n)"


def compared(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d)
    return scoring.compare_detectors(df, {"z": scoring.ZScore().fit(df), "iqr": scoring.InterquartileRange().fit(df)}, ThresholdRule("quantile", quantile=0.9))


@query("a10_compare", COMPARED_SQL + f" SELECT detector, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({F1_SQL}, 6) AS f1, round((tp + tn) * 1.0 / (tp + fp + tn + fn), 6)::DOUBLE AS accuracy, round(auc, 6)::DOUBLE AS roc_auc FROM r")
def _(spark, d):
    return rounded(compared(spark, d), "precision", "recall", "f1", "accuracy", "roc_auc")


@query("z3_comparison", COMPARED_SQL + f", f AS (SELECT *, {F1_SQL} AS f1 FROM r) SELECT detector, 'precision' AS metric, round(precision, 6) AS value FROM f UNION ALL SELECT detector, 'recall', round(recall, 6) FROM f UNION ALL SELECT detector, 'f1', round(f1, 6) FROM f")
def _(spark, d):
    return rounded(scoring.comparison_metrics(compared(spark, d)), "value")


@query("o4_detector_flags", f"WITH {SCORES_SQL} SELECT vec_id, round(mean, 6) AS score, CASE WHEN votes >= 1 THEN 1 ELSE 0 END AS flag FROM v")
def _(spark, d):
    """A detector's own flag stays, whatever the rule."""
    df = vectors(spark, d)
    model = detectors.Ensemble(_both(), "vote", votes=1).fit(df)
    return rounded(scoring.detect_anomalies(df, model, ThresholdRule("absolute", 0.0)).select("vec_id", "score", "flag"), "score")


@query("o7_distance_health")
def _(spark, d):
    df = embedded(spark, d)
    model = detectors.PCADetector(("x",), method="mahalanobis").fit(df)
    return detectors.health_by_distance(df, model, *detectors.health_thresholds(df, model)).select("vec_id", "mahalanobis_distance", "health_state")


@query("z1_boundary_points")
def _(spark, d):
    df = embedded(spark, d)
    return detectors.boundary_points(df, detectors.PCADetector(("x",)).fit(df))


@query("c8_stacked_ordinal")
def _(spark, d):
    df = embedded(spark, d).withColumn("health_state", F.floor(F.col("label") / 4).cast("int"))
    models = [supervised.ProportionalOdds(["x"]), supervised.BoostedOrdinal(["x"])]
    return supervised.StackedOrdinal(models).fit(df).transform(df).select("vec_id", "health_state", "prediction")


def _rate_sql(k: int) -> str:
    return f"{change_sql(filled_sql(), filled_sql(k))} AS rate_{k}"


@query("t4_maintenance_features", f"WITH {RUL_SQL}, n AS (SELECT * REPLACE (CASE WHEN isnan(value) THEN NULL ELSE value END AS value) FROM r), l AS (SELECT *, CASE WHEN RUL > 30 THEN 'healthy' WHEN RUL > 15 THEN 'warning' WHEN RUL > 0 THEN 'critical' WHEN RUL = 0 THEN 'failed' ELSE 'unknown' END AS health_label, {_rate_sql(1)}, {_rate_sql(3)}, {_rate_sql(5)}, avg(value) {ROLL} AS mean, {std_sql(ROLL)} AS sd FROM n) SELECT event_id, RUL, health_label, {half_up('mean')} AS value_rolling_mean, {half_up('sd')} AS value_rolling_std, round(min(value) {ROLL}, 6) AS value_rolling_min, round(max(value) {ROLL}, 6) AS value_rolling_max, {half_up('rate_1')} AS value_rate_1, {half_up('rate_3')} AS value_rate_3, {half_up('rate_5')} AS value_rate_5 FROM l")
def _(spark, d):
    made = [*[f"value_rolling_{k}" for k in ("mean", "std", "min", "max")], *[f"value_rate_{k}" for k in (1, 3, 5)]]
    df = maintenance.maintenance_features(cycles(spark, d), "user_id", "cycle", ["value"])
    return rounded(df.select("event_id", F.col("RUL").cast("long").alias("RUL"), "health_label", *made), *made)


@query("d5_arima_drift")
def _(spark, d):
    return detectors.arima_drift(cycles(spark, d), "value", ["user_id"], ["cycle"]).select("event_id", "score", "flag")


@query("d6_wavelet")
def _(spark, d):
    return detectors.wavelet_detector(cycles(spark, d), "value", ["user_id"], ["cycle"]).select("event_id", "score", "flag")


@query("d7_wavelet_denoise")
def _(spark, d):
    return detectors.wavelet_denoise(cycles(spark, d), "value", ["user_id"], ["cycle"]).select("event_id", "denoised")


@query("d10_autoencoder")
def _(spark, d):
    df = cycles(spark, d)
    return recurrent.LSTMAutoencoder("value", ("user_id",), ("cycle",)).fit(df).transform(df).select("event_id", "score", "flag")


@query("d11_dense_autoencoder")
def _(spark, d):
    df = cycles(spark, d)
    return recurrent.DenseAutoencoder("value", ("user_id",), ("cycle",)).fit(df).transform(df).select("event_id", "score", "flag")


def life_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The last 30 values before each event, and the state of what is left of its user's events (0, 1, 2)."""
    df = windows.remaining_life(cycles(spark, d), "user_id", "cycle").withColumn("state", rules.health_from_rul(F.col("RUL")))
    return windows.sequences(df, ["value", "cycle"], "state", ["user_id"], ["cycle", "event_id"])


@query("c9_recurrent_distress")
def _(spark, d):
    rows = windows.sequences(cycles(spark, d), ["value"], "label", ["user_id"], ["cycle", "event_id"])
    return recurrent.RecurrentClassifier().fit(rows).transform(rows).select("event_id", "distress_probability", "health_state")


@query("c10_attention_distress")
def _(spark, d):
    rows = windows.sequences(cycles(spark, d), ["value"], "label", ["user_id"], ["cycle", "event_id"])
    return recurrent.RecurrentClassifier(attention=True).fit(rows).transform(rows).select("event_id", "distress_probability", "health_state", "attention")


@query("c11_recurrent_ordinal")
def _(spark, d):
    rows = life_sequences(spark, d)
    return recurrent.RecurrentClassifier(ordinal=True, epochs=10, batch=64).fit(rows).transform(rows).select("event_id", "label", "prediction", "probabilities")


@query("c1_failure_risk")
def _(spark, d):
    df = embedded(spark, d).withColumn("label", (F.col("label") >= 7).cast("int"))
    return supervised.FailureRisk(["x"]).fit(df).transform(df).select("vec_id", "failure_probability", "health_state")


@query("c2_sequence_classifier")
def _(spark, d):
    rows = windows.sequences(cycles(spark, d), ["value"], "label", ["user_id"], ["cycle", "event_id"])
    return supervised.SequenceClassifier().fit(rows).transform(rows).select("event_id", "distress_probability", "health_state")


@query("c3_rul")
def _(spark, d):
    df = maintenance.maintenance_features(cycles(spark, d), "user_id", "cycle", ["value"]).na.fill(0.0).withColumnRenamed("RUL", "life")
    made = [c for c in df.columns if c in ("cycle", "value") or c.startswith("value_")]
    df = df.withColumns({c: F.when(F.abs(c) < 1e300, F.col(c)).otherwise(0.0) for c in made})  # rates from 0 are infinite
    return supervised.RULEstimator(made, "life").fit(df).transform(df).select("event_id", "life", "rul")


@query("c5_ordinal")
def _(spark, d):
    df = embedded(spark, d).withColumn("health_state", F.floor(F.col("label") / 4).cast("int"))
    return supervised.ProportionalOdds(["x"]).fit(df).transform(df).select("vec_id", "health_state", "prediction", F.transform("probabilities", lambda p: F.round(p, 6)).alias("probabilities"))


@query("c11_conditional_ordinal")
def _(spark, d):
    df = embedded(spark, d).withColumn("health_state", F.floor(F.col("label") / 4).cast("int"))
    return supervised.OrdinalClassifier(["x"], kind="conditional").fit(df).transform(df).select("vec_id", "health_state", "prediction")


@query("o5_asset_health")
def _(spark, d):
    return supervised.assess_assets(embedded(spark, d).withColumn("label", (F.col("label") >= 7).cast("int")), "vec_id", ["x"], "label")


@query("s2_panel", "SELECT p_partkey AS k, 'p_size' AS ts, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice::DOUBLE FROM part")
def _(spark, d):
    return io.panel(table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice"), "k")


@query("t1_buffered_features", f"WITH {C_SQL}, w AS (SELECT event_id, user_id, count(*) OVER b AS n, avg(value) OVER b AS m, stddev_samp(value) OVER b AS s, min(value) OVER b AS lo, max(value) OVER b AS hi, value - first_value(value) OVER b AS ch, value FROM c WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT user_id, CASE WHEN n = 20 THEN 'ready' ELSE 'buffering' END AS status, n::INT AS rows, round(CASE WHEN n = 20 THEN m END, 6) AS mean, round(CASE WHEN n = 20 THEN s END, 6) AS std, CASE WHEN n = 20 THEN lo END AS min, CASE WHEN n = 20 THEN hi END AS max, CASE WHEN n = 20 THEN value END AS last, round(CASE WHEN n = 20 THEN ch END, 6) AS change FROM w")
def _(spark, d):
    return rounded(maintenance.buffered_features_batch(events(spark, d), "user_id", "ts", "value", 20).select("user_id", "status", "rows", "mean", "std", "min", "max", "last", "change"), "mean", "std", "change")


@query("t2_escalated_alerts", f"WITH {E_SQL}, q AS (SELECT event_id, user_id, CASE WHEN value >= 60 THEN 'critical' WHEN value >= 40 THEN 'warning' END AS level FROM e), a AS (SELECT event_id, user_id, level, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM q WHERE level IS NOT NULL) SELECT event_id, user_id, level, n AS \"count\", CASE WHEN level = 'warning' AND n >= 3 THEN 'critical' WHEN level = 'critical' AND n >= 5 THEN 'failure' ELSE level END AS escalated_level FROM a")
def _(spark, d):
    found = maintenance.alerts(events(spark, d), "user_id", "event_id", {"value": {"warning": 40, "critical": 60}})
    return maintenance.escalated(found, "user_id", "event_id").select("event_id", "user_id", "level", "count", "escalated_level")


@query("t5_tracked_performance", f"WITH {Z_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM f), k AS (SELECT user_id, {COUNTS_SQL} FROM l WHERE n <= 50 GROUP BY user_id), r AS (SELECT *, {RATES_SQL} FROM k) SELECT user_id, tp, fp, tn, fn, round({F1_SQL}, 6) AS f1 FROM r")
def _(spark, d):
    return rounded(maintenance.tracked_performance(flagged(spark, d), "user_id", "ts", 50).select("user_id", "tp", "fp", "tn", "fn", "f1"), "f1")


#: Micro-batches that a table is streamed in.
MICRO_BATCHES = 10


def streamed(spark: SparkSession, d: str, order: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events as a stream in their order, until all are there; the sink is a table in the shared folder.

    A part of the order is written, however many files it takes, and the stream goes on from its checkpoint with all of them as one micro-batch:
    no later row is seen before an earlier one, and the number of micro-batches does not grow with the table.
    """
    path, rows = new_path(spark, "stream"), events(spark, d)
    at = F.col(order).cast("timestamp").cast("double") if order == "ts" else F.col(order).cast("double")
    edges = quantiles(rows, {"at": (at, [k / MICRO_BATCHES for k in range(1, MICRO_BATCHES)])})["at"]
    part = sum(((at > e).cast("int") for e in edges), F.lit(0))
    for k in range(MICRO_BATCHES):
        rows.where(part == k).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        made(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("t1_buffered_stream", ORACLE_SQL["t1_buffered_features"])
def _(spark, d):
    out = streamed(spark, d, "ts", lambda rows: maintenance.buffered_features(rows, "user_id", "ts", "value", 20))
    return rounded(out.select("user_id", "status", "rows", "mean", "std", "min", "max", "last", "change"), "mean", "std", "change")


@query("t2_escalated_stream", ORACLE_SQL["t2_escalated_alerts"])
def _(spark, d):
    made = lambda rows: maintenance.escalated_stream(maintenance.alerts(rows, "user_id", "event_id", {"value": {"warning": 40, "critical": 60}}), "user_id", "event_id")
    return streamed(spark, d, "event_id", made).select("event_id", "user_id", "level", "count", "escalated_level")


PROCESS_SQL = f"WITH {E_SQL}, w AS (SELECT user_id, ts, value, count(*) OVER b AS n, avg(value) OVER b AS m, stddev_samp(value) OVER b AS s, CASE WHEN value >= 60 THEN 'critical' WHEN value >= 40 THEN 'warning' END AS level FROM e WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), k AS (SELECT *, CASE WHEN level IS NOT NULL THEN count(level) OVER (PARTITION BY user_id ORDER BY ts) END AS k FROM w) SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN n = 20 THEN 'ready' ELSE 'buffering' END AS status, n::INT AS rows, round(CASE WHEN n = 20 THEN m END, 6) AS mean, round(CASE WHEN n = 20 THEN s END, 6) AS std, level, k AS \"count\", CASE WHEN level = 'warning' AND k >= 3 THEN 'critical' WHEN level = 'critical' AND k >= 5 THEN 'failure' ELSE level END AS escalated_level FROM k"
PROCESSED = ("user_id", "at", "status", "rows", "mean", "std", "level", "count", "escalated_level")
LIMITS = {"warning": 40.0, "critical": 60.0}


@query("t3_process_table", PROCESS_SQL)
def _(spark, d):
    out = stateful.process_table(events(spark, d), "user_id", "ts", "value", 20, LIMITS)
    return rounded(out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).select(*PROCESSED), "mean", "std")


@query("t3_process_stream", PROCESS_SQL)
def _(spark, d):
    out = streamed(spark, d, "ts", lambda rows: stateful.process_stream(rows, "user_id", "ts", "value", 20, LIMITS))
    return rounded(out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).select(*PROCESSED), "mean", "std")


@query("t3_process", f"WITH {RUL_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back, avg(value) {ROLL} AS m FROM r), s AS (SELECT avg(value) AS am, stddev_pop(value) AS asd FROM e) SELECT user_id, event_id, round(m, 6) AS value_rolling_mean, round(abs((value - am) / asd), 6) AS score, 'ready' AS status FROM x, s WHERE back = 1")
def _(spark, d):
    df = cycles(spark, d)
    features = lambda rows: windows.rolling_statistics(rows, ["value"], ["user_id"], ["cycle"])
    latest, _ = maintenance.process(df, "user_id", "ts", {"z": scoring.ZScore().fit(df)}, features=features)
    return rounded(latest.select("user_id", "event_id", "value_rolling_mean", "score", "status"), "value_rolling_mean", "score")


@query("d4_errors")
def _(spark, d):
    df = embedded(spark, d)
    return detectors.reconstruction_errors(df, detectors.PCADetector(("x",)).fit(df), ["vec_id"])


@query("z4_sensor_drift")
def _(spark, d):
    return detectors.sensor_drift(cycles(spark, d), ["value"], ["user_id"], ["cycle"]).select("user_id", "cycle", "sensor", "score", "flag")


@query("z5_dashboard", f"WITH {RUL_SQL}, x AS (SELECT user_id, RUL, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM r), a AS (SELECT user_id, count(*) FILTER (value >= 40 AND value < 60) AS w, count(*) FILTER (value >= 60 AND value < 100) AS c, count(*) FILTER (value >= 100) AS f FROM e GROUP BY user_id) SELECT user_id, CASE WHEN RUL > 30 THEN 'healthy' WHEN RUL > 15 THEN 'warning' WHEN RUL > 0 THEN 'critical' ELSE 'failed' END AS status, w AS n_warning, c AS n_critical, f AS n_failure FROM x JOIN a USING (user_id) WHERE back = 1")
def _(spark, d):
    df = windows.remaining_life(cycles(spark, d), "user_id", "cycle")
    latest, found = maintenance.process(df, "user_id", "ts", {}, {"value": {"warning": 40, "critical": 60, "failure": 100}})
    return maintenance.asset_dashboard(latest, found, "user_id", "ts").select("user_id", "status", "n_warning", "n_critical", "n_failure")
