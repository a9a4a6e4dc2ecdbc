"""Split, scaling, metrics, curves and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import GateConfig
from ..functions.numeric import finite_or_zero
from ..operators import evaluation as E
from ..operators import gates, scaling, split
from .aggregates import MEASURES, _rounded
from .joins import ENTITIES_SQL, _entities
from .views import EMAILS_SQL, JOB_TIME, SCORED_SQL, moment, scored, table, with_views

METRICS_SQL = """
{name} AS (
  SELECT CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0e0) AS precision,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0e0) AS recall,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0e0) AS f1, auc_roc
  FROM (
    SELECT count(*) FILTER (label = 1 AND {p} = 1) AS tp, count(*) FILTER (label = 0 AND {p} = 1) AS fp,
      count(*) FILTER (label = 1 AND {p} = 0) AS fn, count(*) FILTER (label = 0 AND {p} = 0) AS tn FROM scored),
  (SELECT (sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * n) AS auc_roc FROM (
    SELECT label, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0e0 AS r,
      CAST(count(*) FILTER (label = 1) OVER () AS DOUBLE) AS p, CAST(count(*) FILTER (label = 0) OVER () AS DOUBLE) AS n FROM scored)
   GROUP BY p, n)
)"""
A_SQL = METRICS_SQL.format(name="ma", p="prediction", s="score")
B_SQL = METRICS_SQL.format(name="mb", p="prediction_b", s="score_b")

STEPS_SQL = """
curve AS (
  SELECT threshold, p_total, n_total, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
    SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg,
      sum(count(*) FILTER (label = 1)) OVER () AS p_total, sum(count(*) FILTER (label = 0)) OVER () AS n_total
    FROM scored GROUP BY score)
  WINDOW w AS (ORDER BY threshold DESC)
)"""


def _metrics(spark, sf):
    return E.metrics(scored(spark, sf))


def _metrics_b(spark, sf):
    return E.metrics(scored(spark, sf), prediction="prediction_b", score="score_b")


def _scaled(spark, sf):
    rows = table(spark, sf, "lineitem")
    z = scaling.fit_scaler(rows, MEASURES).transform(rows.select("l_orderkey", "l_linenumber", "l_partkey", *MEASURES))
    return z.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(m, 6).alias(m) for m in MEASURES])


def _split(spark, sf):
    return split.stratified_split(_entities(spark, sf)).select("email_id", "label", "is_test")


def _split_priority(spark, sf):
    """Orders split by priority: five classes, every order counted."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("email_id"), F.col("o_orderpriority").alias("label"))
    return split.stratified_split(orders)


def _split_sql(source: str) -> str:
    return f"""SELECT email_id, label,
                 row_number() OVER (PARTITION BY label ORDER BY md5(email_id || '|42')) <= round(count(*) OVER (PARTITION BY label) * 0.2e0) AS is_test
               FROM {source}"""


def _parity(spark, sf):
    a = scored(spark, sf).select("doc_id", "score")
    b = scored(spark, sf).select("doc_id", (F.col("score") + (F.col("doc_id") % 7).cast("double") / 10000).alias("score"))
    return _rounded(E.score_parity(a, b, "doc_id"), keep=())


def _promotion(spark, sf):
    m = _metrics(spark, sf)
    gate = gates.quality_gate(m, GateConfig(min_f1=0.5, min_auc=0.4, min_precision=0.5, min_recall=0.3))
    comparison = gates.compare_models(m, _metrics_b(spark, sf), GateConfig(max_f1_regression=0.001, max_auc_regression=0.5))
    return gates.promotion_decision(gate, comparison)


def _r(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_M = ["accuracy", "precision", "recall", "f1", "auc_roc"]

def _cleaned(spark, sf):
    """Order prices with missing, infinite and not-a-number cells by priority."""
    level = F.left("o_orderpriority", F.lit(1))
    odd = (
        F.when(level == "1", F.lit(None)).when(level == "2", F.lit(float("nan"))).when(level == "3", F.lit(float("-inf")))
        .otherwise(F.col("o_totalprice"))
    )
    return table(spark, sf, "orders").select("o_orderkey", finite_or_zero(odd).alias("price"))


def _registry(spark, sf):
    return _rounded(gates.registry_row(_metrics(spark, sf), "spam-detector", "7", 0.1, moment(JOB_TIME)), 4, keep=())


QUERIES = {
    "h02_stratified_split": (_split, with_views(EMAILS_SQL, ENTITIES_SQL, body=_split_sql("entities"))),
    "h02_stratified_split_orders": (
        _split_priority,
        with_views("o AS (SELECT CAST(o_orderkey AS VARCHAR) AS email_id, o_orderpriority AS label FROM orders)", body=_split_sql("o")),
    ),
    "h04_standard_scaler": (
        _scaled,
        "SELECT l_orderkey, l_linenumber, l_partkey, "
        + ", ".join(f"round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 6) AS {m}" for m in MEASURES)
        + " FROM lineitem",
    ),
    "h05_finite_or_zero": (
        _cleaned,
        "SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3') THEN 0.0e0 ELSE o_totalprice END AS price FROM orders",
    ),
    "h23_registry_row": (
        _registry,
        with_views(
            SCORED_SQL, A_SQL,
            body=f"""SELECT 'spam-detector' AS model_name, '7' AS model_version, 'Staging' AS stage, TIMESTAMP '{JOB_TIME}' AS registered_at,
                       round(f1, 4) AS test_f1, round(auc_roc, 4) AS test_auc_roc, round(precision, 4) AS test_precision,
                       round(recall, 4) AS test_recall FROM ma WHERE f1 >= 0.1""",
        ),
    ),
    "h11_metrics": (
        lambda spark, sf: _rounded(_metrics(spark, sf), keep=()),
        with_views(SCORED_SQL, A_SQL, body=f"SELECT {_r(_M)} FROM ma"),
    ),
    "h12_confusion_matrix": (
        lambda spark, sf: E.confusion_matrix(scored(spark, sf)),
        with_views(SCORED_SQL, body="SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction"),
    ),
    "h13_classification_report": (
        lambda spark, sf: _rounded(E.classification_report(scored(spark, sf)), keep=("class",)),
        with_views(
            SCORED_SQL,
            """cls AS (
                 SELECT CAST(c AS VARCHAR) AS class, CAST(count(*) FILTER (label = c AND prediction = c) AS DOUBLE) / nullif(count(*) FILTER (prediction = c), 0) AS precision,
                   CAST(count(*) FILTER (label = c AND prediction = c) AS DOUBLE) / nullif(count(*) FILTER (label = c), 0) AS recall,
                   CAST(2 * count(*) FILTER (label = c AND prediction = c) AS DOUBLE) / nullif(count(*) FILTER (label = c) + count(*) FILTER (prediction = c), 0) AS f1,
                   count(*) FILTER (label = c) AS support
                 FROM scored, (SELECT unnest([0, 1]) AS c) GROUP BY c)""",
            body="""SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cls
                    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM cls
                    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM cls""",
        ),
    ),
    "h14_roc_curve": (
        lambda spark, sf: _rounded(E.roc_curve(scored(spark, sf)), keep=()),
        with_views(SCORED_SQL, STEPS_SQL, body="SELECT threshold, round(CAST(fp AS DOUBLE) / n_total, 6) AS fpr, round(CAST(tp AS DOUBLE) / p_total, 6) AS tpr FROM curve"),
    ),
    "h15_precision_recall_curve": (
        lambda spark, sf: _rounded(E.precision_recall_curve(scored(spark, sf)), keep=()),
        with_views(SCORED_SQL, STEPS_SQL, body="SELECT threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / p_total, 6) AS recall FROM curve"),
    ),
    "h17_quality_gate": (
        lambda spark, sf: _rounded(gates.quality_gate(_metrics(spark, sf)), keep=("metric",)),
        with_views(
            SCORED_SQL, A_SQL,
            body="""SELECT 'f1' AS metric, round(f1, 6) AS value, 0.85e0 AS threshold, f1 >= 0.85 AS passed FROM ma
                    UNION ALL SELECT 'auc_roc', round(auc_roc, 6), 0.90e0, auc_roc >= 0.90 FROM ma
                    UNION ALL SELECT 'precision', round(precision, 6), 0.80e0, precision >= 0.80 FROM ma
                    UNION ALL SELECT 'recall', round(recall, 6), 0.80e0, recall >= 0.80 FROM ma""",
        ),
    ),
    "h18_sanity_gate": (
        lambda spark, sf: _rounded(gates.sanity_gate(scored(spark, sf)), keep=()),
        with_views(
            SCORED_SQL,
            body="""SELECT round(a, 6) AS actual_spam_ratio, round(p, 6) AS predicted_spam_ratio, diverse,
                      round(abs(p - a) / greatest(a, 0.01e0), 6) AS ratio_difference, abs(p - a) / greatest(a, 0.01e0) < 0.5 AND diverse AS passed
                    FROM (SELECT avg(label) AS a, avg(prediction) AS p, max(prediction) <> min(prediction) AS diverse FROM scored)""",
        ),
    ),
    "h20_model_comparison": (
        lambda spark, sf: _rounded(gates.compare_models(_metrics(spark, sf), _metrics_b(spark, sf)), keep=()),
        with_views(
            SCORED_SQL, A_SQL, B_SQL,
            body="""SELECT round(df, 6) AS f1_improvement, round(da, 6) AS auc_improvement, round(greatest(-df, 0.0e0), 6) AS f1_regression,
                      round(greatest(-da, 0.0e0), 6) AS auc_regression, greatest(-df, 0) <= 0.05 AND greatest(-da, 0) <= 0.05 AS passed
                    FROM (SELECT ma.f1 - mb.f1 AS df, ma.auc_roc - mb.auc_roc AS da FROM ma, mb)""",
        ),
    ),
    "h21_promotion_decision": (
        _promotion,
        with_views(
            SCORED_SQL, A_SQL, B_SQL,
            """d AS (SELECT ma.f1 >= 0.5 AND ma.auc_roc >= 0.4 AND ma.precision >= 0.5 AND ma.recall >= 0.3 AS v,
                      greatest(mb.f1 - ma.f1, 0) <= 0.001 AND greatest(mb.auc_roc - ma.auc_roc, 0) <= 0.5 AS c FROM ma, mb)""",
            body="""SELECT v AND c AS promoted, v AS validation_passed, c AS comparison_passed,
                      concat_ws('; ', CASE WHEN NOT v THEN 'validation failed' END, CASE WHEN NOT c THEN 'comparison failed' END) AS blocking_reasons FROM d""",
        ),
    ),
    "h22_score_parity": (
        _parity,
        with_views(
            SCORED_SQL,
            "p AS (SELECT score AS a, score + CAST(doc_id % 7 AS DOUBLE) / 10000 AS b FROM scored)",
            "q AS (SELECT abs(a - b) AS d, (a > 0.5e0) = (b > 0.5e0) AS same FROM p)",
            body="""SELECT round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS std_diff,
                      round(CAST(count(*) FILTER (same) AS DOUBLE) / count(*), 6) AS label_match_rate, round(quantile_cont(d, 0.99), 6) AS p99_diff,
                      max(d) <= 0.001 AND CAST(count(*) FILTER (same) AS DOUBLE) / count(*) >= 0.99 AS passed FROM q""",
        ),
    ),
}
