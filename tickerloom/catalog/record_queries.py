"""Profiles, integrity rules, linting, tracking tables, streams, tabular models and walk-forward training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog import inputs as src
from tickerloom.catalog.feature_queries import FAST_MATRIX_SQL, FAST_SQL, matrix
from tickerloom.catalog.panel_queries import DEFAULT_FOLDS_SQL, SQL_LISTING, listing, scratch
from tickerloom.catalog.registry import query, r
from tickerloom.catalog.study_queries import SQL_PRED, _metric_sql, fold_metrics, regime_table
from tickerloom.config import FoldSettings, ModelSettings
from tickerloom.operators import attribution as at, boosting as bo, cleaning as cl, folds as fo, metrics as me, models as mo, quality as qa, tabular as tb
from tickerloom.operators import reports as rp, tracking as tr
from tickerloom.plans import plugins
from tickerloom.session import cut_lineage, stored, stored_rounded
from tickerloom.sources import tables as io
from tickerloom.streaming import metrics as sm

# integrity and linting ------------------------------------------------------------------------------------------
SQL_LONG = f"""{SQL_PRED}, {_metric_sql('fold, model')},
tall AS (SELECT 'fold ' || fold || ' ' || model AS context, unnest(['auc_roc', 'precision', 'recall', 'sharpe', 'p_value', 'accuracy']) AS name,
  unnest([auc_roc, round(precision, 2), CASE WHEN fold % 2 = 0 THEN recall END, log_loss * 10, CASE WHEN fold = 3 THEN 1.5 ELSE accuracy END, CASE WHEN fold = 1 THEN 'NaN'::DOUBLE ELSE accuracy END]) AS value FROM metrics)"""


def long_metrics(spark, d):
    m, v = fold_metrics(spark, d), F.col
    pairs = [("auc_roc", v("auc_roc")), ("precision", F.round("precision", 2)), ("recall", F.when(v("fold") % 2 == 0, v("recall"))),
             ("sharpe", v("log_loss") * 10), ("p_value", F.when(v("fold") == 3, F.lit(1.5)).otherwise(v("accuracy"))),
             ("accuracy", F.when(v("fold") == 1, F.lit(float("nan"))).otherwise(v("accuracy")))]
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in pairs]))
    context = F.concat(F.lit("fold "), v("fold").cast("string"), F.lit(" "), v("model"))
    return m.select(context.alias("context"), items.alias("_m")).select("context", "_m.name", "_m.value")


SOUND = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"
SQL_CHECKS = f"""{SQL_LONG},
checks AS (
  SELECT context, name, 'null_check' AS "check" FROM tall WHERE value IS NULL
  UNION ALL SELECT context, name, 'nan_inf_check' FROM tall WHERE isnan(value) OR isinf(value)
  UNION ALL SELECT context, name, 'fabrication_check' FROM tall WHERE (name = 'precision' AND abs(value - 0.61) < 1e-10) OR (name = 'recall' AND abs(value - 0.57) < 1e-10) OR (name = 'sharpe' AND abs(value - 1.42) < 1e-10)
  UNION ALL SELECT context, name, 'range_check' FROM tall WHERE {SOUND} AND ((name IN ('auc_roc', 'precision', 'recall', 'accuracy', 'p_value') AND (value < 0 OR value > 1)) OR (name = 'sharpe' AND abs(value) > 10))
  UNION ALL SELECT context, name, 'roundness_check' FROM tall WHERE {SOUND} AND value NOT IN (0, 1, -1) AND name <> 'p_value' AND abs(value) > 0.01 AND length(rtrim(split_part(printf('%.10f', value), '.', 2), '0')) <= 2)"""


@query("dq01_metrics_integrity", f'WITH {SQL_CHECKS} SELECT context, name, "check" FROM checks')
def _integrity(spark, d):
    return qa.metrics_integrity(long_metrics(spark, d)).select("context", "name", "check")


@query("dq02_integrity_report", f"WITH {SQL_CHECKS} SELECT context, count(*) AS n_metrics, (SELECT count(*) FROM checks WHERE checks.context = tall.context) AS n_failed, "
       "(SELECT count(*) FROM checks WHERE checks.context = tall.context) = 0 AS passed FROM tall GROUP BY context")
def _report(spark, d):
    return qa.integrity_report(long_metrics(spark, d)).select("context", "n_metrics", "n_failed", "passed")


@query("cs01_lint_hardcoded_metrics", """
WITH s AS (SELECT page_id AS path, string_split(html, chr(10)) AS parts FROM pages UNION ALL SELECT -1 - doc_id, string_split('recall = 0.57' || chr(10) || text || chr(10) || '# demo DEPRECATED', chr(10)) FROM documents),
l AS (SELECT path, unnest(range(1, len(parts) + 1))::INTEGER AS line_no, trim(regexp_replace(unnest(parts), '[\\t\\r]', ' ', 'g')) AS line FROM s)
SELECT path, line_no, line FROM l WHERE NOT (starts_with(line, '#') AND contains(line, 'DEPRECATED')) AND (regexp_matches(line, 'if\\s+\\w+\\s*==\\s*0\\s*:\\s*\\w+\\s*=\\s*[-]?[\\d.]+')
  OR regexp_matches(line, '\\b(?:prec|precision|recall|sharpe|dm_pvalue)\\s*[:=]\\s*(?:0\\.61|0\\.57|1\\.42|0\\.028|-0\\.135)\\b') OR regexp_matches(line, '(?i)#.*(?:realistic|demo|presentation|scholarship)'))""")
def _lint(spark, d):
    pages = src.table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    docs = src.table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("path"), F.concat(
        F.lit("recall = 0.57\n"), F.col("text"), F.lit("\n# demo DEPRECATED")).alias("text"))
    return qa.lint_hardcoded_metrics(io.number_lines(pages.unionByName(docs), "text", ("path",)))


# profiles -------------------------------------------------------------------------------------------------------
def _kinds(table: str, kinds: dict[str, str]) -> str:
    """Kinds are facts of the column types and contents; they are listed with the evidence DuckDB counts."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, (SELECT count({c}) FROM {table}) AS n" for c, k in kinds.items())
    return rows


def _with_counts(kinds, table, names):
    counts = qa.column_counts(table, names)
    return kinds.join(counts, "column").select("column", "kind", (F.col("total_count") - F.col("missing_count")).alias("n"))


ORDER_KINDS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
               "o_orderdate": "datetime", "o_orderpriority": "categorical"}


@query("dq03_infer_column_kinds", _kinds("orders", ORDER_KINDS) + " UNION ALL " + _kinds("labels", {"doc_id": "numeric", "quality": "boolean", "toxic": "boolean"})
       + " UNION ALL " + _kinds("documents", {"text": "text", "lang": "categorical"}))
def _column_kinds(spark, d):
    orders, labels = src.table(spark, d, "orders"), src.table(spark, d, "labels")
    docs = src.table(spark, d, "documents").select("text", "lang")
    parts = [_with_counts(qa.infer_column_kinds(t), t, t.columns) for t in (orders, labels, docs)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


NUM = ("o_orderkey", "o_custkey", "o_totalprice")


@query("dq04_column_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'avg({c}) AS mean', f'stddev_samp({c}) AS std', f'min({c}) AS min', f'max({c}) AS max', f'quantile_cont({c}, 0.5) AS median')} FROM orders" for c in NUM))
def _stats(spark, d):
    return qa.numeric_stats(src.table(spark, d, "orders"), NUM)


@query("dq05_infer_schema", "WITH " + ", ".join(
    f"m_{c} AS (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY {c} ORDER BY n DESC, v LIMIT 1)" for c in ("o_orderstatus", "o_orderpriority")) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS total_count, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count, "
    + (f"round(avg({c}), 6) + 0.0 AS mean, round(quantile_cont({c}, 0.5)::DOUBLE, 6) + 0.0 AS median, " if k == "numeric" else "NULL::DOUBLE AS mean, NULL::DOUBLE AS median, ")
    + (f"(SELECT v FROM m_{c}) AS most_frequent, (SELECT n FROM m_{c}) AS most_frequent_frequency, " if k == "categorical" else "NULL AS most_frequent, NULL::BIGINT AS most_frequent_frequency, ")
    + (f"strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min_date" if k == "datetime" else "NULL AS min_date") + " FROM orders" for c, k in ORDER_KINDS.items()))
def _schema(spark, d):
    return qa.infer_schema(src.table(spark, d, "orders")).select(
        "column", "type", "total_count", "missing_count", "unique_count", "mean", "median", "most_frequent", "most_frequent_frequency", "min_date")


@query("dq06_suggest_target", "SELECT 'o_orderkey' AS target, count(*) AS n_rows FROM orders")
def _suggest(spark, d):
    t = src.table(spark, d, "orders")
    return t.agg(F.lit(qa.suggest_target(t.columns)).alias("target"), F.count(F.lit(1)).alias("n_rows"))


@query("dq07_suggest_problem_type", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderstatus', 'o_orderpriority', 'o_orderdate']) AS \"column\", "
       "unnest(['forecasting', 'forecasting', 'forecasting', CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END, "
       "CASE WHEN count(DISTINCT o_orderpriority) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END, 'unknown']) AS problem_type FROM orders")
def _problem(spark, d):
    t = src.table(spark, d, "orders")
    return qa.suggest_problem_type(qa.infer_schema(t), "*")


PRINTED = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "CAST(l_shipdate AS DATE)", "CAST(round(l_extendedprice * 100) AS BIGINT)",
           "CAST(round(l_quantity) AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)", "CAST(round(l_tax * 100) AS BIGINT)", "CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END")


@query("dq08_table_fingerprint", "WITH h AS (SELECT md5(" + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in PRINTED)
       + ") AS h FROM lineitem) SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(h, 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS content_hash FROM h")
def _fingerprint(spark, d):
    return io.table_fingerprint(src.table(spark, d, "lineitem").select(*[F.expr(c).alias(f"c{i}") for i, c in enumerate(PRINTED)]))


# tracking -------------------------------------------------------------------------------------------------------
SQL_TRACK = """
metrics AS (SELECT user_id AS run_id, event_type AS key, value, event_id AS step, ts FROM events),
runs AS (SELECT user_id AS run_id, user_id % 20 AS experiment_id, CAST(user_id // 20 + 1 AS INTEGER) AS run_number,
                CASE user_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, min(ts) AS started_at, max(ts) AS last_at FROM events GROUP BY user_id),
experiments AS (SELECT DISTINCT experiment_id, experiment_id % 7 AS dataset_id FROM runs),
steps AS (SELECT user_id AS run_id, 'step_' || (event_id % 8) AS step_name, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'completed' ELSE 'failed' END AS status, ts, event_id FROM events),
planned AS (SELECT run_id, 'step_' || i AS step_name FROM runs, range(0, 8) t(i)),
laststep AS (SELECT run_id, step_name, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step_name ORDER BY ts DESC, status DESC) AS rn FROM steps) WHERE rn = 1)"""


def metric_rows(spark, d):
    return sm.as_metrics(src.table(spark, d, "events"))


def runs(spark, d):
    u = F.col("user_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("created", "running", "completed", "failed")]), (u % 4 + 1).cast("int"))
    return src.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at")).select(
        u.alias("run_id"), (u % 20).alias("experiment_id"), (F.floor(u / 20) + 1).cast("int").alias("run_number"), status.alias("status"), "started_at", "last_at")


def experiments(spark, d):
    return runs(spark, d).select("experiment_id").distinct().withColumn("dataset_id", F.col("experiment_id") % 7)


def steps(spark, d):
    e = F.col("event_id")
    status = F.when(e % 3 == 0, "running").when(e % 3 == 1, "completed").otherwise("failed")
    return src.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.concat(F.lit("step_"), (e % 8).cast("string")).alias("step_name"), status.alias("status"), "ts")


def planned(spark, d):
    names = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("step_"), i.cast("string"))))
    return runs(spark, d).select("run_id", names.alias("step_name"))


@query("tr01_append_log", f"WITH {SQL_TRACK} SELECT run_id, key, {r('value')}, step FROM metrics")
def _append(spark, d):
    path, rows = f"{scratch(spark)}/metrics", metric_rows(spark, d)
    for part in range(2):
        tr.append_log(rows.where(F.col("step") % 2 == part), path, 8)
    return spark.read.parquet(path).select("run_id", "key", "value", "step")


def _event_files(spark, d):
    path = f"{scratch(spark)}/events"
    day = F.to_date("ts")
    src.table(spark, d, "events").repartition(8, day).write.parquet(path)
    return path


@query("tr02_stream_metrics", f"WITH {SQL_TRACK} SELECT run_id, key, {r('value')}, step, ts FROM metrics")
def _stream(spark, d):
    base = scratch(spark)
    stream = sm.as_metrics(sm.read_event_files(spark, _event_files(spark, d), files_per_batch=3))
    sm.stream_metrics(stream, f"{base}/out", f"{base}/state", every=None).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("run_id", "key", "value", "step", "ts")


@query("tr03_run_channel", f"WITH {SQL_TRACK} SELECT 'run:' || run_id AS channel, 'metric.logged' AS name, run_id, key, {r('value')}, step FROM metrics")
def _channel(spark, d):
    events = sm.to_events(metric_rows(spark, d))
    out = sm.subscribe(events, names=["metric.logged"])
    return out.select("channel", "name", "run_id", "key", "value", "step")


@query("tr04_latest_metric", f"WITH {SQL_TRACK} SELECT run_id, key, max(step) AS step, {r('arg_max(value, step) AS value')} FROM metrics GROUP BY run_id, key")
def _latest(spark, d):
    return tr.latest_metric(metric_rows(spark, d)).select("run_id", "key", "step", "value")


@query("tr04_running_latest_stream", f"WITH {SQL_TRACK} SELECT run_id, key, max(step) AS step, {r('arg_max(value, step) AS value')} FROM metrics GROUP BY run_id, key")
def _running_latest(spark, d):
    base = scratch(spark)
    stream = sm.as_metrics(sm.read_event_files(spark, _event_files(spark, d), files_per_batch=3))
    sm.write_latest(sm.running_latest(stream), f"{base}/out", f"{base}/state", every=None).awaitTermination()
    return tr.latest_metric(spark.read.parquet(f"{base}/out").select("run_id", "key", "step", "ts", "value")).select("run_id", "key", "step", "value")


@query("tr05_step_states", f"WITH {SQL_TRACK} SELECT run_id, step_name, status, CASE WHEN status = 'completed' THEN ts END AS completed_at FROM laststep")
def _step_states(spark, d):
    return tr.step_states(steps(spark, d))


@query("tr05_steps_to_resume", f"WITH {SQL_TRACK} SELECT run_id, step_name FROM planned EXCEPT SELECT run_id, step_name FROM laststep WHERE status = 'completed'")
def _resume(spark, d):
    return tr.steps_to_resume(planned(spark, d), steps(spark, d))


@query("tr06_run_lifecycle", f"WITH {SQL_TRACK} SELECT run_id, arg_max(status, (ts, status)) AS status, max(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at, "
       f"{r('''epoch_us(max(ts) FILTER (status IN ('completed', 'failed'))) / 1e6 - epoch_us(max(ts) FILTER (status = 'running')) / 1e6 AS duration_seconds''')}, "
       "arg_max(CASE WHEN status = 'failed' THEN step_name END, (ts, CASE WHEN status = 'failed' THEN step_name END)) FILTER (status = 'failed') AS error_message FROM steps GROUP BY run_id")
def _lifecycle(spark, d):
    events = steps(spark, d).withColumn("error", F.when(F.col("status") == "failed", F.col("step_name")))
    return tr.run_lifecycle(events)


@query("tr07_fail_stuck_runs", f"WITH {SQL_TRACK} SELECT run_id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN 'Server restarted during execution' END AS error_message, "
       f"{r('''CASE status WHEN 'running' THEN epoch_us(last_at) / 1e6 - epoch_us(started_at) / 1e6 END AS duration_seconds''')} FROM runs")
def _stuck(spark, d):
    r_ = runs(spark, d).withColumns({"error_message": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("timestamp"), "duration_seconds": F.lit(None).cast("double")})
    return tr.fail_stuck_runs(r_, F.col("last_at")).select("run_id", "status", "error_message", "duration_seconds")


@query("tr08_run_progress", f"WITH {SQL_TRACK} SELECT run_id, count(*) FILTER (status = 'completed') AS n_completed, count(*) AS n_planned, {r('count(*) FILTER (status = chr(99) || substr(status, 2) AND status = $$completed$$) / count(*) AS progress')} "
       "FROM planned LEFT JOIN laststep USING (run_id, step_name) GROUP BY run_id")
def _progress(spark, d):
    return tr.run_progress(planned(spark, d), steps(spark, d))


@query("tr09_backfill_artifacts", f"WITH {SQL_TRACK}, {SQL_LISTING} SELECT run_id, name, size_bytes, content_type, artifact_type FROM runs, listing WHERE status = 'completed' AND run_id NOT IN (SELECT run_id FROM metrics WHERE step % 500 = 0)")
def _backfill(spark, d):
    have = metric_rows(spark, d).where(F.col("step") % 500 == 0).select("run_id").distinct()
    return tr.backfill_artifacts(runs(spark, d), have, listing(spark, d))


@query("tr10_upsert_experiments", f"""WITH {SQL_TRACK}, old AS (SELECT experiment_id, dataset_id, 'old' AS name, 'd' || experiment_id AS description FROM experiments WHERE experiment_id < 15),
new AS (SELECT experiment_id, dataset_id, CASE WHEN experiment_id % 2 = 0 THEN 'new' END AS name, 'n' || experiment_id AS description FROM experiments WHERE experiment_id >= 5),
sets AS (SELECT DISTINCT dataset_id FROM experiments WHERE dataset_id < 4)
SELECT experiment_id, coalesce(o.dataset_id, n.dataset_id) AS dataset_id, coalesce(n.name, o.name) AS name, coalesce(n.description, o.description) AS description
FROM old o FULL JOIN new n USING (experiment_id) WHERE o.experiment_id IS NOT NULL OR n.dataset_id IN (SELECT dataset_id FROM sets)""")
def _upsert(spark, d):
    e, key = experiments(spark, d), F.col("experiment_id")
    tags = F.lit(None).cast("array<string>").alias("tags")
    text = lambda p: F.concat(F.lit(p), key.cast("string")).alias("description")
    old = e.where(key < 15).select("experiment_id", "dataset_id", F.lit("old").alias("name"), text("d"), tags)
    new = e.where(key >= 5).select("experiment_id", "dataset_id", F.when(key % 2 == 0, "new").alias("name"), text("n"), tags)
    return tr.upsert_experiments(old, new, e.where("dataset_id < 4")).drop("tags")


@query("jn12_tracking_lookup", f"WITH {SQL_TRACK} SELECT run_id, key, {r('value')}, step FROM metrics WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'completed')")
def _lookup(spark, d):
    done = runs(spark, d).where(F.col("status") == "completed")
    return tr.tracking_lookup(metric_rows(spark, d), done, "run_id", ["run_id", F.col("step").desc()], ["run_id", "key", "value", "step"])


@query("jn13_cascade_delete", f"WITH {SQL_TRACK} SELECT run_id, key, step FROM metrics WHERE run_id NOT IN (SELECT run_id FROM runs WHERE experiment_id % 3 = 0)")
def _cascade(spark, d):
    gone = experiments(spark, d).where(F.col("experiment_id") % 3 == 0).select("experiment_id")
    left = tr.cascade_delete({"experiments": experiments(spark, d), "runs": runs(spark, d), "metrics": metric_rows(spark, d)}, gone)
    return left["metrics"].select("run_id", "key", "step")


@query("jn13_unreferenced_datasets", f"WITH {SQL_TRACK} SELECT DISTINCT doc_id AS dataset_id FROM documents WHERE doc_id NOT IN (SELECT dataset_id FROM experiments)")
def _unreferenced(spark, d):
    return tr.unreferenced_datasets(src.table(spark, d, "documents").select(F.col("doc_id").alias("dataset_id")), experiments(spark, d))


@query("ag08_next_run_number", f"WITH {SQL_TRACK} SELECT e.experiment_id, coalesce(max(run_number), 0) + 1 AS next_run_number FROM experiments e LEFT JOIN runs USING (experiment_id) GROUP BY e.experiment_id")
def _next_run(spark, d):
    return tr.next_run_number(runs(spark, d), experiments(spark, d))


@query("tk03_latest_first", f"WITH {SQL_TRACK} SELECT run_id, started_at, row_number() OVER (PARTITION BY experiment_id ORDER BY started_at DESC) AS place FROM runs")
def _latest_first(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("experiment_id").orderBy(F.col("started_at").desc())
    return runs(spark, d).select("run_id", "started_at", F.row_number().over(w).cast("bigint").alias("place"))


# plug-ins -------------------------------------------------------------------------------------------------------
class _Spread:
    def compute(self, df):
        return df.withColumn("spread", F.col("high") - F.col("low"))

    def get_feature_names(self):
        return ["spread"]


@query("ud02_feature_plugin", f"WITH {src.SQL_BARS} SELECT ticker, date, {r('high - low AS spread')} FROM bars")
def _plugin(spark, d):
    return plugins.apply_features(src.bars(spark, d), [_Spread()]).select("ticker", "date", "spread")


@query("ud04_step_plugin", f"WITH {src.SQL_BARS} SELECT ticker, {r('avg(close) AS mean_close')} FROM bars GROUP BY ticker")
def _steps(spark, d):
    out = plugins.run_steps([("load", lambda t: {"bars": src.bars(spark, d)}),
                             ("summarise", lambda t: {"means": t["bars"].groupBy("ticker").agg(F.avg("close").alias("mean_close"))})], {}, "r1")
    return out["means"]


# tabular --------------------------------------------------------------------------------------------------------
SQL_TAB = """tab AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority, c_acctbal AS balance,
 c_mktsegment AS segment, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def tab(spark, d):
    key = F.col("o_orderkey")
    o, c = src.table(spark, d, "orders"), src.table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(key % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"))


@query("wf17_impute", f"WITH {SQL_TAB}, m AS (SELECT quantile_cont(price, 0.5) AS p FROM tab), q AS (SELECT priority AS v FROM tab WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1) "
       f"SELECT o_orderkey, {r('coalesce(price, p) AS price')}, coalesce(priority, v) AS priority FROM tab, m, q")
def _impute(spark, d):
    return tb.impute(tab(spark, d), ["price"], ["priority"]).select("o_orderkey", "price", "priority")


@query("wf18_label_encode", f"WITH {SQL_TAB} SELECT o_orderkey, {r('dense_rank() OVER (ORDER BY segment) - 1 AS segment', 'dense_rank() OVER (ORDER BY status) - 1 AS status')} FROM tab")
def _encode(spark, d):
    return tb.label_encode(tab(spark, d), ["segment", "status"]).select("o_orderkey", "segment", "status")


@query("wf19_standard_scale", f"WITH {SQL_TAB} SELECT o_orderkey, {r('(balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS balance', '(price - avg(price) OVER ()) / stddev_pop(price) OVER () AS price')} FROM tab")
def _scale(spark, d):
    return tb.standard_scale(tab(spark, d), ["balance", "price"]).select("o_orderkey", "balance", "price")


@query("wf20_stratified_split", f"WITH {SQL_TAB}, n AS (SELECT o_orderkey, status, row_number() OVER (PARTITION BY status ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn, count(*) OVER (PARTITION BY status) AS n FROM tab) "
       "SELECT o_orderkey, status, rn <= floor(n * 0.8) AS is_train FROM n")
def _stratified(spark, d):
    return tb.stratified_split(tab(spark, d).select("o_orderkey", "status"), "o_orderkey", "status")


def _prepared(spark, d):
    # Every step reads its input several times, so each starts from stored rows.
    t = cut_lineage(tb.impute(cut_lineage(tab(spark, d)), ["price"], ["priority"]))
    t = cut_lineage(tb.label_encode(t, ["priority", "segment", "status"]))
    split = cut_lineage(tb.stratified_split(t, "o_orderkey", "status"))
    names = ["balance", "priority", "segment"]
    return cut_lineage(tb.standard_scale(split, names, fit_on=split.where("is_train"))), names


@query("wf21_generic_classifier")
def _classifier(spark, d):
    t, names = _prepared(spark, d)
    model = tb.fit_classifier(t.where("is_train"), [*names, "price"], "status", 3, ModelSettings(max_depth=4), rounds=10)
    return tb.macro_metrics(tb.score_classifier(model, t.where("NOT is_train"), [*names, "price"], "status"))


@query("wf21_generic_regressor")
def _regressor(spark, d):
    t, names = _prepared(spark, d)
    model = tb.fit_regressor(t.where("is_train"), names, "price", ModelSettings(max_depth=3), rounds=5)
    return me.regression_metrics(tb.score_regressor(model, t.where("NOT is_train"), names, "price"))


# walk-forward models --------------------------------------------------------------------------------------------
FOLDS = FoldSettings(initial_train_months=48, test_months=12, step_months=12)
NAMES = list(FAST_SQL)
_FITTED: dict[tuple[str, str], tuple] = {}


def _study(spark, d):
    """(rows of all folds, regime, fitted models) under the settings users get; fitted once for a session and folder, as many queries look at them."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _FITTED:
        # The features are written once; the tables below are read from these rows.
        m = stored_rounded(matrix(spark, d, "fast").select("date", "ticker", mo.LABEL, *NAMES), NAMES)
        regime = stored(regime_table(spark, d))
        rows = mo.fold_rows(mo.training_table(m, regime, NAMES), fo.data_folds(m, FOLDS), FOLDS)
        _FITTED[at] = rows, regime, mo.fit_folds(rows, regime, NAMES)
    return _FITTED[at]


MODEL_SQL = f"""{FAST_MATRIX_SQL},
m AS (SELECT date, ticker, label, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in NAMES)} FROM matrix),
{DEFAULT_FOLDS_SQL.replace("60 + 3 *", "48 + 12 *").replace("INTERVAL 6 MONTH", "INTERVAL 12 MONTH").replace("FROM bars", "FROM m")},
tr0 AS (SELECT fold, m.*, row_number() OVER (PARTITION BY fold ORDER BY date DESC, ticker DESC) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM m JOIN folds ON date BETWEEN train_start AND train_end),
tr AS (SELECT * EXCLUDE (rn, n), rn <= greatest(floor(n * 0.2), 50) AS is_valid FROM tr0),
te AS (SELECT fold, m.* FROM m JOIN folds ON date BETWEEN test_start AND test_end),
sz AS (SELECT fold, count(*) FILTER (NOT is_valid) AS n_train, count(*) FILTER (is_valid) AS n_valid, avg(label) FILTER (NOT is_valid) AS p FROM tr GROUP BY fold)"""


def first_tree_sql(s: bo.BoostSettings) -> str:
    """The first tree of every fold down to the root's children: bins, sums of gradients, gains and best splits."""
    used = [NAMES[i] for i in bo.sampled_columns(s.seed, 0, NAMES, s.column_share)]
    scale = f"{bo.SCALE}.0::DOUBLE"

    def part(g, h):
        return f"pow(sign({g}) * greatest(abs({g}) / {scale} - {s.l1}, 0), 2) / (({h}) / {scale} + {s.l2})"

    def level(k: int, rows: str) -> str:
        return f"""
hist{k} AS MATERIALIZED (SELECT fold, node, f, bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, count(*) AS n FROM {rows} GROUP BY ALL),
cum{k} AS (SELECT fold, node, f, bin, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl, sum(g) OVER t AS gt, sum(h) OVER t AS ht, sum(n) OVER t AS nt FROM hist{k}
           WINDOW t AS (PARTITION BY fold, node, f), u AS (PARTITION BY fold, node, f ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gain{k} AS (SELECT *, {part('gl', 'hl')} + {part('(gt - gl)', 'ht - hl')} - {part('gt', 'ht')} AS gain FROM cum{k}
            WHERE nl >= {s.min_rows} AND nt - nl >= {s.min_rows} AND hl >= {s.min_hessian} * {scale} AND ht - hl >= {s.min_hessian} * {scale}),
split{k} AS MATERIALIZED (SELECT b.*, e.v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold, node ORDER BY gain DESC, f, bin) AS rk FROM gain{k} WHERE gain > 0) b
           JOIN (SELECT fold, f, bin, v FROM cuts WHERE is_edge) e USING (fold, f, bin) WHERE rk = 1)"""

    def value(g, h):
        return f"-sign({g}) * greatest(abs({g}) / {scale} - {s.l1}, 0) / (({h}) / {scale} + {s.l2}) * {s.step}"

    return f"""{MODEL_SQL},
gr AS (SELECT tr.*, row_number() OVER () AS rid, round((p - label) * {scale}) AS g, round(p * (1 - p) * {scale}) AS h FROM tr JOIN sz USING (fold) WHERE NOT is_valid),
tall AS MATERIALIZED (SELECT fold, rid, g, h, list_position({NAMES}, feature) - 1 AS f, v FROM (UNPIVOT (SELECT fold, rid, g, h, {', '.join(used)} FROM gr) ON {', '.join(used)} INTO NAME feature VALUE v)),
cnt AS (SELECT fold, f, v, count(*) AS c FROM tall GROUP BY ALL),
run AS (SELECT *, sum(c) OVER (PARTITION BY fold, f ORDER BY v) AS upto, sum(c) OVER (PARTITION BY fold, f) AS whole FROM cnt),
edg AS (SELECT *, upto * {s.bins} // whole > (upto - c) * {s.bins} // whole AND upto < whole AS is_edge FROM run),
cuts AS MATERIALIZED (SELECT *, coalesce(sum(CAST(is_edge AS INT)) OVER (PARTITION BY fold, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bin FROM edg),
binned AS MATERIALIZED (SELECT tall.fold, rid, tall.f, bin, g, h, 0 AS node FROM tall JOIN cuts ON cuts.fold = tall.fold AND cuts.f = tall.f AND cuts.v = tall.v),{level(0, 'binned')},
side AS (SELECT b.fold, b.rid, CASE WHEN b.bin <= s.bin THEN 1 ELSE 2 END AS node FROM binned b JOIN split0 s ON s.fold = b.fold AND s.f = b.f),
below AS (SELECT b.* EXCLUDE (node), side.node FROM binned b JOIN side ON side.fold = b.fold AND side.rid = b.rid),{level(1, 'below')},
nodes AS (
  SELECT fold, 0 AS node, nt AS n_rows, 0.0::DOUBLE AS value FROM split0
  UNION ALL SELECT fold, 1, nl, {value('gl', 'hl')} FROM split0
  UNION ALL SELECT fold, 2, nt - nl, {value('(gt - gl)', 'ht - hl')} FROM split0)
SELECT nodes.fold, nodes.node, n_train, n_valid, {NAMES}[s.f + 1] AS feature, CAST(n_rows AS BIGINT) AS n_rows, {r('threshold', 'gain', 'value')}
FROM nodes JOIN sz ON sz.fold = nodes.fold LEFT JOIN (SELECT * FROM split0 UNION ALL SELECT * FROM split1) s ON s.fold = nodes.fold AND s.node = nodes.node"""


@query("wf06_fit_base", first_tree_sql(mo.base_settings(ModelSettings())))
def _base(spark, d):
    """Top of each fold's first tree and the sizes it was grown on; the fit itself runs to its end."""
    rows, _, fitted = _study(spark, d)
    sizes = rows.train.groupBy("fold").agg(F.count(F.when(~F.col("is_valid"), 1)).alias("n_train"), F.count(F.when(F.col("is_valid"), 1)).alias("n_valid"))
    top = fitted.base.table(spark).where("round = 0 AND node <= 2").withColumn("fold", F.col("fit").cast("int"))
    split = F.col("feature").isNotNull()
    return top.join(sizes, "fold").select("fold", "node", "n_train", "n_valid", "feature", "n_rows", F.when(split, F.col("threshold")).alias("threshold"), F.when(split, F.col("gain")).alias("gain"), "value")


def _scored_facts(scored, p="y_proba"):
    """What every scored row set must show, whatever the trees are."""
    inside = F.min(F.col(p).between(0.0, 1.0)).alias("in_range")
    return scored.groupBy("fold").agg(F.count(p).alias("n_scored"), F.sum(mo.LABEL).cast("bigint").alias("n_positive"), inside)


SCORED_SQL = f"{MODEL_SQL} SELECT fold, count(*) AS n_scored, CAST(sum(label) AS BIGINT) AS n_positive, true AS in_range"


@query("wf07_fit_second_booster", f"{SCORED_SQL} FROM te GROUP BY fold")
def _second(spark, d):
    rows, _, fitted = _study(spark, d)
    return _scored_facts(bo.score(fitted.second, rows.test))


REGIME_SQL = "reg AS (SELECT DISTINCT date, CAST(day(date) % 3 AS INTEGER) AS regime FROM bars WHERE dayofyear(date) % 5 <> 0)"


@query("wf08_fit_transfer", f"""{MODEL_SQL}, {REGIME_SQL},
cur AS (SELECT fold, arg_max(regime, reg.date) AS cur FROM folds JOIN reg ON reg.date <= train_end GROUP BY fold),
car AS (SELECT date, coalesce(last_value(regime IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS regime FROM (SELECT DISTINCT date FROM m) LEFT JOIN reg USING (date)),
hit AS (SELECT tr.fold, tr.date, tr.label, car.regime, cur, count(*) FILTER (car.regime = cur) OVER (PARTITION BY tr.fold) AS hits FROM tr JOIN car USING (date) JOIN cur USING (fold)),
few AS (SELECT * FROM hit WHERE hits < 50 OR regime = cur),
rk AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY date) AS dr FROM few),
wt AS (SELECT *, pow(0.997, max(dr) OVER (PARTITION BY fold) - dr) AS raw FROM rk),
nw AS (SELECT *, raw / avg(raw) OVER (PARTITION BY fold) AS weight FROM wt),
tf AS (SELECT fold, any_value(cur) AS current_regime, count(*) AS n_tuned, {r('sum(weight) AS weights', 'sum(weight * label) AS weighted_positive')} FROM nw GROUP BY fold),
tt AS (SELECT fold, count(*) AS n_scored, CAST(sum(label) AS BIGINT) AS n_positive, true AS in_range, true AS base_kept FROM te GROUP BY fold)
SELECT * FROM tf JOIN tt USING (fold)""")
def _transfer(spark, d):
    """Which rows each fold is tuned on, with their weights; that the base trees stay; its scores."""
    rows, regime, fitted = _study(spark, d)
    current = mo.current_regimes(rows, regime)
    tuned = mo.transfer_rows(rows.train, current, ModelSettings().decay_alpha).join(current, "fold").groupBy("fold").agg(
        F.max("current_regime").alias("current_regime"), F.count(F.lit(1)).alias("n_tuned"), F.sum("weight").alias("weights"), F.sum(F.col("weight") * F.col(mo.LABEL)).alias("weighted_positive"))
    kept = [(int(k), fitted.transfer.trees[k][:len(t)] == t and len(fitted.transfer.trees[k]) <= len(t) + ModelSettings().fine_tune_rounds) for k, t in fitted.base.trees.items()]
    return tuned.join(_scored_facts(bo.score(fitted.transfer, rows.test)), "fold").join(spark.createDataFrame(kept, "fold int, base_kept boolean"), "fold")


MODELS_SQL = "(SELECT unnest(['base', 'transfer', 'ensemble', 'static', 'second', 'random', 'hold']) AS model)"


@query("wf12_run_walk_forward", f"{MODEL_SQL} SELECT fold, model, count(*) AS n_scored, CAST(sum(label) AS BIGINT) AS n_positive, true AS in_range, true AS thresholded, "
       f"count(DISTINCT date) AS n_days FROM te, {MODELS_SQL} GROUP BY fold, model")
def _walk(spark, d):
    rows, regime, fitted = _study(spark, d)
    out = mo.fold_predictions(rows, fitted, regime).withColumnRenamed("y_true", mo.LABEL)
    right = F.min((F.col("y_proba") >= 0.5).cast("int") == F.col("y_pred")).alias("thresholded")
    return out.groupBy("fold", "model").agg(F.count("y_proba").alias("n_scored"), F.sum(mo.LABEL).cast("bigint").alias("n_positive"),
                                            F.min(F.col("y_proba").between(0.0, 1.0)).alias("in_range"), right, F.countDistinct("date").alias("n_days"))


VARIANTS_SQL = "(SELECT unnest(['base', 'transfer', 'transfer_regime', 'transfer_decay', 'full']) AS model)"


@query("wf13_ablation", f"{SCORED_SQL}, model, count(DISTINCT date) AS n_days FROM te, {VARIANTS_SQL} GROUP BY fold, model")
def _ablation(spark, d):
    rows, regime, fitted = _study(spark, d)
    out = mo.ablation_predictions(rows, fitted.base, regime)
    return out.groupBy("fold", "model").agg(F.count("y_proba").alias("n_scored"), F.sum("y_true").cast("bigint").alias("n_positive"), F.min(F.col("y_proba").between(0.0, 1.0)).alias("in_range"),
                                            F.countDistinct("date").alias("n_days"))


@query("wf14_feature_importance")
def _importance(spark, d):
    return mo.feature_importance(_study(spark, d)[2].base, spark)


@query("tk04_top_importance")
def _top(spark, d):
    return mo.top_importance(mo.feature_importance(_study(spark, d)[2].base, spark), 20)


@query("wf15_permutation_importance")
def _permutation(spark, d):
    rows, _, fitted = _study(spark, d)
    return mo.permutation_importance(fitted.base, rows.test)


@query("wf22_score_rows", f"{SCORED_SQL} FROM te GROUP BY fold")
def _score(spark, d):
    rows, _, fitted = _study(spark, d)
    return _scored_facts(bo.score(fitted.base, rows.test))


def _explained(spark, d):
    rows, _, fitted = _study(spark, d)
    return fitted.base, at.contributions(fitted.base, bo.margins(fitted.base, rows.test, "fold", "_margin"))


@query("wf15_exact_attributions", f"{MODEL_SQL} SELECT fold, count(*) AS n_scored, {len(NAMES)} AS n_features, true AS adds_up FROM te GROUP BY fold")
def _adds_up(spark, d):
    """Contributions of every test row, summed: with the base value they are the row's margin."""
    _, rows = _explained(spark, d)
    whole = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c)
    return rows.groupBy("fold").agg(F.count("base_value").alias("n_scored"), F.max(F.size("contributions")).alias("n_features"), (F.max(F.abs(whole - F.col("_margin"))) < 1e-9).alias("adds_up"))


@query("wf15_attribution_summary")
def _attributions(spark, d):
    model, rows = _explained(spark, d)
    return at.contribution_summary(rows, model, ["fold", "regime"])
