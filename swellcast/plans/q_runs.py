"""Registered queries: run and metric tables built from real benchmark runs
(each series is an experiment; a parent 'sweep' run and one child run per
naive model), and the tracking queries on them (E1-E12, T4, T5, T7, F11-F14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HORIZON
from ..operators import runs as R
from ..session import saved
from . import benchmark
from . import oracles as O
from .oracles import rnd
from .queries import register

MODELS = [("Naive", {"WVHT": "last", "APD": "mean"}),
          ("NaiveLast", {"WVHT": "last", "APD": "last"}),
          ("NaiveMean", {"WVHT": "mean", "APD": "mean"})]
TAGS = {"project": "Hourly Forecasting", "type": "Backtesting", "framework": "spark"}
N_BLOCKS = 3


def _starts(spark, sf):
    """First hour of every series."""
    return benchmark.prepared(spark, sf).groupBy("series_id").agg(F.min("ts").alias("t0"))


def experiments(spark, sf):
    """One experiment per series."""
    tag_map = F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k), F.lit(v))])
    return _starts(spark, sf).select(F.concat(F.lit("Backtesting_"), "series_id").alias("name"), tag_map.alias("tags"))


def run_table(spark, sf):
    """A parent run per series and a child run per model."""
    series = saved(_starts(spark, sf), "series")  # read once per kind of run
    parent = series.select(
        F.concat(F.lit("Backtesting_"), "series_id").alias("experiment"),
        F.concat(F.col("series_id"), F.lit("/sweep")).alias("run_id"), F.lit(0).cast("long").alias("run_number"),
        F.lit("sweep_000").alias("run_name"), F.lit("RUNNING").alias("status"), F.col("t0").alias("start_ts"),
        F.lit(None).cast("string").alias("parent_run_id"),
        F.create_map(F.lit("run_number"), F.lit("0"), F.lit("model_name"), F.lit("sweep")).alias("params"))
    runs = parent
    for num, (model, _) in enumerate(MODELS, start=1):
        rid = F.concat(F.col("series_id"), F.lit("/" + model))
        runs = runs.unionByName(series.select(
            F.concat(F.lit("Backtesting_"), "series_id").alias("experiment"), rid.alias("run_id"),
            F.lit(num).cast("long").alias("run_number"),
            F.format_string("%s_%03d", F.lit(model), F.lit(num)).alias("run_name"),
            F.lit("FINISHED").alias("status"),
            F.timestamp_add("HOUR", F.lit(num), F.col("t0")).alias("start_ts"),
            F.concat(F.col("series_id"), F.lit("/sweep")).alias("parent_run_id"),
            F.create_map(F.lit("run_number"), F.lit(str(num)), F.lit("model_type"), F.lit(model),
                         F.lit("targets"), F.lit("WVHT,APD"), F.lit("n_blocks"), F.lit(str(N_BLOCKS)),
                         F.lit("block_size"), F.lit(str(HORIZON))).alias("params")))
    return runs


def metric_table(spark, sf):
    """Block scores of every child run. The hourly targets are written once for the
    fits and truths of all models, the scores once for both kinds of metric rows."""
    from ..config import TARGETS
    from ..operators.forecast import ensemble_fit
    hourly = saved(benchmark.prepared(spark, sf).select("series_id", "idx", *TARGETS), "hourly")
    split, state, scaled_long = benchmark.fit_base(hourly, TARGETS, HORIZON * N_BLOCKS, HORIZON)
    split, state, scaled_long = saved(split, "split"), saved(state, "state"), saved(scaled_long, "scaled")
    out = saved(reduce(DataFrame.unionByName, [
        benchmark.score_blocks(split, state, ensemble_fit(scaled_long, strat), TARGETS)
        .withColumn("run_id", F.concat(F.col("series_id"), F.lit("/" + model))) for model, strat in MODELS]), "scores")
    last = out.select("run_id", F.col("metric").alias("key"), "value", F.lit(0).cast("long").alias("step"))
    hist = out.where(F.col("metric").startswith("block_")).select(
        "run_id", F.regexp_extract("metric", r"^block_\d+_(.*)$", 1).alias("key"), "value",
        F.regexp_extract("metric", r"^block_(\d+)_", 1).cast("long").alias("step"))
    return last.unionByName(hist)


def _runs_sql() -> str:
    """Same tables in DuckDB: ``exps``, ``runs``, ``mets``."""
    base = O.block_benchmark_sql(final=False)
    base = base.replace("model AS (SELECT series_id, arg_max(WVHT, idx) AS lw, avg(APD) AS la FROM sc GROUP BY 1),",
                        """model0 AS (SELECT series_id, arg_max(WVHT, idx) AS w_last, avg(WVHT) AS w_mean,
                          arg_max(APD, idx) AS a_last, avg(APD) AS a_mean FROM sc GROUP BY 1),
model AS (SELECT series_id, 'Naive' AS mname, 1 AS num, w_last AS lw, a_mean AS la FROM model0 UNION ALL
          SELECT series_id, 'NaiveLast', 2, w_last, a_last FROM model0 UNION ALL
          SELECT series_id, 'NaiveMean', 3, w_mean, a_mean FROM model0),""")
    base = base.replace("SELECT t.series_id, t.block_id, 'WVHT' AS col", "SELECT t.series_id, m.mname, t.block_id, 'WVHT' AS col")
    base = base.replace("SELECT t.series_id, t.block_id, 'APD' AS col", "SELECT t.series_id, m.mname, t.block_id, 'APD' AS col")
    base = base.replace("percol AS (SELECT series_id, block_id, col,", "percol AS (SELECT series_id, mname, block_id, col,")
    base = base.replace("FROM pe GROUP BY 1, 2, 3)", "FROM pe GROUP BY 1, 2, 3, 4)")
    base = base.replace("blk AS (SELECT series_id, block_id, avg(rmspe) AS rmspe, avg(mape) AS mape FROM percol GROUP BY 1, 2)",
                        "blk AS (SELECT series_id, mname, block_id, avg(rmspe) AS rmspe, avg(mape) AS mape FROM percol GROUP BY 1, 2, 3)")
    base = base.replace("SELECT series_id, block_id, 'MeanSquaredPercentageError' AS scorer",
                        "SELECT series_id, mname, block_id, 'MeanSquaredPercentageError' AS scorer")
    base = base.replace("UNION ALL SELECT series_id, block_id, 'MeanAbsolutePercentageError', mape FROM blk",
                        "UNION ALL SELECT series_id, mname, block_id, 'MeanAbsolutePercentageError', mape FROM blk")
    base = base.replace("""  SELECT series_id, 'block_' || block_id || '_' || scorer AS metric, value FROM blong
  UNION ALL SELECT series_id, 'avg_' || scorer, avg(value) FROM blong GROUP BY series_id, scorer
  UNION ALL SELECT series_id, 'std_' || scorer, stddev_pop(value) FROM blong GROUP BY series_id, scorer)""",
                        """  SELECT series_id, mname, 'block_' || block_id || '_' || scorer AS metric, value FROM blong
  UNION ALL SELECT series_id, mname, 'avg_' || scorer, avg(value) FROM blong GROUP BY series_id, mname, scorer
  UNION ALL SELECT series_id, mname, 'std_' || scorer, stddev_pop(value) FROM blong GROUP BY series_id, mname, scorer)""")
    tags = ", ".join(f"'{k}': '{v}'" for k, v in TAGS.items())
    return base + f""",
ser AS (SELECT series_id, min(ts) AS t0 FROM hourly GROUP BY 1),
mets AS (SELECT series_id || '/' || mname AS run_id, metric AS key, value, CAST(0 AS BIGINT) AS step FROM outp
         UNION ALL SELECT series_id || '/' || mname, scorer, value, CAST(block_id AS BIGINT) FROM blong),
runs AS (
  SELECT 'Backtesting_' || series_id AS experiment, series_id || '/sweep' AS run_id, CAST(0 AS BIGINT) AS run_number,
         'sweep_000' AS run_name, 'RUNNING' AS status, t0 AS start_ts, CAST(NULL AS VARCHAR) AS parent_run_id,
         MAP {{'run_number': '0', 'model_name': 'sweep'}} AS params FROM ser
  UNION ALL
  SELECT 'Backtesting_' || s.series_id, s.series_id || '/' || m.mname, CAST(m.num AS BIGINT),
         m.mname || '_' || lpad(CAST(m.num AS VARCHAR), 3, '0'), 'FINISHED', s.t0 + INTERVAL 1 HOUR * m.num,
         s.series_id || '/sweep',
         MAP {{'run_number': CAST(m.num AS VARCHAR), 'model_type': m.mname, 'targets': 'WVHT,APD', 'n_blocks': '3', 'block_size': '72'}}
  FROM ser s JOIN (SELECT DISTINCT mname, num FROM model) m ON true),
exps AS (SELECT 'Backtesting_' || series_id AS name, MAP {{{tags}}} AS tags FROM ser)"""


RUNS_SQL = _runs_sql()
EXP1 = "Backtesting_click"


@register("e1_metric_log", RUNS_SQL + f"\nSELECT run_id, key, {rnd('value', 'value')}, step FROM mets")
def e1_metric_log(spark, sf):
    """The metric table: every logged value (step 0) and per-block history,
    appended in two batches (parent and child runs) and read back."""
    from ..operators.runs import log_runs, logged
    from .q_misc import scratch
    runs, metrics = run_table(spark, sf), metric_table(spark, sf)
    path = scratch(spark, "runs")
    for batch in (runs.where("parent_run_id IS NULL"), runs.where("parent_run_id IS NOT NULL")):
        log_runs(batch, metrics, path)
    return logged(spark, path, "metric").select(*metrics.columns)


@register("e2_run_action", RUNS_SQL + """,
planned AS (SELECT name AS experiment, CAST(k.range AS BIGINT) AS run_number FROM exps, range(0, 5) k),
newest AS (SELECT experiment, run_number, arg_max(run_id, start_ts) AS run_id, arg_max(status, start_ts) AS status
           FROM runs GROUP BY 1, 2)
SELECT p.experiment, p.run_number, n.run_id,
  CASE WHEN p.run_number < 0 THEN 'invalid' WHEN n.run_id IS NULL THEN 'new'
       WHEN n.status = 'FINISHED' THEN 'skip' ELSE 'resume' END AS action
FROM planned p LEFT JOIN newest n USING (experiment, run_number)""")
def e2_run_action(spark, sf):
    """Start / resume / skip for planned run numbers 0..4 of every experiment."""
    exps, runs = experiments(spark, sf), run_table(spark, sf)
    planned = exps.select(F.col("name").alias("experiment"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("run_number"))
    return R.run_actions(planned, runs)


_E3_NAMES = [EXP1, "Backtesting"]


@register("e3_experiment_name", RUNS_SQL + f""",
req AS (SELECT unnest({_E3_NAMES!r}) AS name)
SELECT r.name, r.name AS experiment, NOT EXISTS (SELECT 1 FROM exps e WHERE e.name = r.name) AS created,
  CASE WHEN NOT EXISTS (SELECT 1 FROM exps e WHERE e.name = r.name) THEN r.name
       ELSE r.name || '_' || CAST((SELECT min(k.range) FROM range(2, 1000) k WHERE NOT EXISTS (
            SELECT 1 FROM exps e WHERE e.name = r.name || '_' || CAST(k.range AS VARCHAR))) AS VARCHAR) END AS free_name
FROM req r""")
def e3_experiment_name(spark, sf):
    """Get-or-create experiment names (exact match wins) and the first free suffixed name."""
    return R.experiment_name(_E3_NAMES, experiments(spark, sf))


@register("e4_run_lookup", RUNS_SQL + f"""
SELECT run_id, run_name, status FROM runs WHERE experiment = '{EXP1}' AND run_number = 2
ORDER BY start_ts DESC, run_id LIMIT 1""")
def e4_run_lookup(spark, sf):
    """Newest run with run number 2 in one experiment (top-1 by start time)."""
    return R.latest_run(run_table(spark, sf), EXP1, 2).select("run_id", "run_name", "status")


@register("e5_metric_history", RUNS_SQL + f"""
SELECT step, {rnd('value', 'value')} FROM mets WHERE run_id = 'click/Naive' AND key = 'MeanAbsolutePercentageError'""")
def e5_metric_history(spark, sf):
    """Block-by-block history of one metric of one run, by step."""
    return R.metric_history(metric_table(spark, sf), "click/Naive", "MeanAbsolutePercentageError").select("step", "value")


@register("e6_experiments_by_tag", RUNS_SQL + "\nSELECT name FROM exps WHERE tags['type'] = 'Backtesting'")
def e6_experiments_by_tag(spark, sf):
    return R.experiments_by_tag(experiments(spark, sf), "type", "Backtesting").select("name")


@register("e7_runs_of_experiment", RUNS_SQL + f"""
SELECT run_id, run_name, run_number, status, start_ts FROM runs WHERE experiment = '{EXP1}'""")
def e7_runs_of_experiment(spark, sf):
    r = run_table(spark, sf)
    return r.where(F.col("experiment") == EXP1).select("run_id", "run_name", "run_number", "status", "start_ts")


@register("e8_run_tree", RUNS_SQL + """,
tree AS (SELECT * FROM (WITH RECURSIVE t(experiment, run_id, run_name, status, depth, path, orphan) AS (
  SELECT r.experiment, r.run_id, r.run_name, r.status, 0, r.run_name, r.parent_run_id IS NOT NULL
  FROM runs r LEFT JOIN runs p ON p.run_id = r.parent_run_id WHERE r.parent_run_id IS NULL OR p.run_id IS NULL
  UNION ALL
  SELECT c.experiment, c.run_id, c.run_name, c.status, t.depth + 1, t.path || '/' || c.run_name, false
  FROM runs c JOIN t ON c.parent_run_id = t.run_id) SELECT * FROM t))
SELECT experiment, run_id, run_name, status, CAST(depth AS BIGINT) AS depth, path, orphan FROM tree""")
def e8_run_tree(spark, sf):
    """Parent/child run tree with depth and path (recursive CTE)."""
    return R.run_tree(spark, run_table(spark, sf))


@register("e9_run_report", RUNS_SQL + """,
nm AS (SELECT run_id, count(*) AS n_metrics FROM mets WHERE step = 0 GROUP BY 1)
SELECT r.experiment, r.run_id, CAST(r.params['run_number'] AS BIGINT) AS run_number,
  coalesce(r.params['model_type'], r.params['model_name'], 'Unknown') AS model,
  CAST(cardinality(map_from_entries(list_filter(map_entries(r.params),
       lambda e: e.key NOT IN ('run_number', 'model_type', 'model_name')))) AS BIGINT) AS n_params,
  coalesce(nm.n_metrics, 0) AS n_metrics
FROM runs r LEFT JOIN nm USING (run_id)""")
def e9_run_report(spark, sf):
    """Runs by integer run number with model name, other params, metric count."""
    runs, mets = run_table(spark, sf), metric_table(spark, sf)
    return R.run_report(runs, mets)


_E10_KEYS = ["avg_MeanAbsolutePercentageError", "avg_MeanSquaredPercentageError",
             "std_MeanAbsolutePercentageError", "std_MeanSquaredPercentageError"]


@register("e10_model_comparison", RUNS_SQL + f""",
pm AS (SELECT run_id, {', '.join(f"max(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in _E10_KEYS)}
       FROM mets WHERE step = 0 GROUP BY 1)
SELECT r.experiment, r.run_id, coalesce(r.params['model_type'], r.params['model_name'], 'Unknown') AS model,
  CAST(r.params['n_blocks'] AS BIGINT) AS n_blocks, CAST(r.params['block_size'] AS BIGINT) AS block_size,
  {', '.join(rnd(f'pm.{k}', k) for k in _E10_KEYS)}
FROM runs r LEFT JOIN pm USING (run_id) WHERE r.run_number IN (1, 2, 3)""")
def e10_model_comparison(spark, sf):
    """Aggregated scores of runs 1-3 side by side (pivot by metric)."""
    runs, mets = run_table(spark, sf), metric_table(spark, sf)
    return R.model_comparison(runs, mets, [1, 2, 3])


@register("e11_run_analysis", RUNS_SQL + """,
m AS (SELECT * FROM mets WHERE step = 0)
SELECT run_id, count_if(starts_with(key, 'avg_') OR starts_with(key, 'std_')) AS n_aggregated,
  count_if(starts_with(key, 'block_')) AS n_block_metrics,
  count_if(NOT (starts_with(key, 'avg_') OR starts_with(key, 'std_') OR starts_with(key, 'block_'))) AS n_other,
  count_if(contains(key, 'block_1_')) AS n_block1_metrics,
  count(DISTINCT CASE WHEN regexp_extract(key, '^block_(\\d+)_', 1) <> '' THEN regexp_extract(key, '^block_(\\d+)_', 1) END) AS n_blocks
FROM m GROUP BY 1""")
def e11_run_analysis(spark, sf):
    return R.run_analysis(metric_table(spark, sf))


@register("e12_overview", RUNS_SQL + """,
cnt AS (SELECT experiment, count(*) AS n_runs, count_if(parent_run_id IS NULL) AS n_roots,
        count_if(status = 'FINISHED') AS n_finished FROM runs GROUP BY 1)
SELECT e.name AS experiment, c.n_runs, c.n_roots, c.n_finished FROM exps e JOIN cnt c ON c.experiment = e.name
WHERE e.tags['project'] = 'Hourly Forecasting'""")
def e12_overview(spark, sf):
    """Experiments selected by tag with their run counts."""
    exps, runs = experiments(spark, sf), run_table(spark, sf)
    sel = R.experiments_by_tag(exps, "project", TAGS["project"]).select(F.col("name").alias("experiment"))
    cnt = runs.groupBy("experiment").agg(F.count("*").alias("n_runs"),
                                         F.count_if(F.col("parent_run_id").isNull()).alias("n_roots"),
                                         F.count_if(F.col("status") == "FINISHED").alias("n_finished"))
    return sel.join(cnt, "experiment", "inner")
