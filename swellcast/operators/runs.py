"""Run and metric tables (experiment tracking re-aimed as append-only tables)
and the queries on them (E1-E12).

``run(experiment, run_id, run_number, run_name, status, start_ts,
parent_run_id, params MAP<STRING,STRING>)``, ``metric(run_id, key, value,
step)``, ``experiment(name, tags MAP<STRING,STRING>)``. They are small
relative to the data, but every query below is a plain filter / join /
aggregate, so they stay correct at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_runs(runs: DataFrame, metrics: DataFrame, path: str) -> None:
    """Append a batch of runs and their metrics (one write per batch,
    partitioned by experiment), never one write per value."""
    runs.write.mode("append").partitionBy("experiment").parquet(f"{path}/run")
    exp = runs.select("run_id", "experiment")
    metrics.join(exp, "run_id", "inner").write.mode("append").partitionBy("experiment").parquet(f"{path}/metric")


def logged(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The ``run`` or ``metric`` table of all batches appended at ``path``; the
    experiment is a string even where every folder name looks like a number."""
    fields = spark.read.parquet(f"{path}/{table}").schema.fields
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "experiment" else f.dataType) for f in fields])
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def run_actions(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """Start / resume / skip. ``planned(experiment, run_number)`` left
    joined to the newest existing run with that number: FINISHED -> skip,
    any other status -> resume, none -> new. A negative run number is an
    error in the reference; such rows get action 'invalid'."""
    newest = runs.groupBy("experiment", "run_number").agg(
        F.max_by(F.struct("run_id", "status"), "start_ts").alias("_r"))
    x = planned.join(newest, ["experiment", "run_number"], "left")
    action = F.when(F.col("run_number") < 0, "invalid") \
        .when(F.col("_r").isNull(), "new") \
        .when(F.col("_r.status") == "FINISHED", "skip").otherwise("resume")
    return x.select("experiment", "run_number", F.col("_r.run_id").alias("run_id"), action.alias("action"))


def experiment_name(names: list[str], experiments: DataFrame) -> DataFrame:
    """E3 / F14 for requested names (parameters): an exact name is reused,
    otherwise ``name`` is created (the reference's suffix loop can only run
    when the exact name exists, which returns first). ``free_name`` is F14:
    the first of ``name``, ``name_2``, ``name_3`` ... not taken.
    One filtered aggregate over the experiment table, no join."""
    import re
    nm = F.col("name")
    aggs = []
    for i, n in enumerate(names):
        suf = F.when(nm == n, F.lit(1)).when(
            nm.rlike("^" + re.escape(n) + r"_\d+$"),
            F.regexp_extract(nm, r"_(\d+)$", 1).cast("int"))
        aggs += [F.max(nm == n).alias(f"_e{i}"), F.collect_set(suf).alias(f"_t{i}")]
    one = experiments.agg(*aggs)
    rows = []
    for i, n in enumerate(names):
        taken = F.col(f"_t{i}")
        first_free = F.array_min(F.filter(F.sequence(F.lit(1), F.size(taken) + 1),
                                          lambda k: ~F.array_contains(taken, k)))
        free = F.when(first_free == 1, F.lit(n)).otherwise(F.concat(F.lit(n + "_"), first_free.cast("string")))
        rows.append(one.select(F.lit(n).alias("name"), F.lit(n).alias("experiment"),
                               (~F.coalesce(F.col(f"_e{i}"), F.lit(False))).alias("created"),
                               free.alias("free_name")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def latest_run(runs: DataFrame, experiment: str, run_number: int) -> DataFrame:
    """Newest run with that number in the experiment."""
    r = runs.where((F.col("experiment") == experiment) & (F.col("run_number") == run_number))
    return r.orderBy(F.col("start_ts").desc(), F.col("run_id")).limit(1)


def metric_history(metrics: DataFrame, run_id: str, key: str) -> DataFrame:
    """E5 / T5: values of one metric of one run, by step."""
    return metrics.where((F.col("run_id") == run_id) & (F.col("key") == key)).orderBy("step")


def experiments_by_tag(experiments: DataFrame, key: str, value: str) -> DataFrame:
    """Experiments whose tag ``key`` equals ``value``."""
    return experiments.where(F.try_element_at(F.col("tags"), F.lit(key)) == value)


def run_tree(spark, runs: DataFrame) -> DataFrame:
    """Parent -> children with depth and path (recursive CTE); roots have
    no parent; a child whose parent is absent is reported as an orphan root."""
    runs.createOrReplaceTempView("_runs_tree_src")
    return spark.sql("""
    WITH RECURSIVE tree(experiment, run_id, run_name, status, depth, path, orphan) AS (
      SELECT r.experiment, r.run_id, r.run_name, r.status, 0, r.run_name,
             r.parent_run_id IS NOT NULL
      FROM _runs_tree_src r LEFT JOIN _runs_tree_src p ON p.run_id = r.parent_run_id
      WHERE r.parent_run_id IS NULL OR p.run_id IS NULL
      UNION ALL
      SELECT c.experiment, c.run_id, c.run_name, c.status, t.depth + 1, t.path || '/' || c.run_name, false
      FROM _runs_tree_src c JOIN tree t ON c.parent_run_id = t.run_id)
    SELECT experiment, run_id, run_name, status, CAST(depth AS BIGINT) AS depth, path, orphan FROM tree""")


def model_name(params) -> F.Column:
    """Model name by fallback keys: model_type, model_name, else 'Unknown'."""
    return F.coalesce(F.try_element_at(params, F.lit("model_type")),
                      F.try_element_at(params, F.lit("model_name")), F.lit("Unknown"))


def run_report(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per run, ordered by integer run number: model name,
    parameters other than the name keys, number of metrics."""
    other = F.map_filter("params", lambda k, v: ~k.isin("run_number", "model_type", "model_name"))
    m = metrics.where(F.col("step") == 0).groupBy("run_id").agg(F.count("*").alias("n_metrics"))
    return runs.join(m, "run_id", "left").select(
        "experiment", "run_id", F.col("params")["run_number"].cast("long").alias("run_number"),
        model_name(F.col("params")).alias("model"), F.size(other).cast("long").alias("n_params"),
        F.coalesce("n_metrics", F.lit(0).cast("long")).alias("n_metrics")).orderBy("experiment", "run_number")


def run_analysis(metrics: DataFrame) -> DataFrame:
    """Metrics split into aggregated (avg_/std_), block and other;
    the reference's 'number of blocks' counts keys containing 'block_1_';
    the real block count is returned too."""
    m = metrics.where(F.col("step") == 0)
    blk = F.regexp_extract("key", r"^block_(\d+)_", 1)
    return m.groupBy("run_id").agg(
        F.count_if(F.col("key").startswith("avg_") | F.col("key").startswith("std_")).alias("n_aggregated"),
        F.count_if(F.col("key").startswith("block_")).alias("n_block_metrics"),
        F.count_if(~(F.col("key").startswith("avg_") | F.col("key").startswith("std_") |
                     F.col("key").startswith("block_"))).alias("n_other"),
        F.count_if(F.col("key").contains("block_1_")).alias("n_block1_metrics"),
        F.count_distinct(F.when(blk != "", blk)).alias("n_blocks"))


def model_comparison(runs: DataFrame, metrics: DataFrame, run_numbers: list[int]) -> DataFrame:
    """Aggregated metrics of the chosen runs, one column per metric."""
    r = runs.where(F.col("run_number").isin(*run_numbers)).select(
        "experiment", "run_id", model_name(F.col("params")).alias("model"),
        F.col("params")["n_blocks"].cast("long").alias("n_blocks"),
        F.col("params")["block_size"].cast("long").alias("block_size"))
    keys = ["avg_MeanAbsolutePercentageError", "avg_MeanSquaredPercentageError",
            "std_MeanAbsolutePercentageError", "std_MeanSquaredPercentageError"]
    m = metrics.where((F.col("step") == 0) & F.col("key").isin(*keys)) \
        .groupBy("run_id").pivot("key", keys).agg(F.first("value"))
    return r.join(m, "run_id", "left")
