"""Experiments from configuration files: defaults overlaid by entries, and where their results are looked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "struct<project_root:string,input:string,output:string,defaults:map<string,string>,experiments:array<map<string,string>>>"
# What holds where neither an entry nor the defaults say anything.
SETTINGS = {
    "prompt_profile": ("string", "baseline-v1"), "temperature": ("double", "0.0"), "max_tokens": ("int", "4096"), "source_chunk_chars": ("int", "12000"), "context_paragraphs": ("int", "0"),
    "max_context_chars": ("int", "12000"), "max_retries": ("int", "5"), "timeout_seconds": ("double", "300.0"), "workers": ("int", "1"),
}
METHODS = ("glossary", "placeholder")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """file and value (the JSON text) of configuration files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def overlaid(low: Column, high: Column) -> Column:
    """Entries of both maps; where both have a key, that of high."""
    low, high = (F.coalesce(m, F.expr("cast(map() as map<string,string>)")) for m in (low, high))
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def experiment_matrix(configs: DataFrame, *keys: str) -> DataFrame:
    """keys, position, name, model, the settings and further ones (map other) of each enabled experiment, in the order of the file.

    configs: keys, value (JSON). A file without experiments and an enabled one without a name fail the query. Only the
    value false turns an experiment off. Nested values stay JSON text.
    """
    parsed = configs.select(*keys, F.from_json("value", CONFIG).alias("c"))
    none = F.coalesce(F.size("c.experiments"), F.lit(0)) <= 0
    listed = F.when(none, F.raise_error(F.lit("a configuration needs a list of experiments")).cast("array<map<string,string>>")).otherwise(F.col("c.experiments"))
    rows = parsed.select(*keys, F.col("c.defaults").alias("_d"), F.posexplode(listed).alias("position", "_e"))
    rows = rows.filter(F.coalesce(F.lower(F.try_element_at("_e", F.lit("enabled"))), F.lit("true")) != "false").withColumn("_m", overlaid(F.col("_d"), F.col("_e")))
    name = F.btrim(F.coalesce(F.try_element_at("_m", F.lit("name")), F.lit("")))
    rows = rows.withColumn("name", F.when(name == "", F.raise_error(F.lit("an enabled experiment needs a name")).cast("string")).otherwise(name))
    of = lambda k, kind, default: F.coalesce(F.try_element_at("_m", F.lit(k)), F.lit(default)).cast(kind).alias(k)
    other = F.map_filter("_m", lambda k, _: ~k.isin("name", "enabled", "model", *SETTINGS))
    return rows.select(*keys, "position", "name", F.try_element_at("_m", F.lit("model")).alias("model"), *[of(k, kind, d) for k, (kind, d) in SETTINGS.items()], other.alias("other"))


def baseline_of(models: DataFrame, existing: DataFrame) -> DataFrame:
    """model_key with its baseline experiment and whether it is there: the named one if it exists, else the first candidate that does, else the named one.

    models: model_key, baseline_experiment, baseline_candidates (array). existing: name of each experiment that is there.
    """
    named = F.array_compact(F.array(F.nullif(F.col("baseline_experiment"), F.lit(""))))
    tried = models.select("model_key", F.posexplode_outer(F.concat(named, F.coalesce("baseline_candidates", F.expr("cast(array() as array<string>)")))).alias("_i", "name"))
    there = tried.join(existing.select("name").distinct(), "name").groupBy("model_key").agg(F.min_by("name", "_i").alias("_found"))
    rows = models.join(there, "model_key", "left")
    return rows.select("model_key", F.coalesce("_found", F.nullif(F.col("baseline_experiment"), F.lit(""))).alias("source_experiment"), F.col("_found").isNotNull().alias("present"))


def registry(models: DataFrame, existing: DataFrame, include_missing: bool = True) -> DataFrame:
    """experiment_id, model_key, model, method, source_experiment, present: the baseline and two controlled runs of each model.

    existing: kind (baseline or controlled) and name. Controlled runs are looked for under model-method-final.
    """
    base = baseline_of(models, existing.filter("kind = 'baseline'")).join(models.select("model_key", "model"), "model_key").withColumn("method", F.lit("baseline"))
    runs = models.select("model_key", "model", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method")).withColumn("source_experiment", F.concat_ws("-", "model_key", "method", F.lit("final")))
    there = existing.filter("kind = 'controlled'").select(F.col("name").alias("source_experiment"), F.lit(True).alias("present")).distinct()
    runs = runs.join(there, "source_experiment", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    out = base.unionByName(runs).select(F.concat_ws("__", "model_key", "method").alias("experiment_id"), "model_key", "model", "method", "source_experiment", "present")
    return out if include_missing else out.filter("present")
