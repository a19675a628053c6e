"""Generation runs: eligibility, classification, summary, status changes, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relish.functions.text import end_index
from relish.operators import store as store_ops
from relish.operators.filters import runs_with_status
from relish.operators.store import Store

# Run columns, statuses and the transitions between them.
RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("experiment_name", T.StringType()),
    T.StructField("run_name", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("start_time", T.TimestampType()), T.StructField("end_time", T.TimestampType())])
STATUSES = ["pending_review", "approved", "migrated", "migrated_partial", "pending_approval"]
TRANSITIONS = [
    ("pending_review", "approved"), ("pending_approval", "approved"), ("approved", "migrated"),
    ("approved", "migrated_partial"), ("migrated_partial", "approved"), ("migrated_partial", "migrated"),
    ("migrated", "pending_approval"),
]
OUTPUT_TYPES = ["enhanced_json", "intent_matches"]


def param(name: str) -> Column:
    return F.try_element_at("params", F.lit(name))


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def generation_hash() -> Column:
    """The hash parameter, else the source commit tag; empty texts count as absent."""
    return F.coalesce(_present(param("data_gen_hash")), _present(tag("mlflow.source.git.commit")))


def eligible_runs(runs: DataFrame, experiment: str | None = None, run_ids: list[str] | None = None) -> DataFrame:
    """M3: runs that can be promoted.

    By default the approved ones; named runs may have any status but ``migrated``.
    Runs without a generation hash are left out.
    """
    if run_ids is not None:
        chosen = runs.filter(F.col("run_id").isin(run_ids))
    else:
        chosen = runs_with_status(runs, "approved")
        if experiment is not None:
            chosen = chosen.filter(F.col("experiment_name") == experiment)
    return chosen.filter(F.coalesce(tag("data_status"), F.lit("")) != "migrated").select(
        "run_id", "run_name", "experiment_name", generation_hash().alias("data_gen_hash"),
        F.coalesce(param("mlflow_run_id"), F.col("run_id")).alias("mlflow_run_id"),
        param("generation_approach").alias("generation_approach"), param("step").alias("step"),
        param("output_type").alias("output_type"), param("esci_label").alias("esci_label"),
    ).filter(F.col("data_gen_hash").isNotNull())


def generation_type() -> Column:
    """Kind of run from its script name, else from its tags.

    ``stop_at_intents`` is logged as text, so only the text ``true`` counts.
    """
    script = F.coalesce(param("script_name"), F.lit(""))
    stopped = F.lower(F.coalesce(param("stop_at_intents"), F.lit("false"))) == "true"
    values = F.lower(F.array_join(F.map_values("tags"), "\n"))

    def tagged(key: str, text: str) -> Column:
        return F.coalesce(F.map_contains_key("tags", F.lit(key)) | values.contains(text), F.lit(False))

    two = stopped | (F.coalesce(param("step"), F.lit("")) == "1_2")
    return (
        F.when(script == "initial_generation.py", "initial_generation")
        .when((script == "intent_generation_approach.py") & two, "intent_generation_2step")
        .when(script == "intent_generation_approach.py", "intent_generation_3step")
        .when(tagged("initial-generation", "initial_generation"), "initial_generation")
        .when(tagged("intent-generation", "intent_generation") & stopped, "intent_generation_2step")
        .when(tagged("intent-generation", "intent_generation"), "intent_generation_3step")
        .otherwise("unknown")
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """One row per fully or partly migrated run, by experiment and start index."""
    label = param("esci_label")
    start = F.coalesce(param("start_idx").try_cast("long"), F.lit(0).cast("long"))
    return runs_with_status(runs, "migrated", "migrated_partial").select(
        "experiment_name", "run_id", generation_type().alias("generation_type"),
        tag("data_status").alias("migration_status"),
        F.coalesce(label, F.when(F.col("experiment_name").startswith("Intent"), "E"), F.lit("unknown")).alias("esci_label"),
        F.coalesce(generation_hash(), F.lit("unknown")).alias("data_gen_hash"), start.alias("start_idx"),
        end_index(F.coalesce(param("start_idx"), F.lit("0")), param("limit")).alias("end_idx"),
        param("limit").try_cast("long").alias("limit"), param("batch_size").try_cast("long").alias("batch_size"),
        F.coalesce(param("model"), F.lit("unknown")).alias("model"),
        F.coalesce(F.try_element_at("metrics", F.lit("total_runtime_seconds")), F.lit(0.0)).alias("runtime_seconds"),
        "start_time", "end_time",
    ).orderBy("experiment_name", "start_idx", "run_id")


def set_tags(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Overlay ``updates(run_id, new_tags)``, one row per run, on the tags of the runs."""
    joined = runs.join(updates.select("run_id", "new_tags"), "run_id", "left")
    kept = F.map_filter("tags", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("new_tags"), k), F.lit(False)))
    empty = F.create_map().cast("map<string,string>")
    return joined.withColumn(
        "tags", F.map_concat(F.coalesce(kept, empty), F.coalesce("new_tags", empty))).select(*runs.columns)


def approve_runs(runs: DataFrame, run_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark runs approved; also the number approved and of unknown ids."""
    wanted = run_ids.select(F.col(run_ids.columns[0]).alias("run_id"))
    found = wanted.join(runs.select("run_id", F.lit(True).alias("_known")), "run_id", "left")
    updates = wanted.distinct().select("run_id", F.create_map(F.lit("data_status"), F.lit("approved")).alias("new_tags"))
    counts = found.agg(F.count("_known").alias("approved"), F.count_if(F.col("_known").isNull()).alias("errors"))
    return set_tags(runs, updates), counts


def change_status(runs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``changes(run_id, new_status, seq)`` that follow the status machine; the others are returned with a reason.

    Several changes of one run are taken in order of ``seq``, each from the
    status that the valid ones before it led to.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    steps = changes.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "new_status"))).alias("steps"))
    current = steps.join(
        runs.select("run_id", F.lit(True).alias("_known"), tag("data_status").alias("_status")), "run_id", "left")
    row = "struct<old_status:string,new_status:string,ok:boolean>"
    start = F.struct(F.col("_status").alias("status"), F.array().cast(f"array<{row}>").alias("done"))

    def take(state, step):
        ok = F.array_contains(allowed, F.concat(F.coalesce(state["status"], F.lit("")), F.lit(">"), F.coalesce(step["new_status"], F.lit(""))))
        done = F.struct(state["status"].alias("old_status"), step["new_status"].alias("new_status"), ok.alias("ok"))
        return F.struct(F.when(ok, step["new_status"]).otherwise(state["status"]).alias("status"), F.concat(state["done"], F.array(done)).alias("done"))

    walked = current.withColumn("_end", F.aggregate("steps", start, take))
    judged = walked.select("run_id", "_known", F.explode("_end.done").alias("d")).select("run_id", "_known", "d.*")
    reason = F.when(F.col("_known").isNull(), "unknown run").when(~F.col("ok"), "invalid transition")
    bad = judged.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("run_id", "old_status", "new_status", "reason")
    updates = walked.filter(F.col("_known") & F.exists("_end.done", lambda d: d["ok"])).select(
        "run_id", F.create_map(F.lit("data_status"), F.col("_end.status")).alias("new_tags"))
    return set_tags(runs, updates), bad


def promote_runs(store: Store, runs: DataFrame, rows: DataFrame, created_at: Column, bridged: bool = False,
                 dry_run: bool = True, run_ids: list[str] | None = None,
                 experiment: str | None = None) -> tuple[Store, DataFrame, DataFrame]:
    """M4: promote all eligible runs with their generated ``rows`` (those of M1 plus ``query_type``).

    Returns the store, the runs with updated status tags and one result row per
    run.  Runs are promoted in order of start time and id, as one set.
    """
    eligible = eligible_runs(runs, experiment, run_ids).join(runs.select("run_id", "start_time"), "run_id")
    label = F.when((F.col("generation_approach") == "intent"), F.coalesce("esci_label", F.lit("E"))).otherwise(F.col("esci_label"))
    eligible = eligible.withColumn("esci_label", label)
    typed = rows if "query_type" in rows.columns else rows.withColumn("query_type", F.lit(None).cast("string"))
    sizes = typed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.count("query_type").alias("n_typed"),
        F.count_if(F.col("query_type") == "bridged").alias("n_bridged"))
    zero = F.lit(0).cast("long")
    n = F.coalesce("n_bridged" if bridged else "n_all", zero)
    plan = eligible.join(sizes, "run_id", "left").withColumn("records_processed", n).withColumn(
        "error",
        F.when(F.lit(bridged) & (F.coalesce("n_all", zero) > 0) & (F.col("n_typed") == 0),
               "'query_type' column not found: cannot select bridged records")
        .when(F.col("records_processed") == 0, "No records found after filtering")
        .when(~F.lit(dry_run) & ~F.coalesce(F.col("output_type").isin(OUTPUT_TYPES), F.lit(False)),
              F.concat(F.lit("Unsupported output_type: "), F.coalesce("output_type", F.lit("None")))))
    if dry_run:
        results = plan.select(
            "run_id", F.when(F.col("error").isNull(), "dry_run").otherwise("error").alias("status"), "error",
            F.when(F.col("error").isNull(), F.col("records_processed")).otherwise(zero).alias("records_processed"),
            *[zero.alias(c) for c in ("queries_inserted", "examples_inserted", "labels_inserted")])
        return store, runs, results
    good = plan.filter(F.col("error").isNull())
    with_labelers = store_ops.ensure_labelers(store, good, created_at)
    ready = store_ops.labeler_of(with_labelers, good).withColumn("run_seq", F.struct("start_time", "run_id")).select(
        "run_id", "run_seq", "data_gen_hash", "mlflow_run_id", "labeler_id", "esci_label")
    chosen = typed.filter(F.col("query_type") == "bridged") if bridged else typed
    out, stats, _ = store_ops.promote(with_labelers, chosen, ready, created_at)
    counts = stats.select("run_id", "queries_inserted", "examples_inserted", "labels_inserted")
    results = plan.join(counts, "run_id", "left").select(
        "run_id", F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"), "error",
        F.when(F.col("error").isNull(), F.col("records_processed")).otherwise(zero).alias("records_processed"),
        *[F.coalesce(c, zero).alias(c) for c in ("queries_inserted", "examples_inserted", "labels_inserted")])
    entries = [F.lit("data_status"), F.lit("migrated_partial" if bridged else "migrated"),
               F.lit("migration_timestamp"), F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss")]
    if bridged:
        entries += [F.lit("migration_type"), F.lit("bridged_only")]
    return out, set_tags(runs, good.select("run_id", F.create_map(*entries).alias("new_tags"))), results


def rollback_run(store: Store, runs: DataFrame, run_id: str, at: Column, strict: bool = False):
    """M5 with its run: only a migrated run can be rolled back; its status becomes ``pending_approval``.

    Returns the store, the runs, the counts and the labels that blocked it.
    """
    row = runs.filter(F.col("run_id") == run_id).select(
        tag("data_status").alias("status"), generation_hash().alias("hash"),
        F.coalesce(param("mlflow_run_id"), F.col("run_id")).alias("mlflow_run_id"),
        param("generation_approach").alias("approach")).first()
    if row is None or row["status"] != "migrated":
        raise ValueError(f"run {run_id} is not marked as migrated")
    if row["hash"] is None:
        raise ValueError(f"no generation hash for run {run_id}")
    out, stats, blocking = store_ops.rollback(store, row["hash"], row["mlflow_run_id"], row["approach"], strict)
    if not blocking.isEmpty():
        return out, runs, stats, blocking
    update = runs.filter(F.col("run_id") == run_id).select("run_id", F.create_map(
        F.lit("data_status"), F.lit("pending_approval"), F.lit("rollback_timestamp"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("new_tags"))
    return out, set_tags(runs, update), stats, blocking
