"""The five-table relevance store and its mutations.

Every mutation is a set-based function from a ``Store`` (and a DataFrame of
ids, edits or generated rows) to a new ``Store`` plus DataFrames of statistics.
Nothing is executed until a result is read, except where new ids have to be
allocated: their order is written once to the shared folder.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relish.functions.text import valid_json
from relish.operators.filters import constraint_violations
from relish.operators.ordering import with_position
from relish.operators.skew import salted_join
from relish.session import dealt, parts_for, stage

# Roles, labels and table layouts of the store.
ROLES = ["labeler", "reviewer"]
ESCI = ["E", "S", "C", "I"]
_ts = T.TimestampType()
SCHEMAS = {
    "labeler": T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("type", T.StringType()), T.StructField("created_at", _ts)]),
    "query": T.StructType([
        T.StructField("id", T.LongType()), T.StructField("query_content", T.StringType()),
        T.StructField("query_filters", T.StringType()), T.StructField("data_gen_hash", T.StringType()),
        T.StructField("created_at", _ts), T.StructField("mlflow_run_id", T.StringType())]),
    "consumable": T.StructType([
        T.StructField("id", T.LongType()), T.StructField("image_url", T.StringType()),
        T.StructField("consumable_name", T.StringType()), T.StructField("consumable_type", T.StringType()),
        T.StructField("consumable_ingredients", T.StringType()), T.StructField("consumable_portion_size", T.StringType()),
        T.StructField("consumable_nutritional_profile", T.StringType()),
        T.StructField("consumable_cooking_method", T.StringType()), T.StructField("created_at", _ts)]),
    # run_id is ours: it lets a strict rollback find what a run attached to older queries
    "example": T.StructType([
        T.StructField("id", T.LongType()), T.StructField("query_id", T.LongType()),
        T.StructField("consumable_id", T.LongType()), T.StructField("created_at", _ts),
        T.StructField("example_gen_hash", T.StringType()), T.StructField("run_id", T.StringType())]),
    "label": T.StructType([
        T.StructField("id", T.LongType()), T.StructField("labeler_id", T.LongType()),
        T.StructField("example_id", T.LongType()), T.StructField("esci_label", T.StringType()),
        T.StructField("label_reason", T.StringType()), T.StructField("auto_label_score", T.DecimalType(5, 4)),
        T.StructField("created_at", _ts)]),
}


@dataclass(frozen=True)
class Store:
    labeler: DataFrame
    query: DataFrame
    consumable: DataFrame
    example: DataFrame
    label: DataFrame

    def replace(self, **tables: DataFrame) -> Store:
        return dataclasses.replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in order and type; missing ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS[table].fields
    ])


def max_id(df: DataFrame) -> Column:
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()


def allocate_ids(new: DataFrame, order: list[str], existing: DataFrame) -> DataFrame:
    """Ids following the highest existing id, in the given order."""
    placed = with_position(new, order, "_pos")
    return placed.withColumn("id", F.col("_pos") + max_id(existing) + 1).drop("_pos")


def store_violations(store: Store) -> DataFrame:
    """Every broken constraint of the store."""
    checks = [
        constraint_violations(store.labeler, "labeler", "id", ["name", "role", "type"], {"role": ROLES}, ["id"]),
        constraint_violations(store.query, "query", "id", ["query_content"]),
        constraint_violations(store.consumable, "consumable", "id", ["image_url", "consumable_name"]),
        constraint_violations(
            store.example, "example", "id", ["query_id", "consumable_id"], unique=["query_id", "consumable_id"],
            references={"query_id": (store.query, "id"), "consumable_id": (store.consumable, "id")}),
        constraint_violations(
            store.label, "label", "id", ["labeler_id", "example_id", "esci_label"], {"esci_label": ESCI},
            references={"labeler_id": (store.labeler, "id"), "example_id": (store.example, "id")}),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


# ------------------------------------------------------------------ annotation view

def annotation_view(store: Store, human_labeler: int, run_id: str | None = None, bulk: bool = False, ordered: bool = False) -> DataFrame:
    """Examples with query, item, the label of the generator named by the example's hash, and one human's label.

    ``ordered`` sorts all rows by example, for showing them.

    When several labelers share the generator's name, the one that labelled the
    example is used, the lowest id first.
    """
    parts = parts_for(store.example, store.label)
    queries = store.query if run_id is None else store.query.filter(F.col("mlflow_run_id") == run_id)
    q = dealt(queries.select(
        F.col("id").alias("query_id"), F.col("query_content").alias("query"), "query_filters",
        F.col("created_at").alias("query_created_at"), "mlflow_run_id"), parts, "query_id")
    c = dealt(store.consumable.select(F.col("id").alias("consumable_id"), "consumable_name", "consumable_ingredients"), parts, "consumable_id")
    e = store.example.select(F.col("id").alias("example_id"), "query_id", "consumable_id", "example_gen_hash")
    named = store.label.select("example_id", "labeler_id", "id", "esci_label", "label_reason").join(
        store.labeler.select(F.col("id").alias("labeler_id"), F.col("name").alias("example_gen_hash")), "labeler_id")
    ai = (
        dealt(named, parts, "example_id", "example_gen_hash").groupBy("example_id", "example_gen_hash")
        .agg(F.min_by(F.struct("esci_label", "label_reason"), F.struct("labeler_id", "id")).alias("ai"))
    )
    human = dealt(store.label.filter(F.col("labeler_id") == human_labeler).select(
        "example_id", F.col("esci_label").alias("human_esci_label"), F.col("label_reason").alias("human_label_reason")), parts, "example_id")
    view = (
        e.join(q, "query_id").join(c, "consumable_id")
        .join(ai, ["example_id", "example_gen_hash"], "left").join(human, "example_id", "left")
    )
    columns = ["example_id", "query_id", "consumable_id", "example_gen_hash", "query", "query_filters",
               F.col("query_created_at").alias("created_at"), "consumable_name", "consumable_ingredients",
               F.col("ai.esci_label").alias("ai_esci_label"), F.col("ai.label_reason").alias("ai_label_reason"),
               "human_esci_label", "human_label_reason", "mlflow_run_id"]
    if bulk:
        columns = ["example_id", "query_id", "consumable_id", "query", "consumable_name",
                   F.col("ai.esci_label").alias("ai_esci_label"), "human_esci_label"]
    shown = view.select(*columns)
    return shown.orderBy("example_id") if ordered else shown


def ambiguous_generators(store: Store) -> DataFrame:
    """Generator names held by more than one labeler."""
    return store.labeler.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_labelers"), F.count_distinct("type").alias("n_types")).filter("n_labelers > 1")


def effective_label(human: str = "human_esci_label", ai: str = "ai_esci_label") -> Column:
    """The human label when there is one, else the generated label, else empty."""
    return F.coalesce(F.nullif(F.col(human), F.lit("")), F.col(ai), F.lit(""))


# ------------------------------------------------------------------ promotion

def ensure_labelers(store: Store, wanted: DataFrame, created_at: Column) -> Store:
    """M2: add missing generator labelers for ``wanted(data_gen_hash, generation_approach)``."""
    keys = wanted.select(
        F.col("data_gen_hash").alias("name"),
        F.concat(F.lit("synthetic_data_generation_"), F.coalesce("generation_approach", F.lit("None"))).alias("type"),
    ).distinct()
    new = keys.join(store.labeler.select("name", "type"), ["name", "type"], "left_anti")
    rows = allocate_ids(new, ["name", "type"], store.labeler).withColumns(
        {"role": F.lit("labeler"), "created_at": created_at})
    return store.replace(labeler=store.labeler.unionByName(conform(rows, "labeler")))


def labeler_of(store: Store, runs: DataFrame) -> DataFrame:
    """``runs`` with the id of their generator labeler (lowest id of the name and type)."""
    ids = store.labeler.groupBy("name", "type").agg(F.min("id").alias("labeler_id"))
    named = runs.withColumn("_type", F.concat(F.lit("synthetic_data_generation_"), F.coalesce("generation_approach", F.lit("None"))))
    return named.join(
        ids.select(F.col("name").alias("data_gen_hash"), F.col("type").alias("_type"), "labeler_id"),
        ["data_gen_hash", "_type"], "left").drop("_type")


def promote(store: Store, rows: DataFrame, runs: DataFrame, created_at: Column) -> tuple[Store, DataFrame, DataFrame]:
    """M1: add the generated rows of one or many runs to the store.

    ``rows(run_id, row_id, consumable_id, query, query_filters, reasoning)``;
    ``runs(run_id, run_seq, data_gen_hash, mlflow_run_id, labeler_id,
    esci_label)`` in promotion order.  Rows with an unknown item or a null query
    are left out.  A text already stored is reused, a new one belongs to the
    first run (and row) that has it; the same holds for query-item pairs.  Only
    new pairs are labelled, with score 1.

    Returns the new store, counts per run and the distinct unknown item ids.
    """
    known = store.consumable.select(F.col("id").alias("consumable_id"))
    missing = rows.select("consumable_id").distinct().join(known, "consumable_id", "left_anti")
    order = F.struct("run_seq", "row_id")
    valid = stage(
        rows.filter(F.col("query").isNotNull()).join(known, "consumable_id", "left_semi")
        .join(runs, "run_id").withColumn("_order", order)
    )
    filters = F.nullif(valid_json("query_filters"), F.lit("{}"))
    stored = store.query.groupBy(F.col("query_content").alias("query")).agg(F.min("id").alias("query_id"))
    owners = stage(valid.groupBy("query").agg(
        F.min_by(F.struct(filters.alias("query_filters"), "run_id", "data_gen_hash", "mlflow_run_id"), "_order").alias("f"),
        F.count(F.lit(1)).alias("n"),
    ).join(stored, "query", "left"))
    new_texts = owners.filter(F.col("query_id").isNull()).select("query", "f.*")
    new_queries = allocate_ids(new_texts, ["query"], store.query)
    query_ids = (
        owners.filter(F.col("query_id").isNotNull()).select("query", "query_id")
        .unionByName(new_queries.select("query", F.col("id").alias("query_id")))
    )
    # one text may belong to most rows; its rows are dealt over many tasks
    pairs = (
        salted_join(valid, query_ids, "query", ["run_id", "row_id"], counts=owners.select("query", "n")).groupBy("query_id", "consumable_id")
        .agg(F.min_by(F.struct("run_id", "data_gen_hash", "labeler_id", "esci_label", "reasoning"), "_order").alias("p"))
        .join(store.example.select("query_id", "consumable_id"), ["query_id", "consumable_id"], "left_anti")
        .select("query_id", "consumable_id", "p.*")
    )
    new_examples = allocate_ids(pairs, ["query_id", "consumable_id"], store.example)
    labels = new_examples.select(
        F.col("id").alias("example_id"), "labeler_id", "esci_label", F.col("reasoning").alias("label_reason"), F.lit(1.0).alias("auto_label_score"))
    first_example = max_id(store.example)
    # examples and labels are new one to one, so label ids follow the order of example ids
    labels = labels.withColumn("id", F.col("example_id") - first_example + max_id(store.label))
    out = store.replace(
        query=store.query.unionByName(conform(
            new_queries.withColumnRenamed("query", "query_content").withColumn("created_at", created_at), "query")),
        example=store.example.unionByName(conform(
            new_examples.withColumnRenamed("data_gen_hash", "example_gen_hash").withColumn("created_at", created_at), "example")),
        label=store.label.unionByName(conform(labels.withColumn("created_at", created_at), "label")),
    )
    zero = F.lit(0).cast("long")
    stats = (
        runs.select("run_id")
        .join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("records_processed")), "run_id", "left")
        .join(new_queries.groupBy("run_id").agg(F.count(F.lit(1)).alias("queries_inserted")), "run_id", "left")
        .join(new_examples.groupBy("run_id").agg(F.count(F.lit(1)).alias("examples_inserted")), "run_id", "left")
        .select("run_id", *[F.coalesce(c, zero).alias(c) for c in
                            ("records_processed", "queries_inserted", "examples_inserted")],
                F.coalesce("examples_inserted", zero).alias("labels_inserted"))
    )
    return out, stats, missing


def rollback(store: Store, data_gen_hash: str, run_id: str, generation_approach: str,
             strict: bool = False) -> tuple[Store, DataFrame, DataFrame]:
    """M5: remove what a run added.

    Removes the run's labels, examples and queries, and its labeler when it has
    no label left.  Labels of others on these examples block the rollback: then
    the store is returned unchanged and the blocking labels are the third
    result.  ``strict`` also removes examples the run attached to older queries.
    """
    labeler_type = f"synthetic_data_generation_{generation_approach}"
    mine = store.labeler.filter((F.col("name") == data_gen_hash) & (F.col("type") == labeler_type)).select(
        F.col("id").alias("labeler_id"))
    queries = store.query.filter((F.col("data_gen_hash") == data_gen_hash) & (F.col("mlflow_run_id") == run_id)).select(
        F.col("id").alias("query_id"))
    # without a labeler or without queries there is nothing to roll back
    if mine.isEmpty() or (queries.isEmpty() and not strict):
        mine, queries = mine.limit(0), queries.limit(0)
        strict = False
    examples = store.example.join(queries, "query_id", "left_semi")
    if strict:
        examples = examples.unionByName(
            store.example.filter(F.col("run_id") == run_id).join(queries, "query_id", "left_anti"))
    example_ids = examples.select(F.col("id").alias("example_id"))
    on_run = store.label.join(example_ids, "example_id", "left_semi")
    own = on_run.join(mine, "labeler_id", "left_semi")
    blocking = on_run.join(mine, "labeler_id", "left_anti").select("id", "labeler_id", "example_id")
    label = store.label.join(own.select("id"), "id", "left_anti")
    left_over = label.join(mine, "labeler_id", "left_semi").select("labeler_id")
    gone = mine.join(left_over, "labeler_id", "left_anti").select(F.col("labeler_id").alias("id"))
    blocked = not blocking.isEmpty()

    def n(df: DataFrame) -> Column:
        return F.lit(0).cast("long") if blocked else df.agg(F.count(F.lit(1))).scalar()

    stats = store.labeler.sparkSession.range(1).select(
        F.lit("error" if blocked else "success").alias("status"), n(queries).alias("queries_removed"),
        n(examples).alias("examples_removed"), n(own).alias("labels_removed"), n(gone).alias("labelers_removed"))
    if blocked:
        return store, stats, blocking
    out = store.replace(
        label=label.select(*store.label.columns),
        example=store.example.join(example_ids.withColumnRenamed("example_id", "id"), "id", "left_anti").select(*store.example.columns),
        query=store.query.join(queries.withColumnRenamed("query_id", "id"), "id", "left_anti").select(*store.query.columns),
        labeler=store.labeler.join(gone, "id", "left_anti").select(*store.labeler.columns),
    )
    return out, stats, blocking


# ------------------------------------------------------------------ deletions

def _without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not in the one-column ``ids``."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti").select(*df.columns)


def _counts(spark_df: DataFrame, **frames: DataFrame) -> DataFrame:
    """One row of row counts."""
    return spark_df.sparkSession.range(1).select(*[
        f.agg(F.count(F.lit(1))).scalar().alias(name) for name, f in frames.items()])


def preview_consumable_deletion(store: Store, ids: DataFrame) -> DataFrame:
    """M6 preview: per item, its examples, labels, queries and queries that would lose their last example."""
    wanted = ids.select(F.col(ids.columns[0]).alias("consumable_id")).distinct()
    items = store.consumable.select(F.col("id").alias("consumable_id")).join(wanted, "consumable_id", "left_semi")
    ex = store.example.join(wanted, "consumable_id", "left_semi")
    span = store.example.groupBy("query_id").agg(F.min("consumable_id").alias("lo"), F.max("consumable_id").alias("hi"))
    n_labels = store.label.groupBy(F.col("example_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    per = ex.join(span, "query_id").join(n_labels, "id", "left").groupBy("consumable_id").agg(
        F.count(F.lit(1)).alias("examples"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels"),
        F.count_distinct("query_id").alias("queries"),
        F.count_distinct(F.when(F.col("lo") == F.col("hi"), F.col("query_id"))).alias("orphaned_queries"))
    return items.join(per, "consumable_id", "left").select(F.col("consumable_id").alias("id"), *[
        F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("examples", "labels", "queries", "orphaned_queries")])


def _delete_examples(store: Store, examples: DataFrame) -> tuple[Store, DataFrame, DataFrame]:
    """Store without the examples and their labels; also the labels and the queries left without examples."""
    ids = examples.select("id")
    labels = store.label.join(ids.withColumnRenamed("id", "example_id"), "example_id", "left_semi")
    remaining = _without(store.example, ids)
    touched = examples.select("query_id").distinct()
    orphaned = touched.join(remaining.select("query_id"), "query_id", "left_anti")
    out = store.replace(label=_without(store.label, ids, "example_id"), example=remaining)
    return out, labels, orphaned


def delete_consumables(store: Store, ids: DataFrame) -> tuple[Store, DataFrame]:
    """M6: delete items with their examples, labels and the queries that end up without examples."""
    wanted = ids.select(F.col(ids.columns[0]).alias("consumable_id")).distinct()
    examples = store.example.join(wanted, "consumable_id", "left_semi")
    out, labels, orphaned = _delete_examples(store, examples)
    gone = store.consumable.join(wanted.withColumnRenamed("consumable_id", "id"), "id", "left_semi")
    stats = _counts(store.example, consumables=gone, examples=examples, labels=labels,
                    queries=examples.select("query_id").distinct(), orphaned_queries=orphaned)
    return out.replace(query=_without(store.query, orphaned), consumable=_without(store.consumable, wanted)), stats


def preview_query_deletion(store: Store, ids: DataFrame) -> DataFrame:
    """M7 preview: per query, its examples and labels."""
    parts = parts_for(store.example, store.label)
    wanted = dealt(ids.select(F.col(ids.columns[0]).alias("query_id")), parts, "query_id").distinct()
    items = store.query.select(F.col("id").alias("query_id")).join(wanted, "query_id", "left_semi")
    n_labels = dealt(store.label.select(F.col("example_id").alias("id")), parts, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    per = store.example.join(wanted, "query_id", "left_semi").join(n_labels, "id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("examples"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels"))
    return items.join(per, "query_id", "left").select(F.col("query_id").alias("id"), *[
        F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("examples", "labels")])


def delete_queries(store: Store, ids: DataFrame) -> tuple[Store, DataFrame]:
    """M7: delete queries with their examples and labels."""
    wanted = ids.select(F.col(ids.columns[0]).alias("query_id")).distinct()
    examples = store.example.join(wanted, "query_id", "left_semi")
    out, labels, _ = _delete_examples(store, examples)
    gone = store.query.join(wanted.withColumnRenamed("query_id", "id"), "id", "left_semi")
    return out.replace(query=_without(store.query, wanted)), _counts(
        store.example, queries=gone, examples=examples, labels=labels)


def delete_examples(store: Store, ids: DataFrame) -> tuple[Store, DataFrame]:
    """M8: delete examples with their labels, and queries left without examples."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    examples = store.example.join(wanted, "id", "left_semi")
    out, labels, orphaned = _delete_examples(store, examples)
    return out.replace(query=_without(store.query, orphaned)), _counts(
        store.example, examples=examples, labels=labels, orphaned_queries=orphaned)


# ------------------------------------------------------------------ label edits

def upsert_labels(store: Store, edits: DataFrame) -> tuple[Store, DataFrame]:
    """M9: set labels by (example, labeler).

    ``edits(example_id, labeler_id, esci_label, edited_at, seq)``: the last edit
    of a key wins.  Existing labels keep reason and score and take the edit's
    time; others are inserted.  Edits with an unknown label value are returned.
    """
    good = F.coalesce(F.col("esci_label").isin(ESCI), F.lit(False))
    last = edits.filter(good).groupBy("example_id", "labeler_id").agg(
        F.max_by(F.struct("esci_label", "edited_at"), F.struct("edited_at", "seq")).alias("e"))
    key = ["example_id", "labeler_id"]
    merged = store.label.join(last, key, "left").withColumns({
        "esci_label": F.coalesce("e.esci_label", "esci_label"),
        "created_at": F.coalesce("e.edited_at", "created_at")})
    new = last.join(store.label.select(*key), key, "left_anti").select(
        *key, F.col("e.esci_label").alias("esci_label"), F.col("e.edited_at").alias("created_at"))
    inserted = allocate_ids(new, ["example_id", "labeler_id"], store.label)
    return store.replace(label=conform(merged, "label").unionByName(conform(inserted, "label"))), edits.filter(~good)


def delete_own_labels(store: Store, keys: DataFrame) -> Store:
    """Delete labels by (example, labeler), leaving other labelers' alone."""
    k = keys.select("example_id", "labeler_id")
    return store.replace(label=store.label.join(k, ["example_id", "labeler_id"], "left_anti").select(*store.label.columns))


def update_label_reasons(store: Store, edits: DataFrame) -> Store:
    """Set the reason by ``edits(example_id, labeler_id, label_reason, seq)``; an empty reason becomes null.

    Of several edits of one label the last by ``seq`` counts.
    """
    key = ["example_id", "labeler_id"]
    last = edits.groupBy(*key).agg(F.max_by(F.struct("label_reason"), "seq").alias("_e"))
    e = last.select(*key, F.nullif("_e.label_reason", F.lit("")).alias("_new"), F.lit(True).alias("_hit"))
    merged = store.label.join(e, key, "left").withColumn(
        "label_reason", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("label_reason")))
    return store.replace(label=conform(merged, "label"))


def copy_ai_labels(store: Store, example_ids: DataFrame, human_labeler: int, edited_at: Column) -> tuple[Store, DataFrame]:
    """Give the human labeler the generated label of each example; examples without one are returned."""
    wanted = example_ids.select(F.col(example_ids.columns[0]).alias("example_id")).distinct()
    view = annotation_view(store, human_labeler, bulk=True).select("example_id", "ai_esci_label")
    found = wanted.join(view, "example_id", "left")
    has = F.coalesce("ai_esci_label", F.lit("")) != ""
    edits = found.filter(has).select(
        "example_id", F.lit(human_labeler).cast("long").alias("labeler_id"), F.col("ai_esci_label").alias("esci_label"),
        edited_at.alias("edited_at"), F.lit(0).alias("seq"))
    out, _ = upsert_labels(store, edits)
    return out, found.filter(~has).select("example_id")


def edit_query_texts(store: Store, edits: DataFrame) -> tuple[Store, DataFrame]:
    """Change the query text of examples; ``edits(example_id, new_text, seq)``, judged against the store before them.

    Of several edits of one example the last by ``seq`` counts, the others are
    ``superseded``.  A text that is already stored makes the example point to
    that query (lowest id).  A new text renames the query of its first edit, for
    all examples of that query, and its other edits point there.  Of several new
    texts for one query the last one's first edit wins; the first edits of the
    others are ``superseded`` and their other edits refused.  Of the edits that
    would give a query the same item, the first is ``repointed`` unless the pair
    is stored already; the rest are ``refused``, so pairs stay unique.  Returns
    one row per edit with its outcome, ``renamed`` included.
    """
    known = edits.join(
        store.example.select(F.col("id").alias("example_id"), "query_id", "consumable_id"), "example_id")
    last = known.groupBy("example_id").agg(F.max("seq").alias("seq"))
    current = known.join(last, ["example_id", "seq"])
    stored = store.query.groupBy(F.col("query_content").alias("new_text")).agg(F.min("id").alias("target"))
    matched = current.join(stored, "new_text", "left")
    fresh = matched.filter(F.col("target").isNull())
    first = fresh.groupBy("new_text").agg(F.min_by(F.struct("query_id", "example_id", "seq"), "seq").alias("f"))
    renames = first.groupBy(F.col("f.query_id").alias("id")).agg(F.max_by("new_text", "f.seq").alias("_text"))
    led = first.join(renames.select(F.col("id").alias("_id"), F.col("_text").alias("_won")), F.col("f.query_id") == F.col("_id"))
    planned = matched.join(
        led.select("new_text", F.col("f.query_id").alias("first_query"), F.col("f.example_id").alias("first_example"),
                   (F.col("new_text") == F.col("_won")).alias("_wins")), "new_text", "left")
    leads = F.col("target").isNull() & (F.col("first_example") == F.col("example_id"))
    moves = planned.withColumns({"_leads": leads, "_goal": F.coalesce("target", F.when(F.col("_wins"), F.col("first_query")))})
    taken = store.example.groupBy(F.col("query_id").alias("_goal"), "consumable_id").agg(F.min("id").alias("_holder"))
    claims = moves.filter(~F.col("_leads") & F.col("_goal").isNotNull()).groupBy("_goal", "consumable_id").agg(F.min("seq").alias("_first_claim"))
    pair = ["_goal", "consumable_id"]
    judged = moves.join(taken, pair, "left").join(claims, pair, "left").withColumn(
        "outcome",
        F.when(F.col("_leads"), F.when(F.col("_wins"), "renamed").otherwise("superseded"))
        .when(F.col("_goal").isNull(), "refused")
        .when(F.col("_holder").isNotNull() & (F.col("_holder") != F.col("example_id")), "refused")
        .when(F.col("_holder").isNull() & (F.col("_first_claim") != F.col("seq")), "refused")
        .otherwise("repointed"))
    repoint = judged.filter(F.col("outcome") == "repointed").select(F.col("example_id").alias("id"), F.col("_goal").alias("_query"))
    earlier = known.join(last, ["example_id", "seq"], "left_anti").select("example_id", "seq", "new_text", F.lit("superseded").alias("outcome"))
    query = store.query.join(renames, "id", "left").withColumn("query_content", F.coalesce("_text", "query_content"))
    example = store.example.join(repoint, "id", "left").withColumn("query_id", F.coalesce("_query", "query_id"))
    return (
        store.replace(query=conform(query, "query"), example=conform(example, "example")),
        judged.select("example_id", "seq", "new_text", "outcome").unionByName(earlier),
    )


# ------------------------------------------------------------------ query text duplicates

def deduplicate_queries(store: Store) -> tuple[Store, DataFrame]:
    """D-5: one query per text (lowest id), examples repointed, the other queries deleted.

    Pairs that become equal collapse to their lowest example id, which takes
    over the labels of the others.
    """
    parts = parts_for(store.example, store.label)
    texts = dealt(store.query.filter(F.col("query_content").isNotNull()).select("id", "query_content"), parts, "query_content")
    first = texts.groupBy("query_content").agg(F.min("id").alias("first_id"))
    mapping = dealt(texts.join(first, "query_content").filter(F.col("id") != F.col("first_id")).select(
        F.col("id").alias("query_id"), "first_id"), parts, "query_id")
    moved = dealt(store.example.join(mapping, "query_id", "left").withColumns(
        {"query_id": F.coalesce("first_id", "query_id"), "_moved": F.col("first_id").isNotNull()}), parts, "query_id", "consumable_id")
    lowest = moved.groupBy("query_id", "consumable_id").agg(F.min("id").alias("keep_id"))
    placed = moved.join(lowest, ["query_id", "consumable_id"])
    example = placed.filter(F.col("id") == F.col("keep_id"))
    relabel = placed.filter(F.col("id") != F.col("keep_id")).select(F.col("id").alias("example_id"), "keep_id")
    label = store.label.join(dealt(relabel, parts, "example_id"), "example_id", "left").withColumn("example_id", F.coalesce("keep_id", "example_id"))
    stats = _counts(
        store.example, duplicate_queries=mapping, duplicated_texts=mapping.select("first_id").distinct(),
        examples_repointed=moved.filter("_moved"), examples_collapsed=relabel)
    return store.replace(
        query=_without(store.query, mapping), example=conform(example, "example"), label=conform(label, "label")), stats


def verify_deduplication(before: Store, after: Store) -> DataFrame:
    """D-6: totals, remaining duplicates, orphaned examples, removed count and the verdict."""
    groups = after.query.filter(F.col("query_content").isNotNull()).groupBy("query_content").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    orphan = after.example.join(after.query.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    counted = _counts(
        after.query, total_queries=after.query, remaining_duplicates=groups, orphaned_examples=orphan,
        before=before.query)
    unique = after.query.agg(F.count_distinct("query_content")).scalar()
    return counted.select(
        "total_queries", unique.alias("unique_queries"), "remaining_duplicates", "orphaned_examples",
        (F.col("before") - F.col("total_queries")).alias("removed"),
        ((F.col("remaining_duplicates") == 0) & (F.col("orphaned_examples") == 0)).alias("ok"))
