"""Preparation and flattening of batched query generation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relish.functions.dietary import diet_name, query_filters
from relish.functions.text import render_template
from relish.operators.aggregates import theme_distribution
from relish.operators.joins import attach_first
from relish.operators.ordering import shuffle_key, with_hash_position

# Prompt placeholders, output columns and nested output types.
LABEL_MARK, TABLE_MARK, COUNT_MARK, EXAMPLES_MARK = "[E/S/C/I]", "[FOOD CANDIDATES]", "[QUERIES_PER_ITEM]", "[QUERY_EXAMPLES]"
OUTPUT_COLUMNS = ["consumable_id", "consumable_name", "query", "query_filters", "reasoning", "esci_label", "generated_at"]
CANDIDATES_TYPE = (
    "array<struct<id:bigint,name:string,queries:array<struct<query:string,dimensions:map<string,string>,reasoning:string>>>>")
MATCHES_TYPE = "array<struct<consumable_id:bigint,consumable_name:string,intent:string,reasoning:string>>"
RESULTS_TYPE = "array<struct<consumable_id:bigint,consumable_name:string,original_intent:string,queries:array<string>>>"


def _cell(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(c, "True").when(~c, "False").otherwise("")
    return F.coalesce(c.cast("string"), F.lit(""))


def markdown_tables(df: DataFrame, batch: str, order: str, columns: Sequence[str]) -> DataFrame:
    """one aligned pipe table per batch, ``(batch, n_records, table)``.

    Numbers are right-aligned, the rest left-aligned; a column is as wide as its
    longest cell, and at least two wider than its header.  Batches are small by
    construction (W3), so a table fits one row.
    """
    present = [c for c in columns if c in df.columns]
    number = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in present}
    cells = df.select(batch, F.col(order).alias("_order"), *[_cell(df, c).alias(f"_c{i}") for i, c in enumerate(present)])
    widths = cells.groupBy(batch).agg(*[
        F.greatest(F.max(F.length(f"_c{i}")), F.lit(len(c) + 2)).alias(f"_w{i}") for i, c in enumerate(present)])

    def pad(value: Column, i: int, c: str) -> Column:
        fill = F.repeat(F.lit(" "), F.col(f"_w{i}") - F.length(value))
        return F.concat(fill, value) if number[c] else F.concat(value, fill)

    def line(values: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))

    head = line([pad(F.lit(c), i, c) for i, c in enumerate(present)])
    rule = F.concat(F.lit("|"), F.concat_ws("|", *[
        F.concat(F.repeat(F.lit("-"), F.col(f"_w{i}") + 1), F.lit(":")) if number[c]
        else F.concat(F.lit(":"), F.repeat(F.lit("-"), F.col(f"_w{i}") + 1)) for i, c in enumerate(present)]), F.lit("|"))
    rows = cells.join(widths, batch).withColumn("_line", line([pad(F.col(f"_c{i}"), i, c) for i, c in enumerate(present)]))
    tables = rows.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_records"), F.first(F.concat(head, F.lit("\n"), rule)).alias("_head"),
        F.sort_array(F.collect_list(F.struct("_order", "_line"))).alias("_rows"))
    body = F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n")
    return tables.select(batch, "n_records", F.concat("_head", F.lit("\n"), body).alias("table"))


def build_prompts(df: DataFrame, batch: str, order: str, template: str, esci_label: str, queries_per_item: int = 5,
                  examples: str | None = None, diet_columns: Sequence[str] = ()) -> DataFrame:
    """L1: one prompt per batch with its length; missing examples leave their place empty."""
    tables = markdown_tables(df, batch, order, ["id", "consumable_name", "consumable_ingredients", *diet_columns])
    prompt = render_template(template, {
        LABEL_MARK: esci_label, TABLE_MARK: F.col("table"), COUNT_MARK: str(queries_per_item), EXAMPLES_MARK: examples or ""})
    return tables.select(batch, "n_records", prompt.alias("prompt")).withColumn("prompt_length", F.length("prompt"))


def apply_batches(prompts: DataFrame, fn: Callable[[str], str], batch: str = "batch", max_retries: int = 3,
                  parallelism: int | None = None, backoff: Sequence[float] = (0.0,)) -> DataFrame:
    """L2: call ``fn(prompt) -> output text`` once per batch with retries.

    A batch that keeps failing gives a row with status ``failed`` and the last
    error; the others are not affected.  ``parallelism`` limits the rate: at most
    so many tasks call the function at a time; by default there is no limit, and
    prompts are spread as Spark's shuffle settings say.  Write the result before
    using it twice.
    """
    if parallelism is not None and parallelism < 1:
        raise ValueError("parallelism must be at least 1")
    if max_retries < 1:
        raise ValueError("max_retries must be at least 1")
    waits = tuple(backoff) or (0.0,)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, prompt in zip(pdf["batch"], pdf["prompt"]):
                started, output, error, attempt = time.perf_counter(), None, None, 0
                for attempt in range(1, max_retries + 1):
                    try:
                        output, error = fn(prompt), None
                        break
                    except Exception as exc:  # the caller's function may raise anything
                        error = str(exc) or type(exc).__name__
                        if attempt < max_retries:
                            time.sleep(waits[min(attempt - 1, len(waits) - 1)])
                out.append((key, "failed" if error is not None else "success", error, attempt,
                            time.perf_counter() - started, len(prompt), output))
            yield pd.DataFrame(out, columns=["batch", "status", "error", "attempts", "seconds", "prompt_length", "output"])

    spread = prompts.select(F.col(batch).cast("long").alias("batch"), "prompt")
    spread = spread.repartition("batch") if parallelism is None else spread.repartition(parallelism, "batch")
    return spread.mapInPandas(
        run, "batch long, status string, error string, attempts int, seconds double, prompt_length int, output string")


def parse_candidates(batches: DataFrame, output: str = "output") -> DataFrame:
    """Successful outputs as nested candidates ``(batch, candidates)``."""
    parsed = F.from_json(output, f"struct<candidates:{CANDIDATES_TYPE}>")
    return batches.filter(F.col("status") == "success").select("batch", parsed["candidates"].alias("candidates"))


def flatten_candidates(df: DataFrame, candidates: str = "candidates", keep: Sequence[str] = ()) -> DataFrame:
    """L3: one query per row; empty candidates or queries give no rows."""
    flat = df.select(*keep, F.explode(candidates).alias("c")).select(*keep, "c.id", "c.name", F.explode("c.queries").alias("q"))
    dims = F.when(F.coalesce(F.size("q.dimensions"), F.lit(0)) > 0, F.to_json("q.dimensions")).otherwise("{}")
    return flat.select(
        *keep, F.col("id").alias("consumable_id"), F.col("name").alias("consumable_name"), "q.query",
        dims.alias("dimensions_json"), F.coalesce("q.reasoning", F.lit("")).alias("reasoning"), "q.dimensions")


def dimension_rows(flat: DataFrame, keep: Sequence[str] = ("consumable_id", "query"), dimensions: str = "dimensions") -> DataFrame:
    """L4 in long form: one row ``(*keep, dimension, value)`` per dimension of a query, for any number of names."""
    return flat.select(*keep, F.explode(dimensions).alias("dimension", "value"))


def dimension_names(flat: DataFrame, dimensions: str = "dimensions") -> list[str]:
    """Sorted distinct dimension names, which are to become column names and so are listed on the driver."""
    return sorted(r["k"] for r in flat.select(F.explode(F.map_keys(dimensions)).alias("k")).distinct().collect())


def flatten_with_dimensions(df: DataFrame, candidates: str = "candidates", names: Sequence[str] | None = None) -> DataFrame:
    """L4: flattened rows with one ``dim_<name>`` column per dimension, names sorted.

    Give the ``names`` wanted, or use ``dimension_rows``, where names are many.
    """
    flat = flatten_candidates(df, candidates)
    names = dimension_names(flat) if names is None else sorted(names)
    return flat.select(
        "consumable_id", "consumable_name", "query", "dimensions_json",
        *[F.try_element_at("dimensions", F.lit(n)).alias(f"dim_{n}") for n in names])


def final_rows(flat: DataFrame, labels: DataFrame | None, esci_label: str, generated_at: str) -> DataFrame:
    """The output columns with filters, label and time; an empty input keeps the columns.

    ``labels(consumable_id, labels)`` are the rule-based diets; without them the
    filters are the generated dimensions alone.
    """
    if labels is None:
        filled = flat.withColumn("query_filters", F.col("dimensions_json"))
    else:
        filled = flat.join(labels.select("consumable_id", "labels"), "consumable_id", "left").withColumn(
            "query_filters", query_filters("dimensions_json", "labels"))
    return filled.withColumns({"esci_label": F.lit(esci_label), "generated_at": F.lit(generated_at)}).select(*OUTPUT_COLUMNS)


def numbered_list(items: str | Column) -> Column:
    """Lines ``1. item`` of an array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def matching_inputs(foods: DataFrame, intents: DataFrame, batch: str, order: str, diet_columns: Sequence[str] = ()) -> DataFrame:
    """Per batch, the numbered intents of its set and the table of its foods; ``intents(batch, intents)``."""
    columns = [c for c in foods.columns if c not in (batch, order)] if diet_columns else ["consumable_id", "consumable_name"]
    if diet_columns:
        columns = list(dict.fromkeys(["consumable_id", *columns]))
    tables = markdown_tables(foods, batch, order, columns)
    return tables.join(intents.select(batch, numbered_list("intents").alias("intents_list")), batch, "left").select(
        batch, "intents_list", F.col("table").alias("food_dataframe"))


def pair_blocks(matches: DataFrame, foods: DataFrame, batch: str, order: str, diet_columns: Sequence[str] = (),
                food_order: str = "row_id") -> DataFrame:
    """Per batch, the numbered intent-food pairs, with the names of the diets that hold."""
    rows = attach_first(matches, foods, "consumable_id", list(diet_columns), food_order) if diet_columns else matches
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(diet_name(c, "prompt"))) for c in diet_columns]))
    extra = F.when(F.size(names) > 0, F.concat(F.lit(" ["), F.array_join(names, ", "), F.lit("]"))).otherwise("")
    food = F.concat("consumable_name", F.lit(" (ID: "), F.col("consumable_id").cast("string"), F.lit(")"), extra)
    grouped = rows.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col("intent").alias("intent"), food.alias("food")))).alias("p"))
    block = F.transform("p", lambda x, i: F.concat(
        F.lit("\n"), (i + 1).cast("string"), F.lit('. Intent: "'), x["intent"], F.lit('"\n   Food: '), x["food"], F.lit("\n")))
    return grouped.select(batch, F.array_join(block, "").alias("intent_food_pairs"))


def flatten_results(results: DataFrame, generated_at: str, foods: DataFrame | None = None,
                    diet_columns: Sequence[str] = (), food_order: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """One ``intent`` row and the ``bridged`` rows of each result (columns as in RESULTS_TYPE)."""
    entry = "struct<query_type:string,query:string>"
    own = F.array(F.struct(F.lit("intent").alias("query_type"), F.col("original_intent").alias("query")).cast(entry))
    bridged = F.transform(F.coalesce("queries", F.lit([]).cast("array<string>")),
                          lambda q: F.struct(F.lit("bridged").alias("query_type"), q.alias("query")).cast(entry))
    flat = results.select(
        *keep, "consumable_id", "consumable_name", "original_intent", F.explode(F.concat(own, bridged)).alias("q"),
    ).select(*keep, "consumable_id", "consumable_name", "original_intent", F.lit(generated_at).alias("generated_at"),
             "q.query", "q.query_type")
    if foods is not None and diet_columns:
        flat = attach_first(flat, foods, "consumable_id", diet_columns, food_order)
    return flat


def intent_rows(matches: DataFrame, generated_at: str, foods: DataFrame | None = None,
                diet_columns: Sequence[str] = (), food_order: str = "row_id") -> DataFrame:
    """Rows for a run that stops at the intents."""
    rows = matches.select(
        "consumable_id", "consumable_name", F.col("intent").alias("query"), F.lit("intent").alias("query_type"),
        F.col("intent").alias("original_intent"), "reasoning", F.lit(generated_at).alias("generated_at"))
    if foods is not None and diet_columns:
        rows = attach_first(rows, foods, "consumable_id", diet_columns, food_order)
    return rows


def intent_sets(intents: DataFrame, id_col: str, n_sets: int = 10, seed: int = 42) -> DataFrame:
    """Shuffle ``intents(id, theme, intent)`` and cut them into equal sets, the last taking the remainder.

    One row per intent with ``set_number`` (from 1) and ``pos`` in the shuffle.
    """
    placed = with_hash_position(intents, shuffle_key(seed, id_col), name="pos")
    per_set = intents.agg(F.floor(F.count(F.lit(1)) / n_sets)).scalar()
    index = F.when(F.col("_per") > 0, F.least(F.floor(F.col("pos") / F.nullif(F.col("_per"), F.lit(0))), F.lit(n_sets - 1))).otherwise(n_sets - 1)
    return placed.withColumn("_per", per_set).withColumn("set_number", (index + 1).cast("int")).drop("_per")


def intent_set_metadata(members: DataFrame, creation_date: str, seed: int = 42) -> DataFrame:
    """One metadata row per set with its theme distribution and size."""
    sizes = members.groupBy("set_number").agg(F.count(F.lit(1)).alias("total_intents"))
    return sizes.join(theme_distribution(members), "set_number").select(
        "set_number", F.lit(creation_date).alias("creation_date"), F.lit(seed).alias("seed"), "theme_distribution", "total_intents")


def rotation_index(batch: str | Column, frequency: int, n_sets: int) -> Column:
    """The set (from 0) that a batch uses."""
    b = F.col(batch) if isinstance(batch, str) else batch
    return F.floor(b / F.lit(frequency)).cast("long") % n_sets


def match_violations(matches: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Foods matched more than once and intents used more than once (within ``scope``)."""
    scope = list(scope)

    def repeated(column: str, rule: str) -> DataFrame:
        return matches.groupBy(*scope, column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            *scope, F.lit(rule).alias("rule"), F.col(column).cast("string").alias("value"), "n")

    return repeated("consumable_id", "food matched twice").unionByName(repeated("intent", "intent used twice"))
