"""Batched generation: prompts, flattening, intent sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from relish.functions.dietary import DIET_COLUMNS, diet_labels
from relish.operators import aggregates, generation, ordering
from relish.plans.basic_queries import DIETS, diets
from relish.plans.registry import Tables, query
from relish.session import stage

TIME = "2025-01-01T00:00:00"
BATCH = 40


def foods(t: Tables):
    """Parts as foods in batches of forty by key, with the size flag as a diet column."""
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("consumable_name"), F.col("p_brand").alias("consumable_ingredients"),
        (F.col("p_size") > 25).alias("is_vegan"), F.floor(F.col("p_partkey") / BATCH).cast("long").alias("batch"))


# widths per batch, then the lines of each batch in key order
TABLES = f"""f AS (SELECT p_partkey AS id, p_name AS n, p_brand AS i, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS v, p_partkey // {BATCH} AS batch FROM part),
w AS (SELECT batch, greatest(max(length(id::VARCHAR)), 4) AS wi, greatest(max(length(n)), 17) AS wn, greatest(max(length(i)), 24) AS wg, greatest(max(length(v)), 10) AS wv FROM f GROUP BY 1),
tab AS (SELECT f.batch, count(*) AS n_records,
  '| ' || lpad('id', any_value(wi)::INT, ' ') || ' | ' || rpad('consumable_name', any_value(wn)::INT, ' ') || ' | ' || rpad('consumable_ingredients', any_value(wg)::INT, ' ') || ' | ' || rpad('is_vegan', any_value(wv)::INT, ' ') || ' |' || chr(10) ||
  '|' || repeat('-', any_value(wi)::INT + 1) || ':|:' || repeat('-', any_value(wn)::INT + 1) || '|:' || repeat('-', any_value(wg)::INT + 1) || '|:' || repeat('-', any_value(wv)::INT + 1) || '|' || chr(10) ||
  string_agg('| ' || lpad(id::VARCHAR, wi::INT, ' ') || ' | ' || rpad(n, wn::INT, ' ') || ' | ' || rpad(i, wg::INT, ' ') || ' | ' || rpad(v, wv::INT, ' ') || ' |', chr(10) ORDER BY id) AS md
  FROM f JOIN w ON w.batch = f.batch GROUP BY 1)"""


@query("F9_markdown_tables", f"""WITH {TABLES} SELECT batch, n_records, md AS "table" FROM tab""")
def f9(t: Tables):
    return generation.markdown_tables(foods(t), "batch", "id", ["id", "consumable_name", "consumable_ingredients", "is_vegan", "absent"])


@query("L1_build_prompts", f"""WITH {TABLES}, p AS (SELECT batch, n_records, 'Make 3 E queries' || chr(10) || md || chr(10) || 'Examples: ' AS prompt FROM tab)
SELECT batch, n_records, prompt, length(prompt) AS prompt_length FROM p""")
def l1(t: Tables):
    template = "Make [QUERIES_PER_ITEM] [E/S/C/I] queries\n[FOOD CANDIDATES]\nExamples: [QUERY_EXAMPLES]"
    return generation.build_prompts(foods(t), "batch", "id", template, "E", 3, None, ["is_vegan"])


def call_model(prompt: str) -> str:
    """Stands for a remote model: fails for some prompts, else answers with a candidate per table line."""
    import json
    import re

    rows = re.findall(r"^\|\s*(\d+) \| (.*?)\s+\|", prompt, flags=re.M)
    if any(int(i) % 400 == 0 for i, _ in rows):
        raise RuntimeError("no answer")
    return json.dumps({"candidates": [
        {"id": int(i), "name": n, "queries": [{"query": f"cheap {n}", "dimensions": {"price": "cheap"}, "reasoning": "asked"}]}
        for i, n in rows]})


def model_batches(t: Tables):
    prompts = generation.build_prompts(foods(t), "batch", "id", "[FOOD CANDIDATES]", "E")
    return stage(generation.apply_batches(prompts, call_model, max_retries=2))


@query("L2_apply_batches", f"""WITH b AS (SELECT p_partkey // {BATCH} AS batch, bool_or(p_partkey % 400 = 0) AS failed FROM part GROUP BY 1)
SELECT batch, CASE WHEN failed THEN 'failed' ELSE 'success' END AS status, CASE WHEN failed THEN 'no answer' END AS error, CASE WHEN failed THEN 2 ELSE 1 END AS attempts FROM b""")
def l2(t: Tables):
    return model_batches(t).select("batch", "status", "error", "attempts")


ANSWERED = f"(SELECT * FROM part WHERE p_partkey // {BATCH} NOT IN (SELECT p_partkey // {BATCH} FROM part WHERE p_partkey % 400 = 0))"


@query("L2_parsed_answers", f"""SELECT p_partkey AS consumable_id, p_name AS consumable_name, 'cheap ' || p_name AS query, '{{"price":"cheap"}}' AS dimensions_json FROM {ANSWERED}""")
def l2_parsed(t: Tables):
    flat = generation.flatten_candidates(generation.parse_candidates(model_batches(t)))
    return flat.select("consumable_id", "consumable_name", "query", "dimensions_json")


@query("A14_generation_metrics", f"""WITH b AS (SELECT p_partkey // {BATCH} AS batch, bool_or(p_partkey % 400 = 0) AS failed FROM part GROUP BY 1)
SELECT (SELECT count(*) FROM {ANSWERED}) AS total_candidates, (SELECT count(*) FROM {ANSWERED}) AS total_examples, (SELECT count(DISTINCT p_name) FROM {ANSWERED}) AS total_queries,
count(*) FILTER (NOT failed) AS successful_batches, count(*) FILTER (failed) AS failed_batches, round(count(*) FILTER (NOT failed) * 100.0::DOUBLE / count(*), 6) AS success_rate_percent,
sum(batch)::DOUBLE AS total_seconds, round(avg(batch), 6) AS avg_batch_time, min(batch)::DOUBLE AS min_batch_time, max(batch)::DOUBLE AS max_batch_time FROM b""")
def a14(t: Tables):
    batches = model_batches(t)
    parsed = generation.parse_candidates(batches)
    sizes = parsed.select("batch", F.size("candidates").alias("n_candidates"))
    # the batch number stands for the measured time, so that the result can be checked
    timed = batches.join(sizes, "batch", "left").withColumn("seconds", F.col("batch").cast("double"))
    return aggregates.generation_metrics(timed, generation.flatten_candidates(parsed)).withColumns(
        {c: F.round(c, 6) for c in ("success_rate_percent", "avg_batch_time")})


def nested(t: Tables):
    """Generated output per batch: no queries for small parts, no dimensions for economy parts."""
    q = F.struct(
        F.concat("p_name", F.lit(" "), "p_brand").alias("query"),
        F.when(F.col("p_type") == "ECONOMY", F.create_map().cast("map<string,string>"))
        .when(F.col("p_type") == "LARGE", F.create_map(F.lit("price"), F.col("p_size").cast("string"), F.lit("cuisine"), F.col("p_brand")))
        .otherwise(F.create_map(F.lit("location"), F.col("p_type"))).alias("dimensions"), F.col("p_type").alias("reasoning"))
    both = F.array(q, F.struct(F.upper("p_name").alias("query"), F.create_map().cast("map<string,string>").alias("dimensions"), F.lit(None).cast("string").alias("reasoning")))
    queries = F.when(F.col("p_type") == "SMALL", F.filter(both, lambda _: F.lit(False))).otherwise(both)
    return t.part.groupBy(F.floor(F.col("p_partkey") / BATCH).cast("long").alias("batch")).agg(
        F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), queries.alias("queries"))).alias("candidates"))


FLAT = """flat AS (SELECT p_partkey AS consumable_id, p_name AS consumable_name, p_name || ' ' || p_brand AS query,
  CASE p_type WHEN 'ECONOMY' THEN '{}' WHEN 'LARGE' THEN '{"price":"' || p_size || '","cuisine":"' || p_brand || '"}' ELSE '{"location":"' || p_type || '"}' END AS dimensions_json,
  p_type AS reasoning, CASE WHEN p_type = 'LARGE' THEN p_brand END AS dim_cuisine, CASE WHEN p_type NOT IN ('LARGE', 'ECONOMY') THEN p_type END AS dim_location,
  CASE WHEN p_type = 'LARGE' THEN p_size::VARCHAR END AS dim_price FROM part WHERE p_type <> 'SMALL'
UNION ALL SELECT p_partkey, p_name, upper(p_name), '{}', '', NULL, NULL, NULL FROM part WHERE p_type <> 'SMALL')"""


@query("L3_flatten_candidates", f"WITH {FLAT} SELECT consumable_id, consumable_name, query, dimensions_json, reasoning FROM flat")
def l3(t: Tables):
    return generation.flatten_candidates(nested(t)).drop("dimensions")


@query("L4_flatten_with_dimensions", f"WITH {FLAT} SELECT consumable_id, consumable_name, query, dimensions_json, dim_cuisine, dim_location, dim_price FROM flat")
def l4(t: Tables):
    return generation.flatten_with_dimensions(nested(t))


@query("L4_dimension_rows", f"""WITH {FLAT} SELECT * FROM (SELECT consumable_id, query, unnest(['cuisine', 'location', 'price']) AS dimension, unnest([dim_cuisine, dim_location, dim_price]) AS value FROM flat) WHERE value IS NOT NULL""")
def l4_rows(t: Tables):
    return generation.dimension_rows(generation.flatten_candidates(nested(t)))


@query("A16_dimension_fill", f"""WITH {FLAT} SELECT 'cuisine' AS dimension, count(dim_cuisine) AS n, round(count(dim_cuisine) * 100.0::DOUBLE / count(*), 6) AS pct FROM flat
UNION ALL SELECT 'location', count(dim_location), round(count(dim_location) * 100.0::DOUBLE / count(*), 6) FROM flat
UNION ALL SELECT 'price', count(dim_price), round(count(dim_price) * 100.0::DOUBLE / count(*), 6) FROM flat""")
def a16(t: Tables):
    return aggregates.dimension_fill(generation.flatten_candidates(nested(t))).withColumn("pct", F.round("pct", 6))


@query("A16_queries_per_candidate", f"WITH {FLAT} SELECT count(*) AS total_queries, count(DISTINCT consumable_id) AS candidates, round(count(*) / count(DISTINCT consumable_id)::DOUBLE, 6) AS queries_per_candidate FROM flat")
def a16_ratio(t: Tables):
    return aggregates.queries_per_candidate(generation.flatten_candidates(nested(t))).withColumn(
        "queries_per_candidate", F.round("queries_per_candidate", 6))


@query("L5_final_rows", f"""WITH {FLAT}, {DIETS}, lab AS (SELECT p_partkey, list_filter([CASE WHEN is_vegetarian THEN 'Vegetarian' END, CASE WHEN is_vegan THEN 'Vegan' END, CASE WHEN is_gluten_free THEN 'Gluten-Free' END,
 CASE WHEN is_dairy_free THEN 'Dairy-Free' END, CASE WHEN is_nut_free THEN 'Nut-Free' END, CASE WHEN is_lacto_vegetarian THEN 'Lacto Vegetarian' END,
 CASE WHEN is_pescetarian THEN 'Pescetarian' END, CASE WHEN is_lacto_ovo_vegetarian THEN 'Lacto Ovo Vegetarian' END], lambda x: x IS NOT NULL) AS l FROM c)
SELECT consumable_id, consumable_name, query, '{{"dimensions":' || dimensions_json || ',"rule_based_dietary_restrictions":[' || CASE WHEN len(l) > 0 THEN '"' || array_to_string(l, '","') || '"' ELSE '' END || ']}}' AS query_filters,
 reasoning, 'E' AS esci_label, '{TIME}' AS generated_at FROM flat JOIN lab ON p_partkey = consumable_id""")
def l5(t: Tables):
    labels = diets(t).select(F.col("p_partkey").alias("consumable_id"), diet_labels(DIET_COLUMNS).alias("labels"))
    return generation.final_rows(generation.flatten_candidates(nested(t)), labels, "E", TIME)


# ------------------------------------------------------------------ intents from conversations

def user_turns(t: Tables):
    """User turns in batches of 25."""
    said = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("intent"))
    return ordering.batch_numbers(said, ["conv_id", "turn"], 25)


def matches(t: Tables):
    """User turns as intents matched to parts by conversation number."""
    said = user_turns(t)
    return said.select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("row_id"), (F.col("conv_id") % 50).alias("consumable_id"),
        F.concat(F.lit("food "), (F.col("conv_id") % 50).cast("string")).alias("consumable_name"), "intent",
        F.col("turn").cast("string").alias("reasoning"), "batch")


MATCHES = """m AS (SELECT conv_id * 10 + turn AS row_id, conv_id % 50 AS consumable_id, 'food ' || (conv_id % 50) AS consumable_name, text AS intent,
  turn::VARCHAR AS reasoning, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 25 AS batch FROM conversations WHERE role = 'user')"""


@query("L6_matching_inputs", f"""WITH conv AS (SELECT r // 25 AS batch, string_agg((r % 25 + 1) || '. ' || intent, chr(10) ORDER BY r) AS intents_list FROM (
  SELECT conv_id, text AS intent, row_number() OVER (ORDER BY conv_id, turn) - 1 AS r FROM conversations WHERE role = 'user') GROUP BY 1),
f AS (SELECT p_partkey AS id, p_name AS n, p_partkey // {BATCH} AS batch FROM part),
w AS (SELECT batch, greatest(max(length(id::VARCHAR)), 15) AS wi, greatest(max(length(n)), 17) AS wn FROM f GROUP BY 1)
SELECT f.batch, any_value(conv.intents_list) AS intents_list, '| ' || lpad('consumable_id', any_value(wi)::INT, ' ') || ' | ' || rpad('consumable_name', any_value(wn)::INT, ' ') || ' |' || chr(10) ||
  '|' || repeat('-', any_value(wi)::INT + 1) || ':|:' || repeat('-', any_value(wn)::INT + 1) || '|' || chr(10) ||
  string_agg('| ' || lpad(id::VARCHAR, wi::INT, ' ') || ' | ' || rpad(n, wn::INT, ' ') || ' |', chr(10) ORDER BY id) AS food_dataframe
FROM f JOIN w ON w.batch = f.batch LEFT JOIN conv ON conv.batch = f.batch GROUP BY 1""")
def l6(t: Tables):
    said = user_turns(t).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "intent"))).alias("s"))
    intents = said.select("batch", F.transform("s", lambda x: x["intent"]).alias("intents"))
    items = t.part.select(F.col("p_partkey").alias("consumable_id"), F.col("p_name").alias("consumable_name"),
                          F.floor(F.col("p_partkey") / BATCH).cast("long").alias("batch"), F.col("p_partkey").alias("row_id"))
    return generation.matching_inputs(items, intents, "batch", "row_id")


@query("L7_pair_blocks", f"""WITH {MATCHES}, x AS (SELECT m.*, row_number() OVER (PARTITION BY batch ORDER BY row_id) AS r,
  CASE WHEN p_size > 25 AND p_type = 'SMALL' THEN ' [Is Vegan, Is Nut Free]' WHEN p_size > 25 THEN ' [Is Vegan]' WHEN p_type = 'SMALL' THEN ' [Is Nut Free]' ELSE '' END AS extra
  FROM m LEFT JOIN part ON p_partkey = consumable_id)
SELECT batch, string_agg(chr(10) || r || '. Intent: "' || intent || '"' || chr(10) || '   Food: ' || consumable_name || ' (ID: ' || consumable_id || ')' || extra || chr(10), '' ORDER BY r) AS intent_food_pairs FROM x GROUP BY 1""")
def l7(t: Tables):
    items = t.part.select(F.col("p_partkey").alias("consumable_id"), (F.col("p_size") > 25).alias("is_vegan"),
                          (F.col("p_type") == "SMALL").alias("is_nut_free"), F.col("p_partkey").alias("food_row"))
    return generation.pair_blocks(matches(t), items, "batch", "row_id", ["is_vegan", "is_nut_free"], "food_row")


@query("L8_flatten_results", f"""WITH u AS (SELECT conv_id, turn, text AS intent FROM conversations WHERE role = 'user'),
a AS (SELECT u.conv_id, u.turn, u.intent, c.text AS answer FROM u LEFT JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 1 AND c.role = 'assistant'),
q AS (SELECT conv_id, turn, intent, intent AS query, 'intent' AS query_type FROM a
  UNION ALL SELECT conv_id, turn, intent, unnest(list_filter(string_split(answer, chr(10)), lambda x: x <> '')), 'bridged' FROM a)
SELECT conv_id AS consumable_id, 'food ' || conv_id AS consumable_name, intent AS original_intent, '{TIME}' AS generated_at, query, query_type, CASE WHEN p_size IS NOT NULL THEN p_size > 25 END AS is_vegan
FROM q LEFT JOIN part ON p_partkey = conv_id""")
def l8(t: Tables):
    # the lines of the answer that follows a user turn are its bridged queries
    said = t.conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("original_intent"))
    answers = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.filter(F.split("text", "\n"), lambda x: x != "").alias("queries"))
    results = said.join(answers, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("consumable_id"), F.concat(F.lit("food "), F.col("conv_id").cast("string")).alias("consumable_name"), "original_intent", "queries")
    items = t.part.select(F.col("p_partkey").alias("consumable_id"), (F.col("p_size") > 25).alias("is_vegan"), F.col("p_partkey").alias("food_row"))
    return generation.flatten_results(results, TIME, items, ["is_vegan"], "food_row")


@query("L9_intent_rows", f"""WITH {MATCHES} SELECT consumable_id, consumable_name, intent AS query, 'intent' AS query_type, intent AS original_intent, reasoning, '{TIME}' AS generated_at, p_size > 25 AS is_vegan
FROM m LEFT JOIN part ON p_partkey = consumable_id""")
def l9(t: Tables):
    items = t.part.select(F.col("p_partkey").alias("consumable_id"), (F.col("p_size") > 25).alias("is_vegan"), F.col("p_partkey").alias("food_row"))
    return generation.intent_rows(matches(t), TIME, items, ["is_vegan"], "food_row")


SETS = """placed AS (SELECT doc_id, lang AS theme, source || ' ' || doc_id AS intent, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS pos, count(*) OVER () // 7 AS per FROM documents),
sets AS (SELECT doc_id, theme, intent, pos, (least(pos // per, 6) + 1)::INT AS set_number FROM placed)"""


def members(t: Tables):
    themed = t.documents.select("doc_id", F.col("lang").alias("theme"), F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("intent"))
    return generation.intent_sets(themed, "doc_id", 7)


@query("L10_intent_sets", f"WITH {SETS} SELECT * FROM sets")
def l10(t: Tables):
    return members(t)


@query("A12_theme_distribution", f"WITH {SETS} SELECT set_number, theme, count(*) AS n FROM sets GROUP BY 1, 2")
def a12(t: Tables):
    return aggregates.theme_distribution(members(t)).select("set_number", F.explode("theme_distribution").alias("theme", "n"))


@query("L10_set_metadata", f"WITH {SETS} SELECT set_number, '2025-01-01' AS creation_date, 42 AS seed, count(DISTINCT theme) AS n_themes, count(*) AS total_intents FROM sets GROUP BY 1")
def l10_metadata(t: Tables):
    m = generation.intent_set_metadata(members(t), "2025-01-01")
    return m.select("set_number", "creation_date", "seed", F.size("theme_distribution").cast("long").alias("n_themes"), "total_intents")


@query("L11_rotation", f"WITH b AS (SELECT DISTINCT p_partkey // {BATCH} AS batch FROM part) SELECT batch, (batch // 3) % 7 AS set_idx FROM b")
def l11(t: Tables):
    return foods(t).select("batch").distinct().select("batch", generation.rotation_index("batch", 3, 7).alias("set_idx"))


@query("A13_intent_set_usage", f"WITH b AS (SELECT DISTINCT p_partkey // {BATCH} AS batch FROM part) SELECT 'set_' || ((batch // 3) % 7 + 1) AS set_key, count(*) AS n_batches FROM b GROUP BY 1")
def a13(t: Tables):
    used = foods(t).select("batch", generation.rotation_index("batch", 3, 7).alias("set_idx"))
    return aggregates.intent_set_usage(used)


@query("L12_match_violations", f"""WITH {MATCHES} SELECT batch, 'food matched twice' AS rule, consumable_id::VARCHAR AS value, count(*) AS n FROM m GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT batch, 'intent used twice', intent, count(*) FROM m GROUP BY 1, 3 HAVING count(*) > 1""")
def l12(t: Tables):
    return generation.match_violations(matches(t), ["batch"])
