"""Filters, text functions, aggregates, sorts, samples and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relish.functions import dietary, text
from relish.operators import aggregates, filters, joins, ordering, setops, sketches, windows
from relish.plans.registry import Tables, query
from relish.session import stage

# Keywords found in the part names of the test tables.
PART_KEYWORDS = {
    "seafood": ["gear", "bolt"], "other_meat": ["widget"], "egg": ["ring"], "milk": ["old", "small"],
    "honey": ["hot"], "gluten": ["red"], "nuts": ["izmo", "nut"],
}
STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


# ---------------------------------------------------------------- filters

def documents_with_blanks(t: Tables):
    """Documents of which some have a blank text and some none."""
    i = F.col("doc_id")
    return t.documents.withColumn("text", F.when(i % 17 == 3, F.lit(" \n ")).when(i % 41 != 5, F.col("text")))


BLANKED = """b AS (SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 17 = 3 THEN ' ' || chr(10) || ' ' WHEN doc_id % 41 <> 5 THEN text END AS text FROM documents)"""


@query("P1_remove_null_rows", f"""WITH {BLANKED}
SELECT doc_id, lang FROM b WHERE text IS NOT NULL AND trim(text, {STRIP}) <> '' AND trim(lang) <> ''""")
def p1(t: Tables):
    return filters.remove_null_rows(documents_with_blanks(t), ["text", "lang", "no_such_column"]).select("doc_id", "lang")


@query("P2_select_renamed", "SELECT p_partkey AS id, p_name AS consumable_name, p_type AS consumable_type FROM part")
def p2(t: Tables):
    return filters.select_renamed(t.part, {
        "p_partkey": "id", "p_name": "consumable_name", "p_type": "consumable_type", "p_cooking": "consumable_cooking_method"})


@query("P3_drop_missing", f"WITH {BLANKED} SELECT doc_id FROM b WHERE text IS NOT NULL AND source IS NOT NULL")
def p3(t: Tables):
    return filters.drop_missing(documents_with_blanks(t), ["text", "source"]).select("doc_id")


@query("P4_clean_text_fields", """SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang, source FROM documents""")
def p4(t: Tables):
    raw = t.documents.select(
        "doc_id", F.when(F.col("lang") == "fr", F.lit(" nan ")).otherwise(F.concat(F.lit("\t"), "lang", F.lit(" \n"))).alias("lang"),
        F.concat(F.lit(" "), "source").alias("source"))
    return filters.clean_text_fields(raw, ["lang", "source", "missing"])


def query_types(t: Tables):
    return t.conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "intent").when(F.col("role") == "assistant", "bridged").alias("query_type"))


@query("P5_bridged_only", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant'")
def p5(t: Tables):
    return filters.bridged_only(query_types(t)).select("conv_id", "turn")


@query("P5_bridged_info", """SELECT count(*) AS original_count, count(*) FILTER (role = 'assistant') AS final_count, true AS has_query_type,
true AS bridged_requested, true AS filtering_applied, count(*) FILTER (role = 'assistant') > 0 AS can_mark_partial FROM conversations""")
def p5_info(t: Tables):
    return filters.bridged_info(query_types(t))


@query("P8a_find_by_ids", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (
SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 7)""")
def p8a(t: Tables):
    ids = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 7").select("l_orderkey")
    return filters.find_by_ids(t.orders, "o_orderkey", ids).select("o_orderkey", "o_orderstatus")


@query("P8b_find_by_pattern", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%d_w%dge%'")
def p8b(t: Tables):
    return filters.find_by_pattern(t.part, "p_name", "D_W%dge").select("p_partkey", "p_name")


@query("P8b_find_exact", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'red widget'")
def p8b_exact(t: Tables):
    return filters.find_by_pattern(t.part, "p_name", "RED Widget", exact=True).select("p_partkey", "p_name")


@query("P8c_find_by_patterns", """SELECT p_partkey, p_name FROM part
WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%ring%'""")
def p8c(t: Tables):
    return filters.find_by_patterns(t.part.select("p_partkey", "p_name"), "p_name", ["red", " Bolt ", "ring"])


@query("P9_contains_ignore_case", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'THE|QUE', 'i')")
def p9(t: Tables):
    return filters.contains_ignore_case(t.documents, "text", "THE|QUE").select("doc_id")


@query("P10_equals", "SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL'")
def p10(t: Tables):
    return filters.equals(t.part, "p_type", "SMALL").select("p_partkey", "p_name")


@query("P15_drop_empty_text", f"WITH {BLANKED} SELECT doc_id FROM b WHERE length(trim(text, {STRIP})) > 0")
def p15(t: Tables):
    return filters.drop_empty_text(documents_with_blanks(t), "text").select("doc_id")


@query("P16_any_modality", f"""WITH {BLANKED}
SELECT doc_id FROM b WHERE trim(coalesce(text, ''), {STRIP}) <> '' OR lang IN ('de', 'es')""")
def p16(t: Tables):
    rows = documents_with_blanks(t).withColumn("image", F.when(F.col("lang").isin("de", "es"), F.col("source")))
    return filters.any_modality(rows).select("doc_id")


# ---------------------------------------------------------------- text functions

INGREDIENTS = """ing AS (SELECT p_partkey, p_name, CASE p_type
  WHEN 'SMALL' THEN '["' || replace(p_name, ' ', '", " ') || '", ""]'
  WHEN 'LARGE' THEN '[''' || replace(p_name, ' ', ''', ''') || ''']'
  WHEN 'ECONOMY' THEN '["' || p_name
  WHEN 'PROMO' THEN NULL
  ELSE ' ' || p_name || ' ' END AS ingredients, CASE WHEN p_size < 5 THEN '  ' ELSE p_brand END AS dish FROM part)"""


def ingredients(t: Tables):
    """Ingredient cells in every form found in practice: JSON, quoted list, broken list, missing, plain."""
    name, kind = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey", "p_name",
        F.when(kind == "SMALL", F.concat(F.lit('["'), F.replace(name, F.lit(" "), F.lit('", " ')), F.lit('", ""]')))
        .when(kind == "LARGE", F.concat(F.lit("['"), F.replace(name, F.lit(" "), F.lit("', '")), F.lit("']")))
        .when(kind == "ECONOMY", F.concat(F.lit('["'), name))
        .when(kind == "PROMO", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), name, F.lit(" "))).alias("ingredients"),
        F.when(F.col("p_size") < 5, F.lit("  ")).otherwise(F.col("p_brand")).alias("dish"),
    )


@query("F1_combine_text", f"""WITH {INGREDIENTS}
SELECT i.p_partkey, lower((CASE WHEN trim(dish) = '' THEN 'unknown dish' ELSE trim(dish) END) || chr(10) || CASE
  WHEN p_type IN ('SMALL', 'LARGE') THEN replace(i.p_name, ' ', ', ')
  WHEN p_type = 'ECONOMY' THEN '["' || i.p_name WHEN p_type = 'PROMO' THEN 'none specified' ELSE i.p_name END) AS combined_text
FROM ing i JOIN part p ON p.p_partkey = i.p_partkey""")
def f1(t: Tables):
    return ingredients(t).select("p_partkey", text.combine_text("dish", ["ingredients"]).alias("combined_text"))


@query("F2_combine_for_embedding", f"""WITH {INGREDIENTS}
SELECT p_partkey, trim(dish || ' | Ingredients: ' || coalesce(ingredients, ''), {STRIP}) AS piped,
       trim(dish || ' ' || chr(10) || 'Ingredients:' || coalesce(ingredients, ''), {STRIP}) AS lined FROM ing""")
def f2(t: Tables):
    return ingredients(t).select(
        "p_partkey", text.combine_for_embedding("dish", "ingredients").alias("piped"),
        text.combine_for_embedding("dish", "ingredients", " \nIngredients:").alias("lined"))


@query("F3_valid_json", """SELECT event_id, CASE WHEN event_type <> 'error' THEN props END AS props FROM events""")
def f3(t: Tables):
    broken = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    return t.events.select("event_id", text.valid_json(broken).alias("props"))


DIETS = """flags AS (SELECT p_partkey, p_type, p_name, p_name LIKE '%gear%' OR p_name LIKE '%bolt%' AS sea, p_name LIKE '%widget%' AS other,
  p_name LIKE '%ring%' AS has_egg, p_name LIKE '%old%' OR p_name LIKE '%small%' AS has_milk, p_name LIKE '%hot%' AS has_honey,
  p_name LIKE '%red%' AS has_gluten, p_name LIKE '%izmo%' OR p_name LIKE '%nut%' AS has_nuts FROM part),
f AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN false ELSE sea OR other END AS is_non_veg,
  p_type <> 'PROMO' AND has_egg AS has_egg, p_type <> 'PROMO' AND has_milk AS has_milk, p_type <> 'PROMO' AND has_honey AS has_honey,
  p_type <> 'PROMO' AND has_gluten AS has_gluten, p_type <> 'PROMO' AND has_nuts AS has_nuts,
  p_type <> 'PROMO' AND sea AND NOT other AS has_seafood_only FROM flags),
c AS (SELECT *, NOT is_non_veg AS is_vegetarian, NOT (is_non_veg OR has_egg OR has_milk OR has_honey) AS is_vegan,
  NOT has_gluten AS is_gluten_free, NOT has_milk AS is_dairy_free, NOT has_nuts AS is_nut_free,
  has_milk AND NOT has_egg AND NOT is_non_veg AS is_lacto_vegetarian, has_seafood_only AS is_pescetarian,
  (has_milk OR has_egg) AND NOT is_non_veg AS is_lacto_ovo_vegetarian FROM f)"""
FLAG_COLUMNS = ["is_non_veg", "has_egg", "has_milk", "has_honey", "has_gluten", "has_nuts", "has_seafood_only"]


def diets(t: Tables):
    return dietary.evaluate_diets(ingredients(t), "ingredients", PART_KEYWORDS)


@query("F4_dietary_flags", f"WITH {DIETS} SELECT p_partkey, {', '.join(c for c in FLAG_COLUMNS if c != 'has_seafood_only')} FROM f")
def f4(t: Tables):
    return dietary.dietary_flags(ingredients(t), "ingredients", PART_KEYWORDS).select(
        "p_partkey", *[c for c in FLAG_COLUMNS if c != "has_seafood_only"])


@query("F5_seafood_only", f"WITH {DIETS} SELECT p_partkey, has_seafood_only FROM f")
def f5(t: Tables):
    return dietary.dietary_flags(ingredients(t), "ingredients", PART_KEYWORDS).select("p_partkey", "has_seafood_only")


@query("F6_dietary_combinations", f"WITH {DIETS} SELECT p_partkey, {', '.join(dietary.DIET_COLUMNS)} FROM c")
def f6(t: Tables):
    return diets(t).select("p_partkey", *dietary.DIET_COLUMNS)


@query("F7_label_styles", f"""WITH {DIETS} SELECT p_partkey,
concat_ws(', ', CASE WHEN is_vegetarian THEN 'Vegetarian' END, CASE WHEN is_vegan THEN 'Vegan' END, CASE WHEN is_gluten_free THEN 'Gluten-Free' END,
 CASE WHEN is_dairy_free THEN 'Dairy-Free' END, CASE WHEN is_nut_free THEN 'Nut-Free' END, CASE WHEN is_lacto_vegetarian THEN 'Lacto Vegetarian' END,
 CASE WHEN is_pescetarian THEN 'Pescetarian' END, CASE WHEN is_lacto_ovo_vegetarian THEN 'Lacto Ovo Vegetarian' END) AS filters,
concat_ws(', ', CASE WHEN is_vegetarian THEN 'Vegetarian' END, CASE WHEN is_vegan THEN 'Vegan' END, CASE WHEN is_gluten_free THEN 'Gluten-Free' END,
 CASE WHEN is_dairy_free THEN 'Dairy-Free' END, CASE WHEN is_nut_free THEN 'Nut-Free' END, CASE WHEN is_lacto_vegetarian THEN 'Lacto-Vegetarian' END,
 CASE WHEN is_pescetarian THEN 'Pescetarian' END, CASE WHEN is_lacto_ovo_vegetarian THEN 'Lacto-Ovo Vegetarian' END) AS mapping,
concat_ws(', ', CASE WHEN is_vegetarian THEN 'Is Vegetarian' END, CASE WHEN is_vegan THEN 'Is Vegan' END, CASE WHEN is_gluten_free THEN 'Is Gluten Free' END,
 CASE WHEN is_dairy_free THEN 'Is Dairy Free' END, CASE WHEN is_nut_free THEN 'Is Nut Free' END, CASE WHEN is_lacto_vegetarian THEN 'Is Lacto Vegetarian' END,
 CASE WHEN is_pescetarian THEN 'Is Pescetarian' END, CASE WHEN is_lacto_ovo_vegetarian THEN 'Is Lacto Ovo Vegetarian' END) AS prompt
FROM c""")
def f7(t: Tables):
    return diets(t).select("p_partkey", *[
        F.array_join(dietary.diet_labels(style=s), ", ").alias(s) for s in ("filters", "mapping", "prompt")])


@query("F8_query_filters", """SELECT event_id, '{"dimensions":' || CASE WHEN event_type = 'error' THEN '{}' ELSE '{"k":"' || (props->>'k') || '"}' END ||
',"rule_based_dietary_restrictions":' || CASE WHEN event_type = 'view' THEN '["Vegan"]' ELSE '[]' END || '}' AS query_filters FROM events""")
def f8(t: Tables):
    dims = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    labels = F.when(F.col("event_type") == "view", F.array(F.lit("Vegan")))
    return t.events.select("event_id", dietary.query_filters(dims, labels).alias("query_filters"))


@query("F10_render_template", """SELECT p_partkey, 'Label E: ' || p_name || ' x3 ' || p_brand AS prompt FROM part""")
def f10(t: Tables):
    return t.part.select("p_partkey", text.render_template(
        "Label [E/S/C/I]: [FOOD CANDIDATES] x[QUERIES_PER_ITEM] [QUERY_EXAMPLES]",
        {"[E/S/C/I]": "E", "[FOOD CANDIDATES]": F.col("p_name"), "[QUERIES_PER_ITEM]": "3", "[QUERY_EXAMPLES]": F.col("p_brand")},
    ).alias("prompt"))


@query("F11_label_description", """SELECT DISTINCT o_orderstatus AS label, CASE substr(o_orderpriority, 1, 1)
WHEN '1' THEN 'Exact match - items that directly and precisely match all constraints of the search query'
WHEN '2' THEN 'Substitute - items that can be a replacement for the queried item'
WHEN '3' THEN 'Complement - items that are related and typically paired together with the queried item'
WHEN '4' THEN 'Irrelevant - products that do not satisfy the query in any meaningful way'
ELSE 'Unknown ESCI label: ' || o_orderpriority END AS description FROM orders""")
def f11(t: Tables):
    digit = F.substring("o_orderpriority", 1, 1)
    label = F.when(digit == "1", "E").when(digit == "2", "S").when(digit == "3", "C").when(digit == "4", "I").otherwise(
        F.col("o_orderpriority"))
    return t.orders.select(F.col("o_orderstatus").alias("label"), text.label_description(label).alias("description")).distinct()


@query("F12_document_text", f"""SELECT doc_id, substr(trim(source || ' ' || trim(text, {STRIP}), {STRIP}), 1, 2000) AS doc,
substr(trim(text, {STRIP}), 1, 512) AS short FROM documents""")
def f12(t: Tables):
    return t.documents.select(
        "doc_id", text.document_text("source", "text").alias("doc"),
        text.document_text(F.lit(None).cast("string"), "text", 512).alias("short"))


@query("F13_embedded_json", """SELECT event_id, CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS json FROM events""")
def f13(t: Tables):
    free = F.when(F.col("event_type") == "error", F.concat(F.lit("no object { here "), "props")).otherwise(
        F.concat(F.lit("Sure:\n"), "props", F.lit("\nthat is all")))
    return t.events.select("event_id", text.embedded_json(free).alias("json"))


@query("F14_media_manifest", """WITH f AS (SELECT url, min(page_id) AS first_row FROM pages GROUP BY url),
n AS (SELECT url, row_number() OVER (ORDER BY first_row) - 1 AS pos,
  regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]+(\\.[^/.]+)/*$', 1) AS suffix FROM f)
SELECT url, 'image_' || lpad(pos::VARCHAR, 8, '0') || CASE WHEN suffix = '' THEN '.jpg' ELSE suffix END AS local_name FROM n""")
def f14(t: Tables):
    from relish.sources.media import media_manifest
    return media_manifest(t.pages, "url", "page_id")


@query("F15_end_index", """SELECT p_partkey, CASE WHEN p_type <> 'SMALL' THEN p_partkey + p_size - 1 END AS end_idx FROM part""")
def f15(t: Tables):
    limit = F.when(F.col("p_type") == "SMALL", F.lit("None")).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", text.end_index(F.col("p_partkey").cast("string"), limit).alias("end_idx"))


@query("F16_percent", """SELECT lang, round(count(*) FILTER (n_chars > 1000) * 100.0 / count(*), 2)::DOUBLE AS pct FROM documents GROUP BY 1""")
def f16(t: Tables):
    return t.documents.groupBy("lang").agg(
        text.percent(F.count_if(F.col("n_chars") > 1000), F.count(F.lit(1))).alias("pct"))


@query("F18_prefixed_to_map", """SELECT l_orderkey, l_linenumber, l_partkey, 'returnflag=' || l_returnflag || ';suppkey=' || l_suppkey AS params FROM lineitem""")
def f18(t: Tables):
    flat = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("params.returnflag"),
        F.col("l_suppkey").alias("params.suppkey"), F.lit(None).cast("string").alias("params.none"),
        F.col("l_tax").alias("metrics.tax"))
    m = text.prefixed_to_map(flat.columns, "params.")
    pairs = F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return flat.select("l_orderkey", "l_linenumber", "l_partkey", pairs.alias("params"))


@query("F21_timestamps", """SELECT event_type, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts, '2025-01-01T00:00:00' AS generated_at FROM events GROUP BY 1""")
def f21(t: Tables):
    # the creation time is an argument, so a rerun gives the same rows
    return t.events.groupBy("event_type").agg(
        F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"),
    ).withColumn("generated_at", F.date_format(F.to_timestamp(F.lit("2025-01-01 00:00:00")), "yyyy-MM-dd'T'HH:mm:ss"))


@query("E2_word_features", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(list_distinct(w)) AS n_words, len(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS n_trigrams FROM w""")
def e2(t: Tables):
    return t.documents.select(
        "doc_id", F.size(text.word_set("text")).cast("long").alias("n_words"),
        F.size(text.word_ngrams("text", 3)).cast("long").alias("n_trigrams"))


# ---------------------------------------------------------------- aggregates

@query("A1_value_counts", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS ratio FROM lineitem GROUP BY 1, 2""")
def a1(t: Tables):
    return aggregates.value_counts(t.lineitem, "l_returnflag", "l_linestatus", normalize=True).withColumn(
        "ratio", F.round("ratio", 6))


@query("A2_distinct_count", "SELECT count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem")
def a2(t: Tables):
    return aggregates.distinct_count(t.lineitem, "l_orderkey", "l_partkey")


@query("A3_frequency_of_frequencies", """SELECT n AS frequency, count(*) AS n_values FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1) GROUP BY 1""")
def a3(t: Tables):
    return aggregates.frequency_of_frequencies(t.documents, "text")


@query("A4_duplicate_rate", """SELECT count(*) AS total_records, count(DISTINCT text) AS unique_queries,
round((count(*) - count(DISTINCT text)) * 100.0::DOUBLE / count(*), 6) AS duplicate_rate FROM documents""")
def a4(t: Tables):
    return aggregates.duplicate_rate(t.documents, "text").withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query("A5_run_audit", """SELECT source, count(*) AS total_records, count(DISTINCT text) AS unique_queries, min(doc_id) AS first_created, max(doc_id) AS last_created,
round((count(*) - count(DISTINCT text)) * 100.0::DOUBLE / count(*), 2) AS duplicate_rate FROM documents GROUP BY 1""")
def a5(t: Tables):
    return aggregates.run_audit(t.documents, "source", "text", "doc_id")


@query("A6_duplicate_groups", "SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a6(t: Tables):
    return aggregates.duplicate_groups(t.documents, "text", "doc_id")


@query("A6_duplicate_members", """SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n, doc_id AS id FROM documents) WHERE n > 1""")
def a6_members(t: Tables):
    return aggregates.duplicate_members(t.documents, "text", "doc_id")


GROUP_SIZES = "g AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)"


def group_sizes(t: Tables):
    return aggregates.value_counts(t.lineitem, "l_partkey")


@query("A7_describe", f"""WITH {GROUP_SIZES} SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n)::DOUBLE AS min,
quantile_cont(n, 0.25)::DOUBLE AS p25, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.75)::DOUBLE AS p75, max(n)::DOUBLE AS max FROM g""")
def a7(t: Tables):
    return aggregates.describe(group_sizes(t), "n").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("A8_percentiles", """WITH q AS (SELECT quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS v FROM events)
SELECT unnest([10, 25, 50, 75, 90, 95, 99]) AS percentile, round(unnest(v), 6) AS value FROM q""")
def a8(t: Tables):
    return aggregates.percentiles(t.events, "value").withColumn("value", F.round("value", 6))


@query("A9_histogram", f"""WITH {GROUP_SIZES}, r AS (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM g),
b AS (SELECT least(floor((n - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM g, r GROUP BY 1)
SELECT i::INT AS bin, round(lo + i * ((hi - lo) / 50), 6) AS bin_start, round(lo + (i + 1) * ((hi - lo) / 50), 6) AS bin_end, coalesce(n, 0) AS n
FROM range(50) AS x(i) CROSS JOIN r LEFT JOIN b ON b.bin = i""")
def a9(t: Tables):
    return aggregates.histogram(group_sizes(t), "n").withColumns(
        {c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query("A10_diet_statistics", f"""WITH {DIETS}, s AS (
  SELECT unnest(['is_non_veg','has_egg','has_milk','has_honey','has_gluten','has_nuts','is_vegetarian','is_vegan','is_lacto_vegetarian','is_gluten_free','is_nut_free','is_pescetarian']) AS measure,
  unnest([is_non_veg,has_egg,has_milk,has_honey,has_gluten,has_nuts,is_vegetarian,is_vegan,is_lacto_vegetarian,is_gluten_free,is_nut_free,is_pescetarian]) AS v FROM c)
SELECT measure, count(*) FILTER (v) AS n, round(count(*) FILTER (v) * 100.0::DOUBLE / count(*), 4) AS pct FROM s GROUP BY 1""")
def a10(t: Tables):
    return dietary.diet_statistics(diets(t))


@query("A11_diet_labels", f"""WITH {DIETS}, s AS (
  SELECT p_partkey, unnest(['Vegetarian','Vegan','Gluten-Free','Dairy-Free','Nut-Free','Lacto Vegetarian','Pescetarian','Lacto Ovo Vegetarian']) AS label,
  unnest([is_vegetarian,is_vegan,is_gluten_free,is_dairy_free,is_nut_free,is_lacto_vegetarian,is_pescetarian,is_lacto_ovo_vegetarian]) AS v FROM c)
SELECT p_partkey, label FROM s WHERE v""")
def a11(t: Tables):
    return dietary.diet_labels_long(diets(t), "p_partkey")


@query("A21_embedding_quality", """WITH v AS (SELECT embedding::DOUBLE[] AS e FROM embeddings)
SELECT bool_or(len(list_filter(e, lambda x: isnan(x) OR isinf(x))) > 0) AS has_bad, round(min(list_min(e)), 6) AS min_value, round(max(list_max(e)), 6) AS max_value,
round(avg(sqrt(list_inner_product(e, e))), 6) AS mean_norm FROM v""")
def a21(t: Tables):
    return aggregates.embedding_quality(t.embeddings, "embedding").withColumns(
        {c: F.round(c, 6) for c in ("min_value", "max_value", "mean_norm")})


@query("A22_cluster_sizes", "SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def a22(t: Tables):
    return aggregates.cluster_sizes(as_clusters(t))


def as_clusters(t: Tables):
    return t.embeddings.select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"))


@query("A22_cluster_size_summary", """WITH s AS (SELECT label AS c, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY 1)
SELECT (SELECT count(*) FROM embeddings) AS n_points, count(*) AS n_clusters, (SELECT count(*) FROM embeddings WHERE label = 0) AS n_noise,
(SELECT c FROM s ORDER BY n DESC, c LIMIT 1) AS largest_cluster, max(n) AS largest_size, (SELECT c FROM s ORDER BY n, c LIMIT 1) AS smallest_cluster,
min(n) AS smallest_size, round(avg(n), 6) AS mean_size FROM s""")
def a22_summary(t: Tables):
    return aggregates.cluster_size_summary(as_clusters(t)).withColumn("mean_size", F.round("mean_size", 6))


@query("A23_text_profile", f"""WITH {BLANKED} SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL) AS missing_text, count(*) FILTER (lang IS NULL) AS missing_lang,
round(avg(length(text)), 6) AS mean_length FROM b""")
def a23(t: Tables):
    return aggregates.text_profile(documents_with_blanks(t), "text", "text", "lang").withColumn(
        "mean_length", F.round("mean_length", 6))


@query("A24_query_type_counts", "SELECT CASE role WHEN 'user' THEN 'intent' ELSE 'bridged' END AS query_type, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1")
def a24(t: Tables):
    return aggregates.query_type_counts(query_types(t))


@query("A18_cluster_summary", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c) WHERE r = 1),
s AS (SELECT p_brand, string_agg(p_name, '; ' ORDER BY p_partkey) AS sample_dishes FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 3 GROUP BY 1)
SELECT p.p_brand AS cluster_id, count(*) AS size, any_value(b.p_type) AS top_food_type, any_value(b.n) AS top_food_type_count, any_value(s.sample_dishes) AS sample_dishes
FROM part p JOIN b ON b.p_brand = p.p_brand JOIN s ON s.p_brand = p.p_brand GROUP BY 1""")
def a18(t: Tables):
    from relish.operators.cluster import cluster_summary
    return cluster_summary(t.part, "p_brand", "p_type", "p_name", "p_partkey")


@query("C9_representatives", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
b AS (SELECT p_brand, string_agg(p_type || '=' || n, ', ' ORDER BY r) AS top_types FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c) WHERE r <= 3 GROUP BY 1),
s AS (SELECT p_brand, string_agg(p_name, '; ' ORDER BY p_partkey) AS dishes FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 5 GROUP BY 1)
SELECT p_brand AS cluster_id, top_types, dishes FROM b JOIN s USING (p_brand)""")
def c9(t: Tables):
    from relish.operators.cluster import representatives
    return representatives(t.part, "p_brand", "p_type", "p_name", "p_partkey").select(
        "cluster_id", F.array_join(F.transform("top_types", lambda s: F.concat(s["category"], F.lit("="), s["n"].cast("string"))), ", ").alias("top_types"),
        F.array_join("samples", "; ").alias("dishes"))


# ---------------------------------------------------------------- windows, sorts, samples

@query("W1_first_per_key", "SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def w1(t: Tables):
    return windows.first_per_key(t.documents.select("doc_id", "text", "source"), ["text"], "doc_id")


@query("D-1_exact_distinct", "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def d1(t: Tables):
    return windows.first_per_key(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name"], "p_partkey")


@query("W2_stratified_split", """WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN r <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM n""")
def w2(t: Tables):
    return ordering.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id", 0.2, 42)


@query("W3_batch_numbers", "SELECT p_partkey, p - 1 AS pos, (p - 1) // 50 AS batch FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS p FROM part)")
def w3(t: Tables):
    return ordering.batch_numbers(t.part, ["p_name", "p_partkey"], 50).select("p_partkey", "pos", "batch")


@query("W6_top_category", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, p_type AS top_category, n AS top_count FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c) WHERE r = 1""")
def w6(t: Tables):
    return windows.top_category(t.part, "p_brand", "p_type")


@query("W8_elbow", """WITH k AS (SELECT value AS v, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS pos FROM events),
d AS (SELECT pos, abs((lead(v, 2) OVER w - lead(v) OVER w) - (lead(v) OVER w - v)) AS bend FROM k WINDOW w AS (ORDER BY pos)),
b AS (SELECT pos + 1 AS at FROM d WHERE bend IS NOT NULL ORDER BY bend DESC, pos LIMIT 1)
SELECT pos AS elbow_pos, v AS eps FROM k JOIN b ON b.at = k.pos""")
def w8(t: Tables):
    return windows.elbow(t.events, "value", "event_id")


@query("W9_top_groups", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def w9(t: Tables):
    return windows.top_groups(t.lineitem, "l_partkey", 10)


@query("T1_sort", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def t1(t: Tables):
    return ordering.sort_by(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", F.col("o_totalprice").desc(), "o_orderkey")


@query("T2_seeded_window", "SELECT p_partkey, p_name FROM part ORDER BY md5('42:' || p_partkey) LIMIT 200 OFFSET 100")
def t2(t: Tables):
    return ordering.seeded_window(t.part.select("p_partkey", "p_name"), "p_partkey", 42, 100, 200)


@query("T2_resume_without_limit", "SELECT p_partkey FROM part ORDER BY md5('42:' || p_partkey) OFFSET 100")
def t2_resume(t: Tables):
    return ordering.seeded_window(t.part.select("p_partkey"), "p_partkey", 42, 100)


@query("T4_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 25")
def t4(t: Tables):
    return ordering.sample_n(t.documents.select("doc_id"), "doc_id", 25, 7)


@query("T4_sample_fraction", "SELECT event_id FROM events WHERE ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT < (0.1 * 4294967296)::BIGINT")
def t4_fraction(t: Tables):
    return ordering.sample_fraction(t.events.select("event_id"), "event_id", 0.1, 7)


@query("T5_systematic_sample", """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events)
SELECT event_id FROM n WHERE p % greatest(1, n // 300) = 0 AND p < greatest(1, n // 300) * 300""")
def t5(t: Tables):
    return ordering.systematic_sample(t.events.select("event_id"), ["event_id"], 300)


@query("T7_page", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 6 OFFSET 12")
def t7(t: Tables):
    return ordering.page(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 2)


# ---------------------------------------------------------------- set operations and plain joins

@query("U1_concat", """SELECT p_partkey AS id, p_name AS name, p_brand AS brand, NULL::INTEGER AS nation FROM part
UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")
def u1(t: Tables):
    return setops.concat(
        t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("U2_distinct_union", "SELECT p_name FROM part WHERE p_name LIKE '%red%' UNION SELECT p_name FROM part WHERE p_name LIKE '%bolt%'")
def u2(t: Tables):
    return setops.distinct_union(
        *[t.part.filter(filters.matches_pattern("p_name", p)).select("p_name") for p in ("red", "bolt")])


@query("U6_difference", "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u6(t: Tables):
    keys = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return setops.difference(keys.filter("o_orderstatus = 'P'"), keys.filter("o_orderstatus = 'F'"), ["c_custkey"])


@query("J2_left_join_two_keys", """SELECT l_orderkey, l_partkey, l_linenumber, n.cnt FROM lineitem l LEFT JOIN (
SELECT l_suppkey, l_returnflag, count(*) AS cnt FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2) n USING (l_suppkey, l_returnflag)""")
def j2(t: Tables):
    right = t.lineitem.filter("l_returnflag <> 'N'").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("cnt"))
    return joins.attach(t.lineitem, right, ["l_suppkey", "l_returnflag"]).select("l_orderkey", "l_partkey", "l_linenumber", "cnt")


@query("J3_left_join_one_key", """SELECT l_orderkey, l_partkey, l_linenumber, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'SMALL') ON l_partkey = p_partkey""")
def j3(t: Tables):
    right = t.part.filter("p_type <> 'SMALL'").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return joins.attach(t.lineitem, right, ["l_partkey"]).select("l_orderkey", "l_partkey", "l_linenumber", "p_name")


@query("J9_rows_of_top_keys", """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (
SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 5)""")
def j9(t: Tables):
    return joins.rows_of_top_keys(t.lineitem, "l_partkey", 5).select("l_orderkey", "l_partkey", "l_linenumber")


@query("J10_not_in", "SELECT DISTINCT text FROM documents WHERE lang = 'en' AND text NOT IN (SELECT text FROM documents WHERE source = 'src1')")
def j10(t: Tables):
    return joins.not_in(t.documents.filter("lang = 'en'"), "text", t.documents.filter("source = 'src1'")).select("text").distinct()


@query("A7_merged_sketches", """SELECT c AS "column", count(*) AS "rows", count(*) - count(v) AS nulls, TRUE AS distinct_holds, TRUE AS quantiles_hold
FROM (SELECT 'l_extendedprice' AS c, l_extendedprice::DOUBLE AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity::DOUBLE FROM lineitem
UNION ALL SELECT 'l_partkey', l_partkey::DOUBLE FROM lineitem) GROUP BY c""")
def a7_sketches(t: Tables):
    # a part per return flag, merged; errors are judged against the rows
    columns, points = ["l_extendedprice", "l_quantity", "l_partkey"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    parts = sketches.profile_parts(t.lineitem, ["l_returnflag"], columns)
    profile = stage(sketches.read_profile(sketches.merge_parts(parts), points))
    values = t.lineitem.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    ranks = [x for name in points for x in (F.count_if(F.col("v") < F.col(name)).alias(f"{name}_low"), F.count_if(F.col("v") <= F.col(name)).alias(f"{name}_high"))]
    exact = values.join(profile.select("column", *points), "column").groupBy("column").agg(F.count_distinct("v").alias("exact"), *ranks)
    counted, slack = F.col("rows") - F.col("nulls"), 3 * sketches.RANK_ERROR
    held = F.lit(True)
    for name, p in points.items():
        held = held & (F.col(f"{name}_low") <= counted * (p + slack)) & (F.col(f"{name}_high") >= counted * (p - slack))
    return profile.join(exact, "column").select(
        "column", "rows", "nulls", (F.abs(F.col("distinct") - F.col("exact")) <= 4 * sketches.DISTINCT_ERROR * F.col("exact")).alias("distinct_holds"),
        held.alias("quantiles_hold"))
