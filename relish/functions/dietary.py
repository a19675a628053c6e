"""Keyword-based dietary flags, their combinations, names and statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relish.functions.text import parse_list

# Keyword lists matched as substrings of lower-cased ingredients.
SEAFOOD = [
    "fish", "salmon", "tuna", "cod", "shrimp", "shrimps", "prawns", "crab", "lobster", "oysters", "mussels",
    "clams", "scallops", "squid", "octopus", "seafood", "fish sauce", "oyster sauce", "prawn", "clam", "oyster",
]
OTHER_MEAT = [
    "beef", "ground beef", "pork", "chicken", "duck", "turkey", "lamb", "mutton", "veal", "venison", "bacon",
    "ham", "sausage", "pepperoni", "salami", "chorizo", "prosciutto", "meat", "gelatin", "lard",
    "chicken stock", "beef stock", "bone broth", "beef patty",
]
EGG = ["egg", "eggs", "egg white", "egg yolk", "mayonnaise"]
MILK = ["milk", "cheese", "butter", "yogurt", "cream", "ghee", "paneer", "curd"]
HONEY = ["honey"]
GLUTEN = [
    "wheat", "barley", "rye", "malt", "triticale", "spelt", "farro", "couscous", "semolina", "bulgur", "bread",
    "pasta", "noodles", "flour", "cracker",
]
NUTS = [
    "almond", "walnut", "peanut", "cashew", "pecan", "hazelnut", "pistachio", "macadamia", "brazil nut",
    "pine nut", "nuts",
]
# Flag columns, derived columns and their display names.
DIET_COLUMNS = [
    "is_vegetarian", "is_vegan", "is_gluten_free", "is_dairy_free", "is_nut_free", "is_lacto_vegetarian",
    "is_pescetarian", "is_lacto_ovo_vegetarian",
]
NAMES_MAPPING = {
    "is_vegetarian": "Vegetarian",
    "is_vegan": "Vegan",
    "is_gluten_free": "Gluten-Free",
    "is_dairy_free": "Dairy-Free",
    "is_nut_free": "Nut-Free",
    "is_lacto_vegetarian": "Lacto-Vegetarian",
    "is_pescetarian": "Pescetarian",
    "is_lacto_ovo_vegetarian": "Lacto-Ovo Vegetarian",
}
DEFAULT_KEYWORDS = {
    "seafood": SEAFOOD, "other_meat": OTHER_MEAT, "egg": EGG, "milk": MILK, "honey": HONEY, "gluten": GLUTEN,
    "nuts": NUTS,
}


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when any word occurs anywhere in ``text``; null text is false."""
    words = list(words)
    if not words:
        return F.lit(False)
    return F.coalesce(text.rlike("|".join(re.escape(w).replace(r"\ ", " ") for w in words)), F.lit(False))


def dietary_flags(df: DataFrame, ingredients: str = "consumable_ingredients",
                  keywords: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """one boolean column per flag, never null.

    The parsed items are joined by newlines, so one compiled pattern per flag
    scans the whole list; no keyword holds a newline.
    """
    kw = {**DEFAULT_KEYWORDS, **(keywords or {})}
    items = F.lower(F.array_join(parse_list(ingredients, strict=True), "\n"))
    text = F.col("_items")
    seafood, other = contains_any(text, kw["seafood"]), contains_any(text, kw["other_meat"])
    return df.withColumn("_items", items).withColumns({
        "is_non_veg": contains_any(text, [*kw["seafood"], *kw["other_meat"]]),
        "has_egg": contains_any(text, kw["egg"]),
        "has_milk": contains_any(text, kw["milk"]),
        "has_honey": contains_any(text, kw["honey"]),
        "has_gluten": contains_any(text, kw["gluten"]),
        "has_nuts": contains_any(text, kw["nuts"]),
        "has_seafood_only": seafood & ~other,
    }).drop("_items")


def dietary_combinations(df: DataFrame) -> DataFrame:
    """derived diets from the flags."""
    meat, egg, milk, honey = F.col("is_non_veg"), F.col("has_egg"), F.col("has_milk"), F.col("has_honey")
    return df.withColumns({
        "is_vegetarian": ~meat,
        "is_vegan": ~(meat | egg | milk | honey),
        "is_gluten_free": ~F.col("has_gluten"),
        "is_dairy_free": ~milk,
        "is_nut_free": ~F.col("has_nuts"),
        "is_lacto_vegetarian": milk & ~egg & ~meat,
        "is_pescetarian": F.col("has_seafood_only"),
        "is_lacto_ovo_vegetarian": (milk | egg) & ~meat,
    })


def evaluate_diets(df: DataFrame, ingredients: str = "consumable_ingredients",
                   keywords: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    return dietary_combinations(dietary_flags(df, ingredients, keywords))


def diet_name(column: str, style: str = "filters") -> str:
    """display name of a diet column.

    ``filters`` hyphenates the three "free" names, ``mapping`` is the fixed
    table, ``prompt`` is the plain title-cased column name.
    """
    if style == "mapping":
        return NAMES_MAPPING[column]
    if style == "prompt":
        return column.replace("_", " ").title()
    if style == "filters":
        title = column.replace("is_", "").replace("_", " ").title()
        return title.replace(" Free", "-Free")
    raise ValueError(f"unknown style {style}")


def diet_labels(columns: Iterable[str] = DIET_COLUMNS, style: str = "filters") -> Column:
    """The names of the diets that hold for a row, as an array, without a shuffle."""
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(diet_name(c, style))) for c in columns]))


def diet_labels_long(df: DataFrame, id_col: str, columns: Iterable[str] = DIET_COLUMNS,
                     style: str = "filters") -> DataFrame:
    """The same names as rows ``(id, label)``."""
    return df.select(id_col, F.explode(diet_labels(columns, style)).alias("label"))


def diet_statistics(df: DataFrame) -> DataFrame:
    """A10: count and percentage of each measure as rows ``(measure, n, pct)``."""
    measures = [
        "is_non_veg", "has_egg", "has_milk", "has_honey", "has_gluten", "has_nuts", "is_vegetarian", "is_vegan",
        "is_lacto_vegetarian", "is_gluten_free", "is_nut_free", "is_pescetarian",
    ]
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(m)).alias(m) for m in measures])
    return (
        counted.unpivot(["total"], measures, "measure", "n")
        .select("measure", "n", F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 4).alias("pct"))
    )


def query_filters(dimensions_json: str | Column, labels: str | Column) -> Column:
    """F8: JSON of generated dimensions and rule-based diets; unreadable dimensions become ``{}``."""
    dims_text = F.col(dimensions_json) if isinstance(dimensions_json, str) else dimensions_json
    labels = F.col(labels) if isinstance(labels, str) else labels
    empty = F.lit("{}")
    dims = F.from_json(F.coalesce(dims_text, empty), "map<string,string>")
    return F.to_json(F.struct(
        F.coalesce(dims, F.from_json(empty, "map<string,string>")).alias("dimensions"),
        F.coalesce(labels, F.lit([]).cast("array<string>")).alias("rule_based_dietary_restrictions"),
    ))
