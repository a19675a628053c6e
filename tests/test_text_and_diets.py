from pyspark.sql import functions as F

from relish.functions import dietary, text
from relish.operators import filters
from relish.sources.media import media_manifest, use_local_names


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)).select(expr.alias("x")).first()["x"]


def test_parse_list_forms(spark):
    cells = ['["rice","egg"]', "['rice', \"baker's milk\"]", "rice, egg", '["rice"', "[]", None, '"chicken"', "5", '{"ham":1}']
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r["x"] for r in df.select(text.parse_list("c").alias("x")).collect()]
    assert got == [["rice", "egg"], ["rice", "baker's milk"], ["rice, egg"], ['["rice"'], [], None, ['"chicken"'], ["5"], ["ham"]]


def test_combine_text_edges(spark):
    e = text.combine_text("n", ["i"])
    assert one(spark, e, n=" Fried Rice ", i='[" Rice ", "", "Egg"]') == "fried rice\nrice, egg"
    assert one(spark, e, n="   ", i="Salt") == "unknown dish\nsalt"
    assert one(spark, e, n=None, i=None) == "unknown dish\nnone specified"
    assert one(spark, e, n="a", i='["broken"') == 'a\n["broken"'
    assert one(spark, e, n="a", i="[]") == "a\nnone specified"


def test_embedded_json_and_templates(spark):
    assert one(spark, text.embedded_json("t"), t='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, text.embedded_json("t"), t="none") == "{}"
    assert one(spark, text.embedded_json("t"), t="{broken}") == "{}"
    assert one(spark, text.render_template("[X]-[Y]", {"[X]": "1", "[Y]": F.col("t")}), t="z") == "1-z"
    assert one(spark, text.label_description("t"), t="Q") == "Unknown ESCI label: Q"
    assert one(spark, text.document_text("t", "u"), t=" A ", u=None) == "A"
    assert len(one(spark, text.document_text("t", "u"), t="a", u="b" * 3000)) == 2000


def test_keywords_match_inside_words_and_null_is_vegan(spark):
    rows = [(1, '["eggplant", "donuts"]'), (2, '["coconut milk"]'), (3, '["shrimp"]'), (4, '["shrimp", "chicken"]'), (5, None), (6, "Ham")]
    out = {r["id"]: r for r in dietary.evaluate_diets(spark.createDataFrame(rows, "id int, consumable_ingredients string")).collect()}
    assert out[1]["has_egg"] and out[1]["has_nuts"] and out[1]["is_lacto_ovo_vegetarian"]
    assert out[2]["has_milk"] and out[2]["is_lacto_vegetarian"] and not out[2]["is_vegan"]
    assert out[3]["is_pescetarian"] and out[3]["is_non_veg"]
    assert not out[4]["is_pescetarian"]
    assert out[5]["is_vegan"] and out[5]["is_vegetarian"] and not out[5]["is_pescetarian"]
    assert out[6]["is_non_veg"]


def test_label_names():
    names = [dietary.diet_name(c, "filters") for c in dietary.DIET_COLUMNS]
    assert names == ["Vegetarian", "Vegan", "Gluten-Free", "Dairy-Free", "Nut-Free", "Lacto Vegetarian", "Pescetarian", "Lacto Ovo Vegetarian"]
    assert dietary.diet_name("is_lacto_vegetarian", "mapping") == "Lacto-Vegetarian"
    assert dietary.diet_name("is_nut_free", "prompt") == "Is Nut Free"


def test_query_filters(spark):
    e = dietary.query_filters("d", F.array(F.lit("Vegan")))
    assert one(spark, e, d='{"price":"cheap"}') == '{"dimensions":{"price":"cheap"},"rule_based_dietary_restrictions":["Vegan"]}'
    assert one(spark, e, d="{oops") == '{"dimensions":{},"rule_based_dietary_restrictions":["Vegan"]}'


def test_null_rows_and_nan_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (4, "nan"), (5, " a ")], "id int, dish_name string")
    assert [r["id"] for r in filters.remove_null_rows(df, ["dish_name", "other"]).collect()] == [4, 5]
    assert [r["dish_name"] for r in filters.clean_text_fields(df, ["dish_name"]).orderBy("id").collect()] == [None, "", "", None, "a"]


def test_wildcards_stay_wildcards(spark):
    df = spark.createDataFrame([(1, "Red Hot"), (2, "rod"), (3, "blue")], "id int, t string")
    assert [r["id"] for r in filters.find_by_pattern(df, "t", "R_D").collect()] == [1, 2]
    assert [r["id"] for r in filters.find_by_patterns(df, "t", [" red", "%lu%"]).collect()] == [1, 3]


def test_e_share_must_exceed_seventy(spark):
    rows = [(i, "a", "a" if i == 0 else "b", "E" if i < 7 else "S") for i in range(10)]
    view = spark.createDataFrame(rows, "id int, query string, consumable_name string, ai_esci_label string")
    assert filters.drop_trivial_matches(view).count() == 10
    more = view.unionByName(spark.createDataFrame([(10, "x", "y", "E")], view.schema))
    assert filters.drop_trivial_matches(more).count() == 10


def test_media_manifest(spark):
    df = spark.createDataFrame([(0, "http://h/b.PNG?x=1.gif"), (1, "http://h/a"), (2, "http://h/b.PNG?x=1.gif"), (3, "http://h/d.e/f.tar.gz")], "r long, image string")
    names = {r["image"]: r["local_name"] for r in media_manifest(df, "image", "r").collect()}
    assert names == {"http://h/b.PNG?x=1.gif": "image_00000000.PNG", "http://h/a": "image_00000001.jpg", "http://h/d.e/f.tar.gz": "image_00000002.gz"}
    local = use_local_names(df, "image", media_manifest(df, "image", "r")).orderBy("r").collect()
    assert [r["image"] for r in local][:3] == ["image_00000000.PNG", "image_00000001.jpg", "image_00000000.PNG"]
