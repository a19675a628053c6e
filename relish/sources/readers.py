"""Reading catalogues, tables, intent sets and retrieval data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relish.operators.store import Store

# Columns of the raw catalogue, layout of an intent set file, default number of sets.
CATALOGUE_SCHEMA = T.StructType([
    T.StructField("image_url", T.StringType()), T.StructField("food_prob", T.DoubleType()),
    T.StructField("dish_name", T.StringType()), T.StructField("food_type", T.StringType()),
    T.StructField("ingredients", T.StringType()), T.StructField("portion_size", T.StringType()),
    T.StructField("nutritional_profile", T.StringType()), T.StructField("cooking_method", T.StringType())])
INTENT_SET_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("set_number", T.IntegerType()), T.StructField("creation_date", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("theme_distribution", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("total_intents", T.LongType())])),
    T.StructField("intents", T.ArrayType(T.StringType()))])
DEFAULT_SETS = 10


def _load(read):
    """Run a read, turning Spark's missing-path error into FileNotFoundError."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(str(e)) from e
        raise


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; quotes are doubled inside quoted cells.

    Give a schema for large inputs: inferring one reads the data twice.
    ``multi_line`` is needed when cells hold line breaks; a file is then read by
    one task; ``csv_ranges.read_csv_ranges`` reads a large one with many.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _load(lambda: reader.csv(path))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet."""
    return _load(lambda: spark.read.parquet(*paths))


def read_delimited(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """S3: delimited text without a header, all columns text."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _load(lambda: spark.read.schema(schema).option("sep", sep).option("quote", "").csv(path))


def get_table(tables: Store | Mapping[str, DataFrame], name: str, limit: int | None = None,
              columns: Sequence[str] | str = "*", where: str | None = None, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """A table with optional SQL filter, order, limit and columns, each as SQL has it (``"type, id DESC NULLS LAST"``)."""
    frames = tables.tables() if isinstance(tables, Store) else tables
    if name not in frames:
        raise ValueError(f"unknown table {name}")
    plain = lambda text: text.replace("{", "{{").replace("}", "}}")
    listed = columns if isinstance(columns, str) else ", ".join(f"`{c}`" for c in columns)
    parts = [f"SELECT {plain(listed)} FROM {{source}}"]
    if where:
        parts.append(f"WHERE {plain(where)}")
    if order_by:
        parts.append("ORDER BY " + plain(order_by if isinstance(order_by, str) else ", ".join(order_by)))
    if limit:
        parts.append(f"LIMIT {int(limit)}")
    return frames[name].sparkSession.sql(" ".join(parts), source=frames[name])


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
                    partitions: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """S4 from a database, read in parallel ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=dict(properties or {}))


def execute_query(tables: Store | Mapping[str, DataFrame], sql: str, params: Mapping | Sequence | None = None) -> DataFrame:
    """SQL over the tables by name, with ``:name`` or ``?`` parameters."""
    frames = tables.tables() if isinstance(tables, Store) else tables
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=params if params is None or isinstance(params, Mapping) else list(params))


def load_intent_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Intents ``(set_number, pos, intent)`` and metadata of the sets in a folder.

    A summary file tells how many ``intent_set_NN.json`` files there are, ten
    otherwise.  A missing file is an error, as is a folder without sets.
    """
    folder = folder.rstrip("/")
    try:
        summary = spark.read.option("multiLine", True).schema(
            "generation_info STRUCT<total_sets: INT>").json(f"{folder}/intent_sets_summary.json").first()
        total = summary["generation_info"]["total_sets"]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        total = DEFAULT_SETS
    if not total:
        raise ValueError(f"no intent sets in {folder}")
    paths = [f"{folder}/intent_set_{i:02d}.json" for i in range(1, total + 1)]
    sets = _load(lambda: spark.read.option("multiLine", True).schema(INTENT_SET_SCHEMA).json(paths))
    intents = sets.select(F.col("metadata.set_number").alias("set_number"), F.posexplode("intents").alias("pos", "intent"))
    return intents, sets.select("metadata.*")


def read_exported_intent_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Intents written by ``export_intent_sets``."""
    return _load(lambda: spark.read.schema("pos LONG, intent STRING, theme STRING, set_number INT").json(f"{folder.rstrip('/')}/sets"))


def clean_corpus(corpus: DataFrame) -> DataFrame:
    """Documents ``(doc_id, title, text)`` without nulls; an absent title column is empty."""
    titled = corpus if "title" in corpus.columns else corpus.withColumn("title", F.lit(""))
    return titled.select(
        F.col("_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"))


def clean_queries(queries: DataFrame) -> DataFrame:
    """Queries ``(query_id, text)`` without null texts."""
    return queries.select(F.col("_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def clean_qrels(qrels: DataFrame) -> DataFrame:
    """Judgements ``(query_id, doc_id, rel)``; without a score column every pair scores 1."""
    scored = qrels if "score" in qrels.columns else qrels.withColumn("score", F.lit(1))
    return scored.select(
        F.col("query_id").cast("string").alias("query_id"), F.col("corpus_id").cast("string").alias("doc_id"),
        F.col("score").cast("int").alias("rel"))


def load_retrieval_data(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements from three parquet paths."""
    return (clean_corpus(read_parquet(spark, corpus)), clean_queries(read_parquet(spark, queries)),
            clean_qrels(read_parquet(spark, qrels)))
