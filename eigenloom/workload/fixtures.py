"""The given tables as matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.seeds import validation_seed
from ..functions.vectors import pack
from ..operators.shapes import entries_from, rows_from_array, rows_from_columns
from ..operators.skew import salted_join

HOURS = 24  # columns of the user-by-hour matrix
EMBEDDING = 64  # length of the embedding arrays
WIDTH = 4  # components of the check factor


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five numeric lineitem columns as dense rows."""
    price = F.col("l_extendedprice") / 1000
    columns = ["l_quantity", price, "l_discount", "l_tax", "l_linenumber"]
    return rows_from_columns(load(spark, sf_dir, "lineitem"), columns)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_from_array(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by order and part; repeated cells stay as they are and add up."""
    return entries_from(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def order_part_dims(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Declared rows and columns: all orders, all parts, with items or without."""
    return load(spark, sf_dir, "orders").count(), load(spark, sf_dir, "part").count()


def user_hour(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    """An aggregate of events by user and hour of the day."""
    events = load(spark, sf_dir, "events")
    cells = events.groupBy("user_id", F.hour("ts").alias("h")).agg(value.alias("v"))
    return entries_from(cells, "user_id", "h", "v")


def supp_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by supplier and part brand: a join ahead of the matrix, safe for a hot part."""
    items = load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_suppkey", "l_quantity"
    )
    brand = F.substring_index("p_brand", "#", -1).cast("int") - 1
    parts = load(spark, sf_dir, "part").select("p_partkey", brand.alias("brand"))
    joined = salted_join(items, parts, "p_partkey", "l_orderkey")
    return entries_from(joined, "l_suppkey", "brand", "l_quantity")


def order_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by order and part brand; orders without items have no cell."""
    items = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_quantity")
    brand = F.substring_index("p_brand", "#", -1).cast("int") - 1
    parts = load(spark, sf_dir, "part").select("p_partkey", brand.alias("brand"))
    return entries_from(salted_join(items, parts, "p_partkey", "l_orderkey"), "l_orderkey", "brand", "l_quantity")


def order_line_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax by order and line number, many cells of which are zero."""
    items = load(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber") - 1)
    return entries_from(items, "l_orderkey", "line", "l_tax")


def part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("col_id"))


def embedding_columns(rows: DataFrame) -> DataFrame:
    """The column ids that occur in the rows."""
    return rows.select(F.explode("indices").alias("col_id")).distinct()


def check_factor(cols: DataFrame) -> DataFrame:
    return pack(validation_seed(cols, WIDTH), "col_id", WIDTH)
