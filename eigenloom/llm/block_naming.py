"""Exact duplicates by deterministic block naming, in DataFrame operations only (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import as_table, scratch_path

BLOCK_BYTES = 4096
ROWS_PER_BUCKET = 1024
NAME_SPACE = 1 << 31


def row_keys(id_col: str, text: Column) -> tuple[Column, Column]:
    """Two 64-bit values that stand for a row in joins, also where ids are null or repeat."""
    return F.xxhash64(F.col(id_col), text), F.xxhash64(text, F.lit(7))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that names made here cannot clash with the table's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col("_doc").getField(c).alias(c) for c in docs.columns]


def name_by_sorting(rows: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Add ``name``: an integer that two rows share if and only if they agree in ``columns``.

    Rows meet in buckets by a hash of the columns. Each bucket is sorted by the columns themselves, and
    a name is the bucket's number with the rank in it: no two contents can share one, and it does not
    depend on partitions. Contents that would fill a task (more rows than a quarter of an even share)
    are reduced to one row each before they move, are named in a bucket of their own, and their names
    are broadcast back: there can be at most four such contents for each shuffle partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(ROWS_PER_BUCKET // 4, total // (4 * parts))
    rows = rows.withColumn("_digest", F.xxhash64(*columns))
    counts = rows.groupBy("_digest").count().where(F.col("count") > share)
    hot = [r["_digest"] for r in counts.collect()]
    buckets = max(1, -(-total // ROWS_PER_BUCKET))

    def named(part: DataFrame, bucket: Column) -> DataFrame:
        order = Window.partitionBy("_bucket").orderBy(*columns)
        part = part.withColumn("_bucket", bucket.cast("long"))
        return part.withColumn("name", F.col("_bucket") * NAME_SPACE + F.dense_rank().over(order)).drop("_bucket")

    if not hot:
        return named(rows, F.pmod("_digest", F.lit(buckets))).drop("_digest")
    is_hot = F.col("_digest").isin(hot)
    cold = named(rows.where(~is_hot), F.pmod("_digest", F.lit(buckets)))
    few = named(rows.where(is_hot).select("_digest", *columns).distinct(), F.lit(buckets))
    few = few.select("name", *[F.col(c).alias(f"_few_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_few_{c}"))
    warm = rows.where(is_hot).join(F.broadcast(few), same).drop(*[f"_few_{c}" for c in columns])
    return cold.unionByName(warm).drop("_digest")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every document with the group of documents whose text is the same, byte for byte.

    Texts are cut into blocks and each distinct block gets an integer name. Then neighbouring names are
    named in pairs, level by level, until each document has one. Documents are equal if they have the
    same number of blocks and the same last name. Texts cross the network once, as blocks; the rounds,
    as many as the base-2 logarithm of the largest number of blocks, move integers only.

    Returns doc_id, keep_id (largest id of the group), group_size, kept, text_sha256, and the row keys
    ``_a`` and ``_b`` for joining back.

    Null text counts as empty. A null id is smaller than any other; a group of null ids has keep_id null
    and keeps that row. Rows that repeat both id and text are one document: they come out once and count
    in group_size as often as they occur. An empty table gives no rows; other columns are ignored. A
    long text is one row only before it is cut.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a, b = row_keys(id_col, text)
    rows = docs.select(F.col(id_col).alias("doc_id"), a.alias("_a"), b.alias("_b"), text.cast("binary").alias("_text"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / block_bytes)).cast("int")
    rows = rows.withColumn("blocks", n)
    size = rows.agg(F.sum("blocks").alias("total"), F.max("blocks").alias("most")).first()
    if size["total"] is None:
        size = {"total": 0, "most": 1}
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pos"))
    cut = cut.select(
        "doc_id",
        "_a",
        "_b",
        "blocks",
        F.col("blocks").alias("left"),
        "pos",
        F.substring(F.col("_text"), F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block"),
        F.when(F.col("pos") == 0, F.sha2("_text", 256)).alias("text_sha256"),
        F.lit(1).cast("long").alias("weight"),
    )
    level = name_by_sorting(cut, ["block"], int(size["total"])).drop("block")
    level = as_table(level, scratch_path(spark, "names"))
    done = level.where("left = 1")
    for _ in range((int(size["most"]) - 1).bit_length()):
        open_ = level.where("left > 1")
        even = F.col("pos") % 2 == 0
        pairs = open_.groupBy(
            "doc_id", "_a", "_b", "blocks", "left", F.expr("pos div 2").cast("int").alias("half")
        ).agg(
            F.max(F.when(even, F.col("name"))).alias("one"),
            F.max(F.when(~even, F.col("name"))).alias("two"),
            F.max("text_sha256").alias("text_sha256"),
            F.sum(F.when(even, F.col("weight"))).alias("weight"),
        )
        pairs = pairs.withColumn("left", F.expr("(left + 1) div 2").cast("int")).withColumnRenamed("half", "pos")
        level = name_by_sorting(pairs, ["one", "two"], open_.count()).drop("one", "two")
        level = as_table(level.select(*done.columns), scratch_path(spark, "names"))
        done = done.unionByName(level.where("left = 1"))
    members = done.groupBy("doc_id", "_a", "_b", "blocks", "name", "text_sha256").agg(F.sum("weight").alias("weight"))
    groups = members.groupBy("blocks", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("weight").alias("group_size")
    )
    return members.join(groups, ["blocks", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "_a",
        "_b",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text no row with a larger id has. Repeated rows stay once."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select("_a", "_b")
    a, b = row_keys(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.select(whole_row(docs), a.alias("_a"), b.alias("_b"))
    one = keyed.join(kept, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    return one.select(*columns_of(docs))
