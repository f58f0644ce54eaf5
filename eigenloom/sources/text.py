"""Text inputs: dense rows, coordinate triples and stored components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.shapes import limit_columns, merge_entries, rebase_columns
from ..session import FACTOR_LIMIT_BYTES
from .committed import read_committed_lines

# Blocks whose first line numbers may be broadcast, at about 160 bytes each.
MAX_BLOCKS = FACTOR_LIMIT_BYTES // 160

ON_DUPLICATE = ("sum", "last", "error", "keep")


def _located(lines: DataFrame) -> DataFrame:
    """Lines with the file, the block of the file and the order they were read in."""
    return lines.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("order"),
    )


def _block_bound(lines: DataFrame) -> int:
    """At most so many blocks will be read: a file's last block is short, the others fill a task."""
    return len(lines.inputFiles()) + lines.rdd.getNumPartitions()


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with ``place``, one long that grows in the order of file, block and line.

    It is the rank of the block among all blocks, which are listed first, and then the order of reading. So what is
    aggregated by it holds numbers only and no file names: it needs no sort, and little memory for a line.
    """
    located = _located(lines)
    ranks = located.select("file", "block").distinct()
    ranks = ranks.select("file", "block", F.row_number().over(Window.orderBy("file", "block")).alias("rank"))
    if _block_bound(lines) <= MAX_BLOCKS:
        ranks = F.broadcast(ranks)
    # Two scans with other splits would not fit each other.
    unknown = F.raise_error(F.concat_ws(" ", F.lit("no such block was listed:"), "file", "block")).cast("long")
    rank = F.coalesce(F.col("rank").cast("long"), unknown)
    place = F.shiftleft(rank, 33).bitwiseOR(F.col("order").bitwiseAND(F.lit((1 << 33) - 1)))
    return located.join(ranks, ["file", "block"], "left").select(*lines.columns, place.alias("place"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): the non-blank lines, counted from 0 over all files in the order of
    their paths, part files in the order of their number.

    Lines are numbered inside their file block by read order; a block's first number comes from a
    running total of line counts, first over the blocks of a file, then over the files. The windows
    see one row per block and one per file, never the lines. The table of first numbers is broadcast
    when the planned scan bounds it; beyond that it is joined by exchange.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    located = _located(lines)
    blocks = located.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("order").alias("first")
    )
    before = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(*before)
    # Part files in the order of their number, which outgrows its five digits; one row per file.
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    over_files = Window.orderBy(F.regexp_replace("file", r"[^/]*$", ""), number, "file").rowsBetween(*before)
    files = blocks.groupBy("file").agg(F.sum("n").alias("lines"))
    files = files.select("file", F.coalesce(F.sum("lines").over(over_files), F.lit(0)).alias("at"))
    inside = F.coalesce(F.sum("n").over(in_file), F.lit(0))
    starts = blocks.select("file", "block", "first", inside.alias("inside")).join(files, "file")
    if _block_bound(lines) <= MAX_BLOCKS:
        starts = F.broadcast(starts)
    number = F.col("at") + F.col("inside") + F.col("order") - F.col("first")
    return located.join(starts, ["file", "block"]).select(number.alias("row_id"), "value")


def _as_double(column: Column, malformed: str) -> Column:
    return column.cast("double") if malformed == "fail" else column.try_cast("double")


def _checked(malformed: str) -> None:
    if malformed not in ("fail", "drop"):
        raise ValueError("malformed must be 'fail' or 'drop'")


def _dense_cells(lines: DataFrame, parts: Column, malformed: str) -> DataFrame:
    """(row_id, values) of numeric lines; with ``drop``, a line with any bad token goes as a whole."""
    rows = lines.select("row_id", F.transform(parts, lambda t: _as_double(t, malformed)).alias("values"))
    if malformed == "drop":
        rows = rows.where(~F.exists("values", lambda x: x.isNull()))
    return rows


def read_dense_text(spark: SparkSession, path: str, malformed: str = "fail", committed: bool = False) -> DataFrame:
    """Whitespace-separated numbers, one matrix row per line, as sparse rows (zeros dropped).

    Lines of a ``committed`` folder have the row ids they were written with; others are counted.
    """
    _checked(malformed)
    lines = numbered_lines(spark, path) if not committed else read_committed_lines(spark, path).withColumnRenamed("line", "value")
    rows = _dense_cells(lines, _dense_parts(), malformed)
    cells = F.filter(
        F.transform("values", lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda cell: cell["x"] != 0,
    )
    return rows.select("row_id", cells.alias("cells")).select(
        "row_id",
        F.lit(0).alias("segment"),
        F.col("cells.i").alias("indices"),
        F.col("cells.x").alias("values"),
    )


def _coo_cells(spark: SparkSession, path: str) -> DataFrame:
    """Lines as row_id, col_id, value; ``bad`` where one of them is missing or the line is no such triple."""
    schema = "row_id long, col_id int, value double, text string"
    lines = spark.read.schema(schema).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="text")
    bad = F.col("text").isNotNull()
    for column in ("row_id", "col_id", "value"):
        bad = bad | F.col(column).isNull()
    return lines.withColumn("bad", bad)


def read_coo_text(
    spark: SparkSession,
    path: str,
    base: int = 0,
    n_cols: int | None = None,
    max_col: int | None = None,
    on_duplicate: str = "sum",
    malformed: str = "fail",
) -> DataFrame:
    """Lines ``row,col,value`` as entries, merged by cell whatever the order of the lines.

    ``base`` is subtracted from the column ids. ``max_col`` drops columns by their id as written,
    ``n_cols`` by the id after rebasing. ``on_duplicate``: add repeated cells up, keep the last one in
    file order, fail, or ``keep`` them as they are (no exchange; for files known to have none).
    """
    _checked(malformed)
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"on_duplicate must be one of {ON_DUPLICATE}")
    lines = _coo_cells(spark, path)
    if on_duplicate == "last":
        lines = _placed(lines)
    if malformed == "drop":
        lines = lines.where(~F.col("bad"))
    else:
        said = F.raise_error(F.concat_ws(" ", F.lit("not row,col,value:"), "text", "row_id", "col_id", "value"))
        lines = lines.withColumn("row_id", F.when(F.col("bad"), said.cast("long")).otherwise(F.col("row_id")))
    lines = lines.drop("bad", "text")
    if max_col is not None:
        lines = limit_columns(lines, max_col)
    below = F.concat_ws(" ", F.lit("column id below the base:"), "col_id")
    entries = rebase_columns(lines, base).withColumn(
        "col_id", F.when(F.col("col_id") < 0, F.raise_error(below)).otherwise(F.col("col_id"))
    )
    if n_cols is not None:
        entries = entries.where(F.col("col_id") < n_cols)
    if on_duplicate == "keep":
        return entries
    if on_duplicate == "sum":
        return merge_entries(entries)
    cells = entries.groupBy("row_id", "col_id")
    if on_duplicate == "last":
        return cells.agg(F.max_by("value", "place").alias("value"))
    message = F.concat_ws(" ", F.lit("repeated cell"), "row_id", "col_id")
    return cells.agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value")).select(
        "row_id",
        "col_id",
        F.when(F.col("n") > 1, F.raise_error(message)).otherwise(F.col("value")).alias("value"),
    )


def read_components(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """Lines ``[v0,v1,...]``, one per matrix column, as (col_id, comp, value)."""
    _checked(malformed)
    lines = numbered_lines(spark, path)
    rows = _dense_cells(lines, _component_parts(), malformed)
    return rows.select(
        F.col("row_id").cast("int").alias("col_id"), F.posexplode("values").alias("comp", "value")
    )


def rejected_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row ``n``: how many lines of a ``dense``, ``coo`` or ``components`` file the reader would drop."""
    if kind == "coo":
        bad = _coo_cells(spark, path).where("bad")
    elif kind in ("dense", "components"):
        lines = spark.read.text(path).where(F.trim("value") != "").select(F.lit(0).alias("row_id"), "value")
        parts = _dense_parts() if kind == "dense" else _component_parts()
        cells = lines.select(F.transform(parts, lambda t: _as_double(t, "drop")).alias("values"))
        bad = cells.where(F.exists("values", lambda x: x.isNull()))
    else:
        raise ValueError("kind must be one of ['coo', 'components', 'dense']")
    return bad.agg(F.count(F.lit(1)).alias("n"))


def _dense_parts() -> Column:
    return F.split(F.trim("value"), r"\s+")


def _component_parts() -> Column:
    return F.split(F.regexp_replace("value", r"[\[\]\s]", ""), ",")
