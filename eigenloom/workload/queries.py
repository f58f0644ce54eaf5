"""One query per operator over the given tables. All numbers come out as BIGINT or rounded DOUBLE."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import (
    cap_columns,
    center_rows,
    column_abs_sums,
    column_means,
    column_sums,
    cross_product,
    evaluate_components,
    exact_pca,
    fit_until_tolerance,
    gaussian_seed,
    gram,
    kth_singular_value,
    limit_columns,
    matrix_sum,
    mean_correction,
    mean_times_matrix,
    project_rows,
    randomized_pca,
    read_committed_lines,
    read_components,
    read_coo_text,
    read_dense_text,
    read_matrix,
    rebase_columns,
    reconstruct_rows,
    relative_spectral_error,
    residual_norm_bound,
    residual_spectral_norm,
    row_residual,
    sample_rows,
    scan_coo_text,
    score_sums,
    sketch_pca,
    sketch_pca_tsqr,
    sketch_pca_two_pass,
    sparse_sign_seed,
    to_entries,
    to_rows,
    total_variation,
    trace,
    tsqr_r,
    uniform_seed,
    unpack,
    validation_seed,
    write_components_text,
    write_matrix,
    write_matrix_rows,
)
from ..functions.vectors import sum_vectors
from ..operators.products import shifted
from ..plans.spaces import factor_table, opened, small_vector
from ..plans.tiles import Tiles
from ..session import FACTOR_LIMIT_BYTES, scratch_path
from ..sources.text import numbered_lines
from . import fixtures as fx
from .fixtures import EMBEDDING, HOURS, WIDTH

# Rows that a task of a sort holds at most, on average.
SORTED_ROWS = 2_000_000

IDS = ("row_id", "col_id", "comp", "i", "j", "nnz", "first_col", "last_col")


def out(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Ids as BIGINT, numbers as DOUBLE at fixed decimals (never a negative zero), text as it is."""
    fields = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if name in IDS:
            column = column.cast("bigint")
        elif kind != "string":
            column = F.round(column.cast("double"), places)
            column = F.when(column == 0, F.lit(0.0)).otherwise(column)
        fields.append(column.alias(name))
    df = df.select(*fields)
    return df.select(*columns) if columns else df


def number(spark: SparkSession, value: float, places: int) -> DataFrame:
    return out(spark.createDataFrame([(float(value),)], "value double"), places)


# Sources


def dense_text_ingest(spark, sf):
    path = scratch_path(spark, "dense")
    write_matrix(fx.user_hour(spark, sf, F.sum("value")), "DENSE", path, n_cols=HOURS)
    return out(to_entries(read_dense_text(spark, f"{path}/PCs.txt")), 6)


def _coo_files(spark, sf, ordered=False) -> str:
    path = scratch_path(spark, "coo")
    items = fx.load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    if ordered:
        order = ("l_orderkey", "l_partkey", "l_quantity")
        tasks = items.count() // SORTED_ROWS
        if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
            items = items.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        else:
            items = items.sort(*order)
    line = F.concat_ws(",", "l_orderkey", F.col("l_partkey") + 1, "l_quantity")
    items.select(line.alias("value")).write.text(path)
    return path


def coo_text_ingest(spark, sf):
    return out(read_coo_text(spark, _coo_files(spark, sf), base=1), 6)


def coo_text_scan(spark, sf):
    """Through the data source: columns are left out in the tasks that read."""
    _, n_cols = fx.order_part_dims(spark, sf)
    cells = scan_coo_text(spark, _coo_files(spark, sf), base=1)
    return out(cells.where(F.col("col_id") <= n_cols // 2), 6)


def coo_text_last(spark, sf):
    return out(read_coo_text(spark, _coo_files(spark, sf, True), base=1, on_duplicate="last"), 6)


def coo_text_drop(spark, sf):
    """Some lines lack a field: they go, the others stay."""
    path = scratch_path(spark, "coo")
    items = fx.load(spark, sf, "lineitem")
    fields = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_quantity")]
    short = [F.when(F.col("l_linenumber") == k + 2, "").otherwise(field) for k, field in enumerate(fields)]
    items.select(F.concat_ws(",", *short).alias("value")).write.text(path)
    return out(read_coo_text(spark, path, malformed="drop"), 6)


def components_ingest(spark, sf):
    path = scratch_path(spark, "components")
    write_components_text(validation_seed(fx.part_columns(spark, sf), WIDTH), path, WIDTH)
    return out(read_components(spark, path), 6)


def matrix_scan(spark, sf):
    path = scratch_path(spark, "matrix")
    write_matrix_rows(fx.order_part(spark, sf), path)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    per_row = read_matrix(spark, path).groupBy("row_id").agg(
        F.sum(F.size("indices")).alias("nnz"), F.sum(total).alias("total")
    )
    return out(per_row, 6)


# Sinks


def _lines(spark, path):
    lines = numbered_lines(spark, path)
    return out(lines.select(F.col("row_id").alias("i"), F.col("value").alias("line")), 0)


def write_dense(spark, sf):
    counts = fx.user_hour(spark, sf, F.count(F.lit(1)))
    path = write_matrix(counts, "DENSE", scratch_path(spark, "out"), n_cols=HOURS)
    return _lines(spark, path)


def write_lil(spark, sf):
    n_rows, _ = fx.order_part_dims(spark, sf)
    return _lines(
        spark, write_matrix(fx.order_part(spark, sf), "LIL", scratch_path(spark, "out"), n_rows=n_rows)
    )


def write_lil_committed(spark, sf):
    """Rows without a cell have no line; the others keep their ids."""
    path = write_matrix(fx.order_part(spark, sf), "LIL", scratch_path(spark, "out"), committed=True)
    return out(read_committed_lines(spark, path).withColumnRenamed("row_id", "i"), 0)


def write_coo(spark, sf):
    path = write_matrix(fx.order_part(spark, sf), "COO", scratch_path(spark, "out"))
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return out(lines.select(F.split("line", ",")[0].cast("bigint").alias("i"), "line"), 0)


# Projections and filters


def cap_columns_entries(spark, sf):
    _, n_cols = fx.order_part_dims(spark, sf)
    return out(cap_columns(fx.order_part(spark, sf), n_cols // 2), 6)


def cap_columns_rows(spark, sf):
    return out(to_entries(cap_columns(fx.embeddings(spark, sf), EMBEDDING // 2)), 6)


def max_col(spark, sf):
    _, n_cols = fx.order_part_dims(spark, sf)
    return out(limit_columns(fx.order_part(spark, sf), n_cols // 2), 6)


def rebase_index(spark, sf):
    items = fx.load(spark, sf, "lineitem")
    entries = fx.entries_from(items, "l_orderkey", "l_linenumber", "l_tax")
    return out(rebase_columns(entries, 1), 6)


def sparse_rows(spark, sf):
    per_row = to_rows(fx.order_part(spark, sf)).groupBy("row_id").agg(
        F.sum(F.size("indices")).alias("nnz"),
        F.min(F.col("indices")[0]).alias("first_col"),
        F.max(F.element_at("indices", -1)).alias("last_col"),
    )
    return out(per_row, 0)


def row_entries(spark, sf):
    return out(to_entries(fx.embeddings(spark, sf)), 6)


def sampled_rows(spark, sf):
    return out(sample_rows(fx.order_part(spark, sf), 0.25, seed=7), 6)


def centered_rows(spark, sf):
    rows = to_rows(fx.user_hour(spark, sf, F.sum("value")))
    means = column_means(rows, rows.count(), HOURS)
    mu = small_vector(means.withColumnRenamed("col_id", "comp"), HOURS)
    return out(center_rows(rows, mu), 6)


# Products


def _embedding_scores(spark, sf):
    rows = fx.embeddings(spark, sf)
    factor = fx.check_factor(fx.embedding_columns(rows))
    return rows, factor, project_rows(rows, factor, EMBEDDING, WIDTH)


def _embedding_means(rows):
    return column_means(rows, rows.count(), EMBEDDING)


def _score_means(means, factor):
    return small_vector(mean_times_matrix(means, factor, WIDTH), WIDTH)


def project_rows_block(spark, sf):
    return out(unpack(_embedding_scores(spark, sf)[2], "row_id", value="z"), 6)


def _order_part_scores(spark, sf, limit=FACTOR_LIMIT_BYTES):
    n_rows, n_cols = fx.order_part_dims(spark, sf)
    entries, factor = fx.order_part(spark, sf), fx.check_factor(fx.part_columns(spark, sf))
    scores = project_rows(entries, factor, n_cols, WIDTH, limit)
    return entries, factor, scores, n_rows, n_cols


def project_rows_join(spark, sf):
    return out(unpack(_order_part_scores(spark, sf)[2], "row_id", value="z"), 6)


def project_rows_salted(spark, sf):
    return out(unpack(_order_part_scores(spark, sf, limit=0)[2], "row_id", value="z"), 6)


def _order_part_tiles(spark, sf):
    """The matrix as stored tiles of a quarter of the columns, and its scores from them."""
    n_rows, n_cols = fx.order_part_dims(spark, sf)
    entries, factor = fx.order_part(spark, sf), fx.check_factor(fx.part_columns(spark, sf))
    tiles = Tiles.store(entries, WIDTH, columns=-(-n_cols // 4))
    return tiles, entries, factor, tiles.project(factor, WIDTH), n_rows, n_cols


def project_rows_tiles(spark, sf):
    return out(unpack(_order_part_tiles(spark, sf)[3], "row_id", value="z"), 6)


def means_times_matrix(spark, sf):
    rows, factor, _ = _embedding_scores(spark, sf)
    product = mean_times_matrix(_embedding_means(rows), factor, WIDTH)
    return out(product.withColumnRenamed("value", "zm"), 6)


def reconstructed_rows(spark, sf):
    rows, factor, scores = _embedding_scores(spark, sf)
    return out(reconstruct_rows(scores, factor, EMBEDDING, WIDTH, _embedding_means(rows)), 5)


def residual_rows(spark, sf):
    rows, factor, scores = _embedding_scores(spark, sf)
    means = _embedding_means(rows)
    return out(row_residual(scores, factor, rows, EMBEDDING, WIDTH, means), 5)


# Sums


def column_sums_entries(spark, sf):
    return out(column_sums(fx.order_part(spark, sf)), 6)


def column_sums_rows(spark, sf):
    return out(column_sums(fx.embeddings(spark, sf), EMBEDDING), 6)


def column_means_declared(spark, sf):
    n_rows, n_cols = fx.order_part_dims(spark, sf)
    return out(column_means(fx.order_part(spark, sf), n_rows, n_cols), 6)


def column_absolute_sums(spark, sf):
    return out(column_abs_sums(fx.embeddings(spark, sf)), 6)


def vector_sum(spark, sf):
    vectors = fx.embeddings(spark, sf).select(F.col("values").alias("vec"))
    total = sum_vectors(vectors, [], EMBEDDING)
    return out(total.select(F.posexplode("vec").alias("col_id", "value")), 6)


def summed_matrices(spark, sf):
    items = fx.load(spark, sf, "lineitem")
    returned = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    parts = [
        fx.entries_from(items.where(test), "l_suppkey", "l_linenumber", "l_quantity")
        for test in (returned, ~returned)
    ]
    total = matrix_sum(*parts)
    return out(total.select(F.col("row_id").alias("i"), F.col("col_id").alias("j"), "value"), 6)


def _cross_table(factor):
    cells = unpack(factor, "col_id")
    return out(cells.select(F.col("col_id").alias("i"), F.col("comp").alias("j"), "value"), 4)


def cross_product_join(spark, sf):
    entries, factor, scores, n_rows, n_cols = _order_part_scores(spark, sf)
    zm = _score_means(column_means(entries, n_rows, n_cols), factor)
    return _cross_table(cross_product(entries, scores, zm))


def cross_product_tiles(spark, sf):
    tiles, entries, factor, scores, n_rows, n_cols = _order_part_tiles(spark, sf)
    zm = _score_means(column_means(entries, n_rows, n_cols), factor)
    return _cross_table(tiles.cross(shifted(scores, zm), WIDTH))


def corrected_cross_product(spark, sf):
    entries, factor, scores, n_rows, n_cols = _order_part_scores(spark, sf)
    means = column_means(entries, n_rows, n_cols)
    zm = _score_means(means, factor)
    z_sum = small_vector(score_sums(scores, WIDTH), WIDTH)
    cross = cross_product(entries, scores, zm)
    return _cross_table(mean_correction(cross, means, z_sum - n_rows * zm))


def _one_scan(spark, sf, which, places):
    n_rows, n_cols = fx.order_part_dims(spark, sf)
    factor = validation_seed(fx.part_columns(spark, sf), WIDTH)
    with opened(fx.order_part(spark, sf), WIDTH, n_rows, n_cols) as space:
        found = space.sketch(space.load(factor, WIDTH))[which]
        cells = factor_table(spark, found) if isinstance(found, np.ndarray) else space.table(found)
    return out(cells.select(F.col("col_id").alias("i"), F.col("comp").alias("j"), "value"), places)


def cross_product_scan(spark, sf):
    return _one_scan(spark, sf, 0, 4)


def gram_scan(spark, sf):
    return _one_scan(spark, sf, 1, 1)


def _embedding_gram(spark, sf):
    rows, factor, scores = _embedding_scores(spark, sf)
    return unpack(gram(scores, _score_means(_embedding_means(rows), factor)), "i", comp="j")


def gram_table(spark, sf):
    return out(_embedding_gram(spark, sf), 4)


def summed_scores(spark, sf):
    return out(score_sums(_embedding_scores(spark, sf)[2], WIDTH), 5)


def tsqr_gram(spark, sf):
    rows = fx.lineitem5(spark, sf)
    means = column_means(rows, rows.count(), 5)
    zm = small_vector(means.withColumnRenamed("col_id", "comp"), 5)
    r = tsqr_r(rows.select(F.col("values").alias("vec")), zm)
    return out(unpack(gram(r, np.zeros(5)), "i", comp="j"), 2)


def gram_trace(spark, sf):
    cells = _embedding_gram(spark, sf)
    return out(trace(cells.withColumnsRenamed({"i": "row_id", "j": "col_id"})), 4)


def variation(spark, sf):
    n_rows, _ = fx.order_part_dims(spark, sf)
    return out(total_variation(fx.order_part(spark, sf), n_rows), 4)


# Start matrices, one row of entries per part


def seed_validation(spark, sf):
    return out(validation_seed(fx.part_columns(spark, sf), WIDTH), 6)


def seed_uniform(spark, sf):
    return out(uniform_seed(fx.part_columns(spark, sf), WIDTH, seed=11), 6)


def seed_gaussian(spark, sf):
    return out(gaussian_seed(fx.part_columns(spark, sf), WIDTH, seed=11), 6)


def seed_sparse_sign(spark, sf):
    return out(sparse_sign_seed(fx.part_columns(spark, sf), WIDTH, seed=11, nonzeros=3), 6)


# Principal components


def _loadings(fit):
    table = fit.components.join(fit.sigma_table(), "comp")
    size = F.abs("value").alias("loading")
    cells = out(table.select("comp", "col_id", size, "sigma"), 6)
    return cells.withColumn("sigma", F.round("sigma", 3))


def _sigma(fit):
    return out(fit.sigma_table(), 3)


def pca_fused(spark, sf):
    return _loadings(sketch_pca(fx.lineitem5(spark, sf), 2, oversample=2, max_iter=3))


def pca_sparse_sign(spark, sf):
    return _loadings(sketch_pca(fx.lineitem5(spark, sf), 2, oversample=2, max_iter=4, start="sparse_sign"))


def pca_sparse_sign_tables(spark, sf):
    options = {"oversample": 2, "max_iter": 4, "start": "sparse_sign", "limit": 0}
    return _loadings(sketch_pca(fx.lineitem5(spark, sf), 2, **options))


def pca_resumed(spark, sf):
    """Ended after the first pass, then gone on with from its journal."""
    options = {"oversample": 2, "journal": scratch_path(spark, "journal")}
    sketch_pca(fx.lineitem5(spark, sf), 2, max_iter=1, **options)
    return _loadings(sketch_pca(fx.lineitem5(spark, sf), 2, max_iter=3, **options))


def pca_two_pass(spark, sf):
    return _loadings(sketch_pca_two_pass(fx.lineitem5(spark, sf), 2, oversample=2, max_iter=3))


def pca_tsqr(spark, sf):
    return _loadings(sketch_pca_tsqr(fx.lineitem5(spark, sf), 2, oversample=2, max_iter=3))


def pca_joined(spark, sf):
    return _sigma(sketch_pca(fx.supp_brand(spark, sf), 3, oversample=22, max_iter=1, n_cols=25))


def pca_joined_tables(spark, sf):
    matrix = fx.supp_brand(spark, sf)
    return _sigma(sketch_pca(matrix, 3, oversample=22, max_iter=1, n_cols=25, limit=0))


def pca_embeddings(spark, sf):
    rows = fx.embeddings(spark, sf)
    return _sigma(sketch_pca(rows, 3, oversample=EMBEDDING - 3, max_iter=1, n_cols=EMBEDDING))


def pca_sparse(spark, sf):
    n_rows, n_cols = fx.order_part_dims(spark, sf)
    return _sigma(sketch_pca(fx.order_part(spark, sf), 3, max_iter=4, n_rows=n_rows, n_cols=n_cols))


def pca_sparse_brand(spark, sf):
    """Orders by brand, in full width: orders without items are declared and absent."""
    n_rows, _ = fx.order_part_dims(spark, sf)
    options = {"oversample": 22, "max_iter": 1, "n_rows": n_rows, "n_cols": 25}
    return _sigma(sketch_pca(fx.order_brand(spark, sf), 3, **options))


def pca_zero_rows(spark, sf):
    """Orders by line number, tax: orders without tax hold zeros only and are rows all the same."""
    matrix = fx.order_line_tax(spark, sf)
    options = {"oversample": 5, "max_iter": 1, "n_cols": 7}
    local, tables = (_sigma(sketch_pca(matrix, 2, limit=limit, **options)) for limit in (FACTOR_LIMIT_BYTES, 0))
    return local.join(tables.withColumnRenamed("sigma", "sigma_tables"), "comp")


def pca_two_pass_tables(spark, sf):
    return _loadings(sketch_pca_two_pass(fx.lineitem5(spark, sf), 2, oversample=2, max_iter=3, limit=0))


def pca_tsqr_tables(spark, sf):
    return _loadings(sketch_pca_tsqr(fx.lineitem5(spark, sf), 2, oversample=2, max_iter=3, limit=0))


def singular_value_tables(spark, sf):
    value = kth_singular_value(fx.lineitem5(spark, sf), 3, limit=0)
    return out(spark.createDataFrame([(float(value),)], "sigma double"), 3)


def residual_norm_tables(spark, sf):
    rows = fx.lineitem5(spark, sf)
    fit = sketch_pca(rows, 2, oversample=2, max_iter=3)
    return number(spark, residual_spectral_norm(rows, fit.components, 2, limit=0), 3)


def singular_value(spark, sf):
    value = kth_singular_value(fx.lineitem5(spark, sf), 3)
    return out(spark.createDataFrame([(float(value),)], "sigma double"), 3)


def residual_norm(spark, sf):
    rows = fx.lineitem5(spark, sf)
    fit = sketch_pca(rows, 2, oversample=2, max_iter=3)
    return number(spark, residual_spectral_norm(rows, fit.components, 2), 3)


def residual_bound(spark, sf):
    """The residual norm, and whether its bound lies above it but below twice as much."""
    rows = fx.lineitem5(spark, sf)
    fit = sketch_pca(rows, 2, oversample=2, max_iter=3)
    norm, bound = residual_spectral_norm(rows, fit.components, 2), residual_norm_bound(rows, fit.components, 2)
    return number(spark, norm, 3).withColumn("holds", F.lit(norm <= bound < 2 * norm))


def relative_error(spark, sf):
    """How far one plain axis, the quantity column, is from the best single component."""
    rows = fx.lineitem5(spark, sf)
    axis = fx.embedding_columns(rows).select(
        "col_id", F.lit(0).alias("comp"), (F.col("col_id") == 0).cast("double").alias("value")
    )
    return number(spark, relative_spectral_error(rows, axis, 1), 4)


def until_tolerance(spark, sf):
    return _sigma(fit_until_tolerance(fx.lineitem5(spark, sf), 2))


def evaluated_components(spark, sf):
    rows = fx.lineitem5(spark, sf)
    fit = sketch_pca(rows, 2, oversample=2, max_iter=3)
    path = scratch_path(spark, "components")
    write_components_text(fit.components, path, 2, 5)
    stored = read_components(spark, path)
    return number(spark, evaluate_components(rows, stored, 2, kth_singular_value(rows, 3))[0], 3)


def pca_exact(spark, sf):
    return _loadings(exact_pca(fx.lineitem5(spark, sf), 2))


def pca_lanczos(spark, sf):
    return _loadings(exact_pca(fx.lineitem5(spark, sf), 2, method="lanczos"))


def pca_randomized(spark, sf):
    return _loadings(randomized_pca(fx.lineitem5(spark, sf), 2, p=2, q=2))


QUERIES = {
    "dense_text_ingest": dense_text_ingest,
    "coo_text_ingest": coo_text_ingest,
    "coo_text_scan": coo_text_scan,
    "coo_text_last": coo_text_last,
    "coo_text_drop": coo_text_drop,
    "components_ingest": components_ingest,
    "matrix_scan": matrix_scan,
    "write_dense": write_dense,
    "write_lil_committed": write_lil_committed,
    "write_lil": write_lil,
    "write_coo": write_coo,
    "cap_columns": cap_columns_entries,
    "cap_columns_rows": cap_columns_rows,
    "max_col": max_col,
    "rebase_index": rebase_index,
    "sparse_rows": sparse_rows,
    "row_entries": row_entries,
    "sample_rows": sampled_rows,
    "center_rows": centered_rows,
    "project_rows": project_rows_block,
    "project_rows_join": project_rows_join,
    "project_rows_salted": project_rows_salted,
    "project_rows_tiles": project_rows_tiles,
    "cross_product_tiles": cross_product_tiles,
    "mean_times_matrix": means_times_matrix,
    "reconstruct_rows": reconstructed_rows,
    "row_residual": residual_rows,
    "column_sums": column_sums_entries,
    "column_sums_rows": column_sums_rows,
    "column_means": column_means_declared,
    "column_abs_sums": column_absolute_sums,
    "vector_sum": vector_sum,
    "matrix_sum": summed_matrices,
    "cross_product": cross_product_join,
    "mean_correction": corrected_cross_product,
    "cross_product_scan": cross_product_scan,
    "gram_scan": gram_scan,
    "gram": gram_table,
    "score_sums": summed_scores,
    "tsqr_r": tsqr_gram,
    "trace": gram_trace,
    "total_variation": variation,
    "validation_seed": seed_validation,
    "uniform_seed": seed_uniform,
    "gaussian_seed": seed_gaussian,
    "sparse_sign_seed": seed_sparse_sign,
    "sketch_pca": pca_fused,
    "sketch_pca_sparse_sign": pca_sparse_sign,
    "sketch_pca_sparse_sign_tables": pca_sparse_sign_tables,
    "sketch_pca_resumed": pca_resumed,
    "sketch_pca_two_pass": pca_two_pass,
    "sketch_pca_tsqr": pca_tsqr,
    "sketch_pca_joined": pca_joined,
    "sketch_pca_tables": pca_joined_tables,
    "sketch_pca_embeddings": pca_embeddings,
    "sketch_pca_sparse": pca_sparse,
    "sketch_pca_sparse_brand": pca_sparse_brand,
    "sketch_pca_zero_rows": pca_zero_rows,
    "sketch_pca_two_pass_tables": pca_two_pass_tables,
    "sketch_pca_tsqr_tables": pca_tsqr_tables,
    "kth_singular_value_tables": singular_value_tables,
    "residual_norm_tables": residual_norm_tables,
    "kth_singular_value": singular_value,
    "residual_norm": residual_norm,
    "residual_bound": residual_bound,
    "relative_error": relative_error,
    "fit_until_tolerance": until_tolerance,
    "evaluate_components": evaluated_components,
    "exact_pca": pca_exact,
    "exact_pca_lanczos": pca_lanczos,
    "randomized_pca": pca_randomized,
}
