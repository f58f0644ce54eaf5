"""Principal components of very large sparse matrices held as Spark tables."""

import sys

from pyspark import cloudpickle

from .functions.seeds import column_range, gaussian_seed, sparse_sign_seed, uniform_seed, validation_seed
from .functions.vectors import pack, unpack
from .operators.products import (
    cross_product,
    gram,
    mean_correction,
    mean_times_matrix,
    project_rows,
    reconstruct_rows,
    row_residual,
)
from .operators.shapes import (
    cap_columns,
    center_rows,
    dimensions,
    entries_from,
    limit_columns,
    merge_entries,
    rebase_columns,
    rows_from_array,
    rows_from_columns,
    sample_rows,
    to_entries,
    to_rows,
)
from .operators.sums import (
    column_abs_sums,
    column_means,
    column_sums,
    matrix_sum,
    score_sums,
    total_variation,
    trace,
)
from .operators.tsqr import tsqr_r
from .plans.exact import exact_pca
from .plans.pca import (
    Fit,
    fit_until_tolerance,
    randomized_pca,
    sketch_pca,
    sketch_pca_tsqr,
    sketch_pca_two_pass,
)
from .plans.residual import (
    evaluate_components,
    kth_singular_value,
    relative_spectral_bound,
    relative_spectral_error,
    residual_norm_bound,
    residual_spectral_norm,
)
from .sinks.matrices import (
    write_coo_text,
    write_components_text,
    write_dense_text,
    write_lil_text,
    write_matrix,
    write_matrix_rows,
)
from .sources.committed import read_committed_lines, write_committed_lines
from .sources.coo import scan_coo_text
from .sources.tables import read_matrix
from .sources.text import read_components, read_coo_text, read_dense_text, rejected_lines

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
