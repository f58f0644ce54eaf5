"""The same queries in DuckDB SQL, written from the definitions of the operators."""

from __future__ import annotations

from ..functions.seeds import COMP_STRIDE, MIX_MULTIPLIER, WORD, seed_state


def rnd(x: str, places: int) -> str:
    """Round, without a negative zero."""
    return f"CASE WHEN round({x}, {places}) = 0 THEN 0.0 ELSE round({x}, {places}) END"


ENTRIES = "SELECT l_orderkey AS r, l_partkey AS c, l_quantity AS v FROM lineitem"

# The embedding cells, the 4-wide check factor on their columns, means and scores.
EMBEDDING = """
y AS (SELECT vec_id AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c,
             CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings),
m AS (SELECT c, j, CAST((c + j) % 10 + 1 AS DOUBLE) AS m
      FROM (SELECT DISTINCT c FROM y), (SELECT unnest(range(4)) AS j)),
mu AS (SELECT c, sum(v) / any_value(n.n) AS mu FROM y, n GROUP BY c),
z AS (SELECT r, j, sum(v * m) AS z FROM y JOIN m USING (c) GROUP BY r, j),
zm AS (SELECT j, sum(mu * m) AS zm FROM mu JOIN m USING (c) GROUP BY j)
"""

# The same for the order-by-part matrix with its declared dimensions.
ORDER_PART = f"""
raw AS ({ENTRIES}),
y AS (SELECT r, c, sum(v) AS v FROM raw GROUP BY r, c),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders),
m AS (SELECT p_partkey AS c, j, CAST((p_partkey + j) % 10 + 1 AS DOUBLE) AS m
      FROM part, (SELECT unnest(range(4)) AS j)),
mu AS (SELECT p_partkey AS c, coalesce(sum(v), 0) / any_value(n.n) AS mu
       FROM part LEFT JOIN y ON c = p_partkey, n GROUP BY p_partkey),
z AS (SELECT r, j, sum(v * m) AS z FROM y JOIN m USING (c) GROUP BY r, j),
zm AS (SELECT j, sum(mu * m) AS zm FROM mu JOIN m USING (c) GROUP BY j)
"""

CORRECTED = f"""
WITH {ORDER_PART},
a AS (SELECT c, j, sum(v * (z - zm)) AS x FROM y JOIN z USING (r) JOIN zm USING (j) GROUP BY c, j),
s AS (SELECT j, sum(z) AS s FROM z GROUP BY j)
SELECT c AS i, j, {rnd("coalesce(x, 0) - mu * (s - n * zm)", 4)} AS value
FROM mu CROSS JOIN n CROSS JOIN s JOIN zm USING (j) LEFT JOIN a USING (c, j)
"""

# Cells of lineitem5, dense, as r, c, v.
LINEITEM5 = """
x AS (SELECT [l_quantity, l_extendedprice / 1000, l_discount, l_tax, CAST(l_linenumber AS DOUBLE)] AS a
      FROM lineitem),
e AS (SELECT row_number() OVER () AS r, a FROM x),
l AS (SELECT r, unnest(range(5)) AS c, unnest(a) AS v FROM e)
"""
FOUR_OF_LINEITEM5 = """
x AS (SELECT [l_extendedprice / 1000, l_discount, l_tax, CAST(l_linenumber AS DOUBLE)] AS a FROM lineitem),
e AS (SELECT row_number() OVER () AS r, a FROM x),
l AS (SELECT r, unnest(range(4)) AS c, unnest(a) AS v FROM e)
"""
SUPP_BRAND = """
q AS (SELECT l_suppkey AS r, CAST(substr(p_brand, 7) AS BIGINT) - 1 AS c, sum(l_quantity) AS v
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
l AS (SELECT a.r, b.c, coalesce(v, 0) AS v FROM (SELECT DISTINCT r FROM q) a
      CROSS JOIN (SELECT unnest(range(25)) AS c) b LEFT JOIN q ON q.r = a.r AND q.c = b.c)
"""
ORDER_BRAND = """
q AS (SELECT l_orderkey AS r, CAST(substr(p_brand, 7) AS BIGINT) - 1 AS c, sum(l_quantity) AS v
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
l AS (SELECT a.r, b.c, coalesce(v, 0) AS v FROM (SELECT o_orderkey AS r FROM orders) a
      CROSS JOIN (SELECT unnest(range(25)) AS c) b LEFT JOIN q ON q.r = a.r AND q.c = b.c)
"""
ORDER_LINE_TAX = """
q AS (SELECT l_orderkey AS r, CAST(l_linenumber AS BIGINT) - 1 AS c, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2),
l AS (SELECT a.r, b.c, coalesce(v, 0) AS v FROM (SELECT DISTINCT r FROM q) a
      CROSS JOIN (SELECT unnest(range(7)) AS c) b LEFT JOIN q ON q.r = a.r AND q.c = b.c)
"""
EMBEDDING_CELLS = """
l AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) - 1 AS c,
             CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
"""


def power(cells: str, d: int, steps: int, comps: int) -> str:
    """CTEs ending in ``top(comp, sigma, v)``: power iteration with deflation on the centred Gram."""
    first = f"list_transform(range({d}), lambda k: 1.0::DOUBLE + k)"
    return f"""
WITH RECURSIVE {cells},
mu AS (SELECT c, avg(v) AS m FROM l GROUP BY c),
ctr AS (SELECT r, l.c, v - m AS v FROM l JOIN mu USING (c)),
g AS (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) AS x FROM ctr a JOIN ctr b ON a.r = b.r GROUP BY 1, 2),
m0 AS MATERIALIZED (SELECT list(w ORDER BY i) AS mat
                    FROM (SELECT i, list(x ORDER BY j) AS w FROM g GROUP BY i)),
it(comp, n, mat, v) AS (
  SELECT 0, 0, mat, {first} FROM m0
  UNION ALL
  SELECT CASE WHEN n < {steps} THEN comp ELSE comp + 1 END, CASE WHEN n < {steps} THEN n + 1 ELSE 0 END,
    CASE WHEN n < {steps} THEN mat ELSE list_transform(range({d}), lambda i:
      list_transform(range({d}), lambda j: mat[i + 1][j + 1] - lam * v[i + 1] * v[j + 1])) END,
    CASE WHEN n < {steps} THEN list_transform(y, lambda a: a / sqrt(list_dot_product(y, y)))
         ELSE {first} END
  FROM (SELECT *, list_dot_product(v, y) AS lam
        FROM (SELECT *, list_transform(mat, lambda w: list_dot_product(w, v)) AS y FROM it))
  WHERE comp < {comps}),
top AS (SELECT comp, v, sqrt(list_dot_product(v, list_transform(mat, lambda w: list_dot_product(w, v)))) AS sigma
        FROM it WHERE n = {steps} AND comp < {comps})
"""


def loadings() -> str:
    return power(LINEITEM5, 5, 200, 2) + f"""
SELECT CAST(comp AS BIGINT) AS comp, CAST(c AS BIGINT) AS col_id,
       {rnd("abs(w)", 6)} AS loading, round(sigma, 3) AS sigma
FROM (SELECT comp, sigma, unnest(range(5)) AS c, unnest(v) AS w FROM top)
"""


def sigmas(cells: str, d: int, steps: int, comps: int) -> str:
    return power(cells, d, steps, comps) + """
SELECT CAST(comp AS BIGINT) AS comp, round(sigma, 3) AS sigma FROM top
"""


def one_sigma(name: str, places: int = 3) -> str:
    return power(LINEITEM5, 5, 200, 3) + f"SELECT round(sigma, {places}) AS {name} FROM top WHERE comp = 2"


def relative_error() -> str:
    """Without the quantity column the rest is the residual of that axis."""
    best = power(LINEITEM5, 5, 200, 2) + "SELECT sigma FROM top WHERE comp = 1"
    left = power(FOUR_OF_LINEITEM5, 4, 200, 1) + "SELECT sigma FROM top WHERE comp = 0"
    return f"SELECT {rnd('(a.sigma - b.sigma) / b.sigma', 4)} AS value FROM ({left}) a, ({best}) b"


def mix(x: str, y: str) -> str:
    """Select items that scramble integer column ``x`` into ``y``."""
    step = f"* {MIX_MULTIPLIER}) % {WORD}"
    return (
        f"(xor({x}, {x} >> 16) {step} AS {y}_a, (xor({y}_a, {y}_a >> 16) {step} AS {y}_b,"
        f" xor({y}_b, {y}_b >> 16) AS {y}"
    )


def folded(x: str) -> str:
    return f"(xor(CAST({x} AS BIGINT), CAST({x} AS BIGINT) >> 32) & {WORD - 1})"


def sample(rate: float, seed: int) -> str:
    return f"""
WITH a AS (SELECT *, xor({seed_state(seed)}::BIGINT, {folded("l_orderkey")}) AS x0, {mix("x0", "x")} FROM lineitem)
SELECT l_orderkey AS row_id, l_partkey AS col_id, round(l_quantity, 6) AS value
FROM a WHERE (x + 0.5::DOUBLE) / {WORD}.0::DOUBLE < {rate}
"""


def seeded(value: str, seed: int, factor: int) -> str:
    """Seed entries; ``u`` and ``w`` are the uniforms of streams factor*comp and factor*comp + 1."""
    stream = f"(comp * {factor} {{}}) * {COMP_STRIDE} % {WORD}"
    return f"""
WITH a AS (SELECT p_partkey AS col_id, j AS comp,
                  xor({seed_state(seed)}::BIGINT, {folded("p_partkey")}) AS x0, {mix("x0", "x")}
           FROM part, (SELECT unnest(range(4)) AS j)),
b AS (SELECT *, xor(x, {folded(stream.format(""))}) AS s0, {mix("s0", "s")},
      xor(x, {folded(stream.format("+ 1"))}) AS t0, {mix("t0", "t")} FROM a),
c AS (SELECT *, (s + 0.5::DOUBLE) / {WORD}.0::DOUBLE AS u, (t + 0.5::DOUBLE) / {WORD}.0::DOUBLE AS w FROM b)
SELECT col_id, comp, {rnd(value, 6)} AS value FROM c
"""


def signed(seed: int, draws: int) -> str:
    """A sparse sign matrix of four components: ``draws`` signs for each column."""
    stream = f"(draw * {COMP_STRIDE} % {WORD})"
    return f"""
WITH a AS (SELECT p_partkey AS col_id, draw, xor({seed_state(seed)}::BIGINT, {folded("p_partkey")}) AS x0, {mix("x0", "x")}
           FROM part, (SELECT unnest(range({draws})) AS draw)),
b AS (SELECT *, xor(x, {stream}) AS s0, {mix("s0", "s")} FROM a)
SELECT col_id, CAST((s >> 1) % 4 AS BIGINT) AS comp, {rnd(f"sum((s % 2) * 2 - 1) / sqrt({draws})", 6)} AS value
FROM b GROUP BY 1, 2
"""


CELLS = "SELECT r AS row_id, c AS col_id, round(v, 6) AS value FROM"
HALF = "(SELECT count(*) // 2 FROM part)"
SCORES = "SELECT r AS row_id, j AS comp, round(z, 6) AS z FROM z"
USER_HOUR = "SELECT user_id AS r, hour(ts) AS c, sum(value) AS v FROM events GROUP BY 1, 2"
REBUILT = f"""
WITH {EMBEDDING},
xh AS (SELECT r, m.c, sum(z * m) AS x FROM z JOIN m USING (j) GROUP BY r, m.c)
"""
GRAM = f"""
WITH {EMBEDDING}, zc AS (SELECT r, j, z - zm AS z FROM z JOIN zm USING (j)),
g AS (SELECT a.j AS i, b.j AS j, sum(a.z * b.z) AS x FROM zc a JOIN zc b USING (r) GROUP BY 1, 2)
"""

ORACLE = {
    "dense_text_ingest": f"""
WITH y AS ({USER_HOUR}),
k AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k FROM (SELECT DISTINCT r FROM y WHERE v <> 0))
SELECT k AS row_id, c AS col_id, round(v, 6) AS value FROM y JOIN k USING (r) WHERE v <> 0""",
    "coo_text_ingest": f"{CELLS} (SELECT r, c, sum(v) AS v FROM ({ENTRIES}) GROUP BY r, c)",
    "coo_text_scan": f"{CELLS} ({ENTRIES}) WHERE c <= {HALF}",
    "coo_text_last": f"{CELLS} (SELECT r, c, max(v) AS v FROM ({ENTRIES}) GROUP BY r, c)",
    "components_ingest": """
SELECT p_partkey AS col_id, j AS comp, CAST((p_partkey + j) % 10 + 1 AS DOUBLE) AS value
FROM part, (SELECT unnest(range(4)) AS j)""",
    "matrix_scan": f"""
SELECT r AS row_id, count(DISTINCT c) AS nnz, round(sum(v), 6) AS total FROM ({ENTRIES}) GROUP BY r""",
    "write_dense": """
WITH y AS (SELECT user_id AS r, hour(ts) AS c, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
g AS (SELECT a.r, b.h, coalesce(y.v, 0.0) AS v FROM (SELECT DISTINCT r FROM y) a
      CROSS JOIN (SELECT unnest(range(24)) AS h) b LEFT JOIN y ON y.r = a.r AND y.c = b.h)
SELECT row_number() OVER (ORDER BY r) - 1 AS i, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY h) || ' ' AS line
FROM g GROUP BY r""",
    "write_lil": f"""
WITH y AS (SELECT r, c, sum(v) AS v FROM ({ENTRIES}) GROUP BY r, c),
p AS (SELECT r, string_agg(c || ':' || CAST(v AS VARCHAR), ',' ORDER BY c) AS s FROM y WHERE v <> 0 GROUP BY r)
SELECT i, '{{' || coalesce(s, '') || '}}' AS line
FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i) LEFT JOIN p ON r = i""",
    "write_lil_committed": f"""
SELECT r AS i, '{{' || string_agg(c || ':' || CAST(v AS VARCHAR), ',' ORDER BY c) || '}}' AS line
FROM (SELECT r, c, sum(v) AS v FROM ({ENTRIES}) GROUP BY r, c) WHERE v <> 0 GROUP BY r""",
    "write_coo": f"""
SELECT r AS i, r || ',' || c || ',' || CAST(sum(v) AS VARCHAR) AS line FROM ({ENTRIES})
GROUP BY r, c HAVING sum(v) <> 0""",
    "cap_columns": f"{CELLS} ({ENTRIES}) WHERE c < {HALF} AND v <> 0",
    "cap_columns_rows": f"WITH {EMBEDDING} {CELLS} y WHERE c < 32 AND v <> 0",
    "max_col": f"{CELLS} ({ENTRIES}) WHERE c <= {HALF}",
    "rebase_index": """
SELECT l_orderkey AS row_id, CAST(l_linenumber - 1 AS BIGINT) AS col_id, round(l_tax, 6) AS value FROM lineitem""",
    "sparse_rows": f"""
SELECT r AS row_id, count(*) AS nnz, min(c) AS first_col, max(c) AS last_col
FROM (SELECT r, c FROM ({ENTRIES}) GROUP BY r, c HAVING sum(v) <> 0) GROUP BY r""",
    "row_entries": f"WITH {EMBEDDING} {CELLS} y",
    "sample_rows": sample(0.25, 7),
    "center_rows": f"""
WITH y AS ({USER_HOUR}), u AS (SELECT DISTINCT r FROM y), h AS (SELECT unnest(range(24)) AS c),
d AS (SELECT u.r, h.c, coalesce(v, 0) AS v FROM u CROSS JOIN h LEFT JOIN y ON y.r = u.r AND y.c = h.c),
mu AS (SELECT c, avg(v) AS m FROM d GROUP BY c)
SELECT r AS row_id, c AS col_id, {rnd("v - m", 6)} AS value FROM d JOIN mu USING (c)""",
    "project_rows": f"WITH {EMBEDDING} {SCORES}",
    "project_rows_join": f"WITH {ORDER_PART} {SCORES}",
    "project_rows_salted": f"WITH {ORDER_PART} {SCORES}",
    "project_rows_tiles": f"WITH {ORDER_PART} {SCORES}",
    "mean_times_matrix": f"WITH {EMBEDDING} SELECT j AS comp, {rnd('zm', 6)} AS zm FROM zm",
    "reconstruct_rows": f"""{REBUILT}
SELECT r AS row_id, c AS col_id, {rnd("x + mu", 5)} AS value FROM xh JOIN mu USING (c)""",
    "row_residual": f"""{REBUILT}
SELECT xh.r AS row_id, xh.c AS col_id, {rnd("x - coalesce(v, 0) - mu", 5)} AS value
FROM xh JOIN mu USING (c) LEFT JOIN y ON y.r = xh.r AND y.c = xh.c""",
    "column_sums": f"SELECT c AS col_id, round(sum(v), 6) AS value FROM ({ENTRIES}) GROUP BY c",
    "column_sums_rows": f"WITH {EMBEDDING} SELECT c AS col_id, {rnd('sum(v)', 6)} AS value FROM y GROUP BY c",
    "column_means": f"WITH {ORDER_PART} SELECT c AS col_id, {rnd('mu', 6)} AS value FROM mu",
    "column_abs_sums": f"WITH {EMBEDDING} SELECT c AS col_id, {rnd('sum(abs(v))', 6)} AS value FROM y GROUP BY c",
    "vector_sum": f"WITH {EMBEDDING} SELECT c AS col_id, {rnd('sum(v)', 6)} AS value FROM y GROUP BY c",
    "matrix_sum": """
SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, round(sum(l_quantity), 6) AS value
FROM lineitem GROUP BY 1, 2""",
    "cross_product": f"""
WITH {ORDER_PART}
SELECT c AS i, j, {rnd("sum(v * (z - zm))", 4)} AS value
FROM y JOIN z USING (r) JOIN zm USING (j) GROUP BY c, j""",
    "cross_product_tiles": f"""
WITH {ORDER_PART}
SELECT c AS i, j, {rnd("sum(v * (z - zm))", 4)} AS value
FROM y JOIN z USING (r) JOIN zm USING (j) GROUP BY c, j""",
    "mean_correction": CORRECTED,
    "cross_product_scan": CORRECTED,
    "gram_scan": f"""
WITH {ORDER_PART}, zc AS (SELECT r, j, z - zm AS z FROM z JOIN zm USING (j)),
g AS (SELECT a.j AS i, b.j AS j, sum(a.z * b.z) AS x FROM zc a JOIN zc b USING (r) GROUP BY 1, 2),
w AS (SELECT n - (SELECT count(DISTINCT r) FROM y) AS absent FROM n)
SELECT i, g.j, {rnd("x + absent * a.zm * b.zm", 1)} AS value
FROM g JOIN zm a ON a.j = g.i JOIN zm b ON b.j = g.j, w""",
    "gram": f"{GRAM} SELECT i, j, {rnd('x', 4)} AS value FROM g",
    "score_sums": f"WITH {EMBEDDING} SELECT j AS comp, {rnd('sum(z)', 5)} AS value FROM z GROUP BY j",
    "tsqr_r": f"""
WITH {LINEITEM5}, mu AS (SELECT c, avg(v) AS m FROM l GROUP BY c),
k AS (SELECT r, l.c, v - m AS v FROM l JOIN mu USING (c))
SELECT CAST(a.c AS BIGINT) AS i, CAST(b.c AS BIGINT) AS j, {rnd("sum(a.v * b.v)", 2)} AS value
FROM k a JOIN k b USING (r) GROUP BY 1, 2""",
    "trace": f"{GRAM} SELECT {rnd('sum(x)', 4)} AS value FROM g WHERE i = j",
    "total_variation": f"""
WITH {ORDER_PART}, t AS (SELECT sum(v * v) AS q FROM y), s AS (SELECT sum(mu * mu) AS p FROM mu)
SELECT round(q - n * p, 4) AS value FROM t, s, n""",
    "validation_seed": """
SELECT p_partkey AS col_id, j AS comp, CAST((p_partkey + j) % 10 + 1 AS DOUBLE) AS value
FROM part, (SELECT unnest(range(4)) AS j)""",
    "uniform_seed": seeded("u", 11, 1),
    "gaussian_seed": seeded("sqrt(-2 * ln(u)) * cos(2 * pi() * w)", 11, 2),
    "sparse_sign_seed": signed(11, 3),
    "sketch_pca": loadings(),
    "sketch_pca_sparse_sign": loadings(),
    "sketch_pca_sparse_sign_tables": loadings(),
    "sketch_pca_resumed": loadings(),
    "sketch_pca_two_pass": loadings(),
    "sketch_pca_tsqr": loadings(),
    "sketch_pca_joined": sigmas(SUPP_BRAND, 25, 3000, 3),
    "sketch_pca_tables": sigmas(SUPP_BRAND, 25, 3000, 3),
    "sketch_pca_embeddings": sigmas(EMBEDDING_CELLS, 64, 3000, 3),
    "kth_singular_value": one_sigma("sigma"),
    "residual_norm": one_sigma("value"),
    "residual_bound": f"SELECT value, true AS holds FROM ({one_sigma('value')})",
    "relative_error": relative_error(),
    "fit_until_tolerance": sigmas(LINEITEM5, 5, 200, 2),
    "evaluate_components": one_sigma("value"),
    "exact_pca": loadings(),
    "exact_pca_lanczos": loadings(),
    "randomized_pca": loadings(),
}
ORACLE |= {
    "coo_text_drop": """
        SELECT CAST(l_orderkey AS BIGINT) AS row_id, CAST(l_partkey AS BIGINT) AS col_id,
               round(sum(l_quantity), 6) AS value
        FROM lineitem WHERE l_linenumber NOT IN (2, 3, 4) GROUP BY 1, 2
    """,
    "sketch_pca_sparse_brand": sigmas(ORDER_BRAND, 25, 800, 3),
    "sketch_pca_zero_rows": power(ORDER_LINE_TAX, 7, 400, 2) + """
        SELECT CAST(comp AS BIGINT) AS comp, round(sigma, 3) AS sigma, round(sigma, 3) AS sigma_tables FROM top
    """,
    "sketch_pca_two_pass_tables": ORACLE["sketch_pca_two_pass"],
    "sketch_pca_tsqr_tables": ORACLE["sketch_pca_tsqr"],
    "kth_singular_value_tables": ORACLE["kth_singular_value"],
    "residual_norm_tables": ORACLE["residual_norm"],
}
