"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {
    "op1_block_naming": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op4_column_bwt": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
        w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s
              FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM n WHERE n >= 50)),
        m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
        hit AS (SELECT w.doc_id, i FROM w JOIN m USING (s) WHERE first < w.doc_id),
        new AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
                FROM hit),
        run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM new),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, run),
        gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a FROM span
                UNION ALL SELECT n.doc_id, coalesce(max(b), 0), max(n.n) FROM n LEFT JOIN span USING (doc_id) GROUP BY n.doc_id),
        kept AS (SELECT gap.doc_id, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY p) AS k
                 FROM gap JOIN n USING (doc_id) GROUP BY gap.doc_id),
        gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(k)) AS kept_sha256
        FROM n JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
    """,
    "op7_debruijn_spans": """
        WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 35), ' ') AS s
              FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM n WHERE len(w) >= 35)),
        m AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
        hit AS (SELECT doc_id, i FROM s JOIN m USING (s)),
        new AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 35 THEN 0 ELSE 1 END AS new
                FROM hit),
        run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM new),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 35 AS b FROM run GROUP BY doc_id, run),
        gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a FROM span
                UNION ALL SELECT n.doc_id, coalesce(max(b), 0), max(len(n.w)) FROM n LEFT JOIN span USING (doc_id) GROUP BY n.doc_id),
        kept AS (SELECT gap.doc_id, string_agg(array_to_string(list_slice(w, p + 1, a), ' '), ' ' ORDER BY p) AS k
                 FROM gap JOIN n USING (doc_id) WHERE a > p GROUP BY gap.doc_id),
        gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed FROM span GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(k, '')) AS kept_sha256
        FROM n LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
    """,
    "op11_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
        h AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1,
                     CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3,
                     CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM u),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                               OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS prefix, array_to_string(list_slice(w, a + 1, b), '') AS middle,
                     array_to_string(list_slice(w, b + 1, n), '') AS suffix FROM c)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}
