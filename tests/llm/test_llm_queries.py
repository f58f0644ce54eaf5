"""The registered queries against SQL, and the pipeline against a plain version, at the smallest scale."""

import check
import corpus_pipeline
import pytest
from eigenloom.llm.oracle import ORACLE
from eigenloom.llm.queries import QUERIES
from eigenloom.session import as_table, scratch_path
from pyspark.sql import functions as F
from test_llm_near import plain as plain_near

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert check.compare(spark, check.database(SF), name, SF) == []


def test_pipeline(spark):
    """Stage by stage on what the one before kept; rows of the last cover every document left, whole."""
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = as_table(stage(spark, docs, SF), scratch_path(spark, name))
        assert docs.columns == first.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    every = {r.doc_id: r.text for r in first.collect()}
    language, exact, near, private = kept
    assert language == {i: t for i, t in every.items() if any(c.isalpha() for c in t or "")}
    last = {t: i for i, t in sorted(language.items())}
    assert exact == {i: t for t, i in last.items()}
    assert set(near) == {c for _, c, _ in plain_near(list(exact.items()))}
    assert set(private) == set(near)
    pieces = corpus_pipeline.run(spark, SF).select("doc_id", "length", "doc_tokens").collect()
    assert {p.doc_id for p in pieces} == set(private)
    total = {}
    for p in pieces:
        total.setdefault(p.doc_id, [0, p.doc_tokens])[0] += p.length
    assert all(a == b for a, b in total.values())


def test_pipeline_keeps_short_texts(spark, tmp_path):
    """Texts of one to three letters, and of no known n-gram, have a language and stay to the end."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = ["A.", "De.", "Re.", "x", "Ой", "語", "ȹȸȹȸȹȸȹȸ ȹȸȹȸȹȸȹȸ"]
    rows = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = rows.select(*[rows[c] if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    docs.limit(60).unionByName(rows).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert {10**9 + k for k in range(len(texts))} <= kept
