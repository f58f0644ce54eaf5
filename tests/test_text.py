"""Text and Parquet in and out: formats, numbering over files and blocks, duplicates, bad lines."""

import numpy as np
import pytest
from matrix_tools import array_of, entries_of

import eigenloom as el
from eigenloom.sources.text import _block_bound, numbered_lines

RNG = np.random.default_rng(9)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few lines, packed several to a task, so that numbering has to work for its result."""
    saved = {}
    for key, value in {
        "spark.sql.files.maxPartitionBytes": "64b",
        "spark.sql.files.openCostInBytes": "1b",
    }.items():
        saved[key] = spark.conf.get(key)
        spark.conf.set(key, value)
    yield
    for key, value in saved.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("max_blocks", [1 << 20, 0])
def test_line_numbers_follow_files_and_blocks(spark, tmp_path, small_blocks, monkeypatch, max_blocks):
    monkeypatch.setattr("eigenloom.sources.text.MAX_BLOCKS", max_blocks)
    wanted = []
    for name, n in (("a", 53), ("b", 1), ("c", 17), ("d", 140)):
        lines = [f"{name}{i}" + "x" * int(RNG.integers(0, 30)) for i in range(n)]
        blank = ["" if RNG.random() < 0.3 else "  " for _ in range(n)]
        write(tmp_path / "t" / f"{name}.txt", "\n".join(f"{x}\n{y}" for x, y in zip(lines, blank)))
        wanted += lines
    table = numbered_lines(spark, str(tmp_path / "t"))
    lines = spark.read.text(str(tmp_path / "t"))
    assert lines.rdd.getNumPartitions() > 4
    blocks = lines.select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert 20 < blocks <= _block_bound(lines)
    found = {r["row_id"]: r["value"].strip() for r in table.collect()}
    assert found == dict(enumerate(wanted))


def test_dense_text(spark, tmp_path, small_blocks):
    array = np.round(RNG.standard_normal((40, 6)), 3) * (RNG.random((40, 6)) < 0.6)
    text = "\n\n".join("  " + "\t ".join(repr(float(x)) for x in row) for row in array)
    rows = el.read_dense_text(spark, write(tmp_path / "d.txt", text + "\n"))
    assert np.array_equal(array_of(el.to_entries(rows), array.shape), array)


def test_malformed_dense_text(spark, tmp_path):
    path = write(tmp_path / "d.txt", "1 2\n3 x\n5 6\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        el.read_dense_text(spark, path).collect()
    rows = el.to_entries(el.read_dense_text(spark, path, malformed="drop")).collect()
    assert sorted(r["value"] for r in rows) == [1, 2, 5, 6]
    assert el.rejected_lines(spark, path, "dense").first()["n"] == 1


def test_coo_text_is_merged_by_key(spark, tmp_path, small_blocks):
    """Rows spread over files and lines, one-based, repeated cells."""
    write(tmp_path / "c" / "1.csv", "7,1,1.5\n2,3,2\n7,2,4\n")
    write(tmp_path / "c" / "2.csv", "2,3,5\n7,9,1\n2,1,-1\n")
    path = str(tmp_path / "c")

    def cells(**options):
        df = el.read_coo_text(spark, path, **options)
        return sorted((r["row_id"], r["col_id"], r["value"]) for r in df.collect())

    whole = [(2, 0, -1.0), (2, 2, 7.0), (7, 0, 1.5), (7, 1, 4.0), (7, 8, 1.0)]
    assert cells(base=1) == whole
    assert cells(base=1, on_duplicate="last") == [(2, 0, -1.0), (2, 2, 5.0)] + whole[2:]
    assert len(cells(base=1, on_duplicate="keep")) == 6
    assert cells(base=1, max_col=3) == whole[:-1]  # the bound is on the id as written
    assert cells(base=0, max_col=3) == [(r, c + 1, v) for r, c, v in whole[:-1]]
    assert cells(base=1, n_cols=8) == whole[:-1]  # and this one on the id after rebasing
    with pytest.raises(Exception, match="repeated cell 2 2"):
        cells(base=1, on_duplicate="error")
    with pytest.raises(Exception, match="column id below the base: -1"):
        cells(base=2)
    with pytest.raises(ValueError):
        cells(on_duplicate="first")


def test_last_follows_file_order_over_blocks(spark, tmp_path, small_blocks):
    lines = [f"{int(RNG.integers(0, 3))},0,{i}" for i in range(200)]
    write(tmp_path / "c" / "1.csv", "\n".join(lines[:90]) + "\n")
    write(tmp_path / "c" / "2.csv", "\n".join(lines[90:]) + "\n")
    df = el.read_coo_text(spark, str(tmp_path / "c"), on_duplicate="last")
    wanted = {int(x.split(",")[0]): float(x.split(",")[2]) for x in lines}
    assert {r["row_id"]: r["value"] for r in df.collect()} == wanted


def test_malformed_coo_text(spark, tmp_path):
    path = write(tmp_path / "c.csv", "0,0,1\n0,one,2\n1,1,3\n")
    with pytest.raises(Exception, match="not row,col,value"):
        el.read_coo_text(spark, path).collect()
    assert el.read_coo_text(spark, path, malformed="drop").count() == 2
    assert el.rejected_lines(spark, path, "coo").first()["n"] == 1


def test_components_text(spark, tmp_path):
    path = write(tmp_path / "v.txt", "[1.5,-2.0]\n\n[0.25, 1e-3]\n[0,7]\n")
    v = array_of(el.read_components(spark, path), (3, 2), "col_id", "comp")
    assert v.tolist() == [[1.5, -2.0], [0.25, 1e-3], [0, 7]]
    one = write(tmp_path / "one.txt", "[3.0]\n[4.0]\n")
    assert array_of(el.read_components(spark, one), (2, 1), "col_id", "comp").tolist() == [[3], [4]]


def text_of(path):
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    return "".join(p.read_text() for p in parts)


ARRAY = np.array([[0, 1.5, 0], [0, 0, 0], [-2, 0, 1e-5]])


def test_formats(spark, tmp_path):
    matrix = entries_of(spark, ARRAY)
    for i, table in enumerate((matrix, el.to_rows(matrix))):
        base = tmp_path / str(i)
        el.write_matrix(table, "DENSE", str(base / "dense"), n_cols=3, n_rows=3)
        assert text_of(base / "dense" / "PCs.txt") == "0.0 1.5 0.0 \n0.0 0.0 0.0 \n-2.0 0.0 1.0E-5 \n"
        el.write_matrix(table, "LIL", str(base / "lil"), n_rows=3)
        assert text_of(base / "lil" / "PCs.txt") == "{1:1.5}\n{}\n{0:-2.0,2:1.0E-5}\n"
        el.write_matrix(table, "COO", str(base / "coo"))
        assert text_of(base / "coo" / "PCs.txt") == "0,1,1.5\n2,0,-2.0\n2,2,1.0E-5\n"
        target = el.write_matrix(table, "PARQUET", str(base / "parquet"))
        back = el.read_matrix(spark, target, partitions=3)
        assert back.rdd.getNumPartitions() == 3
        assert np.array_equal(array_of(el.to_entries(back), (3, 3)), ARRAY)
    with pytest.raises(ValueError):
        el.write_matrix(matrix, "CSV", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        el.write_matrix(matrix, "DENSE", str(tmp_path / "x"))


def test_fit_is_written_and_read_back(spark, tmp_path):
    array = RNG.standard_normal((30, 4)) * [9, 5, 2, 1]
    fit = el.sketch_pca(entries_of(spark, array), 2, oversample=2, max_iter=1)
    path = el.write_matrix(fit.components, "DENSE", str(tmp_path / "v"), n_cols=2)
    back = array_of(el.to_entries(el.read_dense_text(spark, path)), (4, 2))
    assert np.array_equal(back, array_of(fit.components, (4, 2), "col_id", "comp"))
    el.write_components_text(fit.components, str(tmp_path / "c"), 2, 4)
    stored = array_of(el.read_components(spark, str(tmp_path / "c")), (4, 2), "col_id", "comp")
    assert np.array_equal(stored, back)
