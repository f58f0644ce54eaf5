"""Stored tiles, starts computed from ids, resumed fits, samples of wide ids."""

import warnings

import eigenloom as el
import numpy as np
import pytest
from eigenloom.functions.seeds import sign_vectors
from eigenloom.plans import tiles as tiles_of
from eigenloom.plans.tiles import Tiles
from matrix_tools import array_of, components_of, entries_of
from pyspark.sql import functions as F


def skewed(seed=0):
    """A column and a row that hold a third of the cells each, ids far from zero."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((60, 41)) * (rng.random((60, 41)) < 0.06)
    a[:, 7] = rng.standard_normal(60)
    a[11, :] = rng.standard_normal(41)
    return a


def packed(spark, array):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(array)]
    return spark.createDataFrame(rows, "col_id int, vec array<double>")


@pytest.mark.parametrize("columns", [1, 5, 100])
@pytest.mark.parametrize("most", [1, 17, 1 << 20])
def test_products_of_tiles(spark, monkeypatch, columns, most):
    monkeypatch.setattr(tiles_of, "TILE_CELLS", most)
    monkeypatch.setattr(tiles_of, "CHUNK_CELLS", 9)
    monkeypatch.setattr(tiles_of, "MOST_BUCKETS", 7)
    a, m = skewed(), np.random.default_rng(1).standard_normal((41, 3))
    if columns == 1 and most == 1:
        a = a[:12, :12]
        m = m[:12]
    tiles = Tiles.store(entries_of(spark, a, 3), 3, columns)
    scores = tiles.project(packed(spark, m), 3).cache()
    vec = {r.row_id: r.vec for r in scores.collect()}
    present = np.flatnonzero((a != 0).any(axis=1))
    assert sorted(vec) == present.tolist()
    z = np.array([vec[i] for i in present])
    assert np.allclose(z, (a @ m)[present])
    touched = {r.row_id: sorted(r.blocks) for r in scores.collect()}
    assert all(touched[i] == sorted({int(c) // tiles.columns for c in np.flatnonzero(a[i])}) for i in present)
    cross = {r.col_id: r.vec for r in tiles.cross(scores, 3).collect()}
    assert np.allclose(np.array([cross.get(j, [0.0] * 3) for j in range(a.shape[1])]), a.T @ (a @ m))
    assert np.allclose(array_of(tiles.cells().withColumn("i", F.lit(0)), (1, a.shape[1]), "i"), a.sum(axis=0))
    tiles.drop()


def test_a_pass_exchanges_no_cells(spark, capsys):
    a = skewed()
    tiles = Tiles.store(entries_of(spark, a), 3, 5)
    plans = [tiles.project(packed(spark, np.ones((41, 3))), 3)]
    plans.append(tiles.cross(plans[0], 3))
    plans.append(tiles.project_seed(lambda ids: sign_vectors(ids, 3, 0, 8), 3))
    for df in plans:
        df.explain()
        lines = capsys.readouterr().out.splitlines()
        scans = [k for k, line in enumerate(lines) if tiles.name in line]
        assert scans
        for k in scans:
            # From the scan up to the operator on tiles: a sort and a projection, no exchange.
            above = []
            for line in reversed(lines[:k]):
                if "InArrow" in line:
                    break
                above.append(line)
            assert not any("Exchange" in line for line in above)
            assert "Bucketed: true" in lines[k]
    tiles.drop()


def test_no_cells(spark):
    tiles = Tiles.store(spark.createDataFrame([], "row_id long, col_id int, value double"), 2)
    scores = tiles.project(packed(spark, np.ones((3, 2))), 2)
    assert scores.collect() == [] and tiles.cross(scores, 2).collect() == []
    tiles.drop()


def decaying(n=80, d=30):
    rng = np.random.default_rng(5)
    u, v = (np.linalg.qr(rng.standard_normal((m, d)))[0] for m in (n, d))
    return (u * 2.0 ** -np.arange(d)) @ v.T


@pytest.mark.parametrize("start", ["sparse_sign", "count_sketch"])
@pytest.mark.parametrize("method, limit", [("fused", 1 << 20), ("fused", 0), ("two_pass", 0), ("tsqr", 0)])
def test_sign_starts(spark, start, method, limit):
    """As close as a normal start, within one pass more."""
    a = decaying()
    right = np.linalg.svd(a - a.mean(axis=0), compute_uv=False)[:3]
    matrix = entries_of(spark, a)
    options = dict(oversample=5, n_rows=80, n_cols=30, method=method, limit=limit)
    normal = el.sketch_pca(matrix, 3, max_iter=2, **options)
    signs = el.sketch_pca(matrix, 3, max_iter=3, start=start, **options)
    assert np.abs(signs.sigma - right).max() <= max(np.abs(normal.sigma - right).max(), 1e-10)
    with pytest.raises(ValueError, match="start"):
        el.sketch_pca(matrix, 3, start="other")


def test_sign_vectors_are_those_of_the_table(spark):
    for seed, width, nonzeros in ((0, 4, 1), (7, 5, 8), (123, 20, 3)):
        table = el.sparse_sign_seed(el.column_range(spark, 300), width, seed, nonzeros)
        found = sign_vectors(np.arange(300), width, seed, nonzeros)
        assert np.allclose(array_of(table, (300, width), "col_id", "comp"), found)
        assert np.allclose((np.abs(found) > 0).sum(axis=1).max(), min(width, nonzeros), atol=width)
    assert abs(found.T @ found / 300 * 20 - np.eye(20)).max() < 0.5


@pytest.mark.parametrize("method, limit", [("fused", 1 << 20), ("tsqr", 1 << 20), ("fused", 0)])
def test_a_fit_goes_on_in_a_new_session(spark, tmp_path, method, limit):
    matrix = entries_of(spark, decaying())
    options = dict(oversample=2, n_rows=80, n_cols=30, method=method, limit=limit)
    whole = el.sketch_pca(matrix, 3, max_iter=4, **options)
    path = str(tmp_path / "journal")
    el.sketch_pca(matrix, 3, max_iter=2, journal=path, **options)
    other = entries_of(spark.newSession(), decaying())
    fit = el.sketch_pca(other, 3, max_iter=4, journal=path, **options)
    assert fit.passes == 4 and len(fit.pass_seconds) == 2
    assert np.allclose(fit.sigma, whole.sigma, rtol=1e-12)
    assert np.allclose(components_of(fit, 30), components_of(whole, 30), atol=1e-9)
    again = el.sketch_pca(matrix, 3, max_iter=4, journal=path, **options)
    assert not again.pass_seconds and np.allclose(again.sigma, fit.sigma, rtol=0)
    with pytest.raises(ValueError, match="another fit"):
        el.sketch_pca(matrix, 2, max_iter=4, journal=path, **options)


def test_a_pass_that_died_is_done_again(spark, tmp_path, monkeypatch):
    """The driver dies between a pass's tables and its row: the pass does not count."""
    from eigenloom.plans.journal import Journal

    matrix, path = entries_of(spark, decaying()), str(tmp_path / "journal")
    options = dict(oversample=2, n_rows=80, n_cols=30, max_iter=3, next_sigma=1e-4, tolerance=1e-9, norm_iter=2)
    commit, calls = Journal.commit, []

    def dying(self, number, factor, means, sigma, errors, n_rows):
        calls.append(number)
        if number == 2:
            factor.write.parquet(f"{self.path}/pass-0002-dead/factor")
            raise KeyboardInterrupt
        commit(self, number, factor, means, sigma, errors, n_rows)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        monkeypatch.setattr(Journal, "commit", dying)
        with pytest.raises(KeyboardInterrupt):
            el.sketch_pca(matrix, 3, journal=path, **options)
        monkeypatch.setattr(Journal, "commit", commit)
        fit = el.sketch_pca(matrix, 3, journal=path, **options)
        whole = el.sketch_pca(matrix, 3, **options)
    assert calls == [1, 2] and fit.passes == 3 and len(fit.pass_seconds) == 2
    assert np.allclose(fit.errors, whole.errors) and np.allclose(fit.sigma, whole.sigma, rtol=1e-12)


def test_partitions_do_not_share_their_draws(spark):
    ids = spark.range(1024).select(F.col("id").alias("row_id"))
    draws = []
    for part in (0, 1, 2, 1 << 20):
        wide = ids.select((F.col("row_id") + (part << 33)).alias("row_id"))
        taken = el.sample_rows(wide, 0.5, seed=3).collect()
        draws.append({r.row_id - (part << 33) for r in taken})
    # Half of the rows each, in sets that a map n -> n ^ c does not turn into one another.
    assert all(400 < len(d) < 620 for d in draws)
    for d in draws[1:]:
        assert max(len({n ^ c for n in d} & draws[0]) for c in range(1024)) < 400
