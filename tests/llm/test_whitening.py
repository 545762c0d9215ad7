"""Whitening against numpy's eigenvalues, exact integers, and odd vectors."""

import math

import numpy as np
import pytest

from slowtrace.llm import whitening
from slowtrace.llm.whitening import eigenvectors, leading_components, leading_eigenvalues, sturm_count, tridiagonal

rng = np.random.default_rng(4)


def matrices():
    basis = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    close = np.concatenate([[5, 5, 5, 5 - 1e-13, 5 - 1e-9, 4], np.linspace(1, 3, 34)])
    spread = 10.0 ** -np.arange(40)
    return {
        "random": (lambda a: a @ a.T)(rng.normal(size=(30, 30))), "equal": basis @ np.diag(close) @ basis.T,
        "spread": basis @ np.diag(spread) @ basis.T, "diagonal": np.diag([3.0, 1, 3, 2, 0]), "zero": np.zeros((4, 4)),
        "one": np.array([[2.5]]), "two": np.array([[2.0, 1], [1, 2]]), "rank one": np.ones((6, 6)),
        "tiny": 1e-200 * np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]]), "negative": -np.eye(3),
    }


@pytest.mark.parametrize("name", matrices())
def test_components(name):
    matrix = matrices()[name]
    matrix = (matrix + matrix.T) / 2
    n = len(matrix)
    values, vectors = leading_components(matrix, n)
    norm = max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=0, atol=1e-13 * norm * n)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * norm * n


def test_tridiagonal_is_similar():
    matrix = matrices()["random"]
    diagonal, off, steps = tridiagonal(matrix)
    small = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    q = np.eye(len(matrix))
    for v in steps:
        q = q @ (np.eye(len(matrix)) - 2 * np.outer(v, v))
    assert np.abs(q @ small @ q.T - matrix).max() < 1e-12


def test_sturm_counts():
    diagonal, off = rng.normal(size=25), rng.normal(size=24)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.concatenate([(values[1:] + values[:-1]) / 2, [values[0] - 1, values[-1] + 1]])
    assert sturm_count(diagonal, off, at).tolist() == [int((values < a).sum()) for a in at]
    assert np.allclose(leading_eigenvalues(diagonal, off, 3), values[::-1][:3])
    found = eigenvectors(diagonal, off, values[::-1].copy())
    assert np.abs(found.T @ found - np.eye(25)).max() < 1e-12


SCHEMA = "vec_id long, embedding array<float>, n long, x string, component int, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 0.5) for i, v in rows], SCHEMA)


def by_hand(rows, k):
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = (exact / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return (exact * exact).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(cov)


def test_whitened_rows(spark):
    vectors = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(300, 12)) @ np.diag(np.arange(1, 13)) + 3]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7]), (7, vectors[7])]
    odd = [(900, None), (901, [1.0, None, *[0.0] * 10]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0])]
    got = whitening.whiten(frame(spark, rows + odd), components=5).collect()
    assert len(got) == 5 * len(rows) and {r["vec_id"] for r in got} == {i for i, _ in rows}
    assert {r["n"] for r in got} == {len(rows)}
    deviation, white, explained = by_hand(rows, 5)
    sign = {}
    at = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        k, c = at[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == deviation[k] and abs(r["explained"] - explained[c]) < 1e-12 and r["identity_error"] < 1e-9
        if abs(white[k, c]) > 1e-6:
            sign.setdefault(c, np.sign(white[k, c] * r["whitened"]))
        assert abs(r["whitened"] * sign.get(c, 1) - white[k, c]) < 1e-9


def test_null_id_ties_and_length(spark):
    """Of two lengths equally common the longer counts; a null id is a row like any other."""
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [5.0]), (3, [6.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {None, 1} and {r["component"] for r in got} == {1}
    assert sorted(r["whitened"] for r in got) == pytest.approx([-1, 1])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    """No rows, or rows without variance: no component can be scaled."""
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(0, [2.0 ** 35, 1.0]), (1, [-(2.0 ** 35), 2.0]), (2, [0.0, 3.0]), (3, [1e30, 0.0])]
    got = whitening.whiten(frame(spark, rows), components=2).collect()
    deviation, _, _ = by_hand(rows[:3], 1)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: (d if d < 2 ** 63 else None) for (i, _), d in zip(rows, deviation)}


def test_dimension_without_variance(spark):
    rows = [(i, [float(i), 4.0, float(-i), float(i * i % 7)]) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-9 for r in got)
