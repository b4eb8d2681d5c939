"""Whitening against numpy's own decomposition and exact integers."""

import math
import random

import numpy as np
import pytest

from tracelake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, component int, n int, deviation string, whitened int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)


def expected(vectors, components=32):
    """(n, deviations, whitened, explained) of vectors in a list, in plain Python integers and numpy."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], centred @ v / np.sqrt(np.maximum(e, 1e-300)), e / (centred**2).sum() * n


def compare(rows, ids, vectors, components):
    n, deviations, whitened, explained = expected(vectors, components)
    have = {(r["id"] if "id" in r else r["vec_id"], r["component"]): r for r in (x.asDict() for x in rows)}
    assert len(have) == len(ids) * components == len(rows)
    for c in range(components):
        mine = np.array([have[i, c + 1]["whitened"] for i in ids])
        sign = np.sign((mine * whitened[:, c]).sum())
        assert np.allclose(mine, sign * whitened[:, c], atol=1e-7)
    for i, d in zip(ids, deviations, strict=True):
        r = have[i, 1]
        assert (r["n"], int(r["deviation"])) == (n, d) and r["identity_error"] < 1e-8
    assert all(math.isclose(have[ids[0], c + 1]["explained"], explained[c], rel_tol=1e-9) for c in range(components))


def test_whitening_equals_plain_numpy(spark):
    r = np.random.default_rng(3)
    vectors = [*(r.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5] @ r.normal(size=(6, 6)) + 100).tolist()]
    odd = [(900, None), (901, [1.0] * 5 + [None]), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 6)]
    rows = whitening.whiten(table(spark, [*enumerate(vectors), *odd]).repartition(4)).collect()
    compare(rows, list(range(300)), vectors, 6)


@pytest.mark.parametrize("n, spread", [(50, 1e3), (50, 1e11), (2000, 3.0)])
def test_deviations_are_exact(spark, n, spread):
    r = random.Random(n)
    vectors = [[r.uniform(-spread, spread) for _ in range(3)] for _ in range(n)]
    have = {r.id: r for r in whitening.whiten(table(spark, enumerate(vectors))).where("component = 1").collect()}
    _, deviations, _, _ = expected(vectors)
    assert all((int(have[i].deviation) if have[i].deviation is not None else None) == (d if d < 10**38 else None) for i, d in enumerate(deviations))


@pytest.mark.parametrize("n", [1, 7, 1 << 20, 1 << 33, 1 << 50])
def test_squares(n):
    r = np.random.default_rng(5)
    near, rest = r.integers(-(1 << 12), 1 << 12, (20, 9)), r.integers(0, n, 9)
    want = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in near]
    assert whitening._squares(near, rest, n) == want


def test_columns_without_variance_have_no_component(spark):
    r = random.Random(1)
    vectors = [(i, [a := r.gauss(0, 1), b := r.gauss(0, 2), a, 7.0, a + b]) for i in range(200)]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert {r.component for r in rows} <= {1, 2, 3, 4} and {1, 2} <= {r.component for r in rows}


def test_no_variance_and_empty_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 == whitening.whiten(table(spark, [(1, None)])).count()
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0 == whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).count()


def test_repeated_rows_and_null_ids(spark):
    vectors = [(None if i % 7 == 0 else i % 11, [float(i % 5), float(i * i % 13)]) for i in range(60)]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert len(rows) == 120 and sum(r.id is None for r in rows) == 2 * sum(i is None for i, _ in vectors)


def test_query_on_the_whole_table(spark, sf_dir):
    found = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = [(i, v) for i, v in found if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    compare(queries.QUERIES["op13_whitening"](spark, sf_dir).collect(), [i for i, _ in found], [v for _, v in found], 32)
