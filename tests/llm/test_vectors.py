import numpy as np
import pytest

from variscope.llm.components import components
from variscope.llm.vectors import near_vectors


def cases():
    rng = np.random.default_rng(4)
    rows, x = [], rng.normal(size=(400, 32))
    for i, v in enumerate(x):
        rows.append((i, v.tolist()))
    for i in range(60):
        rows.append((1000 + i, (x[i] + 0.1 * rng.normal(size=32)).tolist()))
    rows += [(2000 + i, x[0].tolist()) for i in range(700)] + [(3000 + i, (x[1] + 0.05 * rng.normal(size=32)).tolist()) for i in range(700)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [float("nan")] * 32), (5004, [None] + [1.0] * 31), (5005, [float("inf")] + [1.0] * 31), (5006, [1.0, 2.0])]
    return rows, odd


def test_equals_brute_force(spark):
    rows, odd = cases()
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i]["n_links"] for i, _ in rows)
    assert all(got[i]["n_links"] <= n for (i, _), n in zip(rows, links.sum(1), strict=True))
    assert found >= 0.99 * links.sum()
    assert got[2005]["component_id"] == 0 and not got[2005]["kept"] and got[0]["kept"] and got[3005]["component_id"] == 1
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in odd)


@pytest.mark.parametrize("size", [4, 16, 32, 64])
def test_pairs_at_the_threshold_are_found(spark, size):
    """Pairs planted at cosines of 0.90 to 0.93, with a common mean, against brute force."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(600, size)) + 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, (600, 1))
    x = np.vstack([x, cos * x + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df).collect()}
    assert links.sum() >= 1190 and all(got[i] <= n for i, n in enumerate(links.sum(1)))
    assert sum(got.values()) >= 0.985 * links.sum(), sum(got.values()) / links.sum()


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 1


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(500)] + [(7, 7)]
    want = {}
    for a, b in pairs:
        want.setdefault(a, a), want.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(want[a], want[b])
            changed |= (want[a], want[b]) != (low, low)
            want[a] = want[b] = low
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
