"""Near-duplicate embeddings against brute force, and queries against their SQL."""

import numpy as np
import pytest
from compare import compare, duck

from descry.llm import embeddings
from descry.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    near = embeddings.nearest_points(y)
    assert ((2 * near) % 1 == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    for step in embeddings.minimal_vectors():
        assert (((y - near) ** 2).sum(1) <= ((y - near - step) ** 2).sum(1) + 1e-12).all()


def linked(vectors):
    """Links and the least reachable id of each vector, by all pairs."""
    usable = [
        v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v in vectors
    ]
    n = len(vectors)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = np.array(vectors[i][1], float), np.array(vectors[j][1], float)
                near[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
    least = {}
    for i, (vec_id, _) in enumerate(vectors):
        ids = [x for x in (least.get(label[i]), vec_id) if x is not None]
        least[label[i]] = min(ids) if ids else None
    return [(v, int(near[i].sum()), least[label[i]]) for i, (v, _) in enumerate(vectors)]


@pytest.mark.parametrize("chunk", [1024, 4])
def test_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=24)
        for _ in range(int(rng.choice([1, 3, 12]))):
            rows.append((centre + rng.normal(size=24) * 0.12 * rng.random()).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], rows[5][:23]]
    vectors = [(100 - i, r) for i, r in enumerate(rows)]
    vectors += [
        (500, None), (501, []), (502, [0.0] * 24), (503, [None] + [1.0] * 23), (504, [float("nan")] * 24),
        (505, [float("inf")] + [1.0] * 23), (None, rows[2]), (None, None), (100, rows[0]),
        (506, [1e-200 * x for x in rows[3]]), (507, [1e200 * x for x in rows[3]]),
    ]
    df = spark.createDataFrame(
        [(v, e, "own", "own") for v, e in vectors],
        "vec_id long, embedding array<double>, node string, n_links string",
    )
    found = sorted(map(str, ((r[0], r[1], r[2]) for r in embeddings.near_duplicate_vectors(df).collect())))
    # 1e-200 and 1e200 are brought to size before they are squared
    plain = [(v, rows[3] if v in (506, 507) else e) for v, e in vectors]
    expected = sorted(map(str, linked(plain)))
    same = sum(a == b for a, b in zip(found, expected))
    assert len(found) == len(expected) and same >= 0.97 * len(expected)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=(2000, 64))
    g -= (g * x).sum(1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * g
    met = np.zeros(2000, bool)
    for turn in range(embeddings.TABLES):
        a, b = (embeddings.cells(v, turn, 0.9) for v in (x, y))
        met |= (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    assert met.mean() >= 0.97


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    actual, expected = compare(spark, duck(FOLDER), QUERIES[name], SQL[name], FOLDER)
    assert actual == expected
