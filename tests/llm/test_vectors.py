"""Links between vectors against all pairs."""

import numpy as np
import pytest

from flowlucid.llm.queries import op4_embedding_near_dedup
from flowlucid.llm.vectors import fit_pivots, shared_keys, vector_links

from ..conftest import SMALL


def plain(rows, least=0.98):
    """Links by brute force: (id, vector or None, label) rows."""
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = [0] * len(rows), list(range(len(rows)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for lab in {rows[i][2] for i in good}:
        for size in {len(rows[i][1]) for i in good if rows[i][2] == lab}:
            at = [i for i in good if rows[i][2] == lab and len(rows[i][1]) == size]
            x = np.array([rows[i][1] for i in at], float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for a, b in np.argwhere(np.triu(x @ x.T >= least, 1)):
                links[at[a]] += 1
                links[at[b]] += 1
                up[find(at[a])] = find(at[b])
    least_id = {}
    for i, (d, _, _) in enumerate(rows):
        least_id[find(i)] = min(d, least_id.get(find(i), d))
    return {d: (n, least_id[find(i)], least_id[find(i)] == d) for i, ((d, _, _), n) in enumerate(zip(rows, links))}


def made(seed, n=600, dims=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, dims))
    rows = []
    for i in range(n):
        v = base[rng.integers(30)] + rng.normal(size=dims) * rng.choice([0, 0.02, 0.12, 1.0])
        rows.append((i + 5, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return rows


def test_recall_and_no_false_links(spark):
    rows = made(1)
    want = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values())


def test_query_rows(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op4_embedding_near_dedup(spark, SMALL).collect()} == plain(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [2.0, 0.0], 1), (5, [2.0, 0.0], 2), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (10, [inf, 1.0], 1),
            (11, [None, 1.0], 1), (12, [1.0, 0.0], None), (13, [], 1), (14, [1.0, 0.0, 0.0], 1), (15, [1.0], 1), (16, [-1.0], 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links(docs).collect()} == plain(rows)
    twice = vector_links(docs.filter("vec_id = 3").union(docs.filter("vec_id = 3")).union(spark.createDataFrame([(None, [2.0, 0.0], 1, "y")], docs.schema))).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in twice) == [("3", 2, 3), ("3", 2, 3), ("None", 2, 3)]
    assert vector_links(docs.limit(0)).count() == 0


def clustered(seed, n, dims, spread):
    """A third of the rows near one point, no two equal, the rest anywhere."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    third = n // 3
    noise = rng.normal(size=(third, dims))
    x[:third] = x[0] + spread * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    return [(i, [float(np.float32(v)) for v in x[j]], 1) for i, j in enumerate(rng.permutation(n))]


@pytest.mark.parametrize("dims", [16, 64])
def test_recall_in_a_hot_cluster(spark, dims):
    rows = clustered(dims, 2400, dims, 0.13)
    want = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values())
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dims", [64, 384])
@pytest.mark.parametrize("kind,most", [("anywhere", 0.02), ("common direction", 0.1), ("twenty clusters", 0.85)])
def test_lists_stay_short_and_similar_vectors_meet(kind, most, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(5000, dims))
    if kind == "common direction":
        x += 3
    if kind == "twenty clusters":
        x = rng.normal(size=(20, dims))[rng.integers(20, size=5000)] + 0.3 * x
    x = unit(x)
    aside = rng.normal(size=(600, dims))
    aside = unit(aside - (aside * x[:600]).sum(1, keepdims=True) * x[:600])
    near = rng.uniform(0.98, 1, size=(600, 1))
    x = rng.permutation(np.concatenate([x, near * x[:600] + np.sqrt(1 - near * near) * aside]))
    pivots = fit_pivots(x[:4096])
    nearest = pivots.nearest(x)
    sizes = np.unique(shared_keys(nearest, pivots.shared), return_counts=True)[1].astype(float)
    assert (sizes * sizes).sum() <= most * len(x) ** 2
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    met = (nearest[a][:, :, None] == nearest[b][:, None, :]).any(2).sum(1) >= pivots.shared
    assert met.mean() >= 0.97


def test_links_of_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 48)) + 3
    rows = [(i, [float(np.float32(v)) for v in x], 1) for i, x in enumerate(np.concatenate([base, base[:300] + 0.15 * rng.normal(size=(300, 48))]))]
    want = plain(rows)
    got = {r.vec_id: r.n_links for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[k] <= want[k][0] for k in want)
    assert sum(got.values()) >= 0.97 * sum(v[0] for v in want.values()) > 0


def test_pivots_of_equal_and_opposite_vectors():
    same = np.ones((300, 4)) / 2
    for sample in (same, np.concatenate([same, -same]), np.eye(1, 4)):
        pivots = fit_pivots(sample)
        assert (pivots.nearest(sample[:1]) == pivots.nearest(sample[:1])).all() and len(pivots.points) >= 1


def test_every_vector_length_is_linked(spark):
    rows = [(2 * w + i, [1.0 + i] * w, 1) for w in range(2, 82) for i in range(2)] + [(1000 + w, [1.0] * (w - 1) + [1.01], 1) for w in range(2, 82)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == plain(rows)
