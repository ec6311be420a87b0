"""Centroid clustering against plain whole-number k-means."""

import hashlib

import numpy as np
import pytest

from neurotab.llm import queries, vafile

D = 64


def slow(rows, k=40, rounds=5, d=D):
    """[(id, cluster, distance)], centroids of (id, vector) rows."""
    kept = [(i, tuple(int(np.floor(float(v) * 256)) for v in x)) for i, x in rows
            if x is not None and len(x) == d and all(v is not None and np.isfinite(v) for v in x)]
    if not kept:
        return [], []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = np.array([x for _, x in sorted(kept, key=key)[:k]], object)
    x = np.array([v for _, v in kept], object)
    distances = lambda: np.array([[sum((a - c) ** 2) for c in centroids] for a in x], object)
    for _ in range(rounds):
        own = distances().argmin(1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].sum(0) // int((own == c).sum())
    own, dist = distances().argmin(1), distances()
    return [(i, int(c), int(dist[n, c])) for n, ((i, _), c) in enumerate(zip(kept, own))], centroids


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    expected, centroids = slow(rows)
    got = queries.QUERIES["op11_centroid_clustering"](spark, path).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(expected)
    total = {c: sum(d for _, q, d in expected if q == c) for c in range(40)}
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (total[r["cluster"]], sum(total.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def run(spark, rows, **how):
    df = spark.createDataFrame([(x, i, "q") for i, x in rows], "embedding array<float>, vec_id long, cluster string")
    out, model = vafile.cluster(df, **how)
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in out.collect())), model


def cases(rows):
    return sorted((i is None, i or 0, c, d) for i, c, d in rows)


def test_cases(spark, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(vafile, "BLOCK", 50)
    near = [(i, (rng.normal(size=4) * 0.2 + 3 * rng.integers(0, 4, 4)).tolist()) for i in range(300)]
    odd = [(1000, None), (1001, [1.0] * 3), (1002, [1.0, None, 0.0, 0.0]), (1003, [float("nan")] * 4), (1004, [float("-inf"), 0.0, 0.0, 0.0]), (1005, [])]
    twice = [(7, near[7][1]), (8, near[9][1]), (None, near[3][1]), (None, [0.0] * 4), *[(2000 + i, [0.5] * 4) for i in range(200)]]
    rows = near + odd + twice
    got, model = run(spark, rows, dimensions=4, centroids=12)
    assert got == cases(slow(rows, 12, 5, 4)[0])
    # cells decide most vectors, and later rounds move few
    assert model.fetched[-1] < 504 and model.moved[0] == 504 and model.moved[-1] < 504


def test_few_and_equal_vectors(spark):
    assert run(spark, [], dimensions=2) == ([], None)
    assert run(spark, [(1, None)], dimensions=2) == ([], None)
    rows = [(5, [1.0, -1.0]), (6, [1.0, -1.0]), (7, [2.0, 0.5])]
    got, model = run(spark, rows, dimensions=2)
    assert got == cases(slow(rows, 40, 5, 2)[0]) and len(model.centroids) == 3  # the equal one stays empty
    with pytest.raises(Exception, match="2\\^26"):
        run(spark, [(1, [1e9, 0.0])], dimensions=2)


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-200, 200, (500, 7)), rng.integers(-300, 300, (9, 7))
    cells = vafile.Cells.between([sorted(rng.integers(-200, 200, 63).tolist()) for _ in range(7)], x.min(0).tolist(), x.max(0).tolist())
    codes = cells.of(x)
    assert (vafile.unpacked(vafile.packed(codes), 7) == codes).all() and vafile.packed(codes).shape == (500, 6)
    least, most = cells.intervals(codes, c)
    true = ((x[:, None] - c) ** 2).sum(2)
    shared = ((x - np.array(cells.middle)) ** 2).sum(1)[:, None]
    assert (least + shared <= true).all() and (true <= most + shared).all()
    found, fetched = vafile.nearest(cells, codes, c, lambda which: x[which])
    assert (found == true.argmin(1)).all() and 0 < len(fetched) < 200


def test_store_that_cannot_be_mapped(tmp_path):
    x = np.arange(60, dtype="<i2").reshape(15, 4)
    (tmp_path / "v").write_bytes(x.tobytes())
    vectors = vafile.Vectors(f"file://{tmp_path}/v", "<i2", 4)
    want = vectors.rows(5, 6, np.array([0, 3, 5]))
    vectors.map = None
    assert (vectors.rows(5, 6, np.array([0, 3, 5])) == want).all() and (want == x[[5, 8, 10]]).all()
