"""Grid density clustering against a brute-force DBSCAN on small inputs."""

import numpy as np

from fleetlens.learn.density import grid_density_clusters


def _dbscan(pts, eps, min_samples):
    n = len(pts)
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    lab = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):
        if not core[i] or lab[i] != -1:
            continue
        stack = [i]
        lab[i] = c
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in np.nonzero(nb[j])[0]:
                if lab[k] == -1:
                    lab[k] = c
                    stack.append(k)
        c += 1
    return lab, core


def test_blobs_and_noise(spark):
    rng = np.random.default_rng(0)
    blobs = [rng.normal(c, 0.05, size=(60, 2)) for c in ((0, 0), (5, 5), (10, 0))]
    noise = np.array([[20.0, 20.0], [-20.0, 3.0], [7.0, -15.0]])
    pts = np.vstack(blobs + [noise])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = {r.id: r.cluster for r in grid_density_clusters(df, "id", ["x", "y"], 0.5, 5).collect()}
    ref, _ = _dbscan(pts, 0.5, 5)
    # same partition as DBSCAN on well separated blobs, noise flagged
    assert {got[i] for i in range(180, 183)} == {-1}
    for b in range(3):
        ids = range(60 * b, 60 * (b + 1))
        assert len({got[i] for i in ids}) == 1 and got[60 * b] != -1
        assert len({ref[i] for i in ids}) == 1


def test_never_merges_dbscan_clusters_and_cores_are_true_cores(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(c, 0.4, size=(150, 2)) for c in ((0, 0), (3, 0), (0, 3))] +
                    [rng.uniform(-3, 6, size=(60, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = {r.id: r.cluster for r in grid_density_clusters(df, "id", ["x", "y"], 0.5, 5).collect()}
    ref, core = _dbscan(pts, 0.5, 5)
    # each found cluster lies inside one DBSCAN cluster (never spans two)
    for c in set(got.values()) - {-1}:
        members = [i for i, v in got.items() if v == c]
        assert len({ref[i] for i in members if core[i]}) <= 1
