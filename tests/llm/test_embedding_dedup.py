import numpy as np

from finquarry.llm.embedding_dedup import ball_pivots, bounded, embedding_links, orthogonal_pivots, places


def brute(rows, cosine):
    ok = {i: (np.array(v, float), y) for i, v, y in rows if v is not None and y is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v))}
    links = {i: [j for j, (u, z) in ok.items() if j != i and z == y and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine] for i, (v, y) in ok.items()}
    comp = {i: i for i, *_ in rows}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in links.get(i, []))]) for i in comp}
        if new == comp:
            return {i: (len(links.get(i, [])), c) for i, c in comp.items()}
        comp = new


def test_links_equal_brute_force(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 8))
    rows = []
    for i in range(400):
        v = (centres[rnd.integers(12)] + rnd.normal(size=8) * rnd.choice([0.0, 0.05, 0.3])).astype(np.float32).tolist() if i % 3 else rnd.normal(size=8).astype(np.float32).tolist()
        rows.append((i * 7 % 2003, v, int(rnd.integers(2))))
    rows += [(3001, None, 1), (3002, [0.0] * 8, 1), (3003, [float("nan")] + [1.0] * 7, 1), (3004, [float("inf")] + [1.0] * 7, 1), (3005, rows[0][1], None), (3006, [1.0, None], 1), (3007, [1.0, 0.0], 1), (3008, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    want = brute(rows, 0.93)
    for options in ({"block_rows": 30}, {"sample_rows": 60, "directions": 3}, {}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df, **options).collect()}
        assert got == want, options
    assert all(r.kept == (r.vec_id == r.component_id) for r in embedding_links(df).collect())


def clustered(rnd, n, dim, clusters, share):
    centres = rnd.normal(size=(clusters, dim))
    x = np.where((rnd.random(n) < share)[:, None], centres[rnd.integers(clusters, size=n)] + rnd.normal(size=(n, dim)) * 0.08, rnd.normal(size=(n, dim)))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_boundary_replication_covers_neighbours():
    rnd, eps = np.random.default_rng(3), 0.374
    for dim in (3, 8, 64):
        x = clustered(rnd, 600, dim, 5, 0.5)
        p, r = ball_pivots(x[:300], eps, 32)
        own, need = places(x, p, r, eps)
        near = x @ x.T >= 1 - eps**2 / 2
        for i in range(600):
            assert need[i, own[i]] and need[near[i], own[i]].all()
        q = orthogonal_pivots(x, 24)
        assert (bounded(x, q) @ bounded(x, q).T >= x @ x.T - 1e-5).all()


def test_pivots_part_clusters_and_spare_products(spark):
    rnd, figures = np.random.default_rng(5), {}
    x = clustered(rnd, 2500, 64, 6, 0.4)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_links(df, figures=figures).collect()}
    near = (x @ x.T >= 0.93) & (np.arange(2500)[:, None] % 2 == np.arange(2500) % 2)
    assert got == {i: int(near[i].sum()) - 1 for i in range(2500)}
    assert figures["places"] < 1.1 * figures["points"] and figures["pairs"] < 0.6 * figures["pairs_of_labels"] and figures["compared"] < 0.1 * figures["pairs_of_labels"], figures


def test_labels_of_any_text(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, v.tolist(), str(rnd.choice(["a", "a/0", "a/1", "512:a", ""]))) for i, v in enumerate(clustered(rnd, 500, 6, 9, 0.7))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), block_rows=50).collect()}
    assert got == brute(rows, 0.93)


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int, cell string"
    assert embedding_links(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_links(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 0, 0, True), (2, 1, 2, True), (2, 1, 2, True)]


def test_many_rows_without_a_vector_and_of_one_vector(spark, monkeypatch):
    from finquarry.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = [(k, [0.0, 0.0], "a", 0) for k in range(200)] + [(k, [1.0, 2.0], "a", 0) for k in range(200, 500)] + [(k, None, None, 1) for k in range(500, 520)] + [(None, [1.0, 2.0], "a", 0), (600, [2.0, 4.0], "b", 0), (601, [float("nan"), 1.0], "a", 0)]
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, h1 int")).collect()}
    assert len(got) == 523 and all(got[k].n_links == 299 and got[k].component_id == 200 for k in range(200, 500))
    assert all(got[k].n_links == 0 and got[k].kept for k in [*range(200), *range(500, 520), 600, 601, None])
