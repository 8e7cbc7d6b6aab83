import numpy as np

from dossier.llm import embedding_dedup as ed


def brute(rows, threshold=0.98):
    ok = [
        (i, v, y) for i, v, y in rows
        if y is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    x = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v, _ in ok]
    n = [0] * len(ok)
    root = list(range(len(ok)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(ok):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    out = [(i, n[a], least.get(find(a))) for a, (i, _, _) in enumerate(ok)]
    return out + [(r[0], 0, r[0]) for r in rows if not any(r is o or r == o for o in ok)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as u", "2 as nid", "'x' as component")
    got = [(r.vec_id, r.n_links, r.component_id) for r in ed.near_vectors(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def planted(seed, groups, noise=0.05, dim=24):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for size in groups:
        c = rng.standard_normal(dim)
        for _ in range(size):
            v = c + noise * rng.standard_normal(dim)
            rows.append((k, [float(x) for x in v.astype(np.float32)], k % 2 if size == 1 else 0))
            k += 1
    return rows


def test_clusters_pairs_and_singles(spark, monkeypatch):
    monkeypatch.setattr(ed, "CELL", 32)
    check(spark, planted(1, [90, 30, 12, *[2] * 30, *[1] * 200]))


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (5, v, 1), (3, v, 1), (3, v, 1), (9, [2.0, 4.0, 6.0], 1), (1, v, 2), (2, v, None), (4, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 3.0], 1), (10, [1.0, float("nan"), 3.0], 1), (11, [1.0, float("inf"), 3.0], 1), (None, v, 1), (12, [1.0, 2.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in ed.near_vectors(df).collect())
    near = {5, 3, 9}
    for (none, i), n, c, kept in got:
        assert (n, c, kept) == ((4, 3, i == 3) if i in near or none else (0, i, True)), (i, n, c, kept)
    assert ed.near_vectors(df.where("vec_id = 99")).count() == 0


def test_recall_of_rare_pairs(spark):
    """Thousands of single vectors, a few pairs just above the threshold, one dense group."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(150):
        side = rng.standard_normal(32)
        side -= side @ x[i] * x[i]
        x[3000 + i] = 0.983 * x[i] + np.sqrt(1 - 0.983**2) * side / np.linalg.norm(side)
    x[5000:5100] = x[4999] + 0.01 * rng.standard_normal((100, 32))
    rows = [(i, [float(a) for a in v], i % 1000 % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in ed.near_vectors(df).collect()}
    label = np.array([r[2] for r in rows])
    hit = (ed.unit(x) @ ed.unit(x).T >= 0.98) & (label[:, None] == label[None, :])
    want = hit.sum(1) - 1
    mine = np.array([got[i] for i in range(len(rows))])
    assert (mine <= want).all() and mine.sum() >= 0.95 * want.sum()
    assert ((mine > 0) & (want > 0)).sum() >= 0.95 * (want > 0).sum() and (want > 0).sum() >= 200


def test_large_components_of_doubles(spark):
    rows = [(1, [1e200, 2e200, 0.0], 1), (2, [1.0, 2.0, 0.0], 1), (3, [1e-200, 2.001e-200, 0.0], 1), (4, [0.0, 0.0, 1e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_vectors(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_every_compared_link_is_emitted(spark):
    # Nodes 1 and 2 are linked, but both have full lists of closer neighbours (kth is their own in the graph).
    vecs = {0: [1.0, 0.0], 1: [1.0, 0.1], 2: [1.0, -0.05]}
    nodes = spark.createDataFrame([(i, v) for i, v in vecs.items()], "nid long, vec array<float>")
    rows = [(0, 1, 0.999, 2, True, 0.999), (0, 2, 0.999, 2, True, 0.999), (1, 0, 0.999, 1, True, 0.999), (2, 0, 0.999, 1, True, 0.999)]
    graph = spark.createDataFrame(rows, "u long, v long, s double, k int, saturated boolean, kth double")
    got = {tuple(sorted((r.u, r.v))) for r in ed.descend(graph, nodes, 0.98).collect()}
    assert (1, 2) in got


def test_exact_links_join_all(spark, monkeypatch):
    monkeypatch.setattr(ed, "CELL", 16)
    t = [(i, 1, 2, [float(np.cos(i * 0.1)), float(np.sin(i * 0.1))]) for i in range(60)]  # a chain: only neighbours link
    nodes = spark.createDataFrame(t, "nid long, label int, dim int, vec array<float>")
    links = ed.exact_links(nodes, nodes.select("label", "dim").distinct(), 0.99).collect()
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in links} == {(i, i + 1) for i in range(59)}


def test_audit_names_labels_with_lost_links(spark):
    # Label 0: a dense group whose links are all counted hides one lost pair of many; label 1: all lost; label 2: found.
    rows = [(i, 0, 2, [1.0, 0.001 * i], 1) for i in range(20)]
    rows += [(100 + i, 0, 2, [float(np.cos(0.5 + i // 2)), float(np.sin(0.5 + i // 2))], 1) for i in range(4)]
    rows += [(200, 1, 2, [1.0, 0.0], 1), (201, 1, 2, [1.0, 0.01], 1), (300, 2, 2, [1.0, 0.0], 1), (301, 2, 2, [1.0, 0.01], 1)]
    nodes = spark.createDataFrame(rows, "nid long, label int, dim int, vec array<float>, copies long")
    counts = spark.createDataFrame([*((i, 19) for i in range(20)), (300, 1), (301, 1)], "cid long, more long")
    graph = spark.createDataFrame([(200, 0.99)], "u long, s double")
    assert sorted(r.label for r in ed.audit(nodes, graph, counts, 0.98, 0.95).where("failed").collect()) == [0, 1]


def test_full_lists_lead_to_neighbouring_components_only(spark, monkeypatch, tmp_path):
    """Two groups of near copies with links between them, among thousands of single vectors of one label."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(32)
    side -= side @ x[0] * x[0]
    side /= np.linalg.norm(side)
    first = x[0].copy()
    turn = lambda angle: np.cos(angle) * first + np.sin(angle) * side
    x[:60] = [turn(a) + 0.001 * rng.standard_normal(32) for a in np.linspace(0.0, 0.05, 60)]
    x[60:130] = [turn(a) + 0.001 * rng.standard_normal(32) for a in np.linspace(0.2, 0.25, 70)]
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = ed.unit(x)
    hit = u @ u.T >= 0.98
    exact = lambda *a: (_ for _ in ()).throw(AssertionError("compared a whole label"))
    monkeypatch.setattr(ed, "exact_links", exact)
    got = {r.vec_id: r for r in ed.near_vectors(df, audit_path=f"{tmp_path}/audit").collect()}
    assert {i: got[i].n_links for i in got} == {i: int(hit[i].sum()) - 1 for i in range(3000)}
    assert {got[i].component_id for i in range(130)} == {0} and all(got[i].kept for i in range(130, 3000))
    rows = spark.read.parquet(f"{tmp_path}/audit").collect()
    assert [(r.label, r.search, r.failed, r.of_links) for r in rows] == [(0, 0, False, 1.0)]


def test_components_with_hidden_links_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ed, "CELL", 16)
    angles = [*np.linspace(0.0, 0.05, 40), *np.linspace(0.2, 0.25, 40), *np.linspace(1.5, 1.55, 40)]
    t = [(i, 1, 2, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    nodes = spark.createDataFrame(t, "nid long, label int, dim int, vec array<double>")
    graph = spark.createDataFrame([(i, True) for i in range(120)], "u long, saturated boolean")
    comps = spark.createDataFrame([(i, i // 40 * 40) for i in range(120)], "node long, component long")
    links = [tuple(sorted((r.u, r.v))) for r in ed.neighbours_links(nodes, graph, comps, 0.98, 1, 6).collect()]
    assert links and all(u < 40 <= v < 80 and np.cos(angles[u] - angles[v]) >= 0.98 for u, v in links)
    assert ed.neighbours_links(nodes, graph.where("not saturated"), comps, 0.98, 1, 6).count() == 0
