import numpy as np

from tidemark.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, g string, id long, n long"


def fixture():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        rows.append((k, rng.standard_normal(16).tolist(), k % 2))
    centre = rng.standard_normal(16)
    for k in range(45):  # more than a first list holds
        rows.append((100 + k, (centre + 0.12 * rng.standard_normal(16)).tolist(), 1))
    rows += [(200, rows[5][1], 0), (201, rows[5][1], None), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [], 1), (206, rows[5][1][:8], 1), (207, [None] + rows[5][1][1:], 1)]
    rows.append(rows[7])
    return rows


def test_links_match_brute_force(spark):
    rows = fixture()
    found = {r["id"]: (r["n_links"], r["component_id"]) for r in e.link(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()}
    usable = [(i, np.array(v, dtype=np.float32).astype(float), g) for i, v, g in {r[0]: r for r in rows}.values() if g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = {i: 0 for i, _, _ in usable}, {i: i for i, _, _ in usable}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, u, g) in enumerate(usable):
        for j, v, h in usable[:a]:
            if g == h and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= e.THRESHOLD:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for i in links:
        assert found.get(i, (0, i)) == (links[i], find(i)), i
    assert max(links.values()) > e.NEIGHBOURS


def test_dense_groups_with_links_below_those_inside_are_joined(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.HOT", 50)  # label and buckets are hot keys
    rng = np.random.default_rng(4)
    a, b = np.eye(16)[0], np.append([0.96, np.sqrt(1 - 0.96**2)], np.zeros(14))
    ids = [*range(1, 61), *range(101, 161)]  # none is audited, and each group holds more than two lists
    rows = [(i, ((a if i < 100 else b) + 0.002 * rng.standard_normal(16)).tolist(), 1, None, None, None) for i in ids]
    found = {r["id"]: (r["n_links"], r["component_id"]) for r in e.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: (119, 1) for i in ids}


def test_audit_counts_vectors_alike(spark):
    near = lambda k, n: (np.eye(8)[k] + 0.01 * np.eye(8)[n % 8]).tolist()
    rows = [(100 * n if n < 2 else 1000 + n, near(0, n)) for n in range(200)] + [(5000, near(1, 3)), (5001, near(1, 4))]
    rows = [(i, "g", (np.array(v) / np.linalg.norm(v)).tobytes()) for i, v in rows]
    labels = spark.createDataFrame([(i, 0) for i, _, _ in rows if i < 5000], "node long, component long")
    table = spark.createDataFrame([(*r, 1, r[0] % e.AUDIT == 0) for r in rows], "id long, g string, v binary, n long, asked boolean")
    recall, missed = e.audit(labels, table, len(rows))
    queries = [i for i, _, _ in rows if i % e.AUDIT == 0]
    assert abs(recall - (1 - 1 / len(queries))) < 1e-9
    assert [(r["id"], r["c"]) for r in missed.collect()] == [(5000, 5000)]


def test_equal_vectors_are_folded(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.HOT", 50)
    a, b, c = np.eye(4)[0], np.array([0.95, np.sqrt(1 - 0.95**2), 0, 0]), np.eye(4)[3]
    rows = [(1000 + k, (a * (1 + k % 3)).tolist(), 1) for k in range(300)] + [(2000 + k, b.tolist(), 1) for k in range(20)] + [(3000, c.tolist(), 1), (4000, a.tolist(), 2), (4001, a.tolist(), 2)]
    found = {r["id"]: (r["n_links"], r["component_id"]) for r in e.link(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()}
    assert found == {**{i: (319, 1000) for i, _, _ in rows[:320]}, 3000: (0, 3000), 4000: (1, 4000), 4001: (1, 4000)}


def test_large_components_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(e, "COUNTED", 16)
    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(8)[0] + 0.01 * rng.standard_normal(8)).tolist(), 1, None, None, None) for i in range(150)]
    found = {r["id"]: (r["n_links"], r["component_id"]) for r in e.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: (149, 0) for i in range(150)}


def test_empty(spark):
    assert e.link(spark.createDataFrame([], SCHEMA)).count() == 0
