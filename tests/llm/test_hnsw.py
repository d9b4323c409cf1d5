"""Near-duplicate vectors against brute force."""

import numpy as np
import pandas as pd
import pytest

from fleetwatch.llm import hnsw
from fleetwatch.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, cid int, copies string"


def brute(rows, cosine=0.93):
    """rows: (vec_id, embedding, label). One (vec_id, n_links, component_id, kept) per row."""
    good = lambda v: bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
    once = sorted({(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and good(v)}, key=repr)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for _, _, v in once]
    near = {k: [m for m in range(len(once)) if m != k and once[m][1] == once[k][1] and len(unit[m]) == len(unit[k]) and unit[m] @ unit[k] >= cosine] for k in range(len(once))}
    least = {i: i for i, _, _ in rows if i is not None}
    moved = True
    while moved:
        moved = False
        for k, others in near.items():
            low = min(least[once[m][0]] for m in [k, *others])
            for m in [k, *others]:
                if least[once[m][0]] > low:
                    least[once[m][0]], moved = low, True
    place = {x: k for k, x in enumerate(once)}
    out = []
    for i, v, label in rows:
        k = place.get((i, label, tuple(v))) if v is not None and label is not None else None
        out.append((i, len(near[k]) if k is not None else 0, least.get(i), i is None or least[i] == i))
    return sorted(out, key=repr)


def clustered(rng, n, d=24):
    """Vectors around few centres, some closer than the threshold."""
    centres = rng.normal(size=(max(2, n // 12), d))
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, d)) * rng.choice([0.15, 0.3, 0.8], size=(n, 1))
    return (x * rng.lognormal(0, 1, size=(n, 1))).astype(np.float32)


def rows_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard", [8_192, 100])
def test_against_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    x, label = clustered(rng, 900), rng.choice([1, 2, 7], p=[0.6, 0.3, 0.1], size=900)
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(rng.permutation(5000)[:900], x, label)]
    rows += [(i + 10_000, rows[3][1], rows[3][2]) for i in range(40)]  # copies of one vector
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    got, want = rows_of(hnsw.near_copies(df, shard=shard)), brute(rows)
    assert sum(r[1] for r in want) > 1000
    assert got == want


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(5, a, 1), (3, b, 1), (3, b, 1), (4, a, 2), (2, a, None), (1, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 0.5], 1), (8, [float("nan"), 0.0, 1.0], 1), (9, [float("inf"), 0.0, 1.0], 1),
            (None, a, 1), (10, [], 1), (11, [1.0, 0.0], 1), (12, [2.0, 0.0], 1), (13, [1e38, 0.0, 5e37], 1), (14, [-1.0, 0.0, -0.5], 1), (20, [0.0, 1.0, 0.0], 1), (20, [0.0, 0.0, -1.0], 1), (21, [0.0, 0.0, -2.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert rows_of(hnsw.near_copies(df)) == brute(rows)
    assert hnsw.near_copies(df.limit(0)).count() == 0


def test_threshold_is_inclusive_and_in_double_precision(spark):
    c = 0.8
    rows = [(1, [1.0, 0.0], 1), (2, [0.8, 0.6], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in hnsw.near_copies(df, cosine=c).collect()] == [1, 1]
    assert [r.n_links for r in hnsw.near_copies(df, cosine=c + 1e-12).collect()] == [0, 0]


@pytest.mark.parametrize("kind", ["sphere", "clusters", "one"])
def test_graph_recall(kind):
    rng = np.random.default_rng(3)
    x = {"sphere": lambda: rng.normal(size=(3000, 32)), "clusters": lambda: clustered(rng, 3000, 32).astype(float), "one": lambda: rng.normal(size=32) + 0.2 * rng.normal(size=(3000, 32))}[kind]()
    x[1::10] = x[::10] + 0.05 * rng.normal(size=x[::10].shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, order = hnsw.build(x)
    x = x[order]
    truth = x @ x.T >= 0.93
    queries = np.arange(0, 3000, 3)
    beam = hnsw.audited_beam(g, x, x[queries], None, 0.93, 0.99)
    found = hnsw._linked(g, x, x[queries], None, 0.93, beam)
    assert not (found & ~truth[queries]).any()
    assert found.sum() >= 0.99 * truth[queries].sum()


def test_audit_widens_a_poor_graph():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, order = hnsw.build(x)
    assert hnsw.audited_beam(g, x[order], x[order], None, 0.93, 0.99) < 1000
    for near in g.near:
        near[:, 3:] = -1
    assert hnsw.audited_beam(g, x[order], x[order], None, 0.93, 0.99) >= 4 * hnsw.BEAM


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_bound_rules_out_no_link(d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d))
    x[1::3] = x[::3] + 0.2 * rng.normal(size=x[::3].shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[:200], x[100:]
    of_a, of_b = hnsw.open_pairs(hnsw.heads(a.astype("f4")), hnsw.heads(b.astype("f4")), 0.93, False)
    linked = a @ b.T >= 0.93
    assert linked.any() and (of_a >= linked.sum(1)).all() and (of_b >= linked.sum(0)).all()
    if d == 64:
        assert (of_a > 0).sum() < 1.2 * linked.any(1).sum()


def frames_of(x, dealt, d):
    """Index rows of vectors dealt into shards, with the sides they are compared on."""
    frame = pd.DataFrame({"label": "1", "d": d, "shards": int(dealt.max()) + 1, "shard": dealt, "key": np.arange(len(x)), "cid": np.arange(len(x)), "copies": 1, "vector": list(x)})
    return pd.concat([hnsw._index(f) for _, f in frame.groupby("shard")]).assign(one=0, two=0)


@pytest.mark.parametrize("kind", ["float32", "float64"])
def test_few_vectors_walk_and_all_links_are_found(monkeypatch, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[1::30] = x[::30] + 0.03 * rng.normal(size=x[::30].shape)  # some pairs
    x[2000:2300] = x[2000] + 0.03 * rng.normal(size=(300, 32))  # and a group, all linked
    x = x.astype(kind)
    walked = []
    monkeypatch.setattr(hnsw, "walk", lambda g, q, *rest, walk=hnsw.walk, **more: walked.append(len(q)) or walk(g, q, *rest, **more))
    rows = frames_of(x, rng.integers(3, size=len(x)), 32)
    found = hnsw._compare(rows, 0.93, 0.99)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    truth = u @ u.T >= 0.93
    np.fill_diagonal(truth, False)
    got = found.groupby("key")["links"].sum().reindex(range(len(x)), fill_value=0).to_numpy()
    assert (got == truth.sum(1)).all()
    assert sum(walked) < 100


def test_many_open_vectors_walk(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x[1::2] = x[::2] + 0.03 * rng.normal(size=x[::2].shape)
    walked = []
    monkeypatch.setattr(hnsw, "walk", lambda g, q, *rest, walk=hnsw.walk, **more: walked.append(len(q)) or walk(g, q, *rest, **more))
    found = hnsw._compare(frames_of(x, np.zeros(len(x), int), 32), 0.93, 0.99)
    assert sum(walked) >= len(x)
    assert found["links"].sum() >= 0.99 * len(x)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op11_shard_graphs"](spark, sf)) == brute(rows)
