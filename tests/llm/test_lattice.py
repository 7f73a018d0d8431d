"""Lattice hashing: the decoder, recall, brute force and edge cases."""

import itertools
import math
import random

import numpy as np

from climo.llm import lattice

DOUBLES = "vec_id long, embedding array<double>, label int, id long, component string"
SCHEMA = "vec_id long, embedding array<float>, label int, id long, component string"


def test_decoder_finds_nearest_lattice_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(300, 8)) * 2
    got = lattice.decode_e8(y)
    doubled = got * 2
    assert np.allclose(doubled, np.rint(doubled)) and (got.sum(axis=1) % 2 == 0).all()
    assert all(len({int(v) % 2 for v in row}) == 1 for row in np.rint(doubled))
    around = got[:, None, :] + lattice.shortest_vectors()[None]
    assert (((y - got) ** 2).sum(1)[:, None] <= ((y[:, None, :] - around) ** 2).sum(2) + 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93 ** 2) * z
    met = np.zeros(len(x), bool)
    for table in range(8):
        hx, px = lattice.table_cells(x, table, 0.6, 4, 5)
        hy, py = lattice.table_cells(y, table, 0.6, 4, 5)
        met |= (hx == hy) | (px == hy[:, None]).any(1) | (py == hx[:, None]).any(1)
    assert met.mean() > 0.995


def brute(rows, threshold):
    ok = []
    for k, (_, e, label) in enumerate(rows):
        if label is not None and rows[k][0] is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e):
            ok.append(k)
    vec = {k: np.array(rows[k][1], np.float32).astype(float) for k in ok}
    links, up = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(ok, 2):
        x, y = vec[a], vec[b]
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
            links[a] += 1
            links[b] += 1
            up[top(a)] = top(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(top(k), []).append(r[0])
    return sorted((str(r[0]), links[k], str(min(groups[top(k)])) if r[0] is not None else "None") for k, r in enumerate(rows))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    pick = random.Random(3)
    rows, ids = [], iter(pick.sample(range(5000), 1000))
    for _ in range(120):
        rows.append((next(ids), rng.normal(size=16).tolist(), int(rng.integers(3))))
    for size, noise in ((2, 0.05), (3, 0.2), (40, 0.1), (25, 0.25), (70, 0.02)):
        base = rng.normal(size=16)
        for k in range(size):
            rows.append((next(ids), (base + noise * rng.normal(size=16)).tolist(), 1 if k % 5 else 2))
    v = rows[0][1]
    rows += [(next(ids), v, rows[0][2]), (next(ids), [3 * a for a in v], rows[0][2]), (next(ids), v, 9), (next(ids), v, None),
             (next(ids), None, 1), (next(ids), [], 1), (next(ids), [0.0] * 16, 1), (next(ids), [float("nan")] + v[1:], 1),
             (next(ids), [None] + v[1:], 1), (next(ids), [float("inf")] + v[1:], 1), (next(ids), v[:8], rows[0][2]),
             (None, v, rows[0][2]), (next(ids), [1e30 * a for a in v], rows[0][2]), (next(ids), [0.0] * 15 + [1.0], -5)]
    frame = spark.createDataFrame([(i, e, lab, 1, "x") for i, e, lab in rows], SCHEMA)
    got = lattice.near_duplicate_vectors(frame, tables=16, block=32).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert lattice.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_repeated_rows_count_as_links(spark):
    frame = spark.createDataFrame([(4, [1.0, 2.0], 1, 0, "")] * 3 + [(9, [1.0, 2.0], 1, 0, "")], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicate_vectors(frame).collect())
    assert got == [(4, 3, 4)] * 3 + [(9, 3, 4)]


def test_close_pairs_in_crowded_cells(spark):
    """With the 8 tables of the default: pairs whose home cells each hold strangers with smaller ids."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    middle = unit(rng.normal(size=256))
    around = lambda n: unit(0.88 ** 0.5 * middle + 0.12 ** 0.5 * unit(rng.normal(size=(n, 256))))
    strangers, ends = around(500), around(60)
    others = unit(ends + 1e-4 * unit(rng.normal(size=ends.shape)))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.vstack([strangers, ends, others]))]
    frame = spark.createDataFrame([(i, e, lab, 1, "x") for i, e, lab in rows], SCHEMA)
    for block in (2048, 5):
        got = lattice.near_duplicate_vectors(frame, block=block).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows, 0.93)


def test_very_small_and_very_large_components(spark):
    """Only the direction counts: squares that over- or underflow change no link."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(rng.normal(size=(60, 16)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    for cosine, n_links in ((0.92, 0), (0.95, 1)):
        b = cosine * a + (1 - cosine ** 2) ** 0.5 * side
        for scale in (1.0, 1e-200, 1e200):
            rows = [(2 * i + k, (v * scale).tolist(), i, 1, "x") for i in range(60) for k, v in enumerate((a[i], b[i]))]
            got = lattice.near_duplicate_vectors(spark.createDataFrame(rows, DOUBLES)).collect()
            assert {r.n_links for r in got} == {n_links} and all(r.component_id == r.vec_id - (r.vec_id % 2) * n_links for r in got)
    tiny = [(0, [1e-200, 0.0, 0.0], 1, 0, ""), (1, [1e200, 0.0, 0.0], 1, 0, ""), (2, [0.0, 5e-324, 0.0], 1, 0, "")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicate_vectors(spark.createDataFrame(tiny, DOUBLES)).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_brute_force_at_the_query_setting(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=64).tolist(), i % 3) for i in range(60)]
    for g in range(40):
        base = rng.normal(size=64)
        rows += [(1000 + 5 * g + k, (base + 0.22 * rng.normal(size=64)).tolist(), g % 3) for k in range(5)]
    frame = spark.createDataFrame([(i, e, lab, 1, "x") for i, e, lab in rows], SCHEMA)
    got = lattice.near_duplicate_vectors(frame).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows, 0.93)
