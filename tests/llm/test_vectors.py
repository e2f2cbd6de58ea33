"""Near vectors against a comparison of all pairs."""

import numpy as np
import pytest

from skysift.llm import epsilon_grid

SCHEMA = "vec_id long, embedding array<{}>, label int, n_links string, vec int"


def plain(rows, threshold):
    good = {k: np.array(v, float) for k, (_, v, *_) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k in range(len(rows))}
    for i, a in good.items():
        for j, b in good.items():
            if i < j and len(a) == len(b):
                a1, b1 = a / np.abs(a).max(), b / np.abs(b).max()
                if a1 @ b1 / np.sqrt((a1 @ a1) * (b1 @ b1)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for k in links:
        seen, stack = {k}, [k]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[k][0], len(links[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def some_vectors(seed, n=260, size=12):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, size)).tolist()
    centre = rng.normal(size=size)
    rows += (centre + rng.normal(size=(90, size)) * 0.02).tolist()
    chain = [np.cos(t) * np.eye(size)[0] + np.sin(t) * np.eye(size)[1] for t in np.arange(0, 3, 0.25)]
    rows += [c.tolist() for c in chain] + [centre.tolist()] * 40 + [(centre * 3).tolist(), (-centre).tolist()]
    rows += [None, [], [0.0] * size, [-0.0] * size, [None, *[1.0] * (size - 1)], [float("nan")] * size, [float("inf"), *[0.0] * (size - 1)], [1.0, 2.0], [1.0, 2.1], [1.0, 2.0, *[0.0] * (size - 2)]]
    ids = rng.permutation(len(rows)).tolist()
    out = [(int(i), v, 1, "x", 2) for i, v in zip(ids, rows)]
    return [*out, out[3], (None, rows[5], 1, "x", 2), (None, [7.0, -7.0], 1, "x", 2)]


@pytest.mark.parametrize("kind, threshold", [("double", 0.95), ("float", 0.95), ("double", 0.5)])
def test_links(spark, kind, threshold, monkeypatch):
    """With small intervals and with one; wide vectors of doubles too large or small to square."""
    rows = some_vectors(4)
    rows = [(i, np.array(v, np.float32).tolist() if kind == "float" and v and None not in v else v, *r) for i, v, *r in rows]
    if kind == "double":
        rows += [(900, [1e200] * 12, 1, "x", 2), (901, [1e-200] * 12, 1, "x", 2), (902, [5e-324, *[0.0] * 11], 1, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(4)
    want = plain(rows, threshold)

    def found():
        return sorted((tuple(r) for r in epsilon_grid.near_vectors(df, threshold=threshold).collect()), key=str)

    assert found() == want
    if threshold == 0.95:
        monkeypatch.setattr(epsilon_grid, "INTERVAL", 16)
        assert found() == want


def test_nothing_to_link(spark):
    df = spark.createDataFrame([], SCHEMA.format("float"))
    assert epsilon_grid.near_vectors(df).collect() == []
    df = spark.createDataFrame([(1, None, 1, "x", 2)], SCHEMA.format("float"))
    assert [tuple(r) for r in epsilon_grid.near_vectors(df).collect()] == [(1, 0, 1)]


def test_tiles_and_halves():
    """Several tiles an interval, with blocks that are proven near or distant, give the same counts and groups."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(700, 6)), rng.normal(size=(1, 6)) + rng.normal(size=(900, 6)) * 0.001, rng.normal(size=(300, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.argsort(np.floor(x[:, 0] * 4) + x[:, 1] / 10)]
    n = rng.integers(1, 4, len(x))
    found = epsilon_grid.Joined(x, np.full(len(x), 6), n, np.eye(6)[:, :3], 0.95, np.sqrt(0.1))
    found.join((0, len(x)), (0, len(x)))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert (found.count == near @ n).all()
    split = epsilon_grid.Joined(x, np.full(len(x), 6), n, np.eye(6)[:, :3], 0.95, np.sqrt(0.1))
    split.join((0, 800), (0, 800))
    split.join((0, 800), (800, len(x)))
    split.join((800, len(x)), (800, len(x)))
    assert (split.count == found.count).all()
    same = [len({f.root(i) for i in range(len(x))}) for f in (found, split)]
    assert same[0] == same[1] == len(x) - len(found.forest)
    assert all(near[i, j] for i, j in found.forest)
