"""Reference results by comparing all pairs in NumPy, for small fixtures."""

import numpy as np


def distances(x: np.ndarray) -> np.ndarray:
    squares = np.zeros((len(x), len(x)))
    for k in range(x.shape[1]):
        gap = x[:, None, k] - x[None, :, k]
        squares += gap * gap
    return np.sqrt(squares)


def counts(x: np.ndarray, eps: float, rule: str) -> np.ndarray:
    near = distances(x) <= eps
    if rule == "strict":
        near &= ~(x[:, None, :] == x[None, :, :]).all(axis=2)
    return near.sum(axis=1)


def join_sets(n: int, pairs) -> np.ndarray:
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def exact(x: np.ndarray, eps: float, min_pts: int) -> tuple[np.ndarray, np.ndarray]:
    """Textbook labels, numbered by the first core point, and core flags."""
    near = distances(x) <= eps
    core = near.sum(axis=1) >= min_pts
    pairs = np.argwhere(near & core[:, None] & core[None, :])
    root = join_sets(len(x), pairs)
    names = {r: i for i, r in enumerate(sorted(set(root[core])))}
    labels = np.full(len(x), -1)
    for i in range(len(x)):
        owners = [names[root[j]] for j in np.flatnonzero(near[i] & core)]
        if core[i]:
            labels[i] = names[root[i]]
        elif owners:
            labels[i] = min(owners)
    return labels, core


def cells(x: np.ndarray, eps: float) -> tuple[np.ndarray, list[int]]:
    """Stretched grid cells as linear ids."""
    side = eps / np.sqrt(x.shape[1])
    lo, hi = x.min(axis=0), x.max(axis=0)
    n = [max(1, int(np.floor((b - a) / side))) for a, b in zip(lo, hi)]
    gid = np.zeros(len(x), dtype=np.int64)
    for k in range(x.shape[1]):
        width = (hi[k] - lo[k]) / n[k]
        c = np.zeros(len(x), dtype=np.int64) if width == 0 else np.floor((x[:, k] - lo[k]) / width).astype(np.int64)
        gid = gid * n[k] + np.clip(c, 0, n[k] - 1)
    return gid, n


def closest(x: np.ndarray, gid: np.ndarray, chosen: np.ndarray, radius: float) -> dict[tuple[int, int], float]:
    far = distances(x)
    best: dict[tuple[int, int], float] = {}
    picked = np.flatnonzero(chosen)
    for i in picked:
        for j in picked:
            if gid[i] < gid[j] and far[i, j] <= radius:
                key = (int(gid[i]), int(gid[j]))
                best[key] = min(best.get(key, np.inf), far[i, j])
    return best


def approx(x: np.ndarray, eps: float, min_pts: int) -> dict[int, tuple[int, int]]:
    """Point -> (cluster, core flag) with the stretched grid and no tolerance band."""
    gid, _ = cells(x, eps)
    core = counts(x, eps, "strict") >= min_pts
    places = sorted(set(gid[core].tolist()))
    at = {g: i for i, g in enumerate(places)}
    links = [(at[a], at[b]) for a, b in closest(x, gid, core, eps)]
    root = join_sets(len(places), links)
    return {i: (places[root[at[g]]], int(core[i])) for i, g in enumerate(gid.tolist()) if g in at}
