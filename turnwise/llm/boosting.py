"""Gradient-boosted regression trees on the logistic loss, in numpy: fit on a bounded table, applied to arrays inside tasks."""

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 8) -> list:
    """Trees as arrays (feature, limit, value) of full binary trees; feature -1 ends a branch. The first entry is the prior's log-odds."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, model = np.full(len(y), prior), [prior]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, limit, value = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1), np.zeros(2 ** (depth + 1) - 1)
        rows = {0: np.arange(len(y))}
        for node in range(2 ** (depth + 1) - 1):
            if node not in rows:
                continue
            own = rows.pop(node)
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = rate * gs / (hs + 1.0)
            best = (1e-6, None)
            if node < 2**depth - 1 and len(own) >= 2 * least:
                for j in range(x.shape[1]):
                    if not len(edges[j]):
                        continue
                    c = codes[own, j]
                    size = len(edges[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                    gain = np.where((nl >= least) & (len(own) - nl >= least), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k))
            if best[1]:
                j, k = best[1]
                feature[node], limit[node] = j, edges[j][k]
                left = codes[own, j] <= k
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
            else:
                score[own] += value[node]
        model.append((feature, limit, value))
    return model


def log_odds(model: list, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model[0]), np.arange(len(x))
    for feature, limit, value in model[1:]:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(feature) + 1)) - 1):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > limit[node]))
        out += value[node]
    return out
