"""Exact nearest neighbours in few dimensions: a k-d tree of leaves, searched leaf by leaf."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, at most; decimals to which squared distances are compared.
LEAF, DECIMALS = 32, 9


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Places of the points, halved along the widest coordinate until LEAF are left."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        axis = int(np.ptp(x[own], axis=0).argmax())
        half = len(own) // 2
        order = own[np.argpartition(x[own, axis], half)]
        todo += [order[:half], order[half:]]
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, coordinate by coordinate."""
    d = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        d += (a[:, axis, None] - b[None, :, axis]) ** 2
    return d


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Places (points x k) of each point's k nearest, itself included, by squared distance rounded to DECIMALS; ties go to the smaller place.

    The points of a leaf are searched together: other leaves come in order of the distance between boxes, until a box is farther than the k-th
    nearest of every point by more than rounding. Memory is in proportion to leaves and candidates, not to the square of the points.
    """
    k = min(k, len(x))
    parts = leaves(x)
    low, high = np.stack([x[p].min(axis=0) for p in parts]), np.stack([x[p].max(axis=0) for p in parts])
    out = np.empty((len(x), k), np.int64)
    slack = 10.0**-DECIMALS
    for a, own in enumerate(parts):
        gap = np.maximum(np.maximum(low - high[a], low[a] - high), 0.0)
        bound = (gap * gap).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        reach, held, kth = 0, [], np.inf
        step = -(-2 * k // LEAF) + 1
        far = np.zeros((len(own), 0))
        while reach < len(order) and bound[order[reach]] <= kth + slack:
            near = order[reach : reach + step]
            more = np.concatenate([parts[b] for b in near[bound[near] <= kth + slack]])
            reach, step = reach + step, 2 * step
            held.append(more)
            far = np.hstack((far, squared(x[own], x[more])))
            if far.shape[1] >= k:
                kth = float(np.partition(far, k - 1, axis=1)[:, k - 1].max())
        within = (far <= kth + slack).any(axis=0)
        names, far = np.concatenate(held)[within], far[:, within]
        by_name = np.argsort(names)
        names, far = names[by_name], np.round(far[:, by_name], DECIMALS)
        out[own] = names[np.argsort(far, axis=1, kind="stable")[:, :k]]
    return out
