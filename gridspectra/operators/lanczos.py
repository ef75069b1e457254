"""Extreme eigenpairs of large symmetric operators by restarted block Lanczos, which asks for products only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Blocks of a basis before it is restarted, guard vectors of a block, most restarts.
BLOCKS, GUARD, RESTARTS = 6, 6, 500
#: Rows of a product that are formed at once.
ROWS = 512


def _orthogonal(block: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """An orthonormal basis of what `block` adds to `basis`; directions that add nothing go."""
    for _ in range(2):  # twice is enough
        if basis is not None:
            block = block - basis @ (basis.T @ block)
        scale = np.linalg.norm(block, axis=0)
        block = block[:, scale > 1e-13] / np.maximum(scale[scale > 1e-13], 1e-300)
        if not block.shape[1]:
            return block
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-11]
    return block


def largest(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, tolerance: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and eigenvectors of a symmetric operator on n entries, given as product with a matrix of columns.

    Every new block is orthogonalised against the whole basis. The basis is at most BLOCKS * (k + GUARD) wide, so memory is in proportion to n * k. Ends when
    the residuals of the k pairs are below `tolerance` times the largest value met, in size; raises if they do not get there.
    """
    k = min(k, n)
    width = min(n, k + GUARD)
    start = _orthogonal(np.random.default_rng(seed).standard_normal((n, width)), None)
    for _ in range(RESTARTS):
        basis, images = start, product(start)
        last = images
        for _ in range(BLOCKS - 1):
            more = _orthogonal(last, basis)
            if basis.shape[1] + more.shape[1] > n:
                more = more[:, : n - basis.shape[1]]
            if not more.shape[1]:
                break
            last = product(more)
            basis, images = np.hstack((basis, more)), np.hstack((images, last))
        small = basis.T @ images
        value, turn = np.linalg.eigh((small + small.T) / 2)
        keep, size = turn[:, ::-1][:, :width], max(float(np.abs(value).max()), 1e-300)
        value = value[::-1][:width]
        vectors = basis @ keep
        rest = np.linalg.norm(images @ keep[:, :k] - vectors[:, :k] * value[:k], axis=0)
        if (rest <= tolerance * size).all() or basis.shape[1] >= n:
            return value[:k], vectors[:, :k]
        start = _orthogonal(vectors, None)
    raise ArithmeticError(f"{k} eigenpairs of {n} entries did not converge")


class Edges:
    """A symmetric matrix as a list of its entries; repeated ones add up."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        self.n, self.i, self.j, self.w = n, i, j, w

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.i, self.w * x[self.j, c], minlength=self.n) for c in range(x.shape[1])], axis=1)

    def matrix(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        np.add.at(out, (self.i, self.j), self.w)
        return out


class Affinity:
    """The scaled Gram matrix of features as an operator: W x without W. Clipped at 0 it is formed some rows at a time, unclipped it is F (F^T x)."""

    def __init__(self, f: np.ndarray, clip: bool = True, extra: np.ndarray | Edges | None = None, weight: float = 0.0):
        self.f, self.clip, self.extra, self.weight = f, clip, extra, weight
        self.scale = 1.0
        self.scale = 1 / max(max(float(rows.max()) for rows in self._rows()), 1e-300)
        self.degree = self(np.ones((len(f), 1)))[:, 0]

    def _rows(self):
        for a in range(0, len(self.f), ROWS):
            rows = self.f[a : a + ROWS] @ self.f.T
            yield np.maximum(rows, 0.0) if self.clip else rows

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.vstack([rows @ x for rows in self._rows()]) if self.clip else self.f @ (self.f.T @ x)
        out = out * self.scale
        return out + self.weight * (self.extra @ x) if self.extra is not None and self.weight > 0 else out


def laplacian(w: Affinity, k: int, lapnorm: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest k of (D - W) v = l D v, or of D - W: values rising, vectors, largest residual entry of each pair.

    The first are those of largest value of D^-1/2 W D^-1/2, the second of c - (D - W), c twice the largest degree; nothing is inverted.
    """
    d = np.where(w.degree < 1e-12, 1.0, w.degree)[:, None]
    n = len(d)
    if lapnorm:
        s = 1 / np.sqrt(d)
        value, u = largest(lambda x: s * w(s * x), n, k)
        # degrees below the least were set to 1, so the diagonal is D there as it is in the dense form
        value, v = 1 - value, s * u
        rest = np.abs(d * v - w(v) - d * v * value).max(axis=0)
    else:
        c = 2 * float(d.max())
        value, v = largest(lambda x: c * x - d * x + w(x), n, k)
        value = c - value
        rest = np.abs(d * v - w(v) - v * value).max(axis=0)
    return value, v, rest


def by_size(w: Callable, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k eigenpairs of largest absolute value, falling in it, the positive first among equals."""
    pairs = [largest(w, n, k), largest(lambda x: -w(x), n, k)]
    value = np.concatenate((pairs[0][0], -pairs[1][0]))
    v = np.hstack((pairs[0][1], pairs[1][1]))
    half = np.concatenate((value[: len(pairs[0][0])] >= 0, value[len(pairs[0][0]) :] < 0))  # a small matrix has each pair at both ends
    value, v = value[half], v[:, half]
    order = np.argsort(-np.abs(value), kind="stable")[:k]
    return value[order], v[:, order]
