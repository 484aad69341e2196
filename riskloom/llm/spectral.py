"""Eigenvectors of a small symmetric matrix by spectral divide and conquer on polar decompositions."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def polar(x: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    Its eigenvalues are the signs of those of ``x``. ``low`` bounds the smallest singular value from
    below; started at the rounding of the largest one, it reaches 1 in six or seven steps.
    """
    n = len(x)
    x = x / np.linalg.norm(x)
    eye, low = np.eye(n), EPS / max(n, 1)
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        a = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        after = b / c * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        done = abs(1 - low) < 10 * EPS and np.linalg.norm(after - x) <= 1e-14 * np.sqrt(n)
        x, low = after, min(1.0, low * (a + b * square) / (1 + c * square))
        if done:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift, and what couples them.

    The projector on the upper one is half of the identity plus the polar factor of ``a - shift``.
    None if all eigenvalues lie on one side.
    """
    n = len(a)
    upper = (np.eye(n) + polar(a - shift * np.eye(n))) / 2
    k = int(round(float(np.trace(upper))))
    if not 0 < k < n:
        return None
    q = np.random.default_rng(n).normal(size=(n, n))
    for _ in range(3):  # the projector's range and its complement, made orthonormal together
        q, _ = np.linalg.qr(np.hstack([upper @ q[:, :k], q[:, k:] - upper @ q[:, k:]]))
    return q[:, :k], q[:, k:], float(np.linalg.norm(q[:, :k].T @ a @ q[:, k:]))


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A split in two: at the median of the diagonal, or near the mean of the eigenvalues, which lies between them.

    A shift that meets an eigenvalue leaves the halves coupled; then the next one is tried.
    """
    mean = float(np.trace(a)) / len(a)
    spread = float(np.linalg.norm(a - mean * np.eye(len(a)))) / np.sqrt(len(a))
    shifts = [float(np.median(np.diag(a))), mean] + [mean + f * spread for f in (0.07, -0.07, 0.19, -0.19, 0.41, -0.41)]
    best = None
    for shift in shifts:
        found = split(a, shift)
        if found and (best is None or found[2] < best[2]):
            best = found
        if best and best[2] <= 20 * len(a) * EPS * np.linalg.norm(a):
            break
    if best is None:
        raise ArithmeticError("no shift separates the eigenvalues")
    return best[0], best[1]


def largest(a: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``first`` largest eigenvalues (all, if fewer), falling, and their unit vectors as rows.

    Invariant subspaces are split until they have one dimension, or until what is left is
    diagonal to rounding, as for equal eigenvalues. Lower halves are not split when enough lie above.
    """
    a = np.asarray(a, float)
    values, vectors = [], []
    stack = [(a, np.eye(len(a)))] if len(a) else []
    size = float(np.linalg.norm(a))
    while stack and len(values) < first:
        block, basis = stack.pop()
        beside = block - np.diag(np.diag(block))
        flat = np.linalg.norm(block - np.trace(block) / len(block) * np.eye(len(block))) <= len(a) * EPS * size
        if len(block) == 1 or flat or np.linalg.norm(beside) <= EPS * size:
            order = np.argsort(-np.diag(block), kind="stable")
            values += np.diag(block)[order].tolist()
            vectors += basis[:, order].T.tolist()
            continue
        above, below = _halves(block)
        for part in (below, above):  # the upper one is on top
            inner = part.T @ block @ part
            stack.append(((inner + inner.T) / 2, basis @ part))
    unit = np.array(vectors[:first]).reshape(-1, len(a))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    values = np.einsum("ij,jk,ik->i", unit, a, unit)
    order = np.argsort(-values, kind="stable")
    return values[order], unit[order]
