"""Singular values and right singular vectors of a small matrix by qd transforms.

Householder reflections take the matrix to an upper bidiagonal B with diagonal a
and superdiagonal b. All else works on q = a^2 and e = b^2: dqds finds the
eigenvalues of B^T B (the squared singular values) without ever forming it, and
the vectors come from twisted factorisations: the stationary qd transform from
the top and the progressive one from the bottom of B^T B - x I meet where their
twist element is least, and the vector follows by multiplications only.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this share of the largest have their vectors made orthogonal to each other.
CLOSE = 1e-5
#: An entry of e this small beside its eigenvalue, or this small at all, splits the matrix.
SMALL, TINY = (16 * EPS) ** 2, 1e-290


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V) with ``matrix`` = U B V^T for some orthogonal U; ``matrix`` has at least as many rows as columns."""
    m = np.array(matrix, float)
    n = m.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not x[1:].any():
            return None
        u = x.copy()
        u[0] += math.copysign(norm, x[0])
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(m[k:, k])
        if u is not None:
            m[k:, k:] -= 2 * np.outer(u, u @ m[k:, k:])
        if k + 2 < n:
            u = reflector(m[k, k + 1:])
            if u is not None:
                m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ u, u)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(m[:n]).copy(), np.diag(m[:n], 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | float:
    """One transform of (q, e) by ``shift``; where that is too large, the least shift known to be so."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i, x in enumerate(e):
        if d < 0:
            return shift
        top = d + x
        new_q.append(top)
        if top == 0:                                   # d and x are zero: the next pivot starts afresh
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / top
            new_e.append(x * t)
            d = d * t - shift
    if d < 0:                                          # only the last pivot failed: so much less often does
        return shift + d if shift + d > shift / 2 else shift
    new_q.append(d)
    return new_q, new_e


def eigenvalues(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of B^T B, largest first, by dqds with deflation from the bottom."""
    scale = float(max(np.max(q, initial=0.0), np.max(e, initial=0.0)))
    if scale == 0 or not len(q):
        return np.zeros(len(q))
    found: list[float] = []
    todo = [((np.asarray(q) / scale).tolist(), (np.asarray(e) / scale).tolist(), 0.0)]
    while todo:
        a, b, moved = todo.pop()
        steps = 0
        while len(a) > 1:
            cut = next((i for i in range(len(b) - 1, -1, -1) if b[i] <= SMALL * (moved + min(a[i], a[i + 1])) or b[i] < TINY), None)
            if cut is not None:
                if cut < len(b) - 1:                   # two matrices; the lower one goes on here
                    todo.append((a[:cut + 1], b[:cut], moved))
                    a, b = a[cut + 1:], b[cut + 1:]
                else:
                    found.append(moved + a.pop())
                    b.pop()
                steps = min(steps, 1)
                continue
            if steps == 0 and a[0] * 1.5 < a[-1]:      # small values belong at the bottom
                a, b = a[::-1], b[::-1]
                a, b = _reversed(a, b)
            steps += 1
            if steps > 60 * (len(a) + 10):
                raise ArithmeticError("dqds did not settle")
            # The smaller eigenvalue of the last two rows, as a first shift.
            above = b[-2] if len(b) > 1 else 0.0
            x, y, z = a[-2] + above, a[-1] + b[-1], a[-2] * b[-1]
            half = (x - y) / 2
            shift = max(0.0, y - z / (half + math.copysign(math.hypot(half, math.sqrt(z)), half))) if z else min(x, y)
            shift = min(shift, a[-1], min(a))
            tries = 0
            while not isinstance(out := _dqds(a, b, shift), tuple):
                tries += 1
                shift = min(out, shift * (1 - EPS * 64 ** tries)) if tries <= 8 else shift / 4 if tries <= 30 else 0.0
            a, b = out
            moved += shift
        if a:
            found.append(moved + a[0])
    return np.sort(np.array(found))[::-1] * scale


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """(q, e) of the same eigenvalues for arrays given back to front: B read from the other corner is lower bidiagonal."""
    # A lower bidiagonal's L L^T has the diagonal q[i] + e[i-1] of these arrays; one unshifted step restores the form.
    out = _dqds(q, e, 0.0)
    return out if isinstance(out, tuple) else (q[::-1], e[::-1])


class _Twisted:
    """B^T B - x I factored from the top (stationary qd) and from the bottom (progressive qd)."""

    def __init__(self, a, b, q, e, x: float, floor: float):
        n = len(q)

        def pivot(value: float) -> float:
            return value if abs(value) > floor else math.copysign(floor, value)

        s, p = np.empty(n), np.empty(n)
        self.top, self.bottom = np.empty(n), np.empty(n)
        self.down, self.up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
        s[0], p[-1] = -x, q[-1] - x
        for i in range(n - 1):
            self.top[i] = pivot(s[i] + q[i])
            self.down[i] = a[i] * b[i] / self.top[i]
            s[i + 1] = e[i] * s[i] / self.top[i] - x
        twist = np.empty(n)
        twist[-1] = s[-1] + q[-1]
        for i in range(n - 2, -1, -1):
            self.bottom[i + 1] = pivot(e[i] + p[i + 1])
            self.up[i] = a[i] * b[i] / self.bottom[i + 1]
            rest = q[i] * p[i + 1] / self.bottom[i + 1] if e[i] else q[i]
            twist[i] = s[i] + rest
            p[i] = rest - x
        self.at = int(np.abs(twist).argmin())
        self.least = pivot(twist[self.at])

    def vector(self) -> np.ndarray:
        """The vector with one nonzero image, at the twist."""
        z = np.zeros(len(self.top))
        z[self.at] = 1.0
        return self._back(z)

    def _back(self, y: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(self.at, len(y) - 1):
            y[i + 1] -= self.up[i] * y[i]
        return y

    def solve(self, right: np.ndarray) -> np.ndarray:
        y = right.copy()
        for i in range(self.at):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(len(y) - 1, self.at, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        y[:self.at] /= self.top[:self.at]
        y[self.at] /= self.least
        y[self.at + 1:] /= self.bottom[self.at + 1:]
        return self._back(y)


def bidiagonal_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B^T B in columns, for its eigenvalues ``values`` in falling order."""
    n = len(a)
    top = float(values[0]) if len(values) else 0.0
    b = np.where(np.abs(b) <= EPS * math.sqrt(top), 0.0, b)
    q, e = a * a, b * b
    floor = max(EPS * EPS * top, 1e-300)
    out = np.zeros((n, len(values)))

    def freed(z: np.ndarray, near: list[int]) -> np.ndarray:
        for _ in range(2):
            for j in near:
                z = z - (out[:, j] @ z) * out[:, j]
            z = z / np.linalg.norm(z)
        return z

    for k, value in enumerate(values):
        near = [j for j in range(k) if values[j] - value <= CLOSE * top]
        if near:                                            # inverse iteration beside the close vectors
            factors = _Twisted(a, b, q, e, float(value), floor)
            z = freed(np.random.default_rng(k).normal(size=n), near)
            for _ in range(4):
                z = factors.solve(z)
                z = freed(z / np.abs(z).max(), near)
            out[:, k] = z
            continue
        x, best = float(value), None
        for _ in range(4):
            z = _Twisted(a, b, q, e, x, floor).vector()
            z /= np.linalg.norm(z)
            image = a * z
            image[:-1] += b * z[1:]
            x = float(image @ image)                        # the Rayleigh quotient
            back = a * image
            back[1:] += b * image[:-1]
            error = float(np.linalg.norm(back - x * z))
            if best is None or error < best[0]:
                best = (error, z)
            if error <= 4 * EPS * top * math.sqrt(n):
                break
        out[:, k] = best[1]
    return out


def right_singular(matrix: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, right singular vectors in columns, sum of all squares) of the ``keep`` largest.

    Values that are zero to working precision are left out. The largest entry of
    each vector is positive.
    """
    d = matrix.shape[1]
    if matrix.shape[0] < d:
        matrix = np.vstack([matrix, np.zeros((d - matrix.shape[0], d))])
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    a, b, v = bidiagonalise(matrix / size)
    values = eigenvalues(a * a, b * b)
    total = float(values.sum())
    values = values[:keep]
    values = values[values > (d * EPS) ** 2 * values[0] * 16]
    vectors = v @ bidiagonal_vectors(a, b, values)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values * size * size, vectors, total * size * size
