"""Leading eigenpairs of a symmetric matrix by QDWH spectral divide and conquer.

The polar factor of the shifted matrix, found by the dynamically weighted Halley iteration, has eigenvalues 1 above the
shift and -1 below it, so half of its sum with the identity projects on the invariant subspace above the shift. An
orthonormal basis of the subspace and of its complement splits the matrix in two, and each part is split again until it is
diagonal. Parts below the wanted components are not split further.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
#: The iteration reaches double precision in six steps from the least bound; more are a sign of a shift on an eigenvalue.
MOST_STEPS = 12
#: From this weight on the well-conditioned QR form of the step is replaced by the cheaper Cholesky form.
CHOLESKY_WEIGHT = 100.0


def _weights(low: float) -> tuple[float, float, float]:
    """Weights of the Halley step that maps [low, 1] closest to 1."""
    square = low * low
    d = (4.0 * (1.0 - square) / (square * square)) ** (1.0 / 3.0)
    root = math.sqrt(1.0 + d)
    a = root + 0.5 * math.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root))
    b = (a - 1.0) ** 2 / 4.0
    return a, b, a + b - 1.0


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """The symmetric orthogonal polar factor of a symmetric matrix without an eigenvalue at 0."""
    n = len(matrix)
    size = float(np.linalg.norm(matrix))
    x, low, eye = matrix / size, EPS, np.eye(n)
    for _ in range(MOST_STEPS):
        low = min(low, 1.0)
        a, b, c = _weights(low)
        if c > CHOLESKY_WEIGHT:
            q, _ = np.linalg.qr(np.concatenate([math.sqrt(c) * x, eye]))
            following = b / c * x + (a - b / c) / math.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            factor = np.linalg.cholesky(eye + c * (x.T @ x))
            following = b / c * x + (a - b / c) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        following = (following + following.T) / 2.0
        moved = float(np.linalg.norm(following - x))
        x, low = following, low * (a + b * low * low) / (1.0 + c * low * low)
        if abs(1.0 - low) < 10 * EPS and moved < 1e-5 * math.sqrt(n):  # the order of convergence is three
            break
    return x


def _subspaces(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range and of the null space of a projector of the given rank."""
    start = np.random.default_rng(rank).standard_normal((len(projector), rank))
    for _ in range(2):
        start, _ = np.linalg.qr(projector @ start)
    whole, _ = np.linalg.qr(start, mode="complete")
    return whole[:, :rank], whole[:, rank:]


def _split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of two complementary invariant subspaces, that of the greater eigenvalues first."""
    n, diagonal = len(matrix), np.diag(matrix)
    mean = float(diagonal.mean())  # strictly between the least and the greatest eigenvalue, unless they are equal
    width = float(np.linalg.norm(matrix - mean * np.eye(n)))
    shifts = [float(np.median(diagonal)), mean] + [mean + k * 1e-4 * width / n for k in (1, -1, 2, -2, 3, -3, 5, -5)]
    best = None
    for shift in shifts:
        centred = matrix - shift * np.eye(n)
        if not np.linalg.norm(centred):
            continue
        sign = polar_factor(centred)
        rank = int(round((np.trace(sign) + n) / 2.0))
        if not 0 < rank < n:
            continue
        bases = _subspaces((sign + np.eye(n)) / 2.0, rank)
        rest = float(np.linalg.norm(bases[1].T @ matrix @ bases[0]))
        if best is None or rest < best[0]:
            best = rest, bases
        if rest <= 20 * n * EPS * np.linalg.norm(matrix):
            break
    if best is None:
        raise ArithmeticError("no shift splits the matrix")
    return best[1]


def _leading(matrix: np.ndarray, wanted: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(matrix)
    diagonal = np.diag(matrix)
    if n == 1 or np.linalg.norm(matrix - np.diag(diagonal)) <= n * EPS * size:
        order = np.argsort(-diagonal, kind="stable")[:wanted]
        return diagonal[order], np.eye(n)[:, order]
    upper, lower = _split(matrix)
    values, vectors = [], []
    for basis in (upper, lower):
        if wanted > 0:
            inner = basis.T @ matrix @ basis
            some, turned = _leading((inner + inner.T) / 2.0, min(wanted, len(inner)), size)
            values.append(some)
            vectors.append(basis @ turned)
            wanted -= len(some)
    return np.concatenate(values), np.concatenate(vectors, axis=1)


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = float(np.linalg.norm(matrix))
    values, vectors = _leading(matrix, min(wanted, len(matrix)), size)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
