"""Eigenvalues and eigenvectors of integer scatter matrices by their exact characteristic polynomial.

Modulo a prime, elimination by similarity brings a matrix to Hessenberg form, whose characteristic
polynomial follows from a recurrence; the Chinese remainders of enough primes give the coefficients as
integers. All roots are real, so the sign changes of the coefficients of p(x + a) count the roots
above ``a`` exactly; halving intervals isolates them and signs of p refine them, all in integers.
Eigenvectors come by inverse iteration from the refined roots, in fixed point of many more bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

ROOT_BITS = 140     # roots are refined to this many bits
SAME_BITS = 120     # roots that agree in this many are one root, met several times
VECTOR_BITS = 320   # bits after the point while eigenvectors are solved for


def primes() -> Iterator[int]:
    """The primes below 2^31, from the largest down."""
    def prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # these settle every number below 3.2 * 10^9
            x = pow(base, odd, n)
            if x in (1, n - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    return (n for n in range(2**31 - 1, 10_000, -2) if prime(n))


def enough_primes(size: int, trace: int) -> list[int]:
    """Primes whose product tells all coefficients apart, for a matrix without negative eigenvalues.

    A coefficient is a sum of products of eigenvalues, largest when all of them are equal.
    """
    bound = max(math.comb(size, k) * trace**k // size**k + 1 for k in range(size + 1))
    found, product = [], 1
    for p in primes():
        if product > 2 * bound:
            return found
        found.append(p)
        product *= p
    raise ValueError("the matrix is too large")


def poly_mod(matrix: Sequence[Sequence[int]], p: int) -> list[int]:
    """The characteristic polynomial modulo ``p``, constant coefficient first."""
    h = np.array([[value % p for value in row] for row in matrix], np.int64)
    size = len(h)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factors % p).sum(axis=1)) % p
    # The polynomials of the leading blocks, each from those before it.
    polys = np.zeros((size + 1, size + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, size + 1):
        new = np.zeros(size + 1, np.int64)
        new[1:] = polys[m - 1, :-1]
        factors, product = [int(h[m - 1, m - 1])], 1
        for i in range(m - 2, -1, -1):
            product = product * int(h[i + 1, i]) % p
            factors.append(int(h[i, m - 1]) * product % p)
        earlier = polys[m - len(factors):m][::-1]
        polys[m] = (new - (np.array(factors, np.int64)[:, None] * earlier % p).sum(axis=0)) % p
    return polys[size].tolist()


def combine(moduli: Sequence[int], residues: Sequence[Sequence[int]]) -> list[int]:
    """The integers of least magnitude with these residues, one list of them for each modulus."""
    product = math.prod(moduli)
    weights = [product // p * pow(product // p, -1, p) for p in moduli]
    out = []
    for some in zip(*residues, strict=True):
        value = sum(r * w for r, w in zip(some, weights, strict=True)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def count_above(poly: Sequence[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only are above ``at / 2^bits``."""
    size = len(poly) - 1
    shifted = [c << bits * (size - k) for k, c in enumerate(poly)]  # its roots are 2^bits times as large
    for first in range(size):
        for k in range(size - 1, first - 1, -1):
            shifted[k] += at * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: Sequence[int], at: int, bits: int) -> int:
    """The sign of the polynomial at ``at / 2^bits``."""
    value, size = 0, len(poly) - 1
    for k in range(size, -1, -1):
        value = value * at + (poly[k] << bits * (size - k))
    return (value > 0) - (value < 0)


def largest_roots(poly: Sequence[int], most: int) -> list[tuple[int, int, int]]:
    """The ``most`` largest positive roots, falling: each as value, bits after its point, multiplicity.

    The polynomial, constant coefficient first, has no roots but real ones that are not negative. The
    last root may be one that is met more often than was asked for.
    """
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    size = len(poly) - 1
    found: list[tuple[int, int, int]] = []
    if not size:
        return found
    top = 1 << max(1, (-poly[-2] // poly[-1] + 1).bit_length())  # above the sum of all roots
    open_ = [(0, top, 0, size, 0)]  # lower end, upper end, bits, roots above either end
    while open_ and sum(f[2] for f in found) < most:
        low, high, bits, above_low, above_high = open_.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1:
            found.append((*_refine(poly, low, high, bits, above_high), 1))
        elif high > 1 and (high - low) << SAME_BITS <= high:
            found.append((low + high, bits + 1, inside))
        else:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            above = count_above(poly, middle, bits)
            open_.append((low, middle, bits, above_low, above))
            open_.append((middle, high, bits, above, above_high))
    return found


def _refine(poly: Sequence[int], low: int, high: int, bits: int, above_high: int) -> tuple[int, int]:
    """Halve (low, high], which holds one root, until it is as narrow as wanted."""
    right = -1 if above_high % 2 else 1  # the sign between this root and the next larger one
    while (high - low) << ROOT_BITS > high:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        sign = sign_at(poly, middle, bits) * (1 if poly[-1] > 0 else -1)
        if sign == 0:
            return middle, bits
        if sign == right:
            high = middle
        else:
            low = middle
    return low + high, bits + 1


def eigenvectors(matrix: Sequence[Sequence[int]], root: int, bits: int, count: int) -> np.ndarray:
    """``count`` orthonormal eigenvectors, as rows, of a symmetric matrix at ``root / 2^bits``.

    Two rounds of inverse iteration from repeatable starts, with elimination in fixed point; a pivot of
    zero stands for the smallest number. The largest entry of every vector is positive.
    """
    size = len(matrix)
    one = 1 << VECTOR_BITS
    top = max(1, max(abs(v) for row in matrix for v in row))
    # Entries are taken relative to the largest one.
    rows = np.array([[((v << bits) - (root if i == j else 0) << VECTOR_BITS) // (top << bits)
                      for j, v in enumerate(row)] for i, row in enumerate(matrix)], object)
    steps = []
    for k in range(size):
        pivot = k + max(range(size - k), key=lambda i: abs(rows[k + i, k]))
        if pivot != k:
            rows[[k, pivot]] = rows[[pivot, k]]
        if rows[k, k] == 0:
            rows[k, k] = 1
        factors = (rows[k + 1:, k] << VECTOR_BITS) // rows[k, k]
        rows[k + 1:, k + 1:] -= factors[:, None] * rows[k, k + 1:] >> VECTOR_BITS
        steps.append((pivot, factors))

    def solve(right: np.ndarray) -> np.ndarray:
        right = right.copy()
        for k, (pivot, factors) in enumerate(steps):
            right[[k, pivot]] = right[[pivot, k]]
            right[k + 1:] -= factors * right[k] >> VECTOR_BITS
        for k in range(size - 1, -1, -1):
            right[k] = ((right[k] << VECTOR_BITS) - int((rows[k, k + 1:] * right[k + 1:]).sum())
                        ) // rows[k, k]
        return right

    def unit(vector: np.ndarray) -> np.ndarray:
        vector = (vector << VECTOR_BITS) // max(1, max(abs(v) for v in vector))
        return (vector << VECTOR_BITS) // max(1, math.isqrt(int((vector * vector).sum())))

    found: list[np.ndarray] = []
    for n in range(count):
        # Different in every entry and from one start to the next.
        vector = np.array([one // (2 + (i * (n + 2) + 7 * n * n) % (size + 13)) for i in range(size)],
                          object)
        for _ in range(2):
            for other in found:
                vector = vector - (other * (int((vector * other).sum()) >> VECTOR_BITS) >> VECTOR_BITS)
            vector = unit(solve(unit(vector)))
        for _ in range(2):
            for other in found:
                vector = vector - (other * (int((vector * other).sum()) >> VECTOR_BITS) >> VECTOR_BITS)
            vector = unit(vector)
        found.append(vector)
    out = np.array([[v / one for v in vector] for vector in found], np.float64)
    signs = np.sign(out[np.arange(count), np.abs(out).argmax(axis=1)])
    return out * signs[:, None]
