"""Numerics of the von Mises-Fisher distribution for a handful of clusters (driver side, NumPy)."""

from __future__ import annotations

import math

import numpy as np

KAPPA_RANGE = (1e-6, 1e6)


def bessel_ratio(kappa: float, dim: int) -> float:
    """A_d(kappa) = I_{d/2}(kappa) / I_{d/2-1}(kappa), by its continued fraction (modified Lentz).

    Exact to rounding over the whole range, where large-kappa expansions can turn negative.
    """
    if kappa <= 0:
        return 0.0
    nu = dim / 2 - 1
    f = c = 1e-300
    d = 0.0
    for k in range(1, 20_000):
        a, b = 1.0, 2 * (nu + k) / kappa
        d = b + a * d if k > 1 else b
        c = b + a / c
        d = 1 / d
        step = c * d
        f *= step
        if abs(step - 1) < 1e-15:
            break
    return min(max(f, 0.0), 1.0)


def log_bessel_i(nu: float, x: float) -> float:
    """log I_nu(x): power series where it converges fast, Debye's uniform expansion elsewhere."""
    if x <= 0:
        return 0.0 if nu == 0 else -math.inf
    if x * x / 4 < 25 * (nu + 1):
        term = total = 1.0
        for k in range(1, 2000):
            term *= x * x / 4 / (k * (k + nu))
            total += term
            if term < 1e-17 * total:
                break
        return nu * math.log(x / 2) - math.lgamma(nu + 1) + math.log(total)
    if nu < 1:
        s, term = 1.0, 1.0
        for k in range(1, 40):
            following = -term * (4 * nu * nu - (2 * k - 1) ** 2) / (8 * k * x)
            if abs(following) > abs(term):
                break
            term = following
            s += term
        return x - 0.5 * math.log(2 * math.pi * x) + math.log(s)
    z = x / nu
    root = math.sqrt(1 + z * z)
    t = 1 / root
    u1 = (3 * t - 5 * t**3) / 24
    u2 = (81 * t**2 - 462 * t**4 + 385 * t**6) / 1152
    u3 = (30375 * t**3 - 369603 * t**5 + 765765 * t**7 - 425425 * t**9) / 414720
    eta = root + math.log(z / (1 + root))
    return nu * eta - 0.5 * math.log(2 * math.pi * nu) - 0.5 * math.log(root) + math.log1p(u1 / nu + u2 / nu**2 + u3 / nu**3)


def log_normalizer(kappa: float, dim: int) -> float:
    nu = dim / 2 - 1
    return nu * math.log(kappa) - dim / 2 * math.log(2 * math.pi) - log_bessel_i(nu, kappa)


def banerjee(r: float, dim: int) -> float:
    return (r * dim - r**3) / max(1 - r * r, 1e-30)


def estimate_kappa(r: float, dim: int) -> float:
    """Banerjee's start and two Newton steps on A_d(kappa) = r, clamped."""
    if r <= 1e-10:
        return KAPPA_RANGE[0]
    if r >= 1 - 1e-10:
        return KAPPA_RANGE[1]
    kappa = float(np.clip(banerjee(r, dim), *KAPPA_RANGE))
    for _ in range(2):
        a = bessel_ratio(kappa, dim)
        slope = 1 - a * a - (dim - 1) / kappa * a
        if abs(slope) < 1e-30:
            break
        kappa = float(np.clip(kappa - (a - r) / slope, *KAPPA_RANGE))
    return kappa
