"""Island growth and surfaces as Column expressions (SI units)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permeability of free space.
MU0 = 4e-7 * math.pi


def resistive_time(eta: Column, radius: Column, prefactor: float = 1.22) -> Column:
    return MU0 * radius * radius / (prefactor * eta)


def bootstrap_drive(width: Column, beta: Column, radius: Column, l_q: Column, l_p: Column, larmor: Column, factor: float = 1.0) -> Column:
    """0 where a scale is 0, or the island and the Larmor radius are."""
    below = width * width + larmor * larmor
    drive = factor * (beta / radius) * (radius / l_q) * (radius / l_p) * width / below
    return F.when((radius == 0) | (l_q == 0) | (l_p == 0) | (below <= 0), 0.0).otherwise(drive)


def current_drive(current: Column, poloidal: Column, q: Column, axis: Column, width: Column, sigma: Column | None = None) -> Column:
    """Stabilising term of a driven current; with sigma the deposition is that wide."""
    shape = 1 / width if sigma is None else F.when(sigma > 0, sigma * F.tanh(width / sigma) / width).otherwise(1 / width)
    return -MU0 * axis * q / poloidal * current * shape


def growth(delta_prime: Column, *terms: Column) -> Column:
    return sum(terms, delta_prime)


def seed_width(field: Column, wall: Column, radius: Column, poloidal: Column, m: int = 2) -> Column:
    """Half width of an island whose flux is carried inwards from the radial field at the wall (m of 2 or more)."""
    flux = F.abs(field) * wall / (m - 1) * F.pow(radius / wall, F.lit(m))
    return 4 * F.sqrt(radius * flux / (m * poloidal))


def poloidal_field(current: Column, radius: Column, elongation: float = 1.8) -> Column:
    return MU0 * current / (2 * math.pi * radius * elongation)
