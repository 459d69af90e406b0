"""Closed-form physics as Columns, and grid solvers as small array kernels.

Formulas work on any number of rows.  Solvers advance one field each on the
driver's numpy, or a column of fields (a row each) through ``evolve``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.ufuncs import dbl

# Fixed values (SI).
C, G, H, K_B, E_CHARGE, EPS0, G0 = 299_792_458.0, 6.67430e-11, 6.62607015e-34, 1.380649e-23, 1.602176634e-19, 8.8541878128e-12, 9.80665


def kinetic_energy(m, v) -> Column:
    return 0.5 * dbl(m) * dbl(v) * dbl(v)


def potential_energy(m, h, g: float = G0) -> Column:
    return dbl(m) * g * dbl(h)


def gravity(m1, m2, r) -> Column:
    return G * dbl(m1) * dbl(m2) / (dbl(r) * dbl(r))


def coulomb(q1, q2, r) -> Column:
    return dbl(q1) * dbl(q2) / (4 * math.pi * EPS0 * dbl(r) * dbl(r))


def ideal_gas_pressure(n, t, v, r: float = 8.31446261815324) -> Column:
    return dbl(n) * r * dbl(t) / dbl(v)


def photon_energy(wavelength) -> Column:
    return H * C / dbl(wavelength)


def lorentz_factor(v) -> Column:
    b = dbl(v) / C
    return 1 / F.sqrt(1 - b * b)


def blackbody(wavelength, t) -> Column:
    w = dbl(wavelength)
    return 2 * H * C * C / F.pow(w, F.lit(5.0)) / F.expm1(H * C / (w * K_B * dbl(t)))


def reynolds(rho, v, length, mu) -> Column:
    return dbl(rho) * dbl(v) * dbl(length) / dbl(mu)


def projectile(t, speed, angle, g: float = G0) -> Column:
    """struct<x, y> at time t."""
    s, a, u = dbl(speed), dbl(angle), dbl(t)
    return F.struct((s * F.cos(a) * u).alias("x"), (s * F.sin(a) * u - 0.5 * g * u * u).alias("y"))


def projectile_range(speed, angle, g: float = G0) -> Column:
    return dbl(speed) * dbl(speed) * F.sin(2 * dbl(angle)) / g


def harmonic(t, amplitude, omega, phase=0.0) -> Column:
    return dbl(amplitude) * F.cos(dbl(omega) * dbl(t) + dbl(phase))


def damped(t, amplitude, omega0: float, gamma: float) -> Column:
    """Under-damped oscillation."""
    if gamma >= omega0:
        raise ValueError("gamma must be below omega0")
    return dbl(amplitude) * F.exp(-gamma * dbl(t)) * F.cos(math.sqrt(omega0**2 - gamma**2) * dbl(t))


def pendulum_period(length, g: float = G0) -> Column:
    return 2 * math.pi * F.sqrt(dbl(length) / g)


def wave1d(x, t, c: float, shape: Callable[[Column], Column]) -> Column:
    """D'Alembert's solution of a string at rest with the given shape."""
    return (shape(dbl(x) - c * dbl(t)) + shape(dbl(x) + c * dbl(t))) / 2


def heat_kernel(x, t, alpha: float) -> Column:
    return F.exp(-dbl(x) * dbl(x) / (4 * alpha * dbl(t))) / F.sqrt(4 * math.pi * alpha * dbl(t))


# --- solvers on arrays

def laplacian(u: np.ndarray, dx: float = 1.0) -> np.ndarray:
    """Periodic, any number of dimensions."""
    return sum(np.roll(u, 1, k) + np.roll(u, -1, k) - 2 * u for k in range(u.ndim)) / dx**2


def heat(u: np.ndarray, steps: int, alpha: float = 1.0, dt: float = 0.1, dx: float = 1.0) -> np.ndarray:
    if alpha * dt / dx**2 * 2 * u.ndim > 1:
        raise ValueError("the step is too long for the grid")
    for _ in range(steps):
        u = u + alpha * dt * laplacian(u, dx)
    return u


def wave(u: np.ndarray, steps: int, c: float = 1.0, dt: float = 0.1, dx: float = 1.0) -> np.ndarray:
    last = u
    for _ in range(steps):
        u, last = 2 * u - last + (c * dt) ** 2 * laplacian(u, dx), u
    return u


def burgers(u: np.ndarray, steps: int, nu: float = 0.1, dt: float = 0.01, dx: float = 0.1) -> np.ndarray:
    for _ in range(steps):
        u = u - dt * u * (np.roll(u, -1, 0) - np.roll(u, 1, 0)) / (2 * dx) + nu * dt * laplacian(u, dx)
    return u


def advection_diffusion(u: np.ndarray, steps: int, velocity: tuple[float, ...], kappa: float = 0.1, dt: float = 0.01, dx: float = 1.0) -> np.ndarray:
    for _ in range(steps):
        flow = sum(v * (np.roll(u, -1, k) - np.roll(u, 1, k)) / (2 * dx) for k, v in enumerate(velocity))
        u = u + dt * (kappa * laplacian(u, dx) - flow)
    return u


def poisson_fft(f: np.ndarray, dx: float = 1.0) -> np.ndarray:
    """Periodic solution of laplacian(u) = f with mean 0."""
    k = sum(2 * np.cos(2 * np.pi * np.fft.fftfreq(n)).reshape([-1 if j == a else 1 for j in range(f.ndim)]) - 2 for a, n in enumerate(f.shape))
    spectrum = np.fft.fftn(f)
    k.flat[0] = 1
    u = spectrum * dx**2 / k
    u.flat[0] = 0
    return np.fft.ifftn(u).real


def poisson_jacobi(f: np.ndarray, dx: float = 1.0, rounds: int = 5000, tol: float = 1e-8) -> np.ndarray:
    """u is 0 on the edge."""
    u = np.zeros_like(f, dtype=float)
    inner = tuple(slice(1, -1) for _ in f.shape)
    for _ in range(rounds):
        new = u.copy()
        new[inner] = (sum(np.roll(u, 1, k) + np.roll(u, -1, k) for k in range(f.ndim)) - dx**2 * f)[inner] / (2 * f.ndim)
        if np.abs(new - u).max() < tol:
            return new
        u = new
    return u


def navier_stokes2d(u: np.ndarray, v: np.ndarray, steps: int, nu: float = 0.1, dt: float = 0.01, dx: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Periodic, incompressible, by projection on divergence-free fields."""
    d = lambda a, k: (np.roll(a, -1, k) - np.roll(a, 1, k)) / (2 * dx)
    for _ in range(steps):
        a = u + dt * (nu * laplacian(u, dx) - u * d(u, 0) - v * d(u, 1))
        b = v + dt * (nu * laplacian(v, dx) - u * d(v, 0) - v * d(v, 1))
        kx, ky = (np.sin(2 * np.pi * np.fft.fftfreq(n)).reshape(s) / dx for n, s in zip(a.shape, ((-1, 1), (1, -1)), strict=True))
        fa, fb = np.fft.fft2(a), np.fft.fft2(b)
        k2 = kx**2 + ky**2
        div = (kx * fa + ky * fb) / np.where(k2 > 1e-12, k2, 1)
        div = np.where(k2 > 1e-12, div, 0)
        u, v = np.fft.ifft2(fa - kx * div).real, np.fft.ifft2(fb - ky * div).real
    return u, v


def nbody(pos: np.ndarray, vel: np.ndarray, mass: np.ndarray, steps: int, dt: float, g: float = 1.0, soft: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Leapfrog."""
    def pull(p: np.ndarray) -> np.ndarray:
        gap = p[None] - p[:, None]
        r3 = ((gap**2).sum(-1) + soft) ** 1.5
        return g * (gap * (mass[None, :, None] / r3[..., None])).sum(1)

    a = pull(pos)
    for _ in range(steps):
        vel = vel + dt / 2 * a
        pos = pos + dt * vel
        a = pull(pos)
        vel = vel + dt / 2 * a
    return pos, vel


def charged_particle(pos: np.ndarray, vel: np.ndarray, e: np.ndarray, b: np.ndarray, q_over_m: float, steps: int, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Boris's rotation in constant fields."""
    t = q_over_m * b * dt / 2
    s = 2 * t / (1 + t @ t)
    for _ in range(steps):
        minus = vel + q_over_m * e * dt / 2
        plus = minus + np.cross(minus + np.cross(minus, t), s)
        vel = plus + q_over_m * e * dt / 2
        pos = pos + vel * dt
    return pos, vel


def pendulum(theta: float, omega: float, length: float, steps: int, dt: float, g: float = G0) -> tuple[float, float]:
    """Runge-Kutta of the fourth order."""
    f = lambda y: np.array([y[1], -g / length * math.sin(y[0])])
    y = np.array([theta, omega])
    for _ in range(steps):
        k1 = f(y)
        k2 = f(y + dt / 2 * k1)
        k3 = f(y + dt / 2 * k2)
        k4 = f(y + dt * k3)
        y = y + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
    return float(y[0]), float(y[1])


def evolve(field: Column, shape: tuple[int, ...], solver: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A solver over a column of fields (arrays in row-major order)."""
    @F.pandas_udf("array<double>")
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else solver(np.asarray(c, float).reshape(shape)).ravel() for c in cells])

    return run(field)
