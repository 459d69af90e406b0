"""Simulated analog products: a resistive crossbar and a mesh of interferometers.

Weights become conductances or phases of limited precision; a batch of vectors
is multiplied row by row in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Crossbar:
    """Conductances between g_min and g_max in 2**bits levels; noise is relative."""

    weights: np.ndarray
    bits: int = 4
    g_min: float = 1e-6
    g_max: float = 1e-4
    noise: float = 0.0
    seed: int = 0

    def scale(self) -> float:
        return float(np.abs(self.weights).max()) or 1.0

    def quantized(self) -> np.ndarray:
        levels = 2**self.bits - 1
        return np.rint(self.weights / self.scale() * levels) / levels * self.scale()

    def conductances(self) -> tuple[np.ndarray, np.ndarray]:
        """A differential pair: positive and negative weights on separate cells."""
        w = self.quantized() / self.scale()
        g = lambda x: self.g_min + np.maximum(x, 0) * (self.g_max - self.g_min)
        return g(w), g(-w)

    def effective_weights(self) -> np.ndarray:
        plus, minus = self.conductances()
        w = (plus - minus) / (self.g_max - self.g_min) * self.scale()
        if self.noise:
            w = w * (1 + self.noise * np.random.default_rng(self.seed).standard_normal(w.shape))
        return w

    def fidelity(self) -> float:
        a, b = self.weights.ravel(), self.effective_weights().ravel()
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else 1.0

    def dot(self, x: Column) -> Column:
        """The product with a column of vectors."""
        w = self.effective_weights()

        @F.pandas_udf("array<double>")
        def run(cells: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else np.asarray(c, float) @ w for c in cells])

        return run(x)


def mzi(theta: float, phi: float) -> np.ndarray:
    """The 2 x 2 transfer matrix of one interferometer."""
    s, c = math.sin(theta / 2), math.cos(theta / 2)
    return 1j * np.exp(1j * theta / 2) * np.array([[np.exp(1j * phi) * s, c], [np.exp(1j * phi) * c, -s]])


def is_unitary(u: np.ndarray, tol: float = 1e-9) -> bool:
    return bool(np.allclose(u.conj().T @ u, np.eye(len(u)), atol=tol))


def fidelity(a: np.ndarray, b: np.ndarray) -> float:
    return float(abs(np.trace(a.conj().T @ b)) ** 2 / len(a) ** 2)


def quantize_phase(phase, bits: int):
    step = 2 * math.pi / 2**bits
    return np.rint(np.asarray(phase) / step) * step


def mesh_phases(u: np.ndarray) -> tuple[list[tuple[int, float, float]], np.ndarray]:
    """A unitary as interferometers (mode, theta, phi) on neighbouring modes and
    a last column of phases: elements below the diagonal are nulled in turn."""
    if not is_unitary(u, 1e-8):
        raise ValueError("not unitary")
    u, out = u.astype(complex).copy(), []
    n = len(u)
    for row in range(n - 1, 0, -1):
        for m in range(row):
            a, b = u[row, m], u[row, m + 1]
            theta = 2 * math.atan2(abs(b), abs(a))
            phi = float(np.angle(a) - np.angle(b)) if abs(a) and abs(b) else 0.0
            # Columns m, m+1 times the inverse of the interferometer give 0 at (row, m).
            best = min(((t, f) for t in (theta, math.pi - theta, -theta, theta + math.pi) for f in (phi, -phi, phi + math.pi, -phi + math.pi)), key=lambda p: abs((u[row, m : m + 2] @ mzi(*p).conj().T)[0]))
            u[:, m : m + 2] = u[:, m : m + 2] @ mzi(*best).conj().T
            out.append((m, *best))
    return out[::-1], np.angle(np.diag(u))


def mesh_unitary(parts: list[tuple[int, float, float]], phases: np.ndarray) -> np.ndarray:
    u = np.diag(np.exp(1j * np.asarray(phases)))
    for m, theta, phi in parts:
        u[:, m : m + 2] = u[:, m : m + 2] @ mzi(theta, phi)
    return u
