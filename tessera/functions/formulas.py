"""Closed-form physics as Columns: relativity, electromagnetism, optics, heat,
quantum mechanics, nuclei, orbits and flow.  SI units; a null argument gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.ufuncs import Value, dbl

# CODATA 2018, SI.
C = 299792458.0
H = 6.62607015e-34
HBAR = 1.054571817e-34
E_CHARGE = 1.602176634e-19
K_B = 1.380649e-23
N_A = 6.02214076e23
R_GAS = K_B * N_A
G = 6.67430e-11
EPS0 = 8.8541878128e-12
MU0 = 1.25663706212e-6
M_E = 9.1093837015e-31
AMU = 1.66053906660e-27
SIGMA_SB = 5.670374419e-8
A0_BOHR = 5.29177210903e-11
R_INF = 10973731.568160
WIEN_B = 2.897771955e-3

INF = float("inf")


def _root(x: Column) -> Column:
    return F.sqrt(x)


# --- units

def ev_to_j(ev: Value) -> Column:
    return dbl(ev) * E_CHARGE


def j_to_ev(j: Value) -> Column:
    return dbl(j) / E_CHARGE


def amu_to_kg(u: Value) -> Column:
    return dbl(u) * AMU


def kg_to_amu(kg: Value) -> Column:
    return dbl(kg) / AMU


# --- special relativity

def lorentz_gamma(v: Value, c: float = C) -> Column:
    """Infinite from the speed of light on."""
    b = dbl(v) / c
    return F.when(F.abs(b) >= 1, F.lit(INF)).otherwise(1 / _root(1 - b * b))


def lorentz_transform(t: Value, x: Value, v: Value, c: float = C) -> Column:
    """struct<t, x> in a frame that moves at v along x."""
    g = lorentz_gamma(v, c)
    return F.struct((g * (dbl(t) - dbl(v) * dbl(x) / (c * c))).alias("t"), (g * (dbl(x) - dbl(v) * dbl(t))).alias("x"))


def velocity_add(u: Value, v: Value, c: float = C) -> Column:
    return (dbl(u) + dbl(v)) / (1 + dbl(u) * dbl(v) / (c * c))


def relativistic_energy(m: Value, v: Value, c: float = C) -> Column:
    return lorentz_gamma(v, c) * dbl(m) * (c * c)


def relativistic_kinetic(m: Value, v: Value, c: float = C) -> Column:
    return (lorentz_gamma(v, c) - 1) * dbl(m) * (c * c)


def relativistic_momentum(m: Value, v: Value, c: float = C) -> Column:
    return lorentz_gamma(v, c) * dbl(m) * dbl(v)


def invariant_mass(energy: Value, p: Value, c: float = C) -> Column:
    """0 where the momentum exceeds the energy."""
    square = (dbl(energy) * dbl(energy) - dbl(p) * dbl(p) * (c * c)) / c**4
    return _root(F.greatest(square, F.lit(0.0)))


def doppler_longitudinal(wavelength: Value, beta: Value) -> Column:
    return dbl(wavelength) * _root((1 + dbl(beta)) / (1 - dbl(beta)))


def length_contract(length: Value, v: Value, c: float = C) -> Column:
    return dbl(length) / lorentz_gamma(v, c)


def time_dilate(t: Value, v: Value, c: float = C) -> Column:
    return dbl(t) * lorentz_gamma(v, c)


# --- electromagnetism and optics

def lorentz_force(q: Value, e: list[Value], b: list[Value], v: list[Value]) -> Column:
    """array of the three components of q (E + v x B)."""
    e, b, v = ([dbl(x) for x in vec] for vec in (e, b, v))
    turn = [v[(k + 1) % 3] * b[(k + 2) % 3] - v[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]
    return F.array(*[dbl(q) * (e[k] + turn[k]) for k in range(3)])


def cyclotron_frequency(q: Value, b: Value, m: Value) -> Column:
    return F.abs(dbl(q)) * dbl(b) / dbl(m)


def gyroradius(m: Value, v: Value, q: Value, b: Value) -> Column:
    return dbl(m) * dbl(v) / (F.abs(dbl(q)) * dbl(b))


def plasma_frequency(n: Value) -> Column:
    return _root(dbl(n) * (E_CHARGE**2 / (EPS0 * M_E)))


def debye_length(n: Value, t: Value) -> Column:
    return _root(EPS0 * K_B * dbl(t) / (dbl(n) * E_CHARGE**2))


def biot_savart_loop_axis(current: Value, radius: Value, z: Value) -> Column:
    d2 = dbl(radius) * dbl(radius) + dbl(z) * dbl(z)
    return MU0 * dbl(current) * dbl(radius) * dbl(radius) / (2 * d2 * _root(d2))


def larmor_power(q: Value, a: Value) -> Column:
    return dbl(q) * dbl(q) * dbl(a) * dbl(a) / (6 * math.pi * EPS0 * C**3)


def snell(n1: Value, n2: Value, theta: Value) -> Column:
    """The angle behind the surface; null at total reflection."""
    s = dbl(n1) / dbl(n2) * F.sin(dbl(theta))
    return F.when(F.abs(s) <= 1, F.asin(s))


def fresnel_reflectance(n1: Value, n2: Value, theta: Value) -> Column:
    """Of unpolarised light; 1 at total reflection."""
    inside, outside = F.cos(dbl(theta)), F.cos(snell(n1, n2, theta))
    s = (dbl(n1) * inside - dbl(n2) * outside) / (dbl(n1) * inside + dbl(n2) * outside)
    p = (dbl(n1) * outside - dbl(n2) * inside) / (dbl(n1) * outside + dbl(n2) * inside)
    return F.coalesce((s * s + p * p) / 2, F.lit(1.0))


def thin_lens_image(focal: Value, distance: Value) -> Column:
    """Null for an object in the focal plane."""
    vergence = 1 / dbl(focal) - 1 / dbl(distance)
    return F.when(vergence != 0, 1 / vergence)


# --- heat

def maxwell_boltzmann_pdf(v: Value, m: Value, t: Value) -> Column:
    a = dbl(m) / (K_B * dbl(t))
    density = 4 * math.pi * F.pow(a / (2 * math.pi), F.lit(1.5)) * dbl(v) * dbl(v) * F.exp(-a * dbl(v) * dbl(v) / 2)
    return F.when((dbl(v) < 0) | (dbl(t) <= 0), F.lit(0.0)).otherwise(density)


def mb_most_probable(m: Value, t: Value) -> Column:
    return _root(2 * K_B * dbl(t) / dbl(m))


def mb_mean_speed(m: Value, t: Value) -> Column:
    return _root(8 * K_B * dbl(t) / (math.pi * dbl(m)))


def mb_rms_speed(m: Value, t: Value) -> Column:
    return _root(3 * K_B * dbl(t) / dbl(m))


def gas_pressure(particles: Value, volume: Value, t: Value) -> Column:
    """Of a number of particles (not moles)."""
    return dbl(particles) * K_B * dbl(t) / dbl(volume)


def planck_radiance(nu: Value, t: Value) -> Column:
    x = H * dbl(nu) / (K_B * dbl(t))
    none = (dbl(nu) <= 0) | (dbl(t) <= 0) | (x > 700)
    return F.when(none, F.lit(0.0)).otherwise(2 * H * F.pow(dbl(nu), F.lit(3.0)) / (C * C) / F.expm1(x))


def stefan_boltzmann_exitance(t: Value) -> Column:
    return SIGMA_SB * F.pow(dbl(t), F.lit(4.0))


def wien_peak_wavelength(t: Value) -> Column:
    return WIEN_B / dbl(t)


def einstein_heat_capacity(t: Value, theta: Value) -> Column:
    x = dbl(theta) / dbl(t)
    return F.when(x > 700, F.lit(0.0)).otherwise(3 * R_GAS * x * x * F.exp(x) / F.pow(F.expm1(x), F.lit(2.0)))


def schottky_heat_capacity(t: Value, gap: Value) -> Column:
    x = dbl(gap) / (K_B * dbl(t))
    return F.when(x > 700, F.lit(0.0)).otherwise(R_GAS * x * x * F.exp(-x) / F.pow(1 + F.exp(-x), F.lit(2.0)))


def partition_2level(gap: Value, t: Value) -> Column:
    return 1 + F.exp(-dbl(gap) / (K_B * dbl(t)))


def entropy_of_mixing(x: Value) -> Column:
    v = dbl(x)
    inside = (v > 0) & (v < 1)
    share = F.when(inside, v)
    return F.coalesce(-R_GAS * (share * F.ln(share) + (1 - share) * F.ln(1 - share)), F.when(v.isNotNull(), F.lit(0.0)))


def thermal_wavelength(m: Value, t: Value) -> Column:
    return H / _root(2 * math.pi * dbl(m) * K_B * dbl(t))


# --- quantum mechanics

def particle_in_box_energy(n: Value, length: Value, m: Value) -> Column:
    return H * H / (8 * dbl(m) * dbl(length) * dbl(length)) * dbl(n) * dbl(n)


def particle_in_box_psi(n: Value, length: Value, x: Value) -> Column:
    return _root(2 / dbl(length)) * F.sin(dbl(n) * math.pi * dbl(x) / dbl(length))


def ho_energy(n: Value, omega: Value) -> Column:
    return HBAR * dbl(omega) * (dbl(n) + 0.5)


def ho_length(m: Value, omega: Value) -> Column:
    return _root(HBAR / (dbl(m) * dbl(omega)))


def hermite_phys(n: int, x: Value) -> Column:
    """The physicists' Hermite polynomial, from its explicit sum."""
    n = max(n, 0)
    terms = [(-1) ** k * math.factorial(n) // (math.factorial(k) * math.factorial(n - 2 * k)) * 2 ** (n - 2 * k) for k in range(n // 2 + 1)]
    out = F.lit(0.0)
    for k, c in enumerate(terms):
        power = F.lit(1.0)
        for _ in range(n - 2 * k):
            power = power * dbl(x)
        out = out + float(c) * power
    return out


def ho_psi(n: int, m: Value, omega: Value, x: Value) -> Column:
    unit = ho_length(m, omega)
    xi = dbl(x) / unit
    return hermite_phys(n, xi) * F.exp(-xi * xi / 2) / (math.pi**0.25 * _root(2.0**n * math.factorial(n) * unit))


def hydrogen_energy(n: Value) -> Column:
    return -R_INF * H * C / (dbl(n) * dbl(n))


def hydrogen_1s_psi(r: Value) -> Column:
    return F.exp(-dbl(r) / A0_BOHR) / math.sqrt(math.pi * A0_BOHR**3)


def rabi_probability(omega: Value, t: Value, detuning: Value = 0.0) -> Column:
    square = dbl(omega) * dbl(omega) + dbl(detuning) * dbl(detuning)
    swing = F.sin(_root(square) * dbl(t) / 2)
    return F.when(square == 0, F.lit(0.0)).otherwise(dbl(omega) * dbl(omega) / square * swing * swing)


def tunnel_rectangular(energy: Value, barrier: Value, width: Value, m: Value) -> Column:
    """0 unless all of energy, barrier and width are positive."""
    e, v, a = dbl(energy), dbl(barrier), dbl(width)
    k = _root(2 * dbl(m) * F.abs(v - e)) / HBAR * a
    swing = F.when(e < v, F.sinh(k)).otherwise(F.sin(k))
    return F.when((e <= 0) | (v <= 0) | (a <= 0), F.lit(0.0)).otherwise(1 / (1 + v * v * swing * swing / (4 * e * F.abs(v - e))))


def bloch_vector(theta: Value, phi: Value) -> Column:
    t, p = dbl(theta), dbl(phi)
    return F.array(F.sin(t) * F.cos(p), F.sin(t) * F.sin(p), F.cos(t))


def _matrix(*cells: complex) -> Column:
    return F.array(*[F.struct(F.lit(complex(z).real).alias("re"), F.lit(complex(z).imag).alias("im")) for z in cells])


def pauli_x() -> Column:
    """Row-major array of struct<re, im>, as the other two."""
    return _matrix(0, 1, 1, 0)


def pauli_y() -> Column:
    return _matrix(0, -1j, 1j, 0)


def pauli_z() -> Column:
    return _matrix(1, 0, 0, -1)


# --- nuclei

def decay_remaining(n0: Value, t: Value, half_life: Value) -> Column:
    return dbl(n0) * F.pow(F.lit(0.5), dbl(t) / dbl(half_life))


def decay_activity(n: Value, half_life: Value) -> Column:
    return math.log(2) / dbl(half_life) * dbl(n)


# Volume, surface, Coulomb, asymmetry and pairing terms in MeV.
SEMF = (15.8, 18.3, 0.714, 23.2, 12.0)


def semf_binding_mev(z: Value, a: Value) -> Column:
    """Binding energy of Z protons among A nucleons by the semi-empirical formula."""
    p, n = dbl(z), dbl(a)
    volume, surface, coulomb, asymmetry, pairing = SEMF
    odd_p, odd_n = p % 2 == 1, (n - p) % 2 == 1
    pair = F.when(~odd_p & ~odd_n, pairing / _root(n)).when(odd_p & odd_n, -pairing / _root(n)).otherwise(0.0)
    return volume * n - surface * F.pow(n, F.lit(2 / 3)) - coulomb * p * (p - 1) / F.cbrt(n) - asymmetry * (n - 2 * p) * (n - 2 * p) / n + pair


# --- orbits and flow

def escape_velocity(mass: Value, r: Value, g: float = G) -> Column:
    return _root(2 * g * dbl(mass) / dbl(r))


def circular_velocity(mass: Value, r: Value, g: float = G) -> Column:
    return _root(g * dbl(mass) / dbl(r))


def orbital_period(mass: Value, r: Value, g: float = G) -> Column:
    return 2 * math.pi * _root(F.pow(dbl(r), F.lit(3.0)) / (g * dbl(mass)))


def schwarzschild_radius(mass: Value, g: float = G, c: float = C) -> Column:
    return 2 * g * dbl(mass) / (c * c)


def hubble_velocity(h0: Value, d: Value) -> Column:
    return dbl(h0) * dbl(d)


def mach_number(v: Value, sound: Value) -> Column:
    return dbl(v) / dbl(sound)


def prandtl(mu: Value, cp: Value, k: Value) -> Column:
    return dbl(mu) * dbl(cp) / dbl(k)


def froude(v: Value, length: Value, g: float = 9.81) -> Column:
    return dbl(v) / _root(g * dbl(length))


def nusselt_laminar_flat(re: Value, pr: Value) -> Column:
    return 0.664 * _root(dbl(re)) * F.cbrt(dbl(pr))


def stokes_drag(mu: Value, r: Value, v: Value) -> Column:
    return 6 * math.pi * dbl(mu) * dbl(r) * dbl(v)


def is_padic_unit_re(x: Value, p: int = 5) -> Column:
    """Whether x is a unit of the p-adic numbers: a whole x if p doesn't divide it, any other unless 0."""
    v = dbl(x)
    return (v != 0) & ((v != F.rint(v)) | (v % p != 0))
