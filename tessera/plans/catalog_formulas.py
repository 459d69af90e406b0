"""Registered queries over closed-form functions: one row per input row, one column per function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import formulas as f
from tessera.functions import physics
from tessera.functions import ufuncs as u
from tessera.plans.catalog import QUERIES, SQL, read, rounded


def per_row(name: str, table: str, key: str, pairs: list[tuple[str, Callable, str]], columns: type) -> None:
    """Registers a query that gives key and, for each (alias, column maker, SQL), that
    column: to nine significant digits, or as it is where the alias begins with ``=``."""

    def query(spark, sf_dir):
        given = columns()
        return read(spark, sf_dir, table).select(key, *[make(given).alias(alias[1:]) if alias[0] == "=" else digits(make(given)).alias(alias) for alias, make, _ in pairs])

    listed = ", ".join(f"{sql} AS {alias[1:]}" if alias[0] == "=" else f"{sql_digits(sql)} AS {alias}" for alias, _, sql in pairs)
    QUERIES[name] = query
    SQL[name] = f"SELECT {key}, {listed} FROM {table}"


def digits(x: Column) -> Column:
    """x as its logarithm's nine digits and its sign, so that sizes from 1e-40 to 1e40 compare alike."""
    v = x.cast("double")
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (rounded(F.ln(F.abs(v)), 8) + 100))


def sql_digits(x: str) -> str:
    return f"CASE WHEN ({x}) = 0 THEN 0.0 ELSE sign({x}) * (round(ln(abs(CAST(({x}) AS DOUBLE))), 8) + 100) END"


class Part:
    """The columns that the formulas take, made when a query runs."""

    def __init__(self):
        self.S, self.P = F.col("p_size"), F.col("p_retailprice")
        self.V = self.S * 4e6  # a speed below that of light


GAMMA = "(1 / sqrt(1 - (p_size * 4e6 / 2.99792458e8) * (p_size * 4e6 / 2.99792458e8)))"
C2 = "(2.99792458e8 * 2.99792458e8)"

per_row("relativity", "part", "p_partkey", [
    ("gamma", lambda c: f.lorentz_gamma(c.V), GAMMA),
    ("fast", lambda c: u.isinf(f.lorentz_gamma(c.P * 1e9)).cast("double"), "CASE WHEN p_retailprice * 1e9 >= 2.99792458e8 THEN 1.0 ELSE 0.0 END"),
    ("boost_t", lambda c: f.lorentz_transform(c.P, c.S, c.V)["t"], f"{GAMMA} * (p_retailprice - p_size * 4e6 * p_size / {C2})"),
    ("boost_x", lambda c: f.lorentz_transform(c.P, c.S, c.V)["x"], f"{GAMMA} * (p_size - p_size * 4e6 * p_retailprice)"),
    ("sum", lambda c: f.velocity_add(c.V, c.V / 2), f"(p_size * 6e6) / (1 + p_size * 4e6 * p_size * 2e6 / {C2})"),
    ("energy", lambda c: f.relativistic_energy(c.P, c.V), f"{GAMMA} * p_retailprice * {C2}"),
    ("kinetic", lambda c: f.relativistic_kinetic(c.P, c.V) + c.P * f.C * f.C, f"{GAMMA} * p_retailprice * {C2}"),
    ("momentum", lambda c: f.relativistic_momentum(c.P, c.V), f"{GAMMA} * p_retailprice * p_size * 4e6"),
    ("mass", lambda c: f.invariant_mass(c.P * 1e17, c.S * 1e8), f"sqrt(greatest((p_retailprice * 1e17 * p_retailprice * 1e17 - p_size * 1e8 * p_size * 1e8 * {C2}) / ({C2} * {C2}), 0))"),
    ("doppler", lambda c: f.doppler_longitudinal(c.P, c.S / 100), "p_retailprice * sqrt((1 + p_size / 100) / (1 - p_size / 100))"),
    ("shorter", lambda c: f.length_contract(c.P, c.V), f"p_retailprice / {GAMMA}"),
    ("longer", lambda c: f.time_dilate(c.P, c.V), f"p_retailprice * {GAMMA}"),
    ("ev", lambda c: f.ev_to_j(c.P), "p_retailprice * 1.602176634e-19"),
    ("joule", lambda c: f.j_to_ev(c.P), "p_retailprice / 1.602176634e-19"),
    ("kg", lambda c: f.amu_to_kg(c.P), "p_retailprice * 1.66053906660e-27"),
    ("amu", lambda c: f.kg_to_amu(c.P), "p_retailprice / 1.66053906660e-27"),
], Part)

SIN = "sin(p_size / 60)"

per_row("fields_and_light", "part", "p_partkey", [
    ("fx", lambda c: f.lorentz_force(2, [c.S, 1, 0], [0, 3, c.P], [1, c.S, 2])[0], "2 * (p_size + p_size * p_retailprice - 6)"),
    ("fy", lambda c: f.lorentz_force(2, [c.S, 1, 0], [0, 3, c.P], [1, c.S, 2])[1], "2 * (1 - p_retailprice)"),
    ("fz", lambda c: f.lorentz_force(2, [c.S, 1, 0], [0, 3, c.P], [1, c.S, 2])[2], "CAST(6 AS DOUBLE)"),
    ("cyclotron", lambda c: f.cyclotron_frequency(-1.602176634e-19, c.S, c.P), "1.602176634e-19 * p_size / p_retailprice"),
    ("gyro", lambda c: f.gyroradius(c.P, c.V, -2.0, c.S), "p_retailprice * p_size * 4e6 / (2.0 * p_size)"),
    ("plasma", lambda c: f.plasma_frequency(c.P * 1e15), "sqrt(p_retailprice * 1e15 * 1.602176634e-19 * 1.602176634e-19 / (8.8541878128e-12 * 9.1093837015e-31))"),
    ("debye", lambda c: f.debye_length(c.P * 1e15, c.S), "sqrt(8.8541878128e-12 * 1.380649e-23 * p_size / (p_retailprice * 1e15 * 1.602176634e-19 * 1.602176634e-19))"),
    ("loop", lambda c: f.biot_savart_loop_axis(c.P, c.S, 2.0), "1.25663706212e-6 * p_retailprice * p_size * p_size / (2 * pow(p_size * p_size + 4.0, 1.5))"),
    ("larmor", lambda c: f.larmor_power(1e-10, c.P * 1e9), "1e-20 * pow(p_retailprice * 1e9, 2) / (6 * pi() * 8.8541878128e-12 * pow(2.99792458e8, 3))"),
    ("snell", lambda c: f.snell(1.5, 1.0, c.S / 60), f"CASE WHEN 1.5 * {SIN} <= 1 THEN asin(1.5 * {SIN}) END"),
    ("reflect", lambda c: f.fresnel_reflectance(1.0, 1.5, c.S / 60), f"""(pow((cos(p_size / 60) - 1.5 * sqrt(1 - pow({SIN} / 1.5, 2))) / (cos(p_size / 60) + 1.5 * sqrt(1 - pow({SIN} / 1.5, 2))), 2)
      + pow((sqrt(1 - pow({SIN} / 1.5, 2)) - 1.5 * cos(p_size / 60)) / (sqrt(1 - pow({SIN} / 1.5, 2)) + 1.5 * cos(p_size / 60)), 2)) / 2"""),
    ("total", lambda c: F.when(f.snell(1.5, 1.0, c.S / 60).isNull(), f.fresnel_reflectance(1.5, 1.0, c.S / 60)), f"CASE WHEN 1.5 * {SIN} > 1 THEN 1.0 END"),
    ("image", lambda c: f.thin_lens_image(10.0, c.S), "CASE WHEN p_size <> 10 THEN 1 / (1 / 10.0 - 1.0 / p_size) END"),
], Part)

EX = "exp(300.0 / (p_size + 50))"
per_row("heat_formulas", "part", "p_partkey", [
    ("pdf", lambda c: f.maxwell_boltzmann_pdf(c.S * 10, 4.65e-26, c.P), "4 * pi() * pow(4.65e-26 / (2 * pi() * 1.380649e-23 * p_retailprice), 1.5) * pow(p_size * 10, 2) * exp(-4.65e-26 * pow(p_size * 10, 2) / (2 * 1.380649e-23 * p_retailprice))"),
    ("likely", lambda c: f.mb_most_probable(4.65e-26, c.P), "sqrt(2 * 1.380649e-23 * p_retailprice / 4.65e-26)"),
    ("mean", lambda c: f.mb_mean_speed(4.65e-26, c.P), "sqrt(8 * 1.380649e-23 * p_retailprice / (pi() * 4.65e-26))"),
    ("rms", lambda c: f.mb_rms_speed(4.65e-26, c.P), "sqrt(3 * 1.380649e-23 * p_retailprice / 4.65e-26)"),
    ("gas", lambda c: f.gas_pressure(1e23, c.S, c.P), "1e23 * 1.380649e-23 * p_retailprice / p_size"),
    ("moles", lambda c: physics.ideal_gas_pressure(3.0, c.P, c.S), "3.0 * 8.31446261815324 * p_retailprice / p_size"),
    ("planck", lambda c: f.planck_radiance(c.S * 1e12, c.P), "2 * 6.62607015e-34 * pow(p_size * 1e12, 3) / (2.99792458e8 * 2.99792458e8) / (exp(6.62607015e-34 * p_size * 1e12 / (1.380649e-23 * p_retailprice)) - 1)"),
    ("dark", lambda c: f.planck_radiance(c.S * 1e18, c.P), "CAST(0 AS DOUBLE)"),
    ("exitance", lambda c: f.stefan_boltzmann_exitance(c.P), "5.670374419e-8 * pow(p_retailprice, 4)"),
    ("wien", lambda c: f.wien_peak_wavelength(c.P), "2.897771955e-3 / p_retailprice"),
    ("einstein", lambda c: f.einstein_heat_capacity(c.S + 50, 300.0), f"3 * 1.380649e-23 * 6.02214076e23 * pow(300.0 / (p_size + 50), 2) * {EX} / pow({EX} - 1, 2)"),
    ("schottky", lambda c: f.schottky_heat_capacity(c.S + 50, 1e-21), "1.380649e-23 * 6.02214076e23 * pow(1e-21 / (1.380649e-23 * (p_size + 50)), 2) * exp(-1e-21 / (1.380649e-23 * (p_size + 50))) / pow(1 + exp(-1e-21 / (1.380649e-23 * (p_size + 50))), 2)"),
    ("states", lambda c: f.partition_2level(1e-21, c.S + 50), "1 + exp(-1e-21 / (1.380649e-23 * (p_size + 50)))"),
    ("mixing", lambda c: f.entropy_of_mixing(c.S / 100), "-1.380649e-23 * 6.02214076e23 * (p_size / 100 * ln(p_size / 100) + (1 - p_size / 100) * ln(1 - p_size / 100))"),
    ("pure", lambda c: f.entropy_of_mixing(c.S), "CAST(0 AS DOUBLE)"),
    ("wave", lambda c: f.thermal_wavelength(4.65e-26, c.P), "6.62607015e-34 / sqrt(2 * pi() * 4.65e-26 * 1.380649e-23 * p_retailprice)"),
], Part)

XI = "(p_size / 25.0)"
TUNNEL = "sqrt(2 * 9.1093837015e-31 * abs(2e-18 - p_size * 1e-19)) / 1.054571817e-34 * 1e-10"
per_row("quantum_formulas", "part", "p_partkey", [
    ("box", lambda c: f.particle_in_box_energy(c.S, 1e-9, 9.1093837015e-31), "6.62607015e-34 * 6.62607015e-34 / (8 * 9.1093837015e-31 * 1e-18) * p_size * p_size"),
    ("box_psi", lambda c: f.particle_in_box_psi(2, 3.0, c.S / 40), "sqrt(2 / 3.0) * sin(2 * pi() * (p_size / 40) / 3)"),
    ("ho", lambda c: f.ho_energy(c.S, c.P), "1.054571817e-34 * p_retailprice * (p_size + 0.5)"),
    ("ho_len", lambda c: f.ho_length(c.P, c.S), "sqrt(1.054571817e-34 / (p_retailprice * p_size))"),
    ("h0", lambda c: f.hermite_phys(0, c.S), "CAST(1 AS DOUBLE)"),
    ("h4", lambda c: f.hermite_phys(4, c.S), "16 * pow(p_size, 4) - 48 * pow(p_size, 2) + 12"),
    ("h5", lambda c: f.hermite_phys(5, c.S), "32 * pow(p_size, 5) - 160 * pow(p_size, 3) + 120 * p_size"),
    ("psi3", lambda c: f.ho_psi(3, 1.054571817e-34, 1.0, c.S / 25.0), f"(8 * pow({XI}, 3) - 12 * {XI}) * exp(-{XI} * {XI} / 2) / sqrt(sqrt(pi()) * 48)"),
    ("hydrogen", lambda c: f.hydrogen_energy(c.S), "-10973731.568160 * 6.62607015e-34 * 2.99792458e8 / (p_size * p_size)"),
    ("s1", lambda c: f.hydrogen_1s_psi(c.S * 1e-11), "exp(-p_size * 1e-11 / 5.29177210903e-11) / sqrt(pi() * pow(5.29177210903e-11, 3))"),
    ("rabi", lambda c: f.rabi_probability(2.0, c.S / 10, 1.5), "4 / 6.25 * pow(sin(sqrt(6.25) * (p_size / 10) / 2), 2)"),
    ("still", lambda c: f.rabi_probability(0.0, c.S), "CAST(0 AS DOUBLE)"),
    ("tunnel", lambda c: f.tunnel_rectangular(F.when(c.S == 20, 19.5).otherwise(c.S) * 1e-19, 2e-18, 1e-10, 9.1093837015e-31),
     f"""CASE WHEN p_size = 20 THEN 1 / (1 + 4e-36 * pow(sinh({TUNNEL.replace('p_size', '19.5')}), 2) / (4 * 19.5e-19 * abs(2e-18 - 19.5e-19)))
      WHEN p_size < 20 THEN 1 / (1 + 4e-36 * pow(sinh({TUNNEL}), 2) / (4 * p_size * 1e-19 * abs(2e-18 - p_size * 1e-19))) ELSE 1 / (1 + 4e-36 * pow(sin({TUNNEL}), 2) / (4 * p_size * 1e-19 * abs(2e-18 - p_size * 1e-19))) END"""),
    ("bx", lambda c: f.bloch_vector(c.S / 20, c.P)[0], "sin(p_size / 20) * cos(p_retailprice)"),
    ("by", lambda c: f.bloch_vector(c.S / 20, c.P)[1], "sin(p_size / 20) * sin(p_retailprice)"),
    ("bz", lambda c: f.bloch_vector(c.S / 20, c.P)[2], "cos(p_size / 20)"),
    ("px", lambda c: f.pauli_x()[1]["re"] + f.pauli_x()[2]["re"] * 2, "CAST(3 AS DOUBLE)"),
    ("py", lambda c: f.pauli_y()[1]["im"] + f.pauli_y()[2]["im"] * 3, "CAST(2 AS DOUBLE)"),
    ("pz", lambda c: f.pauli_z()[0]["re"] * 2 + f.pauli_z()[3]["re"], "CAST(1 AS DOUBLE)"),
], Part)

per_row("nuclei_orbits_flow", "part", "p_partkey", [
    ("left_", lambda c: f.decay_remaining(c.P, c.S, 7.0), "p_retailprice * pow(0.5, p_size / 7.0)"),
    ("activity", lambda c: f.decay_activity(c.P, c.S), "ln(2) / p_size * p_retailprice"),
    ("binding", lambda c: f.semf_binding_mev(c.S, c.S * 2 + 3), """15.8 * (p_size * 2 + 3) - 18.3 * pow(p_size * 2 + 3, 2 / 3.0::DOUBLE) - 0.714 * p_size * (p_size - 1) / pow(p_size * 2 + 3, 1 / 3.0::DOUBLE) - 23.2 * 9 / (p_size * 2 + 3)"""),
    ("paired", lambda c: f.semf_binding_mev(c.S, c.S * 2), """15.8 * (p_size * 2) - 18.3 * pow(p_size * 2, 2 / 3.0::DOUBLE) - 0.714 * p_size * (p_size - 1) / pow(p_size * 2, 1 / 3.0::DOUBLE) + CASE WHEN p_size % 2 = 0 THEN 12 ELSE -12 END / sqrt(p_size * 2)"""),
    ("escape", lambda c: f.escape_velocity(c.P * 1e21, c.S * 1e5), "sqrt(2 * 6.67430e-11 * p_retailprice * 1e21 / (p_size * 1e5))"),
    ("circular", lambda c: f.circular_velocity(c.P * 1e21, c.S * 1e5), "sqrt(6.67430e-11 * p_retailprice * 1e21 / (p_size * 1e5))"),
    ("period", lambda c: f.orbital_period(c.P * 1e21, c.S * 1e5), "2 * pi() * sqrt(pow(p_size * 1e5, 3) / (6.67430e-11 * p_retailprice * 1e21))"),
    ("horizon", lambda c: f.schwarzschild_radius(c.P * 1e27), "2 * 6.67430e-11 * p_retailprice * 1e27 / (2.99792458e8 * 2.99792458e8)"),
    ("hubble", lambda c: f.hubble_velocity(70.0, c.P), "70.0 * p_retailprice"),
    ("reynolds", lambda c: physics.reynolds(1.2, c.P, c.S, 0.5), "1.2 * p_retailprice * p_size / 0.5"),
    ("mach", lambda c: f.mach_number(c.P, 343.0), "p_retailprice / 343.0"),
    ("prandtl", lambda c: f.prandtl(0.3, c.P, c.S), "0.3 * p_retailprice / p_size"),
    ("froude", lambda c: f.froude(c.P, c.S), "p_retailprice / sqrt(9.81 * p_size)"),
    ("nusselt", lambda c: f.nusselt_laminar_flat(c.P, c.S), "0.664 * sqrt(p_retailprice) * pow(p_size, 1 / 3.0::DOUBLE)"),
    ("drag", lambda c: f.stokes_drag(0.001, c.S, c.P), "6 * pi() * 0.001 * p_size * p_retailprice"),
], Part)
