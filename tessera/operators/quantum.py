"""State vectors as DataFrames ``i bigint, re double, im double``.

A gate on one qubit pairs amplitudes whose indices differ in one bit: an
aggregation by the index without that bit, for any number of qubits.
"""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import settled

# Plans longer than this are cut: the state is written and read again.
GATES_PER_PLAN = 24

S2 = 1 / math.sqrt(2)
H = ((S2, S2), (S2, -S2))
X = ((0, 1), (1, 0))
Y = ((0, -1j), (1j, 0))
Z = ((1, 0), (0, -1))
S = ((1, 0), (0, 1j))
T = ((1, 0), (0, cmath.exp(1j * math.pi / 4)))


def rx(a: float):
    return ((math.cos(a / 2), -1j * math.sin(a / 2)), (-1j * math.sin(a / 2), math.cos(a / 2)))


def ry(a: float):
    return ((math.cos(a / 2), -math.sin(a / 2)), (math.sin(a / 2), math.cos(a / 2)))


def rz(a: float):
    return ((cmath.exp(-1j * a / 2), 0), (0, cmath.exp(1j * a / 2)))


def phase(a: float):
    return ((1, 0), (0, cmath.exp(1j * a)))


class State:
    def __init__(self, df: DataFrame, qubits: int, gates: int = 0):
        self.df, self.qubits, self.gates = df, qubits, gates

    @staticmethod
    def basis(spark: SparkSession, qubits: int, index: int = 0) -> State:
        df = spark.range(1 << qubits).select(F.col("id").alias("i"), F.when(F.col("id") == index, 1.0).otherwise(0.0).alias("re"), F.lit(0.0).alias("im"))
        return State(df, qubits)

    def apply(self, gate, qubit: int, controls: list[int] = ()) -> State:
        """A 2 x 2 gate on a qubit, where all control qubits are 1."""
        bit, mask = 1 << qubit, sum(1 << c for c in controls)
        side = F.col("i").bitwiseAND(F.lit(bit)) != 0

        def amp(hi: bool) -> tuple[Column, Column]:
            pick = side if hi else ~side
            return F.sum(F.when(pick, F.col("re")).otherwise(0.0)), F.sum(F.when(pick, F.col("im")).otherwise(0.0))

        (ar, ai), (br, bi) = amp(False), amp(True)
        base = F.col("i").bitwiseAND(F.lit(~bit))
        # Both indices of a pair have the same control bits; where one is 0 the identity stands in for the
        # gate.  So a gate reads its input once, however many gates follow each other.
        live = F.col("b").bitwiseAND(F.lit(mask)) == mask

        def out(row, unit: str) -> list[Column]:
            p, q = complex(row[0]), complex(row[1])
            re = F.col("ar") * p.real - F.col("ai") * p.imag + F.col("br") * q.real - F.col("bi") * q.imag
            im = F.col("ar") * p.imag + F.col("ai") * p.real + F.col("br") * q.imag + F.col("bi") * q.real
            if mask:
                re, im = F.when(live, re).otherwise(F.col(f"{unit}r")), F.when(live, im).otherwise(F.col(f"{unit}i"))
            return [re.alias("re"), im.alias("im")]

        pairs = self.df.groupBy(base.alias("b")).agg(ar.alias("ar"), ai.alias("ai"), br.alias("br"), bi.alias("bi"))
        lo, hi = out(gate[0], "a"), out(gate[1], "b")
        both = pairs.select(F.inline(F.array(F.struct(F.col("b").alias("i"), *lo), F.struct((F.col("b") + bit).alias("i"), *hi))))
        gates = self.gates + 1
        return State(settled(both, "gates") if gates % GATES_PER_PLAN == 0 else both, self.qubits, gates)

    def h(self, q: int) -> State:
        return self.apply(H, q)

    def x(self, q: int) -> State:
        return self.apply(X, q)

    def z(self, q: int) -> State:
        return self.apply(Z, q)

    def cnot(self, control: int, target: int) -> State:
        return self.apply(X, target, [control])

    def cz(self, a: int, b: int) -> State:
        return self.apply(Z, b, [a])

    def toffoli(self, a: int, b: int, target: int) -> State:
        return self.apply(X, target, [a, b])

    def swap(self, a: int, b: int) -> State:
        return self.cnot(a, b).cnot(b, a).cnot(a, b)

    def qft(self) -> State:
        out = self
        for j in range(self.qubits - 1, -1, -1):
            out = out.h(j)
            for k in range(j):
                out = out.apply(phase(math.pi / (1 << (j - k))), k, [j])
        for k in range(self.qubits // 2):
            out = out.swap(k, self.qubits - 1 - k)
        return out

    def probabilities(self) -> DataFrame:
        return self.df.select("i", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))

    def norm(self) -> DataFrame:
        return self.probabilities().agg(F.sqrt(F.sum("p")).alias("norm"))

    def probability_of(self, qubit: int) -> DataFrame:
        """That the qubit is 1."""
        return self.probabilities().agg(F.sum(F.when(F.col("i").bitwiseAND(F.lit(1 << qubit)) != 0, F.col("p")).otherwise(0.0)).alias("p"))

    def expectation_z(self, qubit: int) -> DataFrame:
        return self.probability_of(qubit).select((1 - 2 * F.col("p")).alias("z"))

    def fidelity(self, other: State) -> DataFrame:
        b = other.df.select("i", F.col("re").alias("r2"), F.col("im").alias("m2"))
        dot = self.df.join(b, "i").agg(F.sum(F.col("re") * F.col("r2") + F.col("im") * F.col("m2")).alias("r"), F.sum(F.col("re") * F.col("m2") - F.col("im") * F.col("r2")).alias("m"))
        return dot.select((F.col("r") * F.col("r") + F.col("m") * F.col("m")).alias("fidelity"))

    def sample(self, shots: int, seed: int = 0) -> np.ndarray:
        """Measured indices; the distribution passes through the driver (few qubits)."""
        rows = self.probabilities().orderBy("i").collect()
        p = np.array([r.p for r in rows])
        return np.random.default_rng(seed).choice([r.i for r in rows], size=shots, p=p / p.sum())


def grover(spark: SparkSession, qubits: int, target: int) -> State:
    """Grover's search for one index."""
    s = State.basis(spark, qubits)
    for q in range(qubits):
        s = s.h(q)
    for _ in range(int(math.pi / 4 * math.sqrt(1 << qubits))):
        df = s.df.withColumn("re", F.when(F.col("i") == target, -F.col("re")).otherwise(F.col("re"))).withColumn("im", F.when(F.col("i") == target, -F.col("im")).otherwise(F.col("im")))
        df = settled(df, "grover")  # read twice below
        mean = df.agg(F.avg("re").alias("mr"), F.avg("im").alias("mi"))
        s = State(df.crossJoin(F.broadcast(mean)).select("i", (2 * F.col("mr") - F.col("re")).alias("re"), (2 * F.col("mi") - F.col("im")).alias("im")), qubits)
    return s


def bell(spark: SparkSession) -> State:
    return State.basis(spark, 2).h(0).cnot(0, 1)


def ghz(spark: SparkSession, n: int) -> State:
    s = State.basis(spark, n).h(0)
    for k in range(n - 1):
        s = s.cnot(k, k + 1)
    return s
