"""Constants, formulas, units, quantum registers, fractals."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.distributions import draws

#: Constants in SI units.
CONSTANTS = {
    "c": 299792458.0,
    "G": 6.6743e-11,
    "h": 6.62607015e-34,
    "hbar": 1.054571817e-34,
    "k_B": 1.380649e-23,
    "e": 1.602176634e-19,
    "N_A": 6.02214076e23,
    "R": 8.314462618,
    "sigma": 5.670374419e-8,
    "pi": math.pi,
    "e_math": math.e,
    "m_e": 9.1093837015e-31,
    "m_p": 1.67262192369e-27,
    "epsilon_0": 8.8541878128e-12,
    "g": 9.80665,
    "mu_0": 1.25663706212e-6,
}


def get_constant(name: str) -> float:
    if name not in CONSTANTS:
        raise KeyError(f"unknown constant: {name}")
    return CONSTANTS[name]


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _div(a: Column, b: Column) -> Column:
    """a / b; a zero b is an error under ANSI mode."""
    return a / b


def kinetic_energy(mass, velocity) -> Column:
    return 0.5 * _c(mass) * _c(velocity) * _c(velocity)


def gravitational_force(m1, m2, r) -> Column:
    return _div(CONSTANTS["G"] * _c(m1) * _c(m2), _c(r) * _c(r))


def wave_frequency(wavelength) -> Column:
    return _div(F.lit(CONSTANTS["c"]), _c(wavelength))


def ideal_gas_pressure(n_moles, temperature, volume) -> Column:
    return _div(CONSTANTS["R"] * _c(n_moles) * _c(temperature), _c(volume))


def photon_energy(frequency) -> Column:
    return CONSTANTS["h"] * _c(frequency)


def schwarzschild_radius(mass) -> Column:
    return 2 * CONSTANTS["G"] * _c(mass) / CONSTANTS["c"] ** 2


def de_broglie_wavelength(mass, velocity) -> Column:
    return _div(F.lit(CONSTANTS["h"]), _c(mass) * _c(velocity))


def escape_velocity(mass, radius) -> Column:
    return F.sqrt(_div(2 * CONSTANTS["G"] * _c(mass), _c(radius)))


def coulomb_force(q1, q2, r) -> Column:
    return _div(F.abs(_c(q1) * _c(q2)) / (4 * math.pi * CONSTANTS["epsilon_0"]), _c(r) * _c(r))


def centripetal_acceleration(velocity, radius) -> Column:
    return _div(_c(velocity) * _c(velocity), _c(radius))


def pendulum_period(length, g=None) -> Column:
    return 2 * math.pi * F.sqrt(_div(_c(length), _c(CONSTANTS["g"] if g is None else g)))


def doppler_frequency(f0, v_source=0.0, v_observer=0.0, v_sound=343.0) -> Column:
    return _div(_c(f0) * (_c(v_sound) + _c(v_observer)), _c(v_sound) + _c(v_source))


# ---- units -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dimension:
    """Exponents of the SI base units."""

    mass: int = 0
    length: int = 0
    time: int = 0
    current: int = 0
    temperature: int = 0
    amount: int = 0
    luminous_intensity: int = 0

    def _all(self) -> tuple[int, ...]:
        return tuple(vars(self).values())

    def __mul__(self, o: Dimension) -> Dimension:
        return Dimension(*(a + b for a, b in zip(self._all(), o._all())))

    def __truediv__(self, o: Dimension) -> Dimension:
        return Dimension(*(a - b for a, b in zip(self._all(), o._all())))

    def __pow__(self, n: int) -> Dimension:
        return Dimension(*(a * n for a in self._all()))


@dataclass(frozen=True)
class Unit:
    symbol: str
    scale: float = 1.0
    dimension: Dimension = Dimension()

    def __mul__(self, o: Unit) -> Unit:
        return Unit(f"{self.symbol}*{o.symbol}", self.scale * o.scale, self.dimension * o.dimension)

    def __truediv__(self, o: Unit) -> Unit:
        return Unit(f"{self.symbol}/{o.symbol}", self.scale / o.scale, self.dimension / o.dimension)

    def __pow__(self, n: int) -> Unit:
        return Unit(f"{self.symbol}^{n}", self.scale**n, self.dimension**n)


@dataclass(frozen=True, eq=False)
class Quantity:
    """A number or a Column with a unit; dimensions are checked when the plan is built."""

    value: float | Column
    unit: Unit

    def to(self, target: Unit) -> Quantity:
        if self.unit.dimension != target.dimension:
            raise ValueError(f"{self.unit.symbol} is no {target.symbol}")
        return Quantity(self.value * (self.unit.scale / target.scale), target)

    def __add__(self, o: Quantity) -> Quantity:
        return Quantity(self.value + o.to(self.unit).value, self.unit)

    def __sub__(self, o: Quantity) -> Quantity:
        return Quantity(self.value - o.to(self.unit).value, self.unit)

    def __mul__(self, o: Quantity | float) -> Quantity:
        return Quantity(self.value * o.value, self.unit * o.unit) if isinstance(o, Quantity) else Quantity(self.value * o, self.unit)

    def __truediv__(self, o: Quantity | float) -> Quantity:
        return Quantity(self.value / o.value, self.unit / o.unit) if isinstance(o, Quantity) else Quantity(self.value / o, self.unit)

    def __pow__(self, n: int) -> Quantity:
        return Quantity(self.value**n, self.unit**n)


def dimensions_compatible(*items: Dimension | Unit | Quantity) -> bool:
    of = lambda x: x if isinstance(x, Dimension) else x.dimension if isinstance(x, Unit) else x.unit.dimension
    return len({of(x) for x in items}) <= 1


# ---- quantum -----------------------------------------------------------------------------


@dataclass
class QuantumRegister:
    """2^n amplitudes; bit q of an index is qubit q."""

    n_qubits: int
    amplitudes: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.amplitudes is None:
            self.amplitudes = np.zeros(1 << self.n_qubits, complex)
            self.amplitudes[0] = 1
        self.amplitudes = np.asarray(self.amplitudes, complex)
        if len(self.amplitudes) != 1 << self.n_qubits or abs(np.linalg.norm(self.amplitudes) - 1) > 1e-9:
            raise ValueError("amplitudes must be 2^n with norm 1")

    def probabilities(self) -> np.ndarray:
        return np.abs(self.amplitudes) ** 2

    def apply(self, gate: np.ndarray, target: int, *controls: int) -> QuantumRegister:
        """A 2 x 2 unitary on one qubit, where all controls are set."""
        if not np.allclose(gate @ np.conj(gate.T), np.eye(2)):
            raise ValueError("the gate is not unitary")
        i = np.arange(len(self.amplitudes))
        low = (i >> target & 1 == 0) & np.all([i >> c & 1 == 1 for c in controls] or [i >= 0], axis=0)
        a, b, out = self.amplitudes[i[low]], self.amplitudes[i[low] | 1 << target], self.amplitudes.copy()
        out[i[low]], out[i[low] | 1 << target] = gate[0, 0] * a + gate[0, 1] * b, gate[1, 0] * a + gate[1, 1] * b
        return QuantumRegister(self.n_qubits, out)

    def measure(self, seed: int = 0) -> int:
        """A basis state drawn by its probability; the register collapses to it."""
        k = int(np.random.default_rng(seed).choice(len(self.amplitudes), p=self.probabilities() / self.probabilities().sum()))
        self.amplitudes = np.zeros_like(self.amplitudes)
        self.amplitudes[k] = 1
        return k

    def measure_shots(self, spark: SparkSession, shots: int = 1000, seed: int = 0) -> DataFrame:
        """(state, n): a draw's cell of a grid names the few states it may fall on, in a table of at most 2^(n + 1) rows."""
        p = self.probabilities()
        has = np.flatnonzero(p > 0)
        hi = np.cumsum(p)[has]
        lo, hi[-1] = np.append(0.0, hi[:-1]), 1.0
        grid = len(p)
        first, last = np.floor(lo * grid).astype(int).clip(0, grid - 1), np.floor(hi * grid).astype(int).clip(0, grid - 1)
        table = pd.DataFrame({"state": [format(k, f"0{self.n_qubits}b") for k in has], "lo": lo, "hi": np.append(hi[:-1], 2.0), "cell": [range(a, z + 1) for a, z in zip(first, last)]}).explode("cell").astype({"cell": "int32"})
        cells = spark.createDataFrame(pa.Table.from_pandas(table, preserve_index=False))
        cell = F.least(F.floor(F.col("u0") * grid).cast("int"), F.lit(grid - 1))
        hit = draws(spark, shots, seed).withColumn("cell", cell).join(F.broadcast(cells), "cell").where("u0 >= lo and u0 < hi")
        return hit.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


HADAMARD = np.array([[1, 1], [1, -1]], complex) / math.sqrt(2)
PAULI_X, PAULI_Y, PAULI_Z = np.array([[0, 1], [1, 0]], complex), np.array([[0, -1j], [1j, 0]]), np.diag([1, -1]).astype(complex)


def phase_gate(theta: float) -> np.ndarray:
    return np.diag([1, np.exp(1j * theta)])


def rz_matrix(theta: float) -> np.ndarray:
    return np.diag([np.exp(-0.5j * theta), np.exp(0.5j * theta)])


def h_gate(reg: QuantumRegister, target: int) -> QuantumRegister:
    return reg.apply(HADAMARD, target)


def x_gate(reg: QuantumRegister, target: int) -> QuantumRegister:
    return reg.apply(PAULI_X, target)


def y_gate(reg: QuantumRegister, target: int) -> QuantumRegister:
    return reg.apply(PAULI_Y, target)


def z_gate(reg: QuantumRegister, target: int) -> QuantumRegister:
    return reg.apply(PAULI_Z, target)


def rz_gate(reg: QuantumRegister, target: int, theta: float) -> QuantumRegister:
    return reg.apply(rz_matrix(theta), target)


def cnot(reg: QuantumRegister, control: int, target: int) -> QuantumRegister:
    return reg.apply(PAULI_X, target, control)


def cz(reg: QuantumRegister, control: int, target: int) -> QuantumRegister:
    return reg.apply(PAULI_Z, target, control)


def swap(reg: QuantumRegister, q1: int, q2: int) -> QuantumRegister:
    return cnot(cnot(cnot(reg, q1, q2), q2, q1), q1, q2)


def toffoli(reg: QuantumRegister, c1: int, c2: int, target: int) -> QuantumRegister:
    return reg.apply(PAULI_X, target, c1, c2)


def bell_state(which: int = 0) -> QuantumRegister:
    reg = cnot(h_gate(QuantumRegister(2), 0), 0, 1)
    reg = z_gate(reg, 0) if which & 1 else reg
    return x_gate(reg, 1) if which & 2 else reg


def ghz_state(n: int) -> QuantumRegister:
    reg = h_gate(QuantumRegister(n), 0)
    for q in range(1, n):
        reg = cnot(reg, 0, q)
    return reg


def is_entangled(reg: QuantumRegister) -> bool:
    """Of two qubits: is the concurrence over 1e-9?"""
    if reg.n_qubits != 2:
        raise ValueError("needs two qubits")
    a = reg.amplitudes
    return bool(2 * abs(a[0] * a[3] - a[1] * a[2]) > 1e-9)


@dataclass
class QuantumCircuit:
    """Gates on one qubit in turn."""

    gates: list[np.ndarray]

    def run(self) -> QuantumRegister:
        reg = QuantumRegister(1)
        for g in self.gates:
            reg = reg.apply(g, 0)
        return reg

    def simulate(self, spark: SparkSession, shots: int = 1000, seed: int = 0) -> DataFrame:
        return self.run().measure_shots(spark, shots, seed)


# ---- fractals ----------------------------------------------------------------------------


def escape_counts(df: DataFrame, zr: str, zi: str, cr: str, ci: str, max_iter: int = 256, out: str = "n") -> DataFrame:
    """df with the number of steps of z -> z^2 + c until |z| > 2, max_iter if never; whole batches step at once."""

    def run(rows: pd.DataFrame) -> pd.Series:
        z = rows["zr"].to_numpy() + 1j * rows["zi"].to_numpy()
        c, n = rows["cr"].to_numpy() + 1j * rows["ci"].to_numpy(), np.full(len(rows), max_iter)
        on = np.ones(len(rows), bool)
        for k in range(max_iter):
            gone = on & (np.abs(z) > 2)
            n[gone] = k
            on &= ~gone
            if not on.any():
                break
            z[on] = z[on] ** 2 + c[on]
        return pd.Series(n.astype("int32"))

    return df.withColumn(out, F.pandas_udf(run, "int")(F.struct(*[_c(x).alias(k) for k, x in (("zr", zr), ("zi", zi), ("cr", cr), ("ci", ci))])))


def mandelbrot_image(spark: SparkSession, xmin: float, xmax: float, ymin: float, ymax: float, width: int, height: int, max_iter: int = 256) -> DataFrame:
    """(row, col, n)."""
    g = spark.range(width * height).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    g = g.withColumn("x", xmin + (xmax - xmin) * F.col("col") / max(1, width - 1)).withColumn("y", ymin + (ymax - ymin) * F.col("row") / max(1, height - 1))
    return escape_counts(g.withColumn("_0", F.lit(0.0)), "_0", "_0", "x", "y", max_iter).select("row", "col", "n")


def mandelbrot(c_real: float, c_imag: float, max_iter: int = 256) -> int:
    return julia(0.0, 0.0, c_real, c_imag, max_iter)


def julia(z_real: float, z_imag: float, c_real: float, c_imag: float, max_iter: int = 256) -> int:
    z, c = complex(z_real, z_imag), complex(c_real, c_imag)
    for k in range(max_iter):
        if abs(z) > 2:
            return k
        z = z * z + c
    return max_iter


#: Maps (a, b, c, d, e, f, chance) of the fern, x -> a x + b y + e, y -> c x + d y + f.
FERN = [(0.0, 0.0, 0.0, 0.16, 0.0, 0.0, 0.01), (0.85, 0.04, -0.04, 0.85, 0.0, 1.6, 0.85), (0.2, -0.26, 0.23, 0.22, 0.0, 1.6, 0.07), (-0.15, 0.28, 0.26, 0.24, 0.0, 0.44, 0.07)]


def orbit(spark: SparkSession, maps: list[tuple[float, ...]], n_points: int, seed: int = 0, chains: int = 1) -> DataFrame:
    """(chain, step, x, y) of random maps applied again and again; a chain is sequential, chains run side by side."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        c = int(part["chain"].iloc[0])
        which = np.random.default_rng((seed, c)).choice(len(maps), n_points, p=[m[6] for m in maps])
        x = y = 0.0
        out = []
        for k in which:
            a, b, cc, d, e, f, _ = maps[k]
            x, y = a * x + b * y + e, cc * x + d * y + f
            out.append((x, y))
        return pd.DataFrame({"chain": c, "step": range(n_points), "x": [p[0] for p in out], "y": [p[1] for p in out]})

    return spark.range(chains).withColumnRenamed("id", "chain").groupBy("chain").applyInPandas(run, "chain long, step int, x double, y double")


def barnsley_fern(spark: SparkSession, n_points: int, seed: int = 0, chains: int = 1) -> DataFrame:
    return orbit(spark, FERN, n_points, seed, chains)


def sierpinski_triangle(spark: SparkSession, n_points: int, seed: int = 0, chains: int = 1) -> DataFrame:
    corners = [(0.0, 0.0), (1.0, 0.0), (0.5, math.sqrt(3) / 2)]
    return orbit(spark, [(0.5, 0.0, 0.0, 0.5, x / 2, y / 2, 1 / 3) for x, y in corners], n_points, seed, chains)


def formula_table(df: DataFrame, formula: Callable[..., Column], *columns: str, out: str = "value") -> DataFrame:
    return df.withColumn(out, formula(*columns))
