"""Recursive band-pass filter over series of any length.

A stable linear filter is a state recurrence z' = A z + B x. Each chunk first
finds the state it would leave behind from rest; the state a chunk starts with
is then a sum over the chunks before it, weighted with powers of A^chunk.
Those powers fall below double precision after a number of chunks that the
coefficients alone decide, so every chunk's start is a short grouped sum and
no task walks a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scalefold.operators.indexing import Keys

# Second-order sections (b0 b1 b2 a0 a1 a2) of the order-2 band-pass
# from 1 to 30 Hz at 16,384 samples a second.
STRAIN_SECTIONS = [
    [3.0679588328312956e-05, 6.135917665662591e-05, 3.0679588328312956e-05, 1.0, -1.9848033057682797, 0.9849265232721753],
    [1.0, -2.0, 1.0, 1.0, -1.9994602459966024, 0.9994604027450198],
]

CHUNK = 16_384
LANE = 64
NEGLIGIBLE = 1e-20


def state_space(sections: Sequence[Sequence[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The cascade as one system z' = A z + B x, y = C z + D x (two states per section).

    Each section's states are its first delay and the scaled sum of both, which
    makes A nearly a rotation for slow poles: its powers stay small and lose
    no digits, as those of the plain delays do.
    """
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for i, section in enumerate(sections):
        a0 = section[3]
        b0, b1, b2, _, a1, a2 = (v / a0 for v in section)
        turn = math.sqrt(math.fsum([1.0, a1, a2]))
        j = 2 * i
        # this section's input is c z + d x of the sections before it
        gain = np.array([b1 - a1 * b0, math.fsum([b0, b1, b2]) / turn - b0 * turn])
        a[j : j + 2] += np.outer(gain, c)
        a[j : j + 2, j : j + 2] += np.array([[-a1 - 1.0, turn], [-turn, 1.0]])
        b[j : j + 2] = gain * d
        c, d = b0 * c, b0 * d
        c[j] += 1.0
    return a, b, c, d


def _lane_matrices(system) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For LANE samples at once: outputs from inputs and state, next state from inputs and state."""
    a, b, c, d = system
    powers = [np.eye(len(b))]
    for _ in range(LANE):
        powers.append(a @ powers[-1])
    impulse = np.array([d] + [c @ powers[k] @ b for k in range(LANE - 1)])
    from_x = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(LANE)] for i in range(LANE)])
    from_z = np.array([c @ powers[i] for i in range(LANE)])
    into_z = np.array([powers[LANE - 1 - j] @ b for j in range(LANE)]).T
    return from_x, from_z, into_z, powers[LANE]


def _lanes(values: np.ndarray, z: np.ndarray, system, lane) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of one chunk and the state after it."""
    from_x, from_z, into_z, step = lane
    full = len(values) // LANE
    x = values[: full * LANE].reshape(full, LANE)
    drive = x @ into_z.T
    states = np.empty((full, len(z)))
    for i in range(full):
        states[i] = z
        z = step @ z + drive[i]
    y = [(x @ from_x.T + states @ from_z.T).ravel()]
    a, b, c, d = system
    for v in values[full * LANE :]:
        y.append([c @ z + d * v])
        z = a @ z + b * v
    return np.concatenate(y), z


def _state_udf(system, lane):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        rest = np.zeros(len(system[1]))
        return x.map(lambda v: _lanes(np.asarray(v, dtype=float), rest, system, lane)[1])

    return run


def _output_udf(system, lane):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(
            [_lanes(np.asarray(v, dtype=float), np.asarray(s, dtype=float), system, lane)[0] for v, s in zip(x, z)]
        )

    return run


def bandpass(
    df: DataFrame, keys: Keys, sections: Sequence[Sequence[float]] = STRAIN_SECTIONS, chunk: int = CHUNK
) -> DataFrame:
    """D6. Filter each series forwards from rest."""
    if any(abs(a2 / a0) >= 1.0 or abs(a1 / a0) >= 1.0 + a2 / a0 for _, _, _, a0, a1, a2 in sections):
        raise ValueError("the filter is not stable")
    system = state_space(sections)
    a = system[0]
    per_chunk = np.linalg.matrix_power(a, chunk)
    weights, power = [], np.eye(len(a))
    while np.abs(power).max() > NEGLIGIBLE:
        weights.append(power)
        power = per_chunk @ power
    lane = _lane_matrices(system)
    chunks = (
        df.withColumn("_chunk", F.expr(f"idx div {chunk}"))
        .groupBy(*keys, "_chunk")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("x"))
    )
    n = len(a)
    left = chunks.select(*keys, "_chunk", _state_udf(system, lane)("x").alias("z"))
    # the state of chunk c reaches chunk c + 1 + i with weight (A^chunk)^i
    spread = left.select(
        *keys, "_chunk", "z", F.posexplode(F.lit([[float(v) for v in w.ravel()] for w in weights])).alias("_i", "_w")
    )
    parts = [sum((F.col("_w")[r * n + c] * F.col("z")[c] for c in range(n)), F.lit(0.0)) for r in range(n)]
    entry = (
        spread.groupBy(*keys, (F.col("_chunk") + 1 + F.col("_i")).alias("_chunk"))
        .agg(*[F.sum(p).alias(f"_z{r}") for r, p in enumerate(parts)])
        .select(*keys, "_chunk", F.array(*[f"_z{r}" for r in range(n)]).alias("z"))
    )
    rest = F.array(*[F.lit(0.0)] * n)
    return (
        chunks.join(entry, [*keys, "_chunk"], "left")
        .select(*keys, "_chunk", _output_udf(system, lane)("x", F.coalesce("z", rest)).alias("_y"))
        .select(*keys, "_chunk", F.posexplode("_y").alias("_at", "value"))
        .select(*keys, (F.col("_chunk") * chunk + F.col("_at")).alias("idx"), "value")
    )
