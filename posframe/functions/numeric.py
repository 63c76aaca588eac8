"""Numeric libraries: matrices in long form and in cells, activations, transforms, linear systems.

Large matrices stay distributed, as (i, j, v) rows; a product is a join on the shared index and a sum. Array cells use
array expressions; what they cannot say (Fourier transforms, factorisations) runs in numpy on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = Column


def long_form(df: DataFrame, row: str, cells: str) -> DataFrame:
    """Rows of array cells as (i, j, v)."""
    return df.select(F.col(row).alias("i"), F.posexplode(cells).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v) of a (i, j, v) times b (i=j, j=k, v)."""
    right = b.select(F.col("i").alias("_j"), F.col("j").alias("k"), F.col("v").alias("_w"))
    return a.join(right, F.col("j") == F.col("_j")).groupBy("i", "k").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def gather_reduce(index: DataFrame, weights: DataFrame) -> DataFrame:
    """K3: sums of the rows of a matrix (i, j, v) that each entry (g, i) names: (g, j, v)."""
    return index.join(weights, "i").groupBy("g", "j").agg(F.sum("v").alias("v"))


def dot(x: C, y: C) -> C:
    """G19 on cells."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def let(value: C, f) -> C:
    """f of a value that is computed once, however often f names it, also inside the functions of array expressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x: C) -> C:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def mean(x: C) -> C:
    return total(x) / F.size(x)


def length(x: C) -> C:
    """The Euclidean length."""
    return F.sqrt(dot(x, x))


def normalize(x: C) -> C:
    """M11"""
    return let(length(x), lambda n: F.transform(x, lambda v: v / n))


def cross(x: C, y: C) -> C:
    """The cross product of 3-vectors."""
    at = lambda a, i: F.get(a, F.lit(i))
    return F.array(*[at(x, i) * at(y, j) - at(x, j) * at(y, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def relu(x: C) -> C:
    """L5"""
    return F.transform(x, lambda v: F.greatest(v.cast("double"), F.lit(0.0)))


def sigmoid(v: C) -> C:
    return 1 / (1 + F.exp(-v.cast("double")))


def silu(x: C) -> C:
    """L5"""
    return F.transform(x, lambda v: v * sigmoid(v))


def gelu(x: C) -> C:
    """The tanh form."""
    return F.transform(x, lambda v: 0.5 * v * (1 + F.tanh(np.sqrt(2 / np.pi) * (v + 0.044715 * v * v * v))))


def glu(x: C) -> C:
    """The first half times the sigmoid of the second."""
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a * sigmoid(b))


def softmax(x: C) -> C:
    """L5, shifted by the maximum."""
    e = let(F.array_max(x).cast("double"), lambda top: F.transform(x, lambda v: F.exp(v.cast("double") - top)))
    return let(e, lambda y: let(total(y), lambda n: F.transform(y, lambda v: v / n)))


def layernorm(x: C, epsilon: float = 1e-5) -> C:
    """To mean 0 and variance 1."""
    centred = let(mean(x), lambda m: F.transform(x, lambda v: v.cast("double") - m))
    return let(centred, lambda y: let(F.sqrt(dot(y, y) / F.size(y) + epsilon), lambda s: F.transform(y, lambda v: v / s)))


def linear(x: C, weights: list[list[float]], bias: list[float]) -> C:
    """A dense layer with driver-side weights."""
    return F.array(*[dot(x, F.array(*map(F.lit, map(float, row)))) + float(b) for row, b in zip(weights, bias)])


def convolve(x: C, kernel: list[float], stride: int = 1) -> C:
    """The dot products of a kernel with the full windows of a cell, one every `stride`."""
    weights, size = F.array(*map(F.lit, map(float, kernel))), len(kernel)
    starts = F.sequence(F.lit(0), F.size(x) - size, F.lit(stride))
    return F.when(F.size(x) >= size, F.transform(starts, lambda s: dot(F.slice(x, s + 1, size), weights))).otherwise(F.array().cast("array<double>"))


def _added(x: C, y: C) -> C:
    return F.zip_with(x, y, lambda a, b: a + b)


def attention(q: C, k: C, v: C) -> C:
    """Scaled dot-product attention; q, k and v are cells of rows, k and v of one length."""

    def weighted(weights: C) -> C:
        rows = F.zip_with(weights, v, lambda w, row: F.transform(row, lambda a: a.cast("double") * w))
        return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), F.get(rows, F.lit(0)), _added)

    def of(query: C) -> C:
        scores = F.transform(k, lambda key: dot(query, key) / F.sqrt(F.size(query).cast("double")))
        return let(softmax(scores), weighted)

    return F.transform(q, of)


def lstm(steps: C, weights: list[list[float]], bias: list[float], hidden: int) -> C:
    """The last hidden state of a recurrent cell over a cell of input rows. Driver-side weights, a row for each of the
    input, forget, candidate and output gates of each hidden unit in turn, over the inputs and then the hidden units."""
    zeros = F.array(*[F.lit(0.0)] * hidden)

    def step(state: C, x: C) -> C:
        def gated(g: C) -> C:
            part = lambda i: F.slice(g, i * hidden + 1, hidden)
            kept = F.zip_with(part(1), state["c"], lambda f, c: sigmoid(f) * c)
            new = F.zip_with(part(0), part(2), lambda i, n: sigmoid(i) * F.tanh(n))
            return let(_added(kept, new), lambda c: F.struct(F.zip_with(part(3), c, lambda o, v: sigmoid(o) * F.tanh(v)).alias("h"), c.alias("c")))

        return let(let(F.concat(x, state["h"]), lambda both: linear(both, weights, bias)), gated)

    return F.aggregate(steps, F.struct(zeros.alias("h"), zeros.alias("c")), step, lambda s: s["h"])


def _blade_sign(a: int, b: int) -> int:
    """The sign of the product of two basis blades, given as bit masks whose bit 0 is the null direction; 0 if it vanishes."""
    if a & b & 1:
        return 0
    swaps = sum((a >> i).bit_count() if b >> i - 1 & 1 else 0 for i in range(1, 5))
    return -1 if swaps % 2 else 1


def geometric(x: C, y: C) -> C:
    """The geometric product of multivectors of projective space: sixteen coefficients by bit mask, e0 squared 0."""
    out: list[list[C]] = [[] for _ in range(16)]
    for a in range(16):
        for b in range(16):
            if sign := _blade_sign(a, b):
                out[a ^ b].append(F.get(x, F.lit(a)) * F.get(y, F.lit(b)) * sign)
    return F.array(*[sum(terms[1:], terms[0]) for terms in out])


def _on_cells(f, kind: str, *columns: C) -> C:
    """A numpy function over array cells, a batch at a time; null stays null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*[np.asarray(list(v), float) for v in row]) for row in zip(*series)])

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(*columns)


def fft(x: C) -> C:
    """L3: the discrete Fourier transform of a real cell: interleaved real and imaginary parts."""
    return _on_cells(lambda v: np.fft.fft(v).view(float), "array<double>", x)


def ifft(x: C) -> C:
    """L3: the inverse, from interleaved parts to interleaved parts."""
    return _on_cells(lambda v: np.fft.ifft(v.view(complex)).view(float), "array<double>", x)


def rfft(x: C) -> C:
    """L3: the transform's non-redundant half."""
    return _on_cells(lambda v: np.fft.rfft(v).view(float), "array<double>", x)


def fft2(x: C, columns: int) -> C:
    """L3: the two-dimensional transform of a row-major cell: interleaved parts, row after row."""
    return _on_cells(lambda v: np.fft.fft2(v.reshape(-1, columns)).ravel().view(float), "array<double>", x)


def diagonal(x: C) -> C:
    """L2: the square matrix, as rows, that has a vector on its diagonal."""
    return F.transform(x, lambda v, i: F.transform(x, lambda _, j: F.when(i == j, v.cast("double")).otherwise(0.0)))


def frames(x: C, size: int, hop: int, emphasis: float = 0.0) -> C:
    """L4: full frames of a signal cell, each value less `emphasis` times the one before."""
    shaped = F.transform(x, lambda v, i: v - F.when(i > 0, F.get(x, i - 1) * emphasis).otherwise(0.0)) if emphasis else x
    return let(shaped, lambda y: F.when(F.size(y) >= size, F.transform(F.sequence(F.lit(0), F.size(y) - size, F.lit(hop)), lambda s: F.slice(y, s + 1, size))))


def log_mel(x: C, rate: int, bands: int = 40, size: int = 400, hop: int = 160) -> C:
    """L4: log energies in mel bands of each frame of a signal cell, frame after frame."""
    hz = np.fft.rfftfreq(size, 1 / rate)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bank = np.maximum(0, np.minimum((hz - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - hz) / np.diff(edges)[1:, None]))

    def run(v: np.ndarray) -> np.ndarray:
        if len(v) < size:
            return np.zeros(0)
        frames = np.lib.stride_tricks.sliding_window_view(v, size)[::hop] * np.hanning(size)
        return np.log(np.abs(np.fft.rfft(frames)) ** 2 @ bank.T + 1e-10).ravel()

    return _on_cells(run, "array<double>", x)


def solve(matrix: C, right: C) -> C:
    """L1: the solution of a square system given as a row-major cell; null where it is singular."""

    def run(a: np.ndarray, b: np.ndarray):
        try:
            return np.linalg.solve(a.reshape(len(b), len(b)), b)
        except np.linalg.LinAlgError:
            return None

    return _on_cells(run, "array<double>", matrix, right)


def plu(matrix: C, n: int) -> C:
    """L1: the factors of an n x n row-major cell by partial pivoting: permutation, lower and upper parts, flat, in turn."""

    def run(a: np.ndarray) -> np.ndarray:
        u, perm, low = a.reshape(n, n).copy(), np.arange(n), np.eye(n)
        for k in range(n):
            p = k + int(np.abs(u[k:, k]).argmax())
            u[[k, p]], perm[[k, p]] = u[[p, k]], perm[[p, k]]
            low[[k, p], :k] = low[[p, k], :k]
            if u[k, k]:
                low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
                u[k + 1 :] -= low[k + 1 :, k, None] * u[k]
        return np.concatenate([perm.astype(float), low.ravel(), u.ravel()])

    return _on_cells(run, "array<double>", matrix)


def singular_values(matrix: C, columns: int) -> C:
    """L2: the singular values of a row-major cell, largest first."""
    return _on_cells(lambda a: np.linalg.svd(a.reshape(-1, columns), compute_uv=False), "array<double>", matrix)


def condition(matrix: C, columns: int) -> C:
    """L2: the condition number."""
    return _on_cells(lambda a: float(np.linalg.cond(a.reshape(-1, columns))), "double", matrix)
