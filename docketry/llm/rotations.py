"""Pseudo-random rotations by sign flips and fast Hadamard transforms."""

from __future__ import annotations

import numpy as np


def hadamard(matrix: np.ndarray) -> np.ndarray:
    """Every row times the Hadamard matrix, scaled to keep lengths; rows are a power of two long."""
    rows, size = matrix.shape
    out, half = matrix, 1
    while half < size:
        pairs = out.reshape(rows, size // (2 * half), 2, half)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(rows, size)
        half *= 2
    return out / np.sqrt(size)


def rotate(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, those of one hash table."""
    size = 1 << max(0, unit.shape[1] - 1).bit_length()
    signs = np.random.default_rng([seed, table]).integers(0, 2, (3, size)) * 2.0 - 1.0
    out = np.zeros((len(unit), size))
    out[:, :unit.shape[1]] = unit
    for row in signs:
        out = hadamard(out * row)
    return out


def signed_axes(rotated: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest signed axes of each row, nearest first: axis, plus the number of
    axes if the sign is negative."""
    size = rotated.shape[1]
    strength = np.abs(rotated)
    order = np.argsort(-strength, axis=1, kind="stable")[:, :count]
    return order + size * (np.take_along_axis(rotated, order, 1) < 0)
