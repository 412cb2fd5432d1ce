"""Key-derived pseudo-randomness: the same key always gives the same draw.

Draws come from SHA-256 of the key, so they depend neither on the partitioning
nor on the order of the rows.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def _uniform(digest: Column, word: int) -> Column:
    """A number in (0, 1) from the ``word``-th group of eight hex digits."""
    return (F.conv(digest.substr(8 * word + 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def gaussian_vector(key: Column, dim: int, seed: str) -> Column:
    """Standard normal draws by Box-Muller; one digest gives eight of them."""
    blocks = (dim + 7) // 8

    def block(b: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string"), b.cast("string")), 256)

        def draws(h: Column) -> Column:
            out = []
            for pair in range(4):
                radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(h, 2 * pair)))
                angle = F.lit(2.0 * math.pi) * _uniform(h, 2 * pair + 1)
                out += [radius * F.cos(angle), radius * F.sin(angle)]
            return F.array(*out)

        return F.transform(F.array(digest), draws)[0]

    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), block))
    return F.slice(flat, 1, dim)


def gaussian_block(keys: list[str | None], dim: int, seed: str) -> np.ndarray:
    """The draws of ``gaussian_vector`` for many keys at once."""
    blocks = (dim + 7) // 8
    heads = [f"{seed}:".encode() if k is None else f"{seed}:{k}:".encode() for k in keys]
    tails = [str(b).encode() for b in range(blocks)]
    digests = b"".join(hashlib.sha256(head + tail).digest() for head in heads for tail in tails)
    uniform = (np.frombuffer(digests, ">u4").reshape(len(keys), blocks, 4, 2) + 0.5) / 4294967296.0
    radius, angle = np.sqrt(-2.0 * np.log(uniform[..., 0])), 2.0 * math.pi * uniform[..., 1]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=-1).reshape(len(keys), -1)[:, :dim]


def gaussian_units(key: Column, dim: int, seed: str) -> Column:
    """``gaussian_vector`` of unit length, a batch of keys at a time."""

    @F.arrow_udf("array<double>")
    def draw(keys: pa.Array) -> pa.Array:
        made = gaussian_block(keys.to_pylist(), dim, seed)
        made = made / (np.sqrt((made * made).sum(axis=1, keepdims=True)) + 1e-8)
        bounds = np.arange(0, (len(made) + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(len(made) + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(made.ravel()))

    return draw(key.cast("string"))


def order_hash(key: Column, seed: str) -> Column:
    """A shuffling key: 64 hex digits, unique in practice for unique keys."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)
