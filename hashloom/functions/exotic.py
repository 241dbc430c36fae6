"""Digest functions and compressors of the protocol that Spark has not built in, over Arrow batches."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _root_fraction(p: int, power: int, bits: int = 32) -> int:
    """The leading bits of the fraction of a root, by whole numbers."""
    low, high, target = 0, 1 << (bits + 8), p << (power * bits)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**power <= target else (low, mid)
    return low & ((1 << bits) - 1)


@functools.cache
def _rounds() -> list[int]:
    return [_root_fraction(p, 3) for p in _primes(64)]


@functools.cache
def _tree_state() -> list[int]:
    """Square roots of the ninth to the sixteenth prime."""
    return [_root_fraction(p, 2) for p in _primes(16)[8:]]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def block_cipher(state: list[int], blocks: np.ndarray) -> np.ndarray:
    """The rounds of SHA-256 on each row of 64 bytes, without the final addition of the state; rows of 32 bytes."""
    w = list(blocks.view(">u4").astype(np.uint32).T)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ x >> np.uint32(3)) + w[i - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ y >> np.uint32(10)))
    a, b, c, d, e, f, g, h = (np.full(len(blocks), s, dtype=np.uint32) for s in state)
    for k, x in zip(_rounds(), w, strict=True):
        t = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (e & f ^ ~e & g) + np.uint32(k) + x
        u = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return np.stack([a, b, c, d, e, f, g, h], axis=1).astype(">u4").view(np.uint8)


def sha256tree(bodies: list[bytes]) -> list[bytes]:
    """Tree hashes: leaves of 1024 bytes, neighbours joined level by level, an odd last node carried up. All bodies' nodes of a level go together."""
    level = [[hashlib.sha256(b[i : i + 1024]).digest() for i in range(0, max(len(b), 1), 1024)] for b in bodies]
    while any(len(nodes) > 1 for nodes in level):
        pairs = [nodes[i] + nodes[i + 1] for nodes in level for i in range(0, len(nodes) - 1, 2)]
        joint = iter(block_cipher(_tree_state(), np.frombuffer(b"".join(pairs), dtype=np.uint8).reshape(-1, 64)))
        level = [[next(joint).tobytes() for _ in range(len(nodes) // 2)] + ([nodes[-1]] if len(nodes) % 2 else []) for nodes in level]
    return [nodes[0] for nodes in level]


def murmur3(bodies: list[bytes], seed: int = 0) -> list[bytes]:
    """128 bits, the variant for 64-bit machines, of all bodies side by side. The multipliers are fixed values."""
    u = np.uint64
    c1, c2 = u(0x87C37B91114253D5), u(0x4CF5AD432745937F)
    turn = lambda x, n: (x << u(n)) | (x >> u(64 - n))

    def last(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> u(33)) * u(0xFF51AFD7ED558CCD)
        x = (x ^ x >> u(33)) * u(0xC4CEB9FE1A85EC53)
        return x ^ x >> u(33)

    one = lambda k: turn(k * c1, 31) * c2
    two = lambda k: turn(k * c2, 33) * c1
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    order = np.argsort(-size, kind="stable")  # longest first: those with a block left are the first rows
    blocks = (size // 16)[order]
    a, b = np.full(len(order), seed, dtype=np.uint64), np.full(len(order), seed, dtype=np.uint64)
    words = [np.frombuffer(bodies[i], dtype="<u8", count=2 * int(n)) for i, n in zip(order, blocks, strict=True)]
    starts = np.concatenate([[0], np.cumsum(2 * blocks)])[:-1]
    flat = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
    live = np.searchsorted(-blocks, -np.arange(int(blocks[0]) if len(blocks) else 0), side="left")  # bodies with more than t blocks
    for t, n in enumerate(live.tolist()):
        k = starts[:n] + 2 * t
        a[:n] = (turn(a[:n] ^ one(flat[k]), 27) + b[:n]) * u(5) + u(0x52DCE729)
        b[:n] = (turn(b[:n] ^ two(flat[k + 1]), 31) + a[:n]) * u(5) + u(0x38495AB5)
    rest = [bodies[i][16 * int(n) :].ljust(16, b"\0") for i, n in zip(order, blocks, strict=True)]
    tail = np.frombuffer(b"".join(rest), dtype="<u8").reshape(-1, 2)
    length = size[order].astype(np.uint64)
    b = b ^ two(tail[:, 1]) ^ length  # of nothing it is nothing
    a = a ^ one(tail[:, 0]) ^ length
    a = a + b
    b = b + a
    a, b = last(a), last(b)
    a = a + b
    out = np.stack([a, a + b], axis=1).astype(">u8").view(np.uint8)
    made = [b""] * len(bodies)
    for i, row in zip(order.tolist(), out, strict=True):
        made[i] = row.tobytes()
    return made


def digest_udf(function: str):
    """A column function of binary data: lowercase hex."""
    made = {"SHA256TREE": sha256tree, "MURMUR3": murmur3}[function]

    @F.pandas_udf("string")
    def digest(bodies: pd.Series) -> pd.Series:
        there = bodies[bodies.notna()]
        return pd.Series([d.hex() for d in made([bytes(b) for b in there])], index=there.index, dtype=object).reindex(bodies.index)

    return digest


#: Of Brotli and Zstandard; the former's own default is tens of times slower.
LEVEL = 4


def _codec(name: str):
    return pa.Codec(name.lower(), compression_level=LEVEL)


def _each(bodies: pa.Array, of: Callable[[pa.Buffer], bytes]) -> pa.Array:
    """``of`` each body that is there, read where it lies."""
    done = pa.array([None if (b := x.as_buffer()) is None else of(b) for x in bodies], pa.binary())
    pa.default_memory_pool().release_unused()
    return done


def compress_udf(name: str):
    """IDENTITY, DEFLATE, ZSTD or BROTLI of binary data; the two last lead with the length, as their decoder needs it."""

    @F.arrow_udf("binary")
    def compress(bodies: pa.Array) -> pa.Array:
        if name == "IDENTITY":
            return bodies
        if name == "DEFLATE":
            return _each(bodies, zlib.compress)
        codec = _codec(name)
        return _each(bodies, lambda b: len(b).to_bytes(8, "little") + codec.compress(b, asbytes=True))

    return compress.asNondeterministic()  # it isn't, but so each text is compressed once, however often the result is used


def decompress_udf(name: str):
    @F.arrow_udf("binary")
    def decompress(bodies: pa.Array) -> pa.Array:
        if name == "IDENTITY":
            return bodies
        if name == "DEFLATE":
            return _each(bodies, zlib.decompress)
        codec = _codec(name)
        return _each(bodies, lambda b: codec.decompress(b[8:], decompressed_size=int.from_bytes(bytes(b[:8]), "little"), asbytes=True))

    return decompress
