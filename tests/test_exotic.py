import hashlib

import numpy as np
import pyarrow as pa
import pytest

from hashloom.functions import exotic


def one(digest, body):
    return digest([body])[0]


def test_constants_and_rounds():
    assert exotic._rounds()[:2] == [0x428A2F98, 0x71374491]
    assert exotic._tree_state() == [0xCBBB9D5D, 0x629A292A, 0x9159015A, 0x152FECD8, 0x67332667, 0x8EB44A87, 0xDB0C2E0D, 0x47B5481D]
    state = [exotic._root_fraction(p, 2) for p in exotic._primes(8)]
    block = b"abc\x80" + bytes(52) + (24).to_bytes(8, "big")
    got = [(x + y) & 0xFFFFFFFF for x, y in zip(state, exotic.block_cipher(state, np.frombuffer(block, dtype=np.uint8).reshape(1, 64))[0].view(">u4").tolist())]
    assert b"".join(x.to_bytes(4, "big") for x in got) == hashlib.sha256(b"abc").digest()


def test_tree():
    small = b"x" * 1024
    assert one(exotic.sha256tree, small) == hashlib.sha256(small).digest()
    left, right = one(exotic.sha256tree, small), one(exotic.sha256tree, b"y")
    join = lambda a, b: exotic.block_cipher(exotic._tree_state(), np.frombuffer(a + b, dtype=np.uint8).reshape(1, 64)).tobytes()
    assert one(exotic.sha256tree, small + b"y") == join(left, right)

    def plain(body):
        """The left part is the greatest power of two below the length."""
        if len(body) <= 1024:
            return hashlib.sha256(body).digest()
        cut = 1 << (len(body) - 1).bit_length() - 1
        return join(plain(body[:cut]), plain(body[cut:]))

    bodies = [bytes(i % 251 for i in range(n)) for n in (0, 1, 1024, 1025, 2048, 3000, 5 * 1024, 7 * 1024 + 1, 20_000)]
    assert exotic.sha256tree(bodies) == [plain(b) for b in bodies]


def test_bodies_side_by_side_are_as_alone():
    bodies = [bytes((i * n) % 256 for i in range(n)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 31, 33, 500, 4096)]
    assert exotic.murmur3(bodies) == [one(exotic.murmur3, b) for b in bodies]
    assert one(exotic.murmur3, b"The quick brown fox jumps over the lazy dog").hex() == "e34bbc7bbc071b6c7a433ca9c49a9347"


def test_murmur():
    assert one(exotic.murmur3, b"").hex() == "0" * 32
    assert one(exotic.murmur3, b"hello").hex() == "cbd8a7b341bd9b025b1e906a48ae1d19"


@pytest.mark.parametrize("name", ["IDENTITY", "DEFLATE", "ZSTD", "BROTLI"])
def test_compressors_take_bodies_where_they_lie(spark, name):
    """Arrow arrays in and out, nothing in between that holds all bodies again."""
    bodies = pa.array([b"left out", b"", None, b"ab" * 5000, bytes(range(256))], pa.binary()).slice(1)
    packed = exotic.compress_udf(name).func(bodies)
    assert isinstance(packed, pa.Array) and packed.null_count == 1
    assert exotic.decompress_udf(name).func(packed).to_pylist() == bodies.to_pylist()
    assert name == "IDENTITY" or len(packed[2].as_py()) < 1000
