import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashloom.functions import digests as D
from hashloom.functions import ids, status

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_empty(spark):
    r = spark.range(1).select(D.digest_of(F.lit("")).alias("d")).first().d
    assert (r.hash, r.size_bytes) == (EMPTY, 0)


CASES = [
    (sha(b"hello world"), 11, b"hello world", "ok"),
    (sha(b"hello"), 5, b"hello!", "SizeMismatch"),
    ("0" * 64, 5, b"hello", "HashMismatch"),
    (EMPTY.upper(), 0, b"", "InvalidHex"),
    ("abc", 0, b"", "InvalidLength"),
    (EMPTY, -1, b"", "NegativeSize"),
    (EMPTY[:-1] + "\n", 0, b"", "InvalidHex"),
    (EMPTY + "\n", 0, b"", "InvalidLength"),
    (EMPTY[:-2] + "é", 0, b"", "InvalidHex"),  # 64 bytes, 63 characters
    ("abc", -1, b"x", "InvalidLength"),  # the first fault counts
]


def test_ladder(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, h string, n long, data binary, want string")
    got = df.select("i", D.content_status(F.col("h"), F.col("n"), F.col("data")).alias("s"), "want").orderBy("i").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_required_fails_the_batch(spark):
    df = spark.createDataFrame([(sha(b"a"), 1), ("abc", 1)], "h string, n long")
    with pytest.raises(Exception, match="64 hex chars"):
        df.select(D.required(F.col("h"), F.col("n"))).collect()


def test_parse(spark):
    h = sha(b"x")
    texts = {f"{h}/6": (h, 6, "ok"), f"{h}/+6": (h, 6, "ok"), f"{h}/ 6": (h, None, "InvalidSize"), h: (h, None, "MissingSeparator"), f"{h}/1/2": (h, None, "InvalidSize"), f"{h}/": (h, None, "InvalidSize"), f"{h}/99999999999999999999": (h, None, "InvalidSize"), "ab/3": ("ab", 3, "InvalidLength")}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.parse_digest(F.col("t")).alias("p"))
    assert {r.t: (r.p.hash, r.p.size_bytes, r.p.status) for r in df.collect()} == texts


@settings(max_examples=5, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=20))
def test_round_trip(spark, bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "b binary").select("b", D.digest_of(F.col("b")).alias("d"))
    df = df.select("b", "d", D.parse_digest(D.format_digest(F.col("d.hash"), F.col("d.size_bytes"))).alias("p"), D.content_status(F.col("d.hash"), F.col("d.size_bytes"), F.col("b")).alias("s"))
    for r in df.collect():
        assert (r.d.hash, r.d.size_bytes) == (sha(bytes(r.b)), len(r.b)) == (r.p.hash, r.p.size_bytes)
        assert r.s == r.p.status == "ok"


def test_ids(spark):
    df = spark.createDataFrame([("worker-1",), ("",), ("a" * 129,), ("a" * 128,), ("é" * 65,)], "id string")
    assert [r[0] for r in df.select(ids.id_status(F.col("id"))).collect()] == ["ok", "Empty", "TooLong", "ok", "TooLong"]


def test_functions(spark):
    r = spark.range(1).select(*[D.digest_by(n, F.lit("abc")).alias(n) for n in ("SHA1", "MD5", "SHA384", "SHA512", "GITSHA1")]).first()
    assert (r.SHA1, r.MD5) == (hashlib.sha1(b"abc").hexdigest(), hashlib.md5(b"abc").hexdigest())
    assert (r.SHA384, r.SHA512) == (hashlib.sha384(b"abc").hexdigest(), hashlib.sha512(b"abc").hexdigest())
    assert hashlib.sha1(b"blob 3\0abc").hexdigest() == r.GITSHA1


def test_exit_precedence(spark):
    rows = [(True, True, 0, 9), (False, True, 0, 9), (False, False, 3, 9), (False, False, None, 9), (False, False, None, None)]
    df = spark.createDataFrame(rows, "t boolean, m boolean, c int, s int")
    got = [tuple(r[0]) for r in df.select(status.sandbox_exit(F.col("t"), F.col("m"), F.col("c"), F.col("s"))).collect()]
    assert got == [("Timeout", None, None), ("OutOfMemory", None, None), ("Exited", 3, None), ("Signaled", None, 9), ("Signaled", None, -1)]
