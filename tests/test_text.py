import pytest
from pyspark.sql import functions as F

from hashloom.functions import commands, counters, hostcheck


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_counters(spark):
    io = "8:0 rbytes=4096 wbytes=8192 rios=2\n8:16 rbytes=1 wbytes=x\nrbytes=5\n"
    assert one(spark, counters.summed(F.col("t"), "rbytes="), t=io) == 4097
    assert one(spark, counters.summed(F.col("t"), "wbytes="), t=io) == 8192
    top = (1 << 64) - 1
    assert one(spark, counters.summed(F.col("t"), "rbytes="), t=f"a rbytes={top} rbytes=5") == top
    assert one(spark, counters.last_of(F.col("t"), "user_usec"), t="user_usec 1\nuser_usec 2\nuser_usec -3") == 2
    assert one(spark, counters.gauge(F.col("t")), t=" 42\n") == 42 and one(spark, counters.gauge(F.col("t")), t="max") == 0
    assert one(spark, counters.out_of_memory(F.col("t")), t="low 0\noom_kill 1\noom_kill 0") is True
    assert one(spark, counters.out_of_memory(F.col("t")), t="oom 3") is False
    null = F.lit(None).cast("string")
    assert tuple(spark.range(1).select(counters.accounting(null, null, null, null)).first()[0]) == (0,) * 6


@pytest.mark.parametrize(("release", "want"), [("5.10.0", (5, 10)), ("6.6.87.2-microsoft", (6, 6)), ("6.10-rc2", (6, 10)), ("not.a.version", None), ("", None)])
def test_kernel_version(spark, release, want):
    got = one(spark, hostcheck.kernel_version(F.col("r")), r=release)
    assert (got and tuple(got)) == want


def test_report(spark):
    rows = [(0, "a", "Pass", None), (1, "b", "Warn", "why"), (2, "c", "Fail", "broken")]
    df = spark.createDataFrame(rows, "ord int, name string, status string, detail string")
    c = hostcheck.counts(df).first()
    assert (c.failures, c.warnings, c.functional) == (1, 1, False)
    assert hostcheck.counts(df.where("false")).first().functional is True
    assert hostcheck.lines(df).first().report == "[ OK  ] a\n[WARN ] b — why\n[FAIL ] c — broken"
    text = lambda f, w: spark.range(1).select(hostcheck.summary(F.lit(f), F.lit(w))).first()[0]
    assert text(1, 2) == "Sandbox is NOT functional. 1 failure, 2 warnings."
    assert text(0, 1) == "Sandbox is functional. 1 warning." and text(0, 0) == "Sandbox is functional."


def test_config(spark):
    c = one(spark, commands.config_of(F.col("t")), t='{"argv":["a"],"env":[["K","v"],["L","w"]]}')
    assert (c.argv, [tuple(e) for e in c.env], c.workdir, c.network, c.stdin, c.limits) == (["a"], [("K", "v"), ("L", "w")], None, "none", "null", None)
    c = one(spark, commands.config_of(F.col("t")), t='{"argv":["a"],"rootfs":{"ro_binds":[["/a","/b"]]},"limits":{"memory_bytes":18446744073709551615}}')
    assert c.env == [] and [tuple(b) for b in c.rootfs.ro_binds] == [("/a", "/b")] and int(c.limits.memory_bytes) == (1 << 64) - 1
    with pytest.raises(Exception, match="(?i)malformed"):
        one(spark, commands.config_of(F.col("t")), t="{not json")


def test_commands(spark):
    assert one(spark, commands.cpu_max(F.col("m")), m=1500) == "150000 100000"
    assert spark.range(1).select(commands.cpu_max(F.lit("18446744073709551615"))).first()[0] == "18446744073709551 100000"
    assert one(spark, commands.rebased(F.lit("/new"), F.col("p")), p="//a/b") == "/new/a/b"
    assert one(spark, commands.hostname(F.col("h")), h="") == "unknown"
    argv = lambda a: spark.createDataFrame([(a,)], "a array<string>").select(commands.argv_status(F.col("a"))).first()[0]
    assert argv([]) == "argv is empty" and argv(["a\0"]) == "argv entry contains NUL" and argv(["a"]) == "ok"
