"""The pipeline, stage by stage, on a small table; and the queries of the subpackage."""

import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hashloom.llm import pii, registry


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{data}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"file://{at}/{name}")
        docs = out[name] = spark.read.parquet(f"file://{at}/{name}")
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for name in ("toxicity", "exact_dedup", "near_dedup", "pii"):
        assert stages[name].schema.simpleString() == stages["documents"].schema.simpleString()


def test_exact_stage(stages):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keep = {}
    for r in stages["toxicity"].collect():
        k = (r.text or "").translate(low)
        keep[k] = max(keep.get(k, -1), r.doc_id)
    assert sorted(r.doc_id for r in stages["exact_dedup"].collect()) == sorted(keep.values())


def test_near_stage(stages):
    rows = {}
    for r in stages["exact_dedup"].collect():
        w = (r.text or "").lower().split()
        rows[r.doc_id] = frozenset(zip(*[w[k:] for k in range(5)])) or frozenset([tuple(w)])
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages["near_dedup"].collect()} == {find(i) for i in rows}


def test_pii_stage(stages):
    before = {r.doc_id: r.text for r in stages["near_dedup"].collect()}
    after = {r.doc_id: r for r in stages["pii"].collect()}
    assert before.keys() == after.keys()
    changed = 0
    for i, t in before.items():
        spans = pii.base_spans(t or "")
        assert not spans or (after[i].text != t and after[i].n_chars == len(after[i].text))
        assert spans or after[i].text.count("<") >= (t or "").count("<")
        changed += bool(spans)
    assert changed


def test_packing_stage(stages):
    ids = {r.doc_id for r in stages["pii"].collect()}
    pieces = stages["packing"].collect()
    assert {p.doc_id for p in pieces} == ids
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert all(total[p.doc_id] == p.doc_tokens for p in pieces)


def test_run_equals_the_stages(spark, data, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, data).collect())) == sorted(map(key, stages["packing"].collect()))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = registry.queries()[name](spark, data)
    got = con.execute(registry.oracles()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[names.index(c)] for c in sorted(names)]) for r in got.fetchall()) == sorted(str([r[c] for c in sorted(names)]) for r in df.collect())


def test_eleven_queries():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_folds(spark):
    from pyspark.sql import functions as F

    from hashloom.llm.labelled import fold_of

    got = spark.range(50).select("id", fold_of("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert hashlib.sha256(b"").hexdigest() and F


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names the stages might use."""
    text = "the cat sat on the mat and looked at the other cat for a while"
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, text, "en", "s", len(text)), (3, text, "en", "s", len(text)), (4, text.upper(), None, None, None), (None, text, "en", "s", 5)]
    rows += [(5, "write to a.b@example.org or +1 (415) 555-2671 now please", "en", "s", 3), (6, " ".join(f"w{i % 977}x{i}" for i in range(40_000)), "en", "s", 9), (7, " \n ", "en", "s", 3), (None, "another text that has no id but is not like any other one here", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["__0", "__1", "__2", "__id", "__n", "__sha", "__body", "__at", "node", "component", "key", "bucket", "body", "score", "kept", "class_id", "keep_id", "n", "at", "y"]
    return docs.selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(names)]).repartition(3)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, data, name, stage):
    docs = odd_docs(spark)
    got, none = stage(spark, docs, data), stage(spark, docs.where("false"), data)
    assert none.count() == 0
    rows = got.collect()
    if name == "packing":
        tokens = {(r.doc_id, r.doc_tokens) for r in rows}
        assert (1, 1) in tokens and (2, 1) in tokens and sum(r.length for r in rows) == sum(n for n in (r.doc_tokens for r in rows if r.start == 0))
        return
    assert got.columns == docs.columns and all(r["__id"] == 3 and r.y == 19 for r in rows)
    texts = [r.text for r in rows]
    long = [t for t in texts if t and len(t) > 100_000]
    assert len(long) == 1
    if name in ("toxicity", "pii"):
        assert len(rows) == docs.count()
    if name == "exact_dedup":  # null and empty are one text, and so are the cases
        assert sorted(str(r.doc_id) for r in rows) == sorted(["2", "4", "5", "6", "7", "None"])
    if name == "near_dedup":
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "5", "6", "None"])
    if name == "pii":
        mended = next(r for r in rows if r.doc_id == 5)
        assert mended.text == "write to <EMAIL> or <PHONE> now please" and mended.n_chars == len(mended.text)
        assert sum(r.text is None for r in rows) == 2
