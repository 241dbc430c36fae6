"""Queries over the driver's tables, by name, with the SQL they are held against.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` has for
each the SQL that gives the same rows from the same tables, where SQL can.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom import schemas
from hashloom.ext import queries as extensions
from hashloom.functions import commands, counters, digests, exotic, hostcheck, ids, status
from hashloom.operators import chunking, dispatching, ordering, resolving, results, store
from hashloom.plans import running
from hashloom.sources import tables, writing
from hashloom.sources.shared import fresh_path, settle
from hashloom.streaming import queries as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sized(rows: DataFrame, *keep: str) -> DataFrame:
    d = digests.digest_of(F.col("text"))
    return rows.select(*keep, d["hash"].alias("hash"), d["size_bytes"].alias("size_bytes"))


#: Documents as blobs, for SQL.
_D = "d as (select doc_id, text, sha256(text) as hash, cast(octet_length(encode(text)) as bigint) as size_bytes from documents)"


# Digests and identifiers.


@query("select doc_id, sha256(text) as hash, cast(octet_length(encode(text)) as bigint) as size_bytes from documents")
def digest_of(spark, d):
    return _sized(tables.read(spark, d, "documents"), "doc_id")


@query(f"with {_D} select doc_id, hash || '/' || size_bytes as text_form, hash as parsed_hash, size_bytes as parsed_size, 'ok' as status, true as equal from d")
def digest_format_parse(spark, d):
    rows = _sized(tables.read(spark, d, "documents"), "doc_id").withColumn("text_form", digests.format_digest(F.col("hash"), F.col("size_bytes")))
    p = digests.parse_digest(F.col("text_form"))
    return rows.select("doc_id", "text_form", p["hash"].alias("parsed_hash"), p["size_bytes"].alias("parsed_size"), p["status"].alias("status"), ((p["hash"] == F.col("hash")) & (p["size_bytes"] == F.col("size_bytes"))).alias("equal"))


@query(
    f"""with {_D}, c as (select case doc_id % 6 when 0 then hash || '/' || size_bytes when 1 then hash when 2 then hash || '/ 5' when 3 then hash || '/+7' when 4 then hash || '/1/2' else hash || '/-3' end as t, doc_id from d)
    select doc_id, case doc_id % 6 when 0 then 'ok' when 1 then 'MissingSeparator' when 2 then 'InvalidSize' when 3 then 'ok' when 4 then 'InvalidSize' else 'NegativeSize' end as status from c"""
)
def digest_parse_faults(spark, d):
    rows = _sized(tables.read(spark, d, "documents"), "doc_id")
    form, k = digests.format_digest(F.col("hash"), F.col("size_bytes")), F.col("doc_id") % 6
    text = F.when(k == 0, form).when(k == 1, F.col("hash")).when(k == 2, F.concat("hash", F.lit("/ 5"))).when(k == 3, F.concat("hash", F.lit("/+7"))).when(k == 4, F.concat("hash", F.lit("/1/2"))).otherwise(F.concat("hash", F.lit("/-3")))
    return rows.select("doc_id", digests.parse_digest(text)["status"].alias("status"))


def _corrupted(spark, d):
    rows = tables.read(spark, d, "documents").select("doc_id", "text", digests.hash_of(F.col("text")).alias("h"), digests.size_of(F.col("text")).alias("n"))
    k = F.col("doc_id") % 7
    hash_ = F.when(k == 1, F.upper("h")).when(k == 2, F.substring("h", 1, 63)).when(k == 4, F.repeat(F.lit("0"), F.lit(64))).when(k == 6, F.concat("h", F.lit("\n"))).otherwise(F.col("h"))
    size = F.when(k == 3, -F.col("n")).when(k == 5, F.col("n") + 1).otherwise(F.col("n"))
    return rows.select("doc_id", "text", hash_.alias("hash"), size.alias("size_bytes"), F.col("text").cast("binary").alias("data"))


_CORRUPTED = f"""{_D}, c as (select doc_id, text, case doc_id % 7 when 1 then upper(hash) when 2 then substr(hash, 1, 63) when 4 then repeat('0', 64) when 6 then hash || chr(10) else hash end as hash,
    case doc_id % 7 when 3 then -size_bytes when 5 then size_bytes + 1 else size_bytes end as size_bytes, hash as h, size_bytes as n from d),
  f as (select *, case when octet_length(encode(hash)) <> 64 then 'InvalidLength' when not regexp_full_match(hash, '[0-9a-f]+') then 'InvalidHex' when size_bytes < 0 then 'NegativeSize' end as shape,
    case when n <> size_bytes then 'SizeMismatch' when h <> hash then 'HashMismatch' else 'ok' end as content from c)"""


@query(f"with {_CORRUPTED} select coalesce(shape, 'ok') as status, count(*) as n from f group by 1")
def digest_shape(spark, d):
    return _corrupted(spark, d).groupBy(digests.shape_status(F.col("hash"), F.col("size_bytes")).alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""with {_CORRUPTED} select doc_id, coalesce(shape, content) as status, case coalesce(shape, content)
      when 'InvalidLength' then 'digest hash must be 64 hex chars, got ' || octet_length(encode(hash)) when 'InvalidHex' then 'digest hash must be lowercase hex: ' || hash
      when 'NegativeSize' then 'digest size must be non-negative, got ' || size_bytes when 'SizeMismatch' then 'digest size mismatch: declared ' || size_bytes || ', actual ' || n
      when 'HashMismatch' then 'digest mismatch: declared ' || hash || ', actual ' || h end as message from f"""
)
def digest_verify(spark, d):
    h, n, data = F.col("hash"), F.col("size_bytes"), F.col("data")
    s = digests.content_status(h, n, data)
    return _corrupted(spark, d).select("doc_id", s.alias("status"), digests.message(s, h, n, data).alias("message"))


@query("select doc_id, sha1(text) as sha1, md5(text) as md5, sha256(text) as sha256, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) as gitsha1 from documents")
def digest_functions(spark, d):
    t = F.col("text")
    return tables.read(spark, d, "documents").select("doc_id", *[digests.digest_by(n, t).alias(n.lower()) for n in ("SHA1", "MD5", "SHA256", "GITSHA1")])


@query(
    """with i as (select doc_id, case doc_id % 3 when 0 then source when 1 then '' else repeat('a', 129) end as id from documents)
    select doc_id, case when octet_length(encode(id)) = 0 then 'Empty' when octet_length(encode(id)) > 128 then 'TooLong' else 'ok' end as status,
      case when octet_length(encode(id)) = 0 then 'id cannot be empty' when octet_length(encode(id)) > 128 then 'id exceeds maximum length of 128: got ' || octet_length(encode(id)) end as message from i"""
)
def id_validate(spark, d):
    k = F.col("doc_id") % 3
    name = F.when(k == 0, F.col("source")).when(k == 1, F.lit("")).otherwise(F.repeat(F.lit("a"), F.lit(129)))
    return tables.read(spark, d, "documents").select("doc_id", ids.id_status(name).alias("status"), ids.id_message(name).alias("message"))


# The blob store: documents of even id are stored, all are asked for.


def _stored(spark, d):
    return store.distinct_blobs(store.as_blobs(tables.read(spark, d, "documents").where("doc_id % 2 = 0"), F.col("text")))


def _asked(spark, d):
    return _sized(tables.read(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "pos")


@query(f"with {_D} select doc_id as pos, hash, size_bytes from d r where not exists (select 1 from d s where s.doc_id % 2 = 0 and s.hash = r.hash and s.size_bytes = r.size_bytes)")
def find_missing_hash_size(spark, d):
    return store.find_missing(_asked(spark, d), _stored(spark, d))


def _misnamed(spark, d):
    return _asked(spark, d).withColumn("size_bytes", F.when(F.col("pos") % 3 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))


_MISNAMED = f"{_D}, r as (select doc_id as pos, hash, case when doc_id % 3 = 0 then size_bytes + 1 else size_bytes end as size_bytes from d)"


@query(f"with {_MISNAMED} select pos, hash, size_bytes from r where not exists (select 1 from d s where s.doc_id % 2 = 0 and s.hash = r.hash)")
def find_missing_hash_only(spark, d):
    return store.find_missing(_misnamed(spark, d), _stored(spark, d), key="hash")


@query(f"with {_MISNAMED} select pos, hash, size_bytes from r where not exists (select 1 from d s where s.doc_id % 2 = 0 and s.hash = r.hash and s.size_bytes = r.size_bytes)")
def find_missing_wrong_size(spark, d):
    return store.find_missing(_misnamed(spark, d), _stored(spark, d))


@query(
    f"""with {_D}, s as (select distinct hash, size_bytes, text from d where doc_id % 2 = 0)
    select r.doc_id as pos, r.hash, r.size_bytes, cast(case when s.hash is null then 5 else 0 end as integer) as code, case when s.hash is null then 'blob not found' end as message, s.text as body
    from d r left join s on s.hash = r.hash and s.size_bytes = r.size_bytes"""
)
def batch_read_ordered(spark, d):
    return store.batch_read(_asked(spark, d), _stored(spark, d)).select("pos", "hash", "size_bytes", "code", "message", F.col("data").cast("string").alias("body"))


@query(f"with {_CORRUPTED} select doc_id as pos, cast(case when coalesce(shape, content) = 'ok' then 0 else 3 end as integer) as code, coalesce(shape, content) <> 'ok' as has_message from f")
def batch_update_status(spark, d):
    statuses, _ = store.batch_update(_stored(spark, d), _corrupted(spark, d).withColumnRenamed("doc_id", "pos"))
    return statuses.select("pos", "code", F.col("message").isNotNull().alias("has_message"))


@query(f"with {_CORRUPTED} select distinct hash, size_bytes from (select hash, size_bytes from d where doc_id % 2 = 0 union all select hash, size_bytes from f where coalesce(shape, content) = 'ok')")
def batch_update_store(spark, d):
    _, after = store.batch_update(_stored(spark, d), _corrupted(spark, d).withColumnRenamed("doc_id", "pos"))
    return after.select("hash", "size_bytes")


@query(
    f"""with {_D}, c as (select sha256(text) as hash, cast(octet_length(encode(text)) as bigint) as size_bytes from benchmark union all select hash, size_bytes from d where doc_id % 5 = 0)
    select distinct hash, size_bytes from c where not exists (select 1 from d s where s.doc_id % 2 = 0 and s.hash = c.hash and s.size_bytes = c.size_bytes)"""
)
def conditional_upload(spark, d):
    wanted = store.as_blobs(tables.read(spark, d, "benchmark"), F.col("text")).unionAll(store.as_blobs(tables.read(spark, d, "documents").where("doc_id % 5 = 0"), F.col("text")))
    return store.to_upload(wanted, _stored(spark, d)).select("hash", "size_bytes")


@query(f"with {_CORRUPTED} select source, min(f.doc_id) as pos, cast(3 as integer) as code from f join documents using (doc_id) where coalesce(shape, content) <> 'ok' group by source")
def first_failure(spark, d):
    sources = tables.read(spark, d, "documents").select("doc_id", "source")
    seen = store.with_status(_corrupted(spark, d)).join(sources, "doc_id").withColumnRenamed("doc_id", "pos")
    return store.first_failure(seen, "source").select("source", "pos", "code")


@query(f"with {_D} select hash, size_bytes, count(*) as n, min(doc_id) as first_id from d group by hash, size_bytes")
def dedup_content(spark, d):
    return _sized(tables.read(spark, d, "documents"), "doc_id").groupBy("hash", "size_bytes").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(f"with {_D} select source, count(*) as n_rows, count(distinct hash) as n_distinct, cast(sum(size_bytes) as bigint) as total_bytes from d join documents using (doc_id) group by source")
def batch_counters(spark, d):
    rows = tables.read(spark, d, "documents").select("source", digests.hash_of(F.col("text")).alias("hash"), digests.size_of(F.col("text")).alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("hash").alias("n_distinct"), F.sum("n").alias("total_bytes"))


@query(f"with {_D} select hash, upper(substr(hex(encode(text)), 21, 40)) as part_hex from d")
def ranged_read(spark, d):
    blobs = store.as_blobs(tables.read(spark, d, "documents"), F.col("text"), "doc_id")
    return chunking.ranged(blobs, 10, 20).select("hash", F.hex("data").alias("part_hex"))


# The cache of results: events are requests, "error" fails.


def _log(spark, d):
    e = tables.read(spark, d, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), (F.col("event_id") % 5 == 0).alias("skip"),
        F.struct("ts", "event_id").alias("seq"), F.to_date("ts").alias("day"),
    )


_LOG = "l as (select *, case when event_type = 'error' then 1 else 0 end as exit_code, event_id % 5 = 0 as skip, row_number() over (order by ts, event_id) as seq from events)"


@query("select event_id, sha256(octet_length(encode(cast(user_id as varchar))) || ':' || user_id || ';' || octet_length(encode(event_type)) || ':' || event_type || ';') as action_hash from events")
def action_digest(spark, d):
    return tables.read(spark, d, "events").select("event_id", digests.hash_of(resolving.canonical(F.col("user_id"), F.col("event_type"))).alias("action_hash"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events group by user_id")
def ac_upsert_lww(spark, d):
    return results.upsert(_log(spark, d), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(
    """with c as (select user_id, arg_max(event_id, (ts, event_id)) as cached_id from events where event_type <> 'error' and event_id % 2 = 0 group by user_id)
    select e.event_id, e.event_id % 5 <> 0 and c.cached_id is not null as cache_hit, cast(case when e.event_id % 5 <> 0 then c.cached_id end as varchar) as cached_id from events e left join c using (user_id) where e.event_id % 2 = 1"""
)
def ac_probe(spark, d):
    log = _log(spark, d)
    cache = results.upsert(log.where("exit_code = 0 and event_id % 2 = 0").withColumn("cached_id", F.col("event_id")), "user_id", ["ts", "event_id"], ["cached_id"])
    seen = results.probe(log.where("event_id % 2 = 1"), cache, "user_id", bypass=F.col("skip"))
    return seen.select("event_id", "cache_hit", F.when(F.col("cache_hit"), F.col("cached_id")).cast("string").alias("cached_id"))


@query(
    """with c as (select user_id, arg_max(event_type, (ts, event_id)) as event_type from events where event_id % 2 = 0 group by user_id),
      u as (select user_id, arg_max(event_type, (ts, event_id)) as event_type from events where event_id % 2 = 1 and user_id % 3 = 0 group by user_id)
    select user_id, event_type from u union all select user_id, event_type from c where user_id not in (select user_id from u)"""
)
def ac_merge(spark, d):
    log = _log(spark, d)
    cache = results.upsert(log.where("event_id % 2 = 0"), "user_id", ["ts", "event_id"], ["event_type"])
    return results.merged(cache, log.where("event_id % 2 = 1 and user_id % 3 = 0"), "user_id", ["ts", "event_id"], ["event_type"])


_REPLAY = f"""{_LOG}, a as (select *, coalesce(max(case when exit_code = 0 and not (NEVER) then 1 else 0 end) over w, 0) as prior from l window w as (partition by user_id order by seq rows between unbounded preceding and 1 preceding)),
  b as (select *, not skip and prior = 1 as hit from a),
  c as (select *, max(case when not hit and exit_code = 0 and not (NEVER) then seq end) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding) as stored from b),
  m as (select c.event_id, c.event_type, c.hit, case when c.hit then l.event_id else c.event_id end as source_id, cast(case when c.hit then 0 else c.exit_code end as integer) as replayed_exit, c.exit_code from c left join l on l.seq = c.stored)"""


@query(f"with {_REPLAY.replace('NEVER', 'false')} select event_id, hit, source_id, replayed_exit from m")
def memoize(spark, d):
    seen = results.replay(_log(spark, d), "user_id", "seq", "day")
    return seen.select("event_id", "hit", F.col("source_seq.event_id").alias("source_id"), "replayed_exit")


@query(f"with {_REPLAY.replace('NEVER', 'value < 1')} select event_id, hit, source_id, replayed_exit from m")
def memoize_do_not_cache(spark, d):
    seen = results.replay(_log(spark, d), "user_id", "seq", "day", never=F.col("value") < 1)
    return seen.select("event_id", "hit", F.col("source_seq.event_id").alias("source_id"), "replayed_exit")


@query(f"with {_REPLAY.replace('NEVER', 'false')} select event_type, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, count(*) filter (where not hit and exit_code = 0) as stored from m group by event_type")
def memoize_summary(spark, d):
    seen = results.replay(_log(spark, d), "user_id", "seq", "day")
    return seen.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if(~F.col("hit") & (F.col("exit_code") == 0)).alias("stored"))


@query(
    f"""with {_D}, r as (select event_id, user_id, sha256(text) as h from events join documents on doc_id = event_id % (select count(*) from documents)), s as (select distinct hash from d where doc_id % 3 <> 0)
    select user_id, count(*) as complete from r where h in (select hash from s) group by user_id"""
)
def hit_completeness(spark, d):
    held = _sized(tables.read(spark, d, "documents").where("doc_id % 3 <> 0"))
    blobs = _sized(tables.read(spark, d, "documents"), "doc_id").select("doc_id", F.struct("hash", "size_bytes").alias("out"))
    n = tables.read(spark, d, "documents").count()
    cached = tables.read(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % n).alias("doc_id")).join(blobs, "doc_id")
    return results.complete_hits(cached, F.array("out"), held.distinct(), "event_id").groupBy("user_id").agg(F.count("*").alias("complete"))


@query(
    f"""with {_D}, s as (select distinct hash, size_bytes from d where doc_id % 3 <> 0)
    select event_id from events join d on doc_id = event_id % (select count(*) from documents) where hash in (select hash from s)"""
)
def upsert_precondition(spark, d):
    held = _sized(tables.read(spark, d, "documents").where("doc_id % 3 <> 0"))
    blobs = _sized(tables.read(spark, d, "documents"), "doc_id").select("doc_id", F.struct("hash", "size_bytes").alias("command"))
    n = tables.read(spark, d, "documents").count()
    updates = tables.read(spark, d, "events").select("event_id", (F.col("event_id") % n).alias("doc_id")).join(blobs, "doc_id")
    return results.admissible(updates, held, "command").select("event_id")


# Chains, trees, correlation.


@query("select l_orderkey, l_linenumber, o_custkey, c_name, c_nationkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def resolve_two_hop(spark, d):
    lines = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"))
    orders = tables.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("c_custkey"))
    customers = tables.read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return resolving.resolve(resolving.resolve(lines, orders, "o_orderkey", required="o_custkey"), customers, "c_custkey", required="c_name").select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "c_nationkey")


@query("select j.event_id, j.user_id, r.value, cast(r.event_id as bigint) as reported from events j join events r on j.event_id = r.event_id and r.event_id % 3 = 0 where j.event_type <> 'view'")
def waiter_match(spark, d):
    e = tables.read(spark, d, "events")
    reports = e.where("event_id % 3 = 0").select("event_id", "value", F.col("event_id").alias("reported"))
    return e.where("event_type <> 'view'").select("event_id", "user_id").join(reports, "event_id").select("event_id", "user_id", "value", "reported")


def _tree(spark, d):
    """Nodes of the tree of page addresses: host and path, without query and fragment, to any depth."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*", ""), r"^[a-z]+://", "")
    parts = tables.read(spark, d, "pages").select(F.filter(F.split(path, "/"), lambda p: p != "").alias("parts")).where(F.size("parts") > 0)
    prefix = lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/")
    rows = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return rows.select(prefix(F.col("depth")).alias("node"), prefix(F.col("depth") - 1).alias("parent"), F.element_at("parts", F.col("depth")).alias("name"), "depth").distinct()


_TREE = """p as (select list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-z]+://', ''), '/'), lambda x: x <> '') as parts from pages),
  k as (select parts, unnest(range(1, len(parts) + 1)) as depth from p),
  t as (select distinct array_to_string(parts[1:depth], '/') as node, case when depth > 1 then array_to_string(parts[1:depth - 1], '/') else '' end as parent, parts[depth] as name, cast(depth as integer) as depth from k)"""


@query(f"with recursive {_TREE}, w as (select '' as node, 0 as depth union select t.node, w.depth + 1 from w join t on t.parent = w.node) select '' as root, node, cast(depth as integer) as depth from w")
def tree_expand(spark, d):
    edges = _tree(spark, d).select("parent", F.col("node").alias("child"))
    return resolving.expand(edges, spark.createDataFrame([("",)], "root string"))


@query(
    f"""with recursive {_TREE}, w as (
      select node, parent, name, depth, sha256(name || chr(10)) as digest from t where depth = (select max(depth) from t)
      union all
      select t.node, any_value(t.parent), any_value(t.name), any_value(t.depth), sha256(any_value(t.name) || chr(10) || coalesce(string_agg(w.name || '=' || w.digest, chr(10) order by w.name), ''))
      from t left join w on w.parent = t.node where t.depth = (select max(depth) - 1 from w) group by t.node)
    select node, depth, digest from w"""
)
def merkle_root(spark, d):
    return resolving.merkle(_tree(spark, d).withColumn("content", F.col("name"))).where("depth > 0")


# Outcomes, counters, limits, probes.


@query(
    """with o as (select event_id, event_id % 11 = 0 as t, event_id % 7 = 0 as m, case when event_id % 3 <> 0 then event_id % 4 end as code, case when event_id % 2 = 0 then 9 end as sig from events)
    select event_id, case when t then 'Timeout' when m then 'OutOfMemory' when code is not null then 'Exited' else 'Signaled' end as kind,
      cast(case when not t and not m then code end as varchar) as code, cast(case when not t and not m and code is null then coalesce(sig, -1) end as varchar) as signal,
      cast(coalesce(code, -1) as integer) as worker_code, cast(coalesce(code, 128 + sig, 127) as integer) as mirrored from o"""
)
def exit_classify(spark, d):
    i = F.col("event_id")
    code, sig = F.when(i % 3 != 0, i % 4), F.when(i % 2 == 0, F.lit(9))
    e = status.sandbox_exit(i % 11 == 0, i % 7 == 0, code, sig)
    return tables.read(spark, d, "events").select("event_id", e["kind"].alias("kind"), e["code"].cast("string").alias("code"), e["signal"].cast("string").alias("signal"), status.worker_exit(code).alias("worker_code"), status.mirrored_exit(code, sig).alias("mirrored"))


@query("select event_id, event_id % 3 = 0 and event_id > 0 as oom from events")
def oom_flag(spark, d):
    i = F.col("event_id")
    text = F.concat(F.lit("low 0\nhigh 3\nmax 7\n"), F.when(i % 3 == 0, F.concat(F.lit("oom_kill "), i.cast("string"))).when(i % 3 == 1, F.lit("oom_kill 0\noom_kill 5")).otherwise(F.lit("oom 9")))
    return tables.read(spark, d, "events").select("event_id", counters.out_of_memory(text).alias("oom"))


@query("select event_id, cast(event_id + user_id as varchar) as io_read, cast(least(case when event_id % 10 = 0 then 18446744073709551615::hugeint else 0 end + user_id, 18446744073709551615::hugeint) as varchar) as io_write from events")
def io_stat_sum(spark, d):
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = F.concat(F.lit("8:0 rbytes="), i, F.lit(" wbytes="), u, F.lit(" rios=2\n"), F.lit("8:16 rbytes="), u, F.lit(" wbytes="), F.when(F.col("event_id") % 10 == 0, F.lit("18446744073709551615")).otherwise(F.lit("x1")), F.lit(" dios=0\nrbytes=77"))
    return tables.read(spark, d, "events").select("event_id", counters.summed(text, "rbytes=").cast("string").alias("io_read"), counters.summed(text, "wbytes=").cast("string").alias("io_write"))


@query("select event_id, cast(user_id as bigint) as cpu_user, cast(case when event_id % 2 = 0 then event_id else 0 end as bigint) as cpu_system, cast(case when event_id % 4 = 0 then 0 else event_id end as bigint) as peak from events")
def cpu_stat_pivot(spark, d):
    i = F.col("event_id").cast("string")
    text = F.concat(F.lit("usage_usec 1\nuser_usec 5\nuser_usec "), F.col("user_id").cast("string"), F.lit("\nuser_usec bad\nsystem_usec "), F.when(F.col("event_id") % 2 == 0, i).otherwise(F.lit("-4")))
    peak = F.when(F.col("event_id") % 4 == 0, F.lit("max")).otherwise(F.concat(F.lit(" "), i, F.lit("\n")))
    return tables.read(spark, d, "events").select("event_id", counters.last_of(text, "user_usec").cast("long").alias("cpu_user"), counters.last_of(text, "system_usec").cast("long").alias("cpu_system"), counters.gauge(peak).cast("long").alias("peak"))


@query("select p_partkey, cast(p_size * 100 * 100000 // 1000 as varchar) || ' 100000' as cpu_max from part")
def cpu_quota(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", commands.cpu_max(F.col("p_size") * 100).alias("cpu_max"))


_RELEASES = [("5.10.0",), ("6.6.87.2-microsoft",), ("6.10-rc2",), ("not.a.version",), ("",), ("4.19",), ("5.9.99",), ("5",)]


@query(
    f"""with r(release) as (values {", ".join(f"('{x}')" for (x,) in _RELEASES)}), s as (select release, try_cast(string_split_regex(release, '[.-]')[1] as bigint) as major, try_cast(string_split_regex(release, '[.-]')[2] as bigint) as minor from r)
    select release, cast(case when minor is not null then major end as varchar) as major, cast(case when major is not null then minor end as varchar) as minor, case when (major > 5 or (major = 5 and minor >= 10)) and minor is not null then 'Pass' else 'Fail' end as status from s"""
)
def kernel_version(spark, d):
    r = F.col("release")
    v = hostcheck.kernel_version(r)
    return spark.createDataFrame(_RELEASES, "release string").select("release", v["major"].cast("string").alias("major"), v["minor"].cast("string").alias("minor"), hostcheck.kernel_status(r).alias("status"))


def _probes(spark, d):
    n = tables.read(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_regionkey").alias("host"), k.alias("ord"), F.col("n_name").alias("name"), F.when((k % 7 == 0) & (F.col("n_regionkey") < 3), hostcheck.FAIL).when(k % 3 == 0, hostcheck.WARN).otherwise(hostcheck.PASS).alias("status"), F.when(k % 2 == 0, F.concat(F.lit("detail "), k.cast("string"))).alias("detail"))


_PROBES = "p as (select n_regionkey as host, n_nationkey as ord, n_name as name, case when n_nationkey % 7 = 0 and n_regionkey < 3 then 'Fail' when n_nationkey % 3 = 0 then 'Warn' else 'Pass' end as status, case when n_nationkey % 2 = 0 then 'detail ' || n_nationkey end as detail from nation)"


@query(
    f"""with {_PROBES}, c as (select host, count(*) filter (where status = 'Fail') as failures, count(*) filter (where status = 'Warn') as warnings, bool_and(status <> 'Fail') as functional,
      string_agg('[' || case status when 'Pass' then ' OK  ' when 'Warn' then 'WARN ' else 'FAIL ' end || '] ' || name || coalesce(' — ' || detail, ''), chr(10) order by ord) as report from p group by host)
    select *, case when failures > 0 then 'Sandbox is NOT functional. ' || failures || ' failure' || case when failures = 1 then '' else 's' end || ', ' || warnings || ' warning' || case when warnings = 1 then '' else 's' end || '.'
      when warnings > 0 then 'Sandbox is functional. ' || warnings || ' warning' || case when warnings = 1 then '' else 's' end || '.' else 'Sandbox is functional.' end as summary from c"""
)
def probe_report(spark, d):
    p = _probes(spark, d)
    return hostcheck.counts(p, "host").join(hostcheck.lines(p, "host"), "host").withColumn("summary", hostcheck.summary(F.col("failures"), F.col("warnings")))


@query(
    """select event_id, case when event_id % 4 = 0 then 'Fail' when event_id % 4 = 1 then 'Pass' when event_id % 4 = 2 then 'Fail' else 'Fail' end as namespaces,
      event_id % 2 = 0 as unified, event_id % 3 = 0 as seccomp from events"""
)
def probe_parse(spark, d):
    i = F.col("event_id")
    most = F.when(i % 4 == 0, F.lit("0\n")).when(i % 4 == 3, F.lit("none")).otherwise(F.lit(" 1234 "))
    gate = F.when(i % 4 == 1, F.when(i % 8 == 1, F.lit("1\n"))).otherwise(F.lit("0"))
    mounts = F.when(i % 2 == 0, F.lit("proc /proc proc rw\ncgroup2 /sys/fs/cgroup cgroup2 rw 0 0")).otherwise(F.lit("cgroup /sys/fs/cgroup cgroup rw\ncgroup2 /mnt cgroup2 rw"))
    state = F.when(i % 3 == 0, F.lit("Name:\tx\nSeccomp:\t0")).otherwise(F.lit("Name:\tx\n NoSeccomp:\t0"))
    trim = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return tables.read(spark, d, "events").select("event_id", hostcheck.namespaces_status(trim(most), trim(gate)).alias("namespaces"), hostcheck.unified_hierarchy(mounts).alias("unified"), hostcheck.seccomp_listed(state).alias("seccomp"))


@query(
    """select event_id, cast(len(['a', 'b']) as integer) as n_argv, case when event_id % 2 = 0 then '/w' end as workdir, case when event_id % 3 = 0 then 'loopback' else 'none' end as network, 'null' as stdin,
      cast(json_extract(props, '$.k') as bigint) as cpu_milli, true as bare,
      case when event_id % 5 = 0 then 'box' || user_id end as hostname, event_id % 5 = 0 as timezone_utc, case when event_id % 5 = 0 then event_id end as source_date_epoch, event_id % 5 = 0 as strip_ld_preload, event_id % 10 = 0 as strip_path from events"""
)
def config_defaults(spark, d):
    i = F.col("event_id")
    given = F.concat(F.lit(',"determinism":{"hostname":"box'), "user_id", F.lit('","timezone_utc":true,"strip_ld_preload":true,"source_date_epoch":'), i, F.when(i % 10 == 0, F.lit(',"strip_path":true')).otherwise(""), F.lit("}"))
    policy = F.when(i % 5 == 0, given).otherwise("")
    text = F.concat(F.lit('{"argv":["a","b"]'), F.when(i % 2 == 0, F.lit(',"workdir":"/w"')).otherwise(""), F.when(i % 3 == 0, F.lit(',"network":"loopback"')).otherwise(""), policy, F.lit(',"limits":{"cpu_milli":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    c = F.col("c")
    return tables.read(spark, d, "events").select("event_id", commands.config_of(text).alias("c")).select("event_id", F.size(c["argv"]).alias("n_argv"), c["workdir"].alias("workdir"), c["network"].alias("network"), c["stdin"].alias("stdin"), c["limits"]["cpu_milli"].cast("long").alias("cpu_milli"), commands.rootfs_is_empty(c["rootfs"]).alias("bare"), c["determinism"]["hostname"].alias("hostname"), *[c["determinism"][n].alias(n) for n in ("timezone_utc", "source_date_epoch", "strip_ld_preload", "strip_path")])


@query(
    """select conv_id, turn, case turn % 3 when 0 then 'ok' when 1 then 'argv is empty' else 'argv entry contains NUL' end as argv, case when turn % 2 = 0 then 'ok' else 'env entry contains NUL or ''=''' end as env,
      'ROLE=' || role as line, '/root/' || ltrim('//etc/' || role, '/') as path, case when turn % 2 = 0 then 'bin' end as runner from conversations"""
)
def argv_env_render(spark, d):
    t = F.col("turn")
    argv = F.when(t % 3 == 0, F.array("role", "text")).when(t % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat("role", F.lit("\0"))))
    name = F.when(t % 2 == 0, F.lit("ROLE")).otherwise(F.lit("A=B"))
    env = F.array(F.struct(name.alias("_1"), F.col("role").alias("_2")))
    good = F.array(F.struct(F.lit("ROLE").alias("_1"), F.col("role").alias("_2")))
    return tables.read(spark, d, "conversations").select(
        "conv_id", "turn", commands.argv_status(argv).alias("argv"), commands.env_status(env).alias("env"), commands.env_lines(good)[0].alias("line"), commands.rebased(F.lit("/root"), F.concat(F.lit("//etc/"), "role")).alias("path"),
        commands.first_existing(F.array(F.lit("usr"), F.lit("bin")), F.when(t % 2 == 0, F.array(F.lit("bin"), F.lit("opt"))).otherwise(F.array(F.lit("opt")))).alias("runner"),
    )


@query("select event_type, list_sort(list(value))[count(*) // 2 + 1] as median from events group by event_type")
def median_upper(spark, d):
    """The value at place n / 2 of the ascending values, by rank, so no group is gathered in one row."""
    e = tables.read(spark, d, "events").select("event_type", "value")
    by_value = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("event_type").orderBy("value"))
    half = F.floor(F.sum("n").over(Window.partitionBy("event_type")) / 2)
    return by_value.select("event_type", "value", upto.alias("upto"), half.alias("half")).where("upto > half").groupBy("event_type").agg(F.min("value").alias("median"))


@query("select 'SHA256' as digest_functions, true as update_enabled, cast(4194304 as bigint) as max_batch_total_size_bytes, 'DISALLOWED' as symlink_absolute_path_strategy, true as exec_enabled, '2.0' as low_api_version, '2.3' as high_api_version")
def capabilities(spark, d):
    return tables.capabilities(spark)


@query("select event_id, 'type.example/Result' as type_url, upper(hex(encode(event_type))) as value_hex, cast(case event_type when 'error' then 13 when 'view' then 5 when 'click' then 3 else 0 end as integer) as code from events")
def status_envelope(spark, d):
    kind = F.col("event_type")
    problem = F.when(kind == "error", "Boom").when(kind == "view", "NotFound").when(kind == "click", "InvalidHex").otherwise("ok")
    a = status.any_of("type.example/Result", kind)
    return tables.read(spark, d, "events").select("event_id", a["type_url"].alias("type_url"), F.hex(a["value"]).alias("value_hex"), status.code_of(problem).alias("code"))


@query("select event_id, cast(user_id * 1000 as bigint) as setup_us, cast(event_id * 2000 as bigint) as execution_us, cast(5 as bigint) as teardown_us, event_id * 2000 > 1000000 as over from events")
def phase_durations(spark, d):
    t = F.col("ts").cast("timestamp")
    at = lambda us: F.timestamp_micros(F.unix_micros(t) + us)
    a, b = F.col("user_id") * 1000, F.col("event_id") * 2000
    p = status.phases(t, at(a), at(a + b), at(a + b + 5))
    return tables.read(spark, d, "events").select("event_id", p["setup_us"].alias("setup_us"), p["execution_us"].alias("execution_us"), p["teardown_us"].alias("teardown_us"), status.over_limit(p["execution_us"], F.lit(1)).alias("over"))


# Chunks.


@query(f"with {_D}, c as (select hash, size_bytes, upper(hex(encode(text))) as x, unnest(range(0, greatest(size_bytes, 1), 1000)) as start from (select distinct hash, size_bytes, text from d)) select hash as blob, cast(start // 1000 as integer) as idx, cast(start as bigint) as start, substr(x, 2 * start + 1, 2000) as data_hex from c")
def split_fixed(spark, d):
    blobs = store.distinct_blobs(store.as_blobs(tables.read(spark, d, "documents"), F.col("text")))
    return chunking.split_fixed(blobs, 1000).select("blob", "idx", "start", F.hex("data").alias("data_hex"))


@query(f"with {_D} select distinct hash as blob, hash, size_bytes, true as ok from d")
def splice_verify(spark, d):
    blobs = store.distinct_blobs(store.as_blobs(tables.read(spark, d, "documents"), F.col("text")))
    return chunking.splice(chunking.split_fixed(blobs, 1000))


def _chunked(chunks, least: int, most: int):
    """Chunks spliced and held against their blobs, with whether each but the last is of a lawful size and long blobs are cut at all."""
    n = lambda c: F.octet_length(c["data"])
    lawful = F.forall("chunks", lambda c: (n(c) <= most) & ((n(c) >= least) | (c["idx"] == F.size("chunks") - 1)))
    spliced = chunking.splice(chunks, lawful.alias("lawful"), F.size("chunks").alias("n"))
    return spliced.select("blob", "hash", "size_bytes", "ok", "lawful", ((F.col("n") > 1) | (F.col("size_bytes") <= most)).alias("cut"))


_CHUNKED = f"with {_D} select distinct hash as blob, hash, size_bytes, true as ok, true as lawful, true as cut from d"


@query(_CHUNKED)
def split_fastcdc(spark, d):
    """Content-defined chunks, spliced and held against the blobs."""
    blobs = store.distinct_blobs(store.as_blobs(tables.read(spark, d, "documents"), F.col("text")))
    return _chunked(chunking.split_gear(blobs, 1024), 256, 4096)


@query(_CHUNKED)
def split_repmaxcdc(spark, d):
    blobs = store.distinct_blobs(store.as_blobs(tables.read(spark, d, "documents"), F.col("text")))
    return _chunked(chunking.split_longest(blobs, 256), 256, 511)


# Typed reads, envelopes, order.


@query(f"with {_D} select doc_id as pos, lang, source from d join documents using (doc_id) where doc_id % 4 = 0")
def typed_fetch(spark, d):
    body = F.to_json(F.struct("doc_id", "lang", "source"))
    docs = tables.read(spark, d, "documents")
    held = store.distinct_blobs(store.as_blobs(docs, body))
    wanted = store.as_blobs(docs.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "pos").withColumn("doc_id", F.col("pos")), body, "pos").drop("data")
    got = tables.fetch(wanted, held, T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]))
    return got.select("pos", "message.lang", "message.source")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type from events where event_type <> 'error' and user_id in (3, 5, 8, -1) group by user_id")
def get_result(spark, d):
    """A hit is a row, a miss none."""
    cache = results.upsert(_log(spark, d).where("exit_code = 0"), "user_id", ["ts", "event_id"], ["event_type"])
    return cache.join(spark.createDataFrame([(3,), (5,), (8,), (-1,)], "user_id long"), "user_id", "left_semi")


@query("select user_id, arg_min(event_id, (ts, event_id)) as event_id from events where event_type = 'purchase' group by user_id")
def first_terminal(spark, d):
    """The first element of each stream that is done."""
    done = _log(spark, d).where("event_type = 'purchase'")
    return done.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"with {_TREE} select parent, string_agg(name, '/' order by name) as children, count(*) as n from t group by parent")
def canonical_children(spark, d):
    """A directory's children in the byte order of their names."""
    return _tree(spark, d).groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("name")), "/").alias("children"), F.count("*").alias("n"))


@query("select o_orderkey, md5('order|' || o_orderkey) as digest, sha1(cast(o_custkey as varchar)) as other from orders")
def stable_digests(spark, d):
    return tables.read(spark, d, "orders").select("o_orderkey", digests.digest_by("MD5", F.concat(F.lit("order|"), F.col("o_orderkey").cast("string"))).alias("digest"), digests.digest_by("SHA1", F.col("o_custkey").cast("string")).alias("other"))


@query("select doc_id, sha256(text) as deflate, sha256(text) as zstd, sha256(text) as brotli, length(text) > 500 as shorter from documents")
def compression_round_trip(spark, d):
    """What comes back, by its digest, and whether a text of more than 500 characters went shorter through each codec."""
    settle(spark)
    raw = F.col("text").cast("binary")
    names = ("DEFLATE", "ZSTD", "BROTLI")
    packed = tables.read(spark, d, "documents").select("doc_id", "text", *[exotic.compress_udf(n)(raw).alias(n) for n in names])
    short = (F.greatest(*[F.octet_length(n) for n in names]) < F.octet_length("text")) & (F.length("text") > 500)
    return packed.select("doc_id", *[F.sha2(exotic.decompress_udf(n)(F.col(n)), 256).alias(n.lower()) for n in names], short.alias("shorter"))


@query()
def digest_functions_exotic(spark, d):
    settle(spark)
    raw = F.col("text").cast("binary")
    return tables.read(spark, d, "documents").select("doc_id", *[exotic.digest_udf(n)(raw).alias(n.lower()) for n in ("SHA256TREE", "MURMUR3")])


# Stores that are written and read back, order, files, identifiers.


@query(f"with {_D}, r as (select doc_id, hash, size_bytes + doc_id % 2 as size_bytes from d), s as (select distinct hash, text from d where doc_id % 2 = 0) select r.doc_id as pos, r.hash, r.size_bytes, cast(case when s.hash is null then 5 else 0 end as integer) as code, octet_length(encode(s.text)) as n from r left join s using (hash)")
def batch_read_by_hash(spark, d):
    """A store keyed by hash alone: a request of a wrong size is answered."""
    requests = _sized(tables.read(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("pos"), "hash", (F.col("size_bytes") + F.col("doc_id") % 2).alias("size_bytes"))
    held = store.distinct_blobs(store.as_blobs(tables.read(spark, d, "documents").where("doc_id % 2 = 0"), F.col("text")), "hash")
    return store.batch_read(requests, held, "hash").select("pos", "hash", "size_bytes", "code", F.octet_length("data").cast("long").alias("n"))


@query(f"with {_D} select doc_id as pos, hash, row_number() over (order by doc_id) as place from d where doc_id % 3 <> 1")
def ordered_output(spark, d):
    """Answers in request order, with the place that each has in it."""
    rows = _sized(tables.read(spark, d, "documents").where("doc_id % 3 <> 1"), "doc_id").withColumnRenamed("doc_id", "pos")
    return ordering.in_request_order(ordering.positions(rows, ["pos"], F.floor(F.col("pos") / 100_000)).select("pos", "hash", "place"))


@query("select event_id as job_id, row_number() over (order by ts, event_id) as turn from events where event_type <> 'view'")
def fifo_dequeue(spark, d):
    """Views are assignments without a job."""
    jobs = tables.read(spark, d, "events").select("ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_id")).alias("job_id"))
    return dispatching.dequeued(jobs, ["ts", "event_id"], F.to_date("ts")).select("job_id", "turn")


@query(
    """select event_id as job_id, case when event_id % 5 = 0 then 'worker error: lost' when event_id % 7 = 0 then 'worker reported no ActionResult' end as problem,
      event_id % 5 <> 0 and event_id % 7 <> 0 and event_type <> 'error' as remembered from events where event_type <> 'view' and event_id % 2 = 0"""
)
def worker_reports(spark, d):
    """Clicks and the like wait; views are hellos, odd messages are of no kind, multiples of 5 are errors and of 7 have no result."""
    e, i = tables.read(spark, d, "events"), F.col("event_id")
    result = F.when(i % 7 != 0, F.struct(F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code")))
    report = F.struct(i.alias("job_id"), F.when(i % 5 == 0, "lost").otherwise("").alias("error_message"), result.alias("result"))
    payload = F.struct(F.when(F.col("event_type") == "view", F.lit("hello")).alias("hello"), F.when((F.col("event_type") != "view") & (i % 2 == 0), report).alias("result"))
    seen = dispatching.settled(e.select(i.alias("job_id")), dispatching.reports_of(e.select(payload.alias("payload"))))
    good = dispatching.cacheable(seen).select("job_id", F.lit(True).alias("remembered"))
    return seen.join(good, "job_id", "left").select("job_id", "problem", F.coalesce("remembered", F.lit(False)).alias("remembered"))


@query(
    """with e as (select *, user_id % 2 = 0 and event_type = 'view' and event_id % 5 <> 0 as hit from events)
    select event_id as seq, hit as cache_hit, cast(case when not hit and event_type = 'error' then 1 else 0 end as integer) as exit_code, case when hit then 'kept' else 'echo ' || user_id || ' ' || event_type end as stdout from e"""
)
def execute_once(spark, d):
    """Every event submits a command; even users' views are cached, multiples of 5 skip the look-up. The runner is an expression."""
    e = tables.read(spark, d, "events")
    argv = F.array(F.lit("echo"), F.col("user_id").cast("string"), "event_type")
    jobs = e.select(F.col("event_id").alias("seq"), argv.alias("argv"), (F.col("event_id") % 5 == 0).alias("skip"))
    cached = running.actions(e.where("user_id % 2 = 0 and event_type = 'view'").select(argv.alias("argv")).distinct())
    cache = cached.select("action_hash", F.lit(0).alias("exit_code"), F.lit("kept").cast("binary").alias("stdout"), F.lit("").cast("binary").alias("stderr"))
    runner = lambda rows: rows.select("action_hash", F.when(F.array_contains("argv", "error"), 1).otherwise(0).alias("exit_code"), F.array_join("argv", " ").cast("binary").alias("stdout"), F.lit("").cast("binary").alias("stderr"))
    outcomes, _, _ = running.execute(jobs, cache, spark.createDataFrame([], schemas.BLOB), runner)
    return outcomes.select("seq", "cache_hit", "exit_code", F.col("stdout").cast("string").alias("stdout"))


@query(f"with {_D} select distinct hash, size_bytes from d where doc_id % 3 <> 1")
def append_then_read(spark, d):
    """Two batches that overlap, the second with rows of a wrong size, appended to a store of their own."""
    path = fresh_path(spark, "store")
    rows = store.as_blobs(tables.read(spark, d, "documents"), F.col("text"), F.col("doc_id").alias("pos"))
    writing.append_blobs(rows.where("pos % 3 = 0"), path)
    writing.append_blobs(rows.where("pos % 3 = 2 or pos % 6 = 0").unionByName(rows.where("pos % 3 = 1").withColumn("size_bytes", F.col("size_bytes") + 1)), path)
    return tables.open_store(spark, path).select("hash", "size_bytes")


@query("select sha256(cast(user_id as varchar)) as action_hash, cast(arg_max(case when event_type = 'error' then 1 else 0 end, (ts, event_id)) as integer) as exit_code from events group by user_id")
def upsert_then_read(spark, d):
    """Even events, then odd ones laid over, each the last of its user; failures count too."""
    path = fresh_path(spark, "cache")
    fields = {f.name: f.dataType for f in schemas.ACTION_RESULT.fields}
    code = F.when(F.col("event_type") == "error", 1).otherwise(0)
    result = F.struct(code.cast("int").alias("exit_code"), *[F.lit(None).cast(t).alias(n) for n, t in fields.items() if n != "exit_code"])
    log = _log(spark, d).withColumn("action_hash", digests.hash_of(F.col("user_id").cast("string"))).withColumn("result", result)
    latest = log.groupBy("action_hash").agg(F.max("seq").alias("last"))
    writing.upsert_results(log.where("event_id % 2 = 0"), path, ["ts", "event_id"])
    newer = log.join(latest, (log["action_hash"] == latest["action_hash"]) & (log["seq"] == latest["last"]), "left_semi").where("event_id % 2 = 1")
    writing.upsert_results(newer, path, ["ts", "event_id"])
    return tables.open_cache(spark, path).select("action_hash", F.col("result.exit_code").alias("exit_code"))


@query("select item_id, cast(octet_length(encode(text)) as bigint) as size_bytes, sha256(text) as file_hash from benchmark")
def file_outputs(spark, d):
    """Items written as files, one each, and read back as bytes and as whole texts."""
    path = fresh_path(spark, "files")
    tables.read(spark, d, "benchmark").select(F.base64(F.col("text").cast("binary")).alias("value"), "item_id").repartition("item_id").write.partitionBy("item_id").text(path)
    body = lambda c: F.unbase64(F.rtrim(c.cast("string"), F.lit("\n")))
    name = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long")
    raw = tables.outputs(spark, f"{path}/*/*.txt").select(name.alias("item_id"), digests.size_of(body(F.col("data"))).alias("size_bytes"), digests.hash_of(body(F.col("data"))).alias("file_hash"))
    whole = tables.texts(spark, f"{path}/*/*.txt").select(name.alias("item_id"), digests.hash_of(body(F.col("value"))).alias("again"))
    return raw.join(whole, "item_id").where("again = file_hash").drop("again")


@query("select 'a' as name, cast(2 as bigint) as n union all select 'b', 0 union all select 'c', 5")
def literal_store(spark, d):
    rows = tables.memory_store(spark, [("a", 2, b"xy"), ("b", 0, b""), ("c", 5, b"hello")])
    return rows.select(F.col("hash").alias("name"), F.octet_length("data").cast("long").alias("n"))


@query("select count(*) as n, count(*) as n_distinct, true as sound from events")
def random_ids(spark, d):
    made = tables.read(spark, d, "events").select(ids.random_id().alias("id"))
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.bool_and(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")).alias("sound"))


@query(
    """select event_id, case when event_id % 3 = 0 then 'Fail' when event_id % 2 = 0 then 'Fail' else 'Pass' end as slice, case when event_id % 3 = 0 then '/sys/fs/cgroup/x.slice missing — run install.sh' when event_id % 2 = 0 then 'cannot mkdir under /sys/fs/cgroup/x.slice: denied' end as slice_detail,
      case when event_id % 5 = 0 then 'Warn' else 'Pass' end as peak, case when event_id % 5 = 0 then 'absent on kernel 5.' || user_id || '; falling back to memory.events on the per-action cgroup' end as peak_detail,
      case when event_id % 7 = 0 then 'Fail' else 'Pass' end as setgroups, case when event_id % 7 = 0 then 'required for gid_map writes under unprivileged userns' end as setgroups_detail from events"""
)
def probe_rules(spark, d):
    i = F.col("event_id")
    rules = {
        "slice": hostcheck.slice_rule(i % 3 != 0, F.when(i % 2 == 0, "denied"), "/sys/fs/cgroup/x.slice", "install.sh"),
        "peak": hostcheck.memory_peak_rule(i % 5 != 0, F.concat(F.lit("5."), F.col("user_id").cast("string"))), "setgroups": hostcheck.setgroups_rule(i % 7 != 0),
    }
    return tables.read(spark, d, "events").select("event_id", *[c for n, r in rules.items() for c in (r["status"].alias(n), r["detail"].alias(f"{n}_detail"))])


# Streams, held against the same SQL as their batch forms.

QUERIES.update(streams.QUERIES)
ORACLES["stream_waiter_match"] = ORACLES["waiter_match"]
ORACLES["stream_memoize"] = ORACLES["memoize"]
ORACLES["stream_execute"] = """with c as (select distinct user_id, event_type from events where user_id % 2 = 1 and event_type <> 'error'),
  s as (select e.*, c.user_id is not null as hit, case when c.user_id is not null then null when event_id % 7 = 0 then 'worker error: lost' when event_id % 11 = 0 then 'worker reported no ActionResult' end as problem from events e left join c using (user_id, event_type) where c.user_id is not null or event_id % 3 <> 0)
select 'operations/' || event_id as name, true as done, cast(case when problem is null then case when not hit and event_type = 'error' then 1 else 0 end end as integer) as exit_code, case when problem is null then hit end as cached_result, cast(case when problem is not null then 13 end as integer) as code, problem as message from s"""
ORACLES["stream_dedup_content"] = f"with {_D} select distinct hash, size_bytes from d"

# Extensions.

QUERIES.update(extensions.QUERIES)
ORACLES.update(extensions.ORACLES)
