"""Repeated 50-byte strings by a distributed merge sort of suffixes.

Sorting the suffixes at every byte would move the text fifty times over, so
suffixes are taken at *anchors*. Each window of ``SPAN`` bytes picks the one of its
``GRAM``-byte strings with the least hash, the leftmost of equals; the pick depends
on the window's bytes alone, so equal windows in different documents pick the
same place in them. About one byte in sixteen is an anchor, and every window has one.

1. *Blocks.* Scan tasks pack documents into blocks of about ``BLOCK`` bytes,
   written to shared files.
2. *Candidates.* Each block sends the hashes of its anchors' grams, sorted and
   delta-coded, to the owners of hash ranges; an owner returns to each block the
   hashes that two documents hold. What no other document holds is not sorted.
3. *Runs.* A block sorts the suffixes at its candidate anchors (``SPAN`` bytes
   from the anchor on, then the bytes before it, backwards), folds equal ones into
   one entry with the least document, front-codes the run (length of the prefix
   shared with the entry before, then the rest) and sends it in pieces by hash range.
4. *Merge.* The owner of a range merges the runs with a loser tree that carries
   common prefix lengths: entries that differ in these are ordered by them, others are
   compared from there on. The merged order's prefix lengths give the groups of
   equal right parts, within which equal left parts are told apart; so each
   of an anchor's windows gets the least document that has it.
5. *Marks.* Each block reads, for its own entries, which windows an earlier document
   has, covers their bytes and digests what is left.

A passage that a third of all documents hold is one entry per block, whatever
the number of its copies. Every exchange is keyed by block and hash range.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import free_shuffles, settle, written
from hashloom.llm.tokenizing import tidy

SPAN = 50
GRAM = 20
LEFT = SPAN - GRAM
#: A sorted entry: the suffix, the bytes before the anchor backwards, and the first and last offset of the anchor's windows.
ENTRY = SPAN + LEFT + 2
BLOCK = 6 << 20
#: Bytes of text for each hash range.
RANGE_BYTES = 12 << 20
VALUE_BITS = 39
NOBODY = np.iinfo(np.int64).max
_SLICE = 1 << 20
_BASE = 0x5851F42D4C957F2D
_TABLE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_CODEC, _LEVEL = "zstd", 3


#: Below so many bytes a piece isn't compressed.
_SMALL = 300


def _packed(body: bytes) -> bytes:
    """The length, 0 for what stands as it is, then the body."""
    if len(body) < _SMALL:
        return bytes(8) + body
    return len(body).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=_LEVEL).compress(body, asbytes=True)


def _unpacked(body: bytes) -> bytes:
    size = int.from_bytes(body[:8], "little")
    return pa.Codec(_CODEC).decompress(memoryview(body)[8:], decompressed_size=size, asbytes=True) if size else bytes(body[8:])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    h1 = _TABLE[body]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    return _mix(h16[:-4] * _power(4) + h4[16:])  # 16 and 4 bytes


def anchors(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window start, and gram hash of every anchor, in order; documents end at ``ends``."""
    room = (np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(body))).clip(max=SPAN).astype(np.int8)  # bytes left of the document, as far as it matters
    parts = []
    for low in range(0, max(0, len(body) - SPAN + 1), _SLICE):
        high = min(low + _SLICE, len(body) - SPAN + 1)
        hashes = gram_hashes(body[low : high + SPAN - 1])
        least = (hashes & np.uint64(~((1 << 21) - 1) & (1 << 64) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: high - low], least[LEFT - 15 :][: high - low])  # of LEFT + 1 grams
        start = np.flatnonzero(room[low:high] >= SPAN)
        if not len(start):
            continue
        place = (least[start] & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(new[1:] - 1, len(start) - 1)
        parts.append((place[new] + low, start[new] + low, start[last] + low, hashes[place[new]]))
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    place, first, last, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    joint = np.concatenate([[False], (place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1)])  # cut by a slice's end
    keep = np.flatnonzero(~joint)
    return place[keep], first[keep], last[np.append(keep[1:] - 1, len(place) - 1)], hashes[keep]


# 1. Blocks.


def _blocks(most: int):
    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        ids, bodies, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(b) for b in bodies]], pa.list_(pa.int32())), pa.array([size], pa.int64()), pa.array([_packed(b"".join(bodies))], pa.binary())], ["block", "ids", "sizes", "bytes", "body"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc)
                bodies.append(body or b"")
                size += len(bodies[-1])
                if size >= most:
                    yield out()
                    ids, bodies, size, name = [], [], 0, name + 1
        if ids:
            yield out()

    return run


class Block:
    def __init__(self, ids: list, sizes: list, body: bytes):
        self.ids = np.array([NOBODY if i is None else i for i in ids], dtype=np.int64)
        self.bytes = _unpacked(body)
        self.body = np.frombuffer(self.bytes, dtype=np.uint8)
        self.ends = np.cumsum(np.array(sizes, dtype=np.int64))

    def anchors(self, ranges: int):
        """Place, least and greatest window offset, hash range and value within it, document."""
        place, first, last, hashes = anchors(self.body, self.ends)
        # Anchors have small hashes, so ranges are cut in hashes of these.
        even = _mix(hashes ^ np.uint64(0x1234567))
        owner = ((even >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        value = (even & np.uint64((1 << VALUE_BITS) - 1)).astype(np.int64)
        return place, place - last, place - first, owner, value, np.searchsorted(self.ends, place, side="right")


# 2. Candidates.


def _coded(values: np.ndarray, several: np.ndarray) -> bytes:
    """Ascending values as differences, each with its flag; four bytes each where they fit."""
    x = (np.diff(values, prepend=0) << 1) | several
    return b"\x04" + x.astype("<u4").tobytes() if not len(x) or x.max() < 1 << 32 else b"\x08" + x.astype("<i8").tobytes()


def _uncoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, dtype="<u4" if blob[0] == 4 else "<i8", offset=1).astype(np.int64)
    return np.cumsum(x >> 1), (x & 1).astype(bool)


def _hashes_sent(ranges: int):
    def run(batches):
        for batch in batches:
            for name, ids, sizes, body in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                block = Block(ids, sizes, body)
                _, _, _, owner, value, doc = block.anchors(ranges)
                doc = block.ids[doc]
                order = np.lexsort((doc, (owner << VALUE_BITS) | value))
                owner, value, doc = owner[order], value[order], doc[order]
                same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
                new = np.flatnonzero(np.concatenate([[True], ~same])[: len(value)])
                apart = np.concatenate([[False], same & (doc[1:] != doc[:-1])])[: len(value)]
                several = np.logical_or.reduceat(apart, new) if len(new) else np.zeros(0, dtype=bool)
                owner, value = owner[new], value[new]
                some, cuts = np.unique(owner, return_index=True)  # only what the block has is looked at, however many ranges there are
                cuts = [*cuts.tolist(), len(owner)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), name), pa.int64()), pa.array([_coded(value[a:b], several[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], ["owner", "block", "blob"])
                del block
                tidy()

    return run


def _hashes_kept(rows: pa.Table) -> pa.Table:
    names, blobs = rows.column("block").to_pylist(), rows.column("blob").to_pylist()
    parts = [_uncoded(b) for b in blobs]
    value, several = np.concatenate([v for v, _ in parts]), np.concatenate([s for _, s in parts])
    order = np.argsort(value, kind="stable")
    v = value[order]
    same = np.concatenate([[False], v[1:] == v[:-1]])
    shared = same | np.append(same[1:], False) | several[order]
    keep = np.zeros(len(value), dtype=bool)
    keep[order[shared]] = True
    out, at = [], 0
    for name, (own, _) in zip(names, parts, strict=True):
        mine = own[keep[at : at + len(own)]]
        at += len(own)
        if len(mine):
            out.append((rows.column("owner")[0].as_py(), name, _coded(mine, np.zeros(len(mine), dtype=np.int64))))
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["owner", "block", "blob"])


# 3. Runs.


def entries(body: np.ndarray, ends: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The bytes that are sorted, a row for each anchor; 0 beyond a document, where no window of it reaches."""
    out = np.zeros((len(place), ENTRY), dtype=np.uint8)
    end, begin = ends[doc], np.concatenate([[0], ends])[doc]
    for i in range(SPAN):
        ok = place + i < end
        out[ok, i] = body[place[ok] + i]
    for i in range(LEFT):
        ok = place - 1 - i >= begin
        out[ok, SPAN + i] = body[place[ok] - 1 - i]
    out[:, -2], out[:, -1] = least, most
    return out


def front_coded(rows: np.ndarray, docs: np.ndarray, cuts: list[int]) -> list[bytes]:
    """Sorted runs, one between each two cuts: prefix lengths, least documents and rests."""
    shared = np.zeros(len(rows), dtype=np.uint8)
    differ = rows[1:] != rows[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), ENTRY)
    shared[cuts[:-1]] = 0
    rest = rows[np.arange(ENTRY)[None, :] >= shared[:, None]]
    upto = np.concatenate([[0], np.cumsum(ENTRY - shared.astype(np.int64))])
    docs = docs.astype("<i8")
    return [(b - a).to_bytes(8, "little") + _packed(shared[a:b].tobytes() + docs[a:b].tobytes() + rest[upto[a] : upto[b]].tobytes()) for a, b in zip(cuts, cuts[1:])]


def front_decoded(blob: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    body = _unpacked(blob[8:])
    shared, docs = list(body[:n]), np.frombuffer(body, dtype="<i8", count=n, offset=n)
    out, row, at = [], b"", 9 * n
    for s in shared:
        row = row[:s] + body[at : at + ENTRY - s]
        at += ENTRY - s
        out.append(row)
    return out, shared, docs


def _runs(ranges: int):
    def run(batches):
        for batch in batches:
            for name, ids, sizes, body, owners, blobs in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                block = Block(ids, sizes, body)
                place, least, most, owner, value, doc = block.anchors(ranges)
                key = (owner << VALUE_BITS) | value
                wanted = np.sort(np.concatenate([(np.int64(o) << VALUE_BITS) | _uncoded(b)[0] for o, b in zip(owners, blobs, strict=True)]))
                mine = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                place, least, most, owner, doc = place[mine], least[mine], most[mine], owner[mine], doc[mine]
                rows, who = entries(block.body, block.ends, place, least, most, doc), block.ids[doc]
                order = np.lexsort((who, np.ascontiguousarray(rows).view(f"S{ENTRY}").ravel(), owner))
                rows, who, spot, owner = rows[order], who[order], place[order].astype("<u4"), owner[order]
                new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1) | (owner[1:] != owner[:-1])]))
                count = np.diff(np.append(new, len(rows))).astype("<u4")
                later = (who != np.repeat(who[new], count)).astype(np.uint8)
                some, cuts = np.unique(owner[new], return_index=True)
                cuts, begin = [*cuts.tolist(), len(new)], np.append(new, len(rows))
                reach = rows[new, -2:]
                own = [_packed(count[a:b].tobytes() + reach[a:b].tobytes() + spot[begin[a] : begin[b]].tobytes() + later[begin[a] : begin[b]].tobytes()) for a, b in zip(cuts, cuts[1:])]
                cols = [pa.array(some, pa.int32()), pa.array(np.full(len(some), name), pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(front_coded(rows[new], who[new], cuts), pa.binary()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["owner", "block", "n", "run", "own"])
                del block, rows, own, cols
                tidy()

    return run


# 4. Merge.


def merged(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Run and place of each entry in the order of all runs, and the prefix it shares with the entry before.

    A loser tree over the runs' next entries. ``known[k]`` is the length of the prefix
    that run ``k``'s entry shares with the last entry that went out (for the run that
    lost at a node: with the winner there), so two entries that share different lengths are in
    order of these, the longer first, and others are compared from that length on.
    """
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    at, known = [0] * size, [0] * k + [-1] * (size - k)
    head: list[bytes] = [r[0] for r in runs] + [b""] * (size - k)

    def meet(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes that shared with the winner."""
        x, y = known[a], known[b]
        if x != y or x < 0:
            return (a, b) if x >= y else (b, a)
        rest_a, rest_b = head[a][x:], head[b][x:]
        if rest_a == rest_b:
            known[b] = ENTRY
            return a, b
        gap = int.from_bytes(rest_a, "big") ^ int.from_bytes(rest_b, "big")
        shared = ENTRY - ((gap.bit_length() + 7) >> 3)
        if rest_a < rest_b:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    losers = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node >>= 1
        pairs = [meet(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        for i, (_, lost) in enumerate(pairs):
            losers[node + i] = lost
        level = [w for w, _ in pairs]
    win = level[0]
    out_run, out_at, out_shared = [], [], []
    total = sum(map(len, runs))
    for _ in range(total):
        i = at[win]
        out_run.append(win)
        out_at.append(i)
        out_shared.append(known[win])
        i += 1
        at[win] = i
        if i < len(runs[win]):
            head[win], known[win] = runs[win][i], prefixes[win][i]
        else:
            known[win] = -1
        node = (win + size) >> 1
        while node:
            lost = losers[node]
            x, y = known[win], known[lost]
            if x < y:
                losers[node], win = win, lost
            elif x == y and x >= 0:
                win, losers[node] = meet(win, lost)
            node >>= 1
    return out_run, out_at, out_shared


def earlier(rows: np.ndarray, shared: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry of a merged order, the offsets (bits) of those of its windows that a smaller document has."""
    found = np.zeros(len(rows), dtype=np.uint32)
    left = np.zeros(len(rows), dtype=np.int64)  # of the bytes before the anchor, as far as the offset reaches: equal numbers for equal bytes
    for offset in range(LEFT + 1):
        if offset:
            left = np.unique(left * 256 + rows[:, SPAN + offset - 1], return_inverse=True)[1]
        ok = np.flatnonzero((rows[:, -2] <= offset) & (offset <= rows[:, -1]))
        if not len(ok):
            continue
        right = np.cumsum(shared < SPAN - offset)[ok]  # equal right parts are neighbours
        key = left[ok] * (len(rows) + 1) + right
        order = np.argsort(key, kind="stable")
        key, who = key[order], docs[ok][order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(who, new), np.diff(np.append(new, len(key))))
        found[ok[order[who > least]]] |= np.uint32(1 << offset)
    return found


def _merge(rows: pa.Table) -> pa.Table:
    names = rows.column("block").to_pylist()
    runs, prefixes, docs = zip(*map(front_decoded, rows.column("run").to_pylist()), strict=True)
    run, at, shared = merged(list(runs), list(prefixes))
    body = np.frombuffer(b"".join([runs[r][i] for r, i in zip(run, at, strict=True)]), dtype=np.uint8).reshape(-1, ENTRY)
    starts = np.cumsum([0, *map(len, runs)])
    flat = starts[np.array(run)] + np.array(at)
    found = np.zeros(starts[-1], dtype=np.uint32)
    found[flat] = earlier(body, np.array(shared), np.concatenate(docs)[flat])
    masks = [_packed(found[starts[i] : starts[i + 1]].astype("<u4").tobytes()) for i in range(len(names))]
    return pa.table([rows.column("owner"), rows.column("block"), pa.array(masks, pa.binary())], names=["owner", "block", "masks"])


# 5. Marks.


def covered(size: int, masks: list[bytes], owns: list[bytes]) -> np.ndarray:
    """True for each byte of a block that a window of an earlier document covers."""
    begin = np.zeros(size + 1, dtype=bool)
    for m, o in zip(masks, owns, strict=True):
        mask, own = np.frombuffer(_unpacked(m), dtype="<u4"), _unpacked(o)
        n = len(mask)
        count = np.frombuffer(own, dtype="<u4", count=n)
        reach = np.frombuffer(own, dtype=np.uint8, count=2 * n, offset=4 * n).reshape(n, 2).astype(np.int64)
        total = int(count.sum())
        spot = np.frombuffer(own, dtype="<u4", count=total, offset=6 * n).astype(np.int64)
        later = np.frombuffer(own, dtype=np.uint8, count=total, offset=6 * n + 4 * total).astype(bool)
        all_of = ((np.int64(2) << reach[:, 1]) - (np.int64(1) << reach[:, 0])).astype(np.uint32)
        bits = np.where(later, np.repeat(all_of, count), np.repeat(mask, count))
        for offset in range(LEFT + 1):
            begin[spot[(bits >> np.uint32(offset)) & np.uint32(1) == 1] - offset] = True
    at = np.flatnonzero(begin)
    depth = np.zeros(size + 1, dtype=np.int32)
    depth[at] += 1
    depth[at + SPAN] -= 1
    return np.cumsum(depth)[:size] > 0


def _marked(batches):
    for batch in batches:
        for ids, sizes, body, masks, owns in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            whole = _unpacked(body)
            gone = covered(len(whole), masks or [], owns or [])
            array = np.frombuffer(whole, dtype=np.uint8)
            rows, low = [], 0
            for size in sizes:
                mine = gone[low : low + size]
                n = int(mine.sum())
                spans = int((mine[1:] & ~mine[:-1]).sum() + mine[0]) if n else 0
                kept = array[low : low + size][~mine].tobytes() if n else whole[low : low + size]
                rows.append((size, n, spans, hashlib.sha256(kept).hexdigest()))
                low += size
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, block_bytes: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a ``SPAN``-byte string that covers it also starts in a document
    with a smaller id; strings are judged on the input. Null text is empty; texts
    under ``SPAN`` bytes lose nothing. Rows that repeat an id don't take from each
    other. A null id is above all others. An empty table gives no row; other
    columns are not read. Windows are told apart by their bytes.
    """
    spark = docs.sparkSession
    settle(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = written(docs.mapInArrow(_blocks(block_bytes), "block long, ids array<long>, sizes array<int>, bytes long, body binary"), "blocks")
    ranges = max(8, math.ceil((blocks.agg(F.sum("bytes")).first()[0] or 0) / range_bytes))
    sent = blocks.select("block", "ids", "sizes", "body").mapInArrow(_hashes_sent(ranges), "owner int, block long, blob binary")
    kept = written(sent.groupBy("owner").applyInArrow(_hashes_kept, "owner int, block long, blob binary"), "kept")
    free_shuffles(spark)
    wanted = kept.groupBy("block").agg(F.collect_list("owner").alias("owners"), F.collect_list("blob").alias("blobs"))
    told = blocks.join(wanted, "block").select("block", "ids", "sizes", "body", "owners", "blobs")
    runs = written(told.mapInArrow(_runs(ranges), "owner int, block long, n long, run binary, own binary"), "runs")
    free_shuffles(spark)
    masks = written(runs.select("owner", "block", "run").groupBy("owner").applyInArrow(_merge, "owner int, block long, masks binary"), "masks")
    free_shuffles(spark)
    mine = runs.select("owner", "block", "own").join(masks, ["owner", "block"]).groupBy("block").agg(F.collect_list(F.struct("masks", "own")).alias("all"))
    marked = blocks.join(mine, "block", "left").select("ids", "sizes", "body", F.col("all.masks").alias("masks"), F.col("all.own").alias("own"))
    return marked.mapInArrow(_marked, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All windows of 50 bytes, in hexadecimal; texts are cut into parts first, so that no long one is copied for each of its windows.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
e as (select doc_id, base, substr(x, 2 * base + 1, 2 * 549) as y from (select doc_id, x, unnest(range(0, n, 500)) as base from d)),
w as (select doc_id, base + t as s, substr(y, 2 * t + 1, 100) as g from (select doc_id, base, y, unnest(range(0, length(y) // 2 - 49)) as t from e)),
m as (select g, min(doc_id) as least from w group by g having min(doc_id) < max(doc_id)),
b as (select doc_id, s, lag(s) over (partition by doc_id order by s) as prior from w join m using (g) where least < doc_id),
i as (select doc_id, s, sum(case when s - prior <= 50 then 0 else 1 end) over (partition by doc_id order by s) as k from b),
r as (select doc_id, min(s) as a, max(s) + 50 as e from i group by doc_id, k),
p as (select *, lag(e, 1, 0) over (partition by doc_id order by a) as kept_from from r),
c as (select d.doc_id, string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) || substr(any_value(x), 2 * max(e) + 1) as kept, count(*) as spans, sum(e - a) as gone from p join d using (doc_id) group by d.doc_id)
select doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from d left join c using (doc_id)
"""
