"""Near-duplicate documents by ProbMinHash, banding and verification.

1. *Signatures.* A text's shingles are its runs of ``SHINGLE`` words, hashed. Each has a
   weight, one and the binary logarithm of its number in the text, and is the start of a
   Poisson process of that rate. Arrivals fall into ``BANDS * ROWS`` registers, which keep
   the earliest shingle; a shingle stops when its next arrival is later than every
   register's. Two texts agree in a register with the probability Jaccard of their
   weighted shingles (of texts that repeat none, the Jaccard similarity of the sets).
2. *Nodes.* Texts with the same weighted shingles are one node, whatever their number.
3. *Banding.* Nodes that agree in all registers of a band share a bucket. Each is
   compared with the bucket's first node: as many pairs as rows.
4. *Verification.* Pairs are compared by the probability Jaccard of their 64-bit shingles
   and weights; those at ``THRESHOLD`` or above link, and links make components.
5. *The rest.* Nodes of one bucket that are still in different components are compared
   where they lie, first by an exact bound, then by their shingles, each pair in the first
   bucket it shares; only links leave a task. A bucket over ``BLOCK`` nodes goes in blocks:
   those outside its largest component among themselves and with that component, whose
   nodes are not compared with each other. So no pair that shares a bucket can lose its
   link; a pair at the threshold shares none with probability 1.5e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import components, free_shuffles, fresh_names, settle, written
from hashloom.llm.tokenizing import Memo, text_slices, tidy

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: Parts that the weights of a set are summed by, for a bound of what two sets have in common.
PARTS = 256
BLOCK = 1024
#: Rows of mixed buckets for each group of the last comparison.
ROWS_A_TASK = 2000
WORDS = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of texts, with their counts."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.memo = size, Memo(WORDS)

    def sets(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted hashes and counts. A text of fewer words is one shingle, one without words too."""
        words = [(t or "").lower().split() for t in texts]
        for w in self.memo.missing(set().union(*words)):
            self.memo.now[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        get, out = self.memo.now.__getitem__, []
        for own in words:
            n = len(own)
            h = np.fromiter(map(get, own), dtype=np.uint64, count=n)
            k = min(n, self.size) or 1
            joint = np.zeros(max(1, n - k + 1), dtype=np.uint64)
            for i in range(k if n else 0):
                joint = joint * _MULTIPLIER + mix(h[i : i + len(joint)])
            out.append(np.unique(mix(joint + np.uint64(n if n < self.size else self.size)), return_counts=True))
        return out


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Repeats count by their logarithm, so a line that fills a page doesn't outweigh the rest of it."""
    return 1 + np.log2(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS, weighted: bool = True) -> np.ndarray:
    """ProbMinHash signatures, a row for each set: the shingle that arrived first in each register."""
    sizes = np.array([len(s) for s, _ in sets])
    seed = np.concatenate([s for s, _ in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    rate = weights_of(np.concatenate([c for _, c in sets])) if weighted else np.ones(len(seed))
    first = np.full(len(sets) * registers, np.inf)
    who = np.zeros(len(first), dtype=np.uint64)
    clock, turn = np.zeros(len(seed)), 0
    while len(seed):
        turn += 1
        draw = mix(seed + np.uint64(turn * int(_MULTIPLIER) % (1 << 64)))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = doc * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(clock < first[register])
        np.minimum.at(first, register[better], clock[better])
        won = better[clock[better] == first[register[better]]]
        who[register[won]] = seed[won]
        latest = first.reshape(len(sets), registers).max(axis=1)
        going = clock < latest[doc]
        seed, doc, rate, clock = seed[going], doc[going], rate[going], clock[going]
    return who.reshape(len(sets), registers)


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _MULTIPLIER + parts[:, :, r])
    return key.view(np.int64)


def coded(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A weighted set: ascending hashes, their counts if any is above 1, and a byte that tells."""
    if len(counts) and counts.max() > 1:
        return hashes.astype("<u8").tobytes() + counts.astype("<u4").tobytes() + b"\1"
    return hashes.astype("<u8").tobytes() + b"\0"


def uncoded(blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes and weights; no weights where all are 1."""
    if blob[-1]:
        n = len(blob) // 12
        return np.frombuffer(blob, dtype="<u8", count=n), weights_of(np.frombuffer(blob, dtype="<u4", count=n, offset=8 * n))
    return np.frombuffer(blob, dtype="<u8", count=len(blob) // 8), None


def node_of(blob: bytes) -> int:
    """A 64-bit name for a weighted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(blob)).view(np.int64))


def _signed(batches):
    shingler = Shingler()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for low, high in text_slices(texts, 2_000_000):
            sets = shingler.sets(texts[low:high])
            signature = signatures(sets)
            yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), batch.column(2).slice(low, high - low), pa.array([node_of(coded(*s)) for s in sets], pa.int64()), pa.array(list(bands_of(signature)), pa.list_(pa.int64()))], ["doc_id", "body", "node", "bands"])
    del shingler
    tidy()


def _sets_of(batches):
    shingler = Shingler()
    for batch in batches:
        nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for low, high in text_slices(texts):
            sets = [coded(*s) for s in shingler.sets(texts[low:high])]
            ok = [(n, s) for n, s in zip(nodes[low:high], sets, strict=True) if node_of(s) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in ok], pa.int64()), pa.array([s for _, s in ok], pa.binary())], ["node", "set"])


def likeness(a: bytes, b: bytes) -> float:
    """Probability Jaccard of two weighted sets; 0 where they are too unlike in size to reach the threshold."""
    (x, v), (y, w) = uncoded(a), uncoded(b)
    if v is None and w is None:
        if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
            return 0.0
        both = np.sort(np.concatenate([x, y]))
        common = int((both[1:] == both[:-1]).sum())
        return common / (len(both) - common)
    v, w = np.ones(len(x)) if v is None else v, np.ones(len(y)) if w is None else w
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    ratio = w[j] / v[i]  # the sum over k of max(v_k / v_i, w_k / w_i): those of a greater ratio count by w, others by v
    order = np.argsort(ratio, kind="stable")
    i, j, ratio = i[order], j[order], ratio[order]
    last = np.searchsorted(ratio, ratio, side="right")
    own, other = np.append(0, np.cumsum(v[i])), np.append(0, np.cumsum(w[j]))
    alone_x, alone_y = v.sum() - own[-1], w.sum() - other[-1]
    return float((1 / ((own[last] + alone_x) / v[i] + (other[-1] - other[last] + alone_y) / w[j])).sum())


def parted(sets: list[bytes]) -> np.ndarray:
    """How much of each set's weight lies in each part."""
    pairs = [uncoded(s) for s in sets]
    sizes = [len(h) for h, _ in pairs]
    part = (np.concatenate([h for h, _ in pairs]) % np.uint64(PARTS)).astype(np.int64) if pairs else np.zeros(0, dtype=np.int64)
    weight = np.concatenate([np.ones(len(h)) if w is None else w for h, w in pairs]) if pairs else np.zeros(0)
    held = np.bincount(np.repeat(np.arange(len(sets)), sizes) * PARTS + part, weights=weight, minlength=len(sets) * PARTS).reshape(len(sets), PARTS)
    return held / held.sum(axis=1, keepdims=True)


def may_link(shares: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Those of ``j`` that can be similar enough to ``i``.

    A term of the probability Jaccard is at most the lesser of the two shares that a shingle has
    of its set's weight, and the sum of these at most that of the lesser shares of the parts.
    """
    return j[np.minimum(shares[j], shares[i]).sum(axis=1) >= THRESHOLD - 1e-9]


def _verified(batches):
    for batch in batches:
        ok = [likeness(x, y) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_verified, "a long, b long")


def _linked(rows: pa.Table) -> pa.Table:
    """Links between components among the nodes of a bucket; several buckets may come in one table.

    A pair is looked at in the first bucket that its nodes share, if their components
    have not met in this table yet: by bounds that no similar pair breaks, then by sets.
    """
    rows = rows.combine_chunks().sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending")])
    marks = np.stack([rows.column(c).to_numpy() for c in ("key", "low", "high")])
    node, own = (rows.column(c).to_numpy() for c in ("node", "own"))
    group = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
    label = np.arange(len(group))  # of each group, the least group it has met
    sets = rows.column("set").to_pylist()
    bands = np.array(rows.column("bands").to_pylist(), dtype=np.int64).reshape(len(node), -1)
    cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), len(node)]
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        shares = parted(sets[a:b])
        left, right = own[a:b] == marks[1, a], own[a:b] == marks[2, a]
        for i in np.flatnonzero(left):
            mine = label[group[a + i]]
            j = np.flatnonzero(right & (label[group[a:b]] != mine) & ((node[a:b] > node[a + i]) | (marks[1, a] != marks[2, a])))
            j = may_link(shares, i, j) if len(j) else j
            if not len(j):
                continue
            same = bands[a + j] == bands[a + i]
            j = j[bands[a + i][same.argmax(axis=1)] == marks[0, a]]
            for x in j.tolist():
                other = label[group[a + x]]
                if other != mine and likeness(sets[a + i], sets[a + x]) >= THRESHOLD:
                    found.append((int(node[a + i]), int(node[a + x])))
                    label[label == max(other, mine)] = mine = min(other, mine)
    return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def unsettled(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows ``key, low, high, own, node, component, whole`` of the comparisons that buckets ``placed(key, node, component)`` still need.

    A bucket of one component needs none, nor does one of two nodes, which were compared. In a bucket of at most ``block``
    nodes all meet. Of a larger one, each node outside the largest component goes once to every block of the others; a node
    of the largest only to every block of these, as nodes of one component aren't compared: with ``m`` strays
    among ``n`` nodes there are about ``2 m n / block`` rows, and ``n`` where the strays fit in a block.
    """
    groups = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    large = groups.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1 and n > 2")
    stray = F.when(F.col("n") <= block, 1).otherwise(F.ceil((F.col("n") - F.col("top.m")) / block))
    large = written(large.select("key", F.col("top.component").alias("top"), (F.col("n") <= block).alias("whole"), stray.cast("int").alias("strays"), F.when(F.col("n") <= block, 0).otherwise(F.ceil(F.col("top.m") / block)).cast("int").alias("tops")), "mixed")
    rows = placed.join(large, "key")
    at_top = ~F.col("whole") & (F.col("component") == F.col("top"))
    own = F.when(at_top, F.col("strays") + F.pmod(F.xxhash64("node"), F.greatest("tops", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("strays"))).cast("int")
    upto = F.when(at_top, F.col("strays")).otherwise(F.col("strays") + F.col("tops"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
    return rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component", "whole")


def body_of() -> Column:
    """A hash of the text as it stands; with the id, the name of a row."""
    return F.xxhash64(F.col("text").cast("string"))


def least_row() -> Column:
    """The row of the smallest id, a null id above all others; of rows that repeat it, the one of the smallest hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body"))


def placed_rows(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, body, component``; rows of one component are one class."""
    settle(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), body_of().alias("body"))
    signed = written(docs.mapInArrow(_signed, "doc_id long, body long, node long, bands array<long>"), "signed")
    nodes = signed.groupBy("node").agg(least_row().alias("at"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.body").alias("body"), "bands"), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    buckets = written(rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = written(rows.join(buckets, "key"), "shared")  # the rows of nodes that share a bucket
    free_shuffles(docs.sparkSession)

    wanted = shared.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("at"), F.col("body").alias("its")), "node")
    sets = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("body") == F.col("its"))).select("node", "text")
    sets = written(sets.mapInArrow(_sets_of, "node long, set binary").dropDuplicates(["node"]), "sets")
    free_shuffles(docs.sparkSession)

    stars = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = written(verify(stars, sets), "stars")
    first = written(components(links), "first")

    placed = written(shared.select("key", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    rest = unsettled(placed)
    tasks = max(64, rest.count() // ROWS_A_TASK)
    task = F.when(F.col("whole"), F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "low", "high"))
    rest = rest.withColumn("task", task).join(nodes.select("node", "bands"), "node").join(sets, "node")
    more = written(rest.groupBy("task").applyInArrow(_linked, "a long, b long"), "more")
    final = components(links.unionAll(more)) if not more.isEmpty() else first
    placed = signed.select("doc_id", "body", "node").join(final, "node", "left")
    return placed.select("doc_id", "body", F.coalesce("component", "node").alias("component"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, kept``.

    ``class_id`` is the smallest ``doc_id`` of the texts that links reach; the row
    with that id is kept. Null and empty texts are one node, so are texts of the
    same words. A text of fewer than five words is similar only to itself. Rows that
    repeat are in one class and marked alike. A null id is above all others. An
    empty table gives no row; other columns are not read.
    """
    placed = placed_rows(docs)
    least = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "component").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each class: the one of the smallest id; of rows that repeat that id, one of one text.

    Ids may be null or repeat: classes are told apart by their texts.
    """
    name, at, body = fresh_names(docs, 3)
    kept = placed_rows(docs).groupBy("component").agg(least_row().alias("at")).select(F.col("at.doc_id").alias(name), F.col("at.body").alias(at))
    mine = docs.withColumn(body, body_of())
    mine = mine.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(body) == F.col(at)), "left_semi")
    return mine.dropDuplicates(["doc_id", body]).drop(body)


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
