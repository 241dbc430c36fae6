"""Near-duplicate vectors by sorted passes of concatenated random projections.

Equal vectors are one, with their number. Each pass gives a vector a key of
random hashes one after another: a hash is the direction, of ``FAN`` random ones
and their opposites, on which its projection is longest. Vectors are ordered by
their keys, and those that share the first ``digits`` hashes are neighbours: a
run of them is compared all with all by exact cosines, in one window if it is
short, otherwise in square blocks over many tasks, so no window's edge loses a
pair. A pair at the threshold agrees in one hash with a probability that depends
on its angle alone, whatever other vectors there are. ``passes_for`` makes so
many passes that it meets in one but for probability ``MISS``; dense directions
cost time and no links.

The number of digits is that of least cost, by the pairs that share runs in a
sample: evenly spread vectors take more the more rows there are. Passes go
``TOGETHER`` at a time, so that no more copies of the table are on their way at
once; what they leave are links.

A block emits for each vector one link to the root of its verified neighbours,
not all pairs, so a large group of near copies costs rows in proportion to its
size. Components of the union of the passes are then compared within themselves,
in square blocks, which counts the links of every vector exactly. Blocks of a
large component are spread over tasks.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import components, free_shuffles, settle, written

THRESHOLD = 0.95
#: Directions of a hash, bits of its value, and the most hashes of a key.
FAN, DIGIT_BITS, DIGITS = 64, 7, 6
BLOCK = 1024
#: Rows of a block in the passes at most, and numbers in it.
LINK_BLOCK, LINK_NUMBERS = 8192, 1 << 19
#: Probability that a pair at the threshold meets in no pass.
MISS = 1e-6
#: Passes of one job.
TOGETHER = 4
ROWS_A_TASK = 25_000
#: Rows and passes of the sample that the digits are chosen by.
SAMPLE, TRIED = 50_000, 2
#: Seconds of a row in a pass, of a pair, and of a multiplication in a pair's product.
A_ROW, A_PAIR, A_PRODUCT = 1e-5, 3e-9, 1e-10


@functools.lru_cache(maxsize=8)
def agreement(threshold: float, draws: int = 400_000) -> float:
    """Probability that a hash agrees for vectors of cosine ``threshold``, less three deviations of its estimate.

    Projections of a pair are pairs of normal numbers of that correlation, in any number of dimensions.
    """
    random, met = np.random.default_rng(17), 0
    for _ in range(draws // 20_000):
        x = random.standard_normal((20_000, FAN))
        y = threshold * x + math.sqrt(1 - threshold**2) * random.standard_normal((20_000, FAN))
        i, j = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
        row = np.arange(len(x))
        met += int(((i == j) & (x[row, i] * y[row, j] > 0)).sum())
    p = met / draws
    return p - 3 * math.sqrt(p * (1 - p) / draws)


def passes_for(digits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has shared no run of ``digits`` hashes with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(agreement(threshold) ** digits)))


def cheapest(n: int, share: int, turns: np.ndarray, sizes: np.ndarray, keys: np.ndarray, threshold: float) -> int:
    """Digits of least cost for ``n`` vectors, of which each ``share``-th has its keys of all ``DIGITS`` hashes in ``TRIED`` passes here."""
    order = np.lexsort((keys, sizes, turns))
    turns, sizes, keys = turns[order], sizes[order], keys[order]
    other = np.r_[True, (np.diff(turns) != 0) | (np.diff(sizes) != 0)][: len(keys)]
    best, least = 1, math.inf
    for digits in range(1, DIGITS + 1):
        part = keys >> (DIGIT_BITS * (DIGITS - digits))
        at = np.flatnonzero(other | np.r_[True, np.diff(part) != 0][: len(keys)])
        count = np.diff(np.r_[at, len(keys)])
        pairs = count * (count - 1.0) / 2 * share**2 / TRIED
        cost = passes_for(digits, threshold) * (n * A_ROW + float((pairs * (A_PAIR + A_PRODUCT * sizes[at])).sum()))
        if cost < least:
            best, least = digits, cost
    return best


def usable(vectors: DataFrame, column: str = "embedding"):
    """True where the vector is not null, not empty, not all 0 and has only finite components."""
    v = F.col(column)
    inf = F.lit(float("inf"))
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision. All rows of one batch part have the same size."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(turn: int, size: int) -> np.ndarray:
    return np.random.default_rng([911, turn, size]).standard_normal((size, DIGITS * FAN))


def keys_of(x: np.ndarray, turn: int, digits: int) -> np.ndarray:
    """Keys of so many hashes, the first one highest."""
    key = np.zeros(len(x), dtype=np.int64)
    along = directions(turn, x.shape[1])
    for d in range(digits):
        y = x @ along[:, d * FAN : (d + 1) * FAN]
        longest = np.abs(y).argmax(axis=1)
        key = (key << DIGIT_BITS) | (2 * longest + (y[np.arange(len(x)), longest] > 0))
    return key


def _keyed(turns: list[int], digits: int, vectors: bool = True):
    def run(batches):
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                x = units(part.column(1))
                for turn in turns:
                    marks = [pa.array(np.full(len(part), turn), pa.int32()), pa.array(np.full(len(part), size), pa.int32()), pa.array(keys_of(x, turn, digits), pa.int64())]
                    yield pa.RecordBatch.from_arrays(marks + part.columns if vectors else marks, ["turn", "size", "key", "vec_id", "v"][: 5 if vectors else 3])

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``i, j`` where ``x[i]`` and ``y[j]`` have the cosine ``threshold`` in double precision; single precision rules out most."""
    slack = (x.shape[1] + 4) * 1.2e-7  # above the rounding error of a product of unit vectors
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= threshold - slack)
    if len(i) > len(x) * 64:
        return np.nonzero(x @ y.T >= threshold)
    ok = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[ok], j[ok]


def _linked(threshold: float, step: int = 512):
    """Links of the vectors of each block to a root of their neighbours; one table has many small buckets or one pair of blocks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([(c, "ascending") for c in ("turn", "size", "key", "low", "high")])
        marks = np.stack([rows.column(c).to_numpy() for c in ("turn", "size", "key", "low", "high")])
        ids, own = rows.column("vec_id").to_numpy(), rows.column("own").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), len(ids)]
        vectors, found = rows.column("v"), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            x = units(pa.concat_arrays(vectors.slice(a, b - a).chunks))
            first, second = np.flatnonzero(own[a:b] == marks[3, a]), np.flatnonzero(own[a:b] == marks[4, a])
            links = []
            for low in range(0, len(first), step):
                mine = first[low : low + step]
                others = second[low:] if marks[3, a] == marks[4, a] else second  # within a block each pair once
                i, j = near(x[mine], x[others], threshold)
                if len(i):
                    top = roots(b - a, mine[i], others[j])
                    links.append(np.stack([np.flatnonzero(top != np.arange(b - a)), top[top != np.arange(b - a)]]))
            if links:
                top = roots(b - a, *np.concatenate(links, axis=1))
                node, root = ids[a:b], ids[a:b][top]
                found.append(np.stack([node, root])[:, node != root])
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        return pa.table([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])

    return run


def links(sound: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links ``a, b`` that connect the ``n`` vectors of ``sound(vec_id, embedding)`` as all pairs at the threshold do."""
    kind, marks = sound.schema["embedding"].dataType.simpleString(), "turn int, size int, key long"
    share = math.ceil(n / SAMPLE) or 1
    tried = sound.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(share)) == 0).mapInArrow(_keyed(list(range(TRIED)), DIGITS, False), marks).toPandas()
    digits = cheapest(n, share, *(tried[c].to_numpy(dtype=np.int64) for c in ("turn", "size", "key")), threshold)
    passes = passes_for(digits, threshold)
    # Blocks of an eighth of the rows, as far as they fit into a task.
    most = F.greatest(F.lit(BLOCK), F.least(F.lit(max(1, min(LINK_BLOCK, math.ceil(n / 8)))), F.lit(LINK_NUMBERS) / F.col("size")))
    found = None
    for first in range(0, passes, TOGETHER):
        turns = list(range(first, min(first + TOGETHER, passes)))
        large = sound.mapInArrow(_keyed(turns, digits, False), marks).groupBy("turn", "size", "key").agg(F.count("*").alias("n"))
        large = written(large.select("turn", "size", "key", F.ceil(F.col("n") / most).cast("int").alias("blocks")).where("blocks > 1"), "runs")  # at most an eighth of the rows of a pass, or as many as blocks
        rows = sound.mapInArrow(_keyed(turns, digits), f"{marks}, vec_id long, v {kind}").join(large, ["turn", "size", "key"], "left")
        rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        tasks = max(16, n * len(turns) // ROWS_A_TASK)
        rows = rows.select("turn", "size", "key", low.alias("low"), high.alias("high"), "own", "vec_id", "v", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("turn", "size", "key"), F.lit(tasks))).otherwise(F.xxhash64("turn", "size", "key", low, high)).alias("task"))
        more = written(rows.groupBy("task").applyInArrow(_linked(threshold), "a long, b long"), "found")
        free_shuffles(sound.sparkSession)
        found = more if found is None else found.unionAll(more)
    return found.distinct()


def _counted(threshold: float):
    """Links of each vector within its component's blocks; one table has many small components or one pair of blocks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("component", "ascending"), ("size", "ascending"), ("low", "ascending"), ("high", "ascending")])
        marks = np.stack([rows.column(c).to_numpy() for c in ("component", "size", "low", "high")])
        ids, own = rows.column("vec_id").to_numpy(), rows.column("own").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), len(ids)]
        counts, copies = np.zeros(len(ids), dtype=np.int64), rows.column("copies").to_numpy()
        vectors = rows.column("v")
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = units(pa.concat_arrays(vectors.slice(a, b - a).chunks))
            if marks[2, a] == marks[3, a]:
                linked = x @ x.T >= threshold
                linked &= ids[a:b, None] != ids[None, a:b]
                counts[a:b] = linked @ copies[a:b]
            else:
                first, second = np.flatnonzero(own[a:b] == marks[2, a]), np.flatnonzero(own[a:b] == marks[3, a])
                linked = x[first] @ x[second].T >= threshold
                counts[a + first], counts[a + second] = linked @ copies[a + second], copies[a + first] @ linked
        return pa.table([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["vec_id", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, all 0, or hold null or non-finite components
    link with nothing, and so do vectors of different sizes with each other. Rows
    that repeat an id and its vector are one vector and given each; rows with one id
    and different vectors share links and component. A row with a null id links with
    nothing: its component is null and it is kept. An empty table gives no row.
    """
    settle(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    named = written(rows.where(usable(rows) & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "embedding"]), "vectors")
    sound = written(named.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "embedding", "copies"), "distinct")
    n = sound.count()
    several = sound.where("copies > 1").select("embedding", F.col("vec_id").alias("first"), "copies")
    same = written(named.join(several, "embedding").select("vec_id", "first", "copies"), "same")
    alike = same.groupBy("vec_id").agg(F.sum(F.col("copies") - 1).alias("n"))  # links of equal vectors
    met = links(sound.select("vec_id", "embedding"), n, threshold).unionAll(same.where("vec_id <> first").select("vec_id", "first"))
    found = components(met)
    found = written(found, "components")

    sizes = found.groupBy("component").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    member = found.join(sizes, "component").join(sound.withColumnRenamed("vec_id", "node"), "node").withColumn("blocks", blocks)
    member = member.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    member = member.select("component", F.size("embedding").alias("size"), low.alias("low"), high.alias("high"), "own", F.col("node").alias("vec_id"), F.col("embedding").alias("v"), "copies", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(max(64, n // ROWS_A_TASK)))).otherwise(F.xxhash64("component", low, high)).alias("task"))
    counts = member.groupBy("task").applyInArrow(_counted(threshold), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    # A vector's count is that of the first id of its equals, and those.
    whose = named.select("vec_id").distinct().join(same.select("vec_id", "first"), "vec_id", "left").select("vec_id", F.coalesce("first", "vec_id").alias("first"))
    own = whose.join(counts.withColumnRenamed("vec_id", "first"), "first").groupBy("vec_id").agg(F.sum("n").alias("n")).unionAll(alike).groupBy("vec_id").agg(F.sum("n").alias("n"))
    marks = found.select(F.col("node").alias("vec_id"), F.col("component")).join(own, "vec_id", "left")
    out = rows.select("vec_id").join(marks, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs.
ORACLE = """
with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings
    where len(embedding) > 0 and list_count(embedding) = len(embedding) and isfinite(list_sum(cast(embedding as double[]))) and (list_min(embedding) <> 0 or list_max(embedding) <> 0)),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
r as (select a as node, a as reach from l union select r.node, l.b from r join l on r.reach = l.a),
c as (select node, min(reach) as least from r group by node), n as (select a, count(*) as links from l group by a)
select vec_id, coalesce(links, 0) as n_links, coalesce(least, vec_id) as component_id, coalesce(least, vec_id) = vec_id as kept from embeddings left join c on node = vec_id left join n on a = vec_id
"""
