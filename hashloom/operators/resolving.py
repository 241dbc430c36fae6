"""Following digests: chains of lookups, directory trees and their roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hashloom.functions import digests
from hashloom.sources.shared import kept


def resolve(rows: DataFrame, target: DataFrame, on: list[str] | str, required: str | None = None) -> DataFrame:
    """Each row with its target's columns. With ``required``, a column of the target, a row without one fails the query."""
    if required is None:
        return rows.join(target, on)
    found = rows.join(target, on, "left")
    kind = target.schema[required].dataType
    return found.withColumn(required, F.coalesce(F.col(required), F.raise_error(F.lit("blob not found")).cast(kind)))


def expand(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root, node, depth`` of everything that edges ``(parent, child)`` reach from ``roots(root)``.

    It goes on until a level is empty, or for ``max_depth`` steps; a cycle needs the latter. A subtree
    that isn't there is left out, a node reached in several ways is given once for each depth.
    One equi-join a level, the edges on their own key in each; levels are kept in the shared folder.
    """
    edges = kept(edges.select(F.col("parent").alias("node"), "child"), "edges")
    out = level = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = Observation()
        level = level.join(edges, "node").select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        level = kept(level.observe(seen, F.count("*").alias("n")), "level")
        if not seen.get["n"]:
            break
        out = out.unionAll(level)
    return out


def merkle(nodes: DataFrame) -> DataFrame:
    """``node, depth, digest`` of a tree ``nodes(node, parent, name, depth, content)`` of any depth.

    A node's digest is that of a text with its content and, in the byte order of their names,
    the names and digests of its children. Levels are folded from the deepest up.
    """
    nodes = kept(nodes.select("node", "parent", "name", "depth", "content"), "nodes")
    most = nodes.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(-1 if most is None else most, -1, -1):
        own, lines = nodes.where(F.col("depth") == depth), F.lit("")
        if levels:
            kids = F.array_sort(F.collect_list(F.struct("name", "digest")))
            children = levels[-1].groupBy(F.col("parent").alias("node")).agg(F.array_join(F.transform(kids, lambda k: F.concat(k["name"], F.lit("="), k["digest"])), "\n").alias("lines"))
            own, lines = own.join(children, "node", "left"), F.coalesce("lines", F.lit(""))
        levels.append(kept(own.select("node", "parent", "name", "depth", digests.hash_of(F.concat(F.coalesce("content", F.lit("")), F.lit("\n"), lines)).alias("digest")), "level"))
    out = nodes.select("node", "depth", F.lit("").alias("digest")).limit(0)
    for level in levels:
        out = out.unionAll(level.select("node", "depth", "digest"))
    return out


def canonical(*parts: Column) -> Column:
    """One text of several parts, each led by its length in bytes, so that no two lists of parts give one text.

    The engine's own canonical form: digests of it are not those of protobuf messages.
    """
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t, F.lit(";")) for t in texts])
