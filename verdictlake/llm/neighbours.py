"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors are one node. A first graph comes from blocks of nodes on the same sides of random hyperplanes (a block of
more than ``block`` nodes is dealt by hash), all pairs of a block compared in one matrix product. Then, round by round,
every node brings its neighbours and the nodes that name it together (a join with the nodes' unit vectors, four
bytes a component, multiplied in double precision: bytes would tie among near copies): pairs among them that are nearer than a node's worst neighbour are proposed, and each node keeps its
``degree`` best. Pairs that have met before are not compared again; the rounds end when few neighbours change.

A query starts at its own node, or, if it has none, at the nearest of ``entries`` nodes drawn by hash; round by round the
``width`` best nodes not yet opened are replaced by their neighbours (a join), and the ``beam`` best are kept, until none
of the beam is unopened or ``rounds`` are over. The beam's originals are compared in double precision at the end.

The index holds every row. Recall at 5 against brute force is measured in the tests and stated in the README.

Defined results: vectors null, empty, zero, holding null or non-finite components, or of another length than most of
the table take no part; equal vectors answer by their smallest ids; ties go to the smaller id; fewer candidates give
fewer rows; repeated rows of one id count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged
from .grouped import binary_matrix, runs_of

EDGES = "u bigint, v bigint, s double, fresh boolean"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, copies: int) -> tuple[DataFrame, DataFrame]:
    """Staged: node, q (unit vector, four bytes a component), vector; and node, vec_id of each node's smallest ids."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("vector") == (common[0]["d"] if common else 0))
    rows = rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), b.column(1)], ["node", "q", "vector"])

    nodes = rows.groupBy("vector").agg(F.min("vec_id").alias("node")).select("node", "vector")
    nodes = staged(nodes.mapInArrow(unit, "node bigint, q binary, vector array<double>"), "nn-nodes")
    named = rows.join(nodes.select("node", "vector"), "vector").select("node", "vec_id")
    least = named.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= copies)
    return nodes, staged(least.select("node", "vec_id"), "nn-copies")


def unit_rows(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(edges: DataFrame, degree: int) -> DataFrame:
    """Of every node the nearest, each neighbour once (an old edge stays old)."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v")))
    return ranked.where(F.col("n") <= degree).select("u", "v", "s", "fresh")


def first_graph(nodes: DataFrame, n: int, degree: int, trees: int, block: int, seed: int) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1.0, 1.5 * n / block)))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit_rows(binary_matrix(b.column(1), np.float32))
                for t in range(trees):
                    planes = np.random.default_rng(seed + t).normal(size=(x.shape[1], bits))
                    code = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)) * trees + t
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code.astype(np.int64))], ["node", "q", "code"])

    codes = staged(nodes.select("node", "q").mapInArrow(coded, "node bigint, q binary, code bigint"), "nn-codes")
    sizes = codes.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    blocks = codes.join(sizes, "code").withColumn("work", F.xxhash64("code", F.pmod(F.xxhash64("node"), "parts")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in runs_of(batches, "work"):
            ids = table["node"].to_numpy()
            x = unit_rows(binary_matrix(table["q"], np.float32))
            for a, b in zip(borders, [*borders[1:], table.num_rows], strict=True):
                k = min(degree, b - a - 1)
                if k < 1:
                    continue
                s = x[a:b] @ x[a:b].T
                np.fill_diagonal(s, -2)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], k)), pa.array(ids[a:b][at].ravel()), pa.array(np.take_along_axis(s, at, 1).ravel()), pa.array(np.ones((b - a) * k, bool))], ["u", "v", "s", "fresh"])

    pairs = blocks.select("work", "node", "q").repartition("work").sortWithinPartitions("work").mapInArrow(compared, EDGES)
    return staged(best(pairs, degree), "nn-edges")


def met(edges: DataFrame, reverse: int) -> DataFrame:
    """u, v, fresh: a node's neighbours and up to ``reverse`` of the nodes that name it, drawn by hash."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    back = back.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))).where(F.col("n") <= reverse)
    return edges.select("u", "v", "fresh").unionByName(back.drop("n")).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))


def descend(edges: DataFrame, nodes: DataFrame, degree: int, reverse: int) -> DataFrame:
    worst = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) >= degree, F.min("s")).otherwise(F.lit(-2.0)).alias("worst"))
    known = nodes.select(F.col("node").alias("v"), "q").join(worst.withColumnRenamed("u", "v"), "v", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    meeting = met(edges, reverse).join(known, "v")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in runs_of(batches, "u"):
            ids, worst_, fresh = table["v"].to_numpy(), table["worst"].to_numpy(), table["fresh"].to_numpy()
            x = unit_rows(binary_matrix(table["q"], np.float32))
            us, vs, ss = [], [], []
            for a, b in zip(borders, [*borders[1:], table.num_rows], strict=True):
                f = fresh[a:b]
                if b - a < 2 or not f.any():
                    continue
                s = x[a:b] @ x[a:b].T
                wanted = (s > worst_[a:b][:, None]) & (f[:, None] | f[None, :])
                np.fill_diagonal(wanted, False)
                i, j = np.nonzero(wanted)
                us.append(ids[a:b][i])
                vs.append(ids[a:b][j])
                ss.append(s[i, j])
            if sum(map(len, us)):
                u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss)
                order = np.lexsort((v, u))  # one row a pair and batch
                u, v, s = u[order], v[order], s[order]
                new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
                u, v, s = u[new], v[new], s[new]
                order = np.lexsort((v, -s, u))  # and of each node no more than it can keep
                u, v, s = u[order], v[order], s[order]
                first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                kept = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u)))) < degree
                yield pa.RecordBatch.from_arrays([pa.array(u[kept]), pa.array(v[kept]), pa.array(s[kept]), pa.array(np.ones(kept.sum(), bool))], ["u", "v", "s", "fresh"])

    offers = meeting.repartition("u").sortWithinPartitions("u").mapInArrow(propose, EDGES)
    return staged(best(edges.withColumn("fresh", F.lit(False)).unionByName(offers), degree), "nn-edges")


def build_graph(nodes: DataFrame, degree: int = 32, reverse: int = 32, trees: int = 4, block: int = 512, rounds: int = 8, settled: float = 0.02, seed: int = 3) -> DataFrame:
    n = nodes.count()
    edges = first_graph(nodes, n, degree, trees, block, seed)
    for _ in range(rounds if n > 2 else 0):
        step = descend(edges, nodes, degree, reverse)
        drop_staged(edges)
        edges = step
        if edges.where("fresh").count() <= settled * degree * n:
            break
    return edges


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, beam: int = 128, width: int = 64, rounds: int = 6, reverse: int = 32, entries: int = 512) -> DataFrame:
    """queries: query_id, q, node (null: not of the index). Returns query_id, node: the beam after the last round."""
    around = staged(met(edges, reverse).select("u", "v"), "nn-around")
    start = queries.where("node is not null").select("query_id", F.col("node").alias("v"))
    if entries:
        n = nodes.count()
        drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, entries / max(n, 1)) * (1 << 30)) + 1))
        doors = [r["node"] for r in drawn.select("node").limit(2 * entries).collect()]
        start = start.unionByName(queries.where("node is null").select("query_id", F.explode(F.array(*[F.lit(x).cast("long") for x in doors])).alias("v")))
    asked = queries.select("query_id", F.col("q").alias("asked"))

    def scored(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, y = unit_rows(binary_matrix(b.column(2), np.float32)), unit_rows(binary_matrix(b.column(3), np.float32))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y))], ["query_id", "v", "s"])

        vectors = pairs.join(nodes.select(F.col("node").alias("v"), "q"), "v").join(asked, "query_id")
        return vectors.select("query_id", "v", "q", "asked").mapInArrow(run, "query_id bigint, v bigint, s double")

    by = Window.partitionBy("query_id").orderBy(F.desc("s"), "v")
    state = staged(scored(start).withColumn("opened", F.lit(False)), "nn-beam")
    for _ in range(rounds):
        turn = state.withColumn("n", F.sum(F.when(~F.col("opened"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        turn = staged(turn.withColumn("open", (~F.col("opened")) & (F.col("n") <= width)).drop("n"), "nn-turn")
        reached = turn.where("open").select("query_id", F.col("v").alias("u")).join(around, "u").select("query_id", "v").distinct()
        fresh = scored(reached.join(state.select("query_id", "v"), ["query_id", "v"], "left_anti")).withColumn("opened", F.lit(False))
        both = turn.select("query_id", "v", "s", (F.col("opened") | F.col("open")).alias("opened")).unionByName(fresh)
        step = staged(both.withColumn("n", F.row_number().over(by)).where(F.col("n") <= beam).drop("n"), "nn-beam")
        drop_staged(turn)
        drop_staged(state)
        state = step
        if not state.where("not opened").limit(1).count():
            break
    return state.select("query_id", F.col("v").alias("node"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", **settings) -> DataFrame:
    """The k nearest other rows of every row whose id is divisible by ``every``."""
    building = {x: settings.pop(x) for x in ("degree", "trees", "block", "rounds", "settled", "seed") if x in settings}
    nodes, copies = nodes_of(vectors, vec_id, embedding, k + 1)
    edges = build_graph(nodes, **building)
    rows = vectors.select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("vector")).where((F.col("query_id") % every == 0) & usable(F.col("vector")))
    rows = rows.groupBy("query_id").agg(F.max("vector").alias("vector"))
    queries = staged(rows.join(nodes, "vector").select("query_id", "node", "q", "vector"), "nn-queries")
    found = search(queries.select("query_id", "node", "q"), nodes, edges, entries=0, **settings)  # each has a node of its own
    # The query's own node counts too: its other copies are the nearest of all.
    found = found.unionByName(queries.select("query_id", "node")).distinct()
    exact = found.join(nodes.select("node", F.col("vector").alias("other")), "node").join(queries.select("query_id", "vector"), "query_id")
    exact = exact.select("query_id", "node", cosine(F.col("vector"), F.col("other")).alias("score"))
    rows = exact.join(copies, "node").where(F.col("vec_id") != F.col("query_id"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
