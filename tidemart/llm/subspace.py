"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of at least c have a squared distance of at most 2 - 2c. After a rotation they are
split into ``BLOCKS`` blocks; a pair within the whole budget is within the proportional part of it in at
least one block. Each block is range-joined on a grid over its first coordinates: a vector is compared with
those whose cells the ball of the block's budget around it touches. What passes in a block is verified on
the full vectors in double precision, in the same task; a pair counts in the first block that finds it.

Tasks do not emit pairs: each returns per vector its number of links and its component within the task.
Cells are cut into chunks of at most about ``CHUNK`` vectors, whose pairs are the tasks, so that memory is
bounded whatever a cell holds. Copies of a vector are one node.

On vectors without any structure a block passes a constant share of all pairs, so the comparing grows with the
square of their number, at a few nanoseconds a pair; on real data the grid parts more of them.

Defined results: vectors that are null, zero, or hold nulls or non-finite numbers link with nothing and are
kept. Vectors of different length do not link. Rows that share an id are one vector in the graph; each row
is returned. Rows without an id link with nothing: component_id is null and they are kept. Extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import checkpointed, pick, slices
from tidemart.llm.components import components

COSINE = 0.9
BLOCKS, GRID_COORDINATES = 4, 2
CHUNK = 50_000
#: Rows and columns of the distance matrices within a task.
TILE = 2_048
#: Added to budgets where single precision is compared.
MARGIN = 1e-4


def rotation(n: int) -> np.ndarray:
    """A fixed random rotation of n coordinates."""
    q, r = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def matrix(lists: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, padded with zeros to n, and their lengths."""
    size = pc.list_value_length(lists).to_numpy()
    out = np.zeros((len(lists), n))
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, size


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Scaled to length 1; first by the largest part, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_bounds(n: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.linspace(0, n, min(blocks, n) + 1).astype(int)


def cells(part: np.ndarray, radius: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each row's own grid cell, and (rows, cells) of the lower-numbered cells that its ball touches."""
    grid = part[:, :GRID_COORDINATES]
    side, reach = 2 * radius, radius * (1 + 1e-6)
    number = lambda g: ((g + 512) << (10 * np.arange(g.shape[1]))).sum(axis=1)
    at = np.floor(grid / side).astype(np.int64)
    low, high = np.floor((grid - reach) / side).astype(np.int64), np.floor((grid + reach) / side).astype(np.int64)
    own, touched = number(at), []
    for code in range(3 ** grid.shape[1]):
        step = np.array([code // 3**k % 3 - 1 for k in range(grid.shape[1])])
        there = at + step
        rows = np.flatnonzero(((there >= low) & (there <= high)).all(axis=1))
        cell = number(there[rows])
        lower = cell < own[rows]
        touched.append((rows[lower], cell[lower]))
    return own, touched


def spread(nodes: DataFrame, n: int) -> DataFrame:
    """A row for each block and cell that a node has to be compared in; ``own`` marks its own cell."""
    bounds = block_bounds(n)
    turn = rotation(n)

    def run(batches):
        for batch in slices(batches, 4_000):
            x, _ = matrix(batch.column(2), n)
            x = unit_rows(x) @ turn
            for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                radius = ((2 - 2 * COSINE) * (hi - lo) / n) ** 0.5
                own, touched = cells(x[:, lo:hi], radius)
                for rows, cell, is_own in [(np.arange(len(x)), own, True), *((r, c, False) for r, c in touched)]:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(c.take(pa.array(rows)) for c in batch.columns),
                                pa.array(np.full(len(rows), b, np.int32)),
                                pa.array(cell),
                                pa.array(np.full(len(rows), is_own)),
                            ],
                            ["node", "copies", "embedding", "block", "cell", "own"],
                        )

    return nodes.select("node", "copies", "embedding").mapInArrow(
        run, "node bigint, copies bigint, embedding array<float>, block int, cell bigint, own boolean"
    )


def within_task(node, copies, x, size, is_data, is_probe, own, block, bounds, turn, budget):
    """Number of links of each row, and its smallest linked row number within the task (labels)."""
    unit = unit_rows(x)
    turned = unit @ turn
    parts = [turned[:, lo:hi] for lo, hi in zip(bounds, bounds[1:])]
    limits = [budget * (hi - lo) / turned.shape[1] * (1 + 1e-9) for lo, hi in zip(bounds, bounds[1:])]
    part = parts[block].astype(np.float32)
    square = (part * part).sum(axis=1)
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))

    data, probe = np.flatnonzero(is_data), np.flatnonzero(is_probe)
    for a in range(0, len(data), TILE):
        left = data[a : a + TILE]
        for b in range(0, len(probe), TILE):
            right = probe[b : b + TILE]
            near = square[left][:, None] + square[right] - 2 * part[left] @ part[right].T <= limits[block] + MARGIN
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i, j = left[i], right[j]
            once = ~own[j] | (node[i] < node[j])  # both in their own cell: each pair in one order
            i, j = i[once], j[once]
            for s in range(0, len(i), 200_000):  # bounds the memory where nearly all pairs are near
                p, q = i[s : s + 200_000], j[s : s + 200_000]
                ok = (np.einsum("ij,ij->i", unit[p], unit[q]) >= COSINE) & (size[p] == size[q])
                p, q = p[ok], q[ok]
                hit = [((parts[k][p] - parts[k][q]) ** 2).sum(axis=1) <= limits[k] for k in range(block + 1)]
                first = hit[block] & ~np.logical_or.reduce([np.zeros(len(p), bool), *hit[:block]])
                p, q = p[first], q[first]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                while True:  # joins the trees of linked rows, each under its smallest row
                    while (parent != parent[parent]).any():
                        parent = parent[parent]
                    apart = parent[p] != parent[q]
                    if not apart.any():
                        break
                    u, v = parent[p[apart]], parent[q[apart]]
                    np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
    return links, parent


def linked(nodes: DataFrame, n: int) -> DataFrame:
    """Per node and task with a link: node, links, other (a node of its component there)."""
    rows = spread(nodes, n)
    sizes = rows.groupBy("block", "cell").count().collect()  # a bounded grid over unit vectors
    chunks = F.create_map(
        *[F.lit(x) for r in sizes for x in (r["block"] << 40 | r["cell"], 1 + r["count"] // CHUNK)]
    )
    many = chunks[F.col("block").cast("bigint") * (1 << 40) + F.col("cell")]
    salted = rows.withColumn("many", many).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    every = F.sequence(F.lit(0), F.col("many") - 1)
    as_data = F.when(F.col("own"), F.transform(every, lambda k: F.struct(F.col("salt").alias("i"), k.alias("j")))).otherwise(
        F.array().cast("array<struct<i:int,j:int>>")
    )
    as_probe = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("salt").alias("j")))
    tasks = salted.select(
        "node", "copies", "embedding", "block", "cell", "own", "salt", F.explode(F.array_union(as_data, as_probe)).alias("t")
    ).select("node", "copies", "embedding", "block", "cell", "own", "salt", "t.i", "t.j")
    bounds, turn, budget = block_bounds(n), rotation(n), 2 - 2 * COSINE

    def run(table: pa.Table) -> pa.Table:
        col = lambda name: table[name].combine_chunks()
        node, own = col("node").to_numpy(), col("own").to_numpy(zero_copy_only=False)
        salt, i, j = (col(c).to_numpy() for c in ("salt", "i", "j"))
        x, size = matrix(col("embedding"), n)
        links, label = within_task(
            node, col("copies").to_numpy(), x, size, own & (salt == i), salt == j, own,
            int(table["block"][0].as_py()), bounds, turn, budget,
        )
        some = np.flatnonzero(links > 0)
        return pa.table({"node": node[some], "links": links[some], "other": node[label[some]]})

    return tasks.groupBy("block", "cell", "i", "j").applyInArrow(run, "node bigint, links bigint, other bigint")


def groups(vectors: DataFrame) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = pick(vectors, vec_id="bigint", embedding="array<float>")
    sound = F.coalesce(
        F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
        & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    usable = rows.where(sound & F.col("vec_id").isNotNull())
    nodes = usable.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpointed(nodes)
    n = nodes.agg(F.max(F.size("embedding"))).first()[0]
    if n is None:
        return rows.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    found = checkpointed(linked(nodes, n))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.join(degree, "node", "left").join(roots, "node", "left")
    named = named.select(
        "embedding",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("component"),
    )
    joined = rows.withColumn("key", F.when(sound & F.col("vec_id").isNotNull(), F.col("embedding"))).join(
        named.withColumnRenamed("embedding", "key"), "key", "left"
    )
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
