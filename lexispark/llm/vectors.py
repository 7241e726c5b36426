"""Near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import components, drop_stored, stored

#: Rows of a block of dot products, which bounds the memory of a task.
BLOCK = 1024
#: Vectors that the pivots are drawn from; bounds what the driver gets.
PIVOT_SAMPLE = 4000
_SLACK = 1e-4  # for distances and first-stage sums in single precision


def unit(values: list | np.ndarray | None) -> np.ndarray | None:
    """The vector scaled to length 1 in double precision; None if it is null, zero or not finite throughout."""
    if values is None or len(values) == 0:
        return None
    v = np.array([np.nan if x is None else x for x in values], dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(v).max()
        if not np.isfinite(top) or not np.isfinite(v).all() or top == 0:
            return None
        v = v / top
        return v / math.sqrt(float(v @ v))


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        units = []
        for i, v in zip(b.column(0).to_pylist(), b.column(1)):
            u = unit(v.values.to_numpy(zero_copy_only=False) if i is not None and v.is_valid and v.values is not None else None)
            units.append(None if u is None else u.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.binary())], names=["vec_id", "unit"])


def _to_cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """Each vector to its own cell, that of the nearest pivot, and to every cell that a vector within reach of it may
    have as its own: by the triangle inequality only those with d(x, p) <= d(x, nearest) + 2 * reach. Vectors of
    another length than the pivots' cannot be near them; they go to a cell by their length."""
    size = pivots.shape[1]
    for b in batches:
        raw = b.column(1).to_pylist()
        cells, rows, own = [], [], []
        same = [i for i, r in enumerate(raw) if len(r) == 8 * size]
        if same:
            x = np.frombuffer(b"".join(raw[i] for i in same), dtype=np.float64).reshape(-1, size)
            for at in range(0, len(x), BLOCK):
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[at : at + BLOCK] @ pivots.T)))
                near = d.argmin(axis=1)
                which, cell = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * reach + _SLACK)
                cells.append(cell)
                rows.append(np.array(same)[which + at])
                own.append(near[which] == cell)
        odd = [i for i, r in enumerate(raw) if len(r) != 8 * size]
        cells.append(np.array([-len(raw[i]) for i in odd], dtype=np.int64))
        rows.append(np.array(odd, dtype=np.int64))
        own.append(np.ones(len(odd), dtype=bool))
        rows = np.concatenate(rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cells).astype(np.int64)), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), b.column(2).take(pa.array(rows)), pa.array(np.concatenate(own).astype(bool))],
            names=["cell", "node", "unit", "copies", "own"],
        )


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (least member) of all nodes after the links a-b are added; parent holds the roots before."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        ra, rb = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _join_block(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """The `mine` rows of a group against its other rows: each mine row's number of links, and a star of links
    (node, least linked node) for each component in the group.

    A vector is first compared on its leading 16 components, in single precision: the distance there is no larger
    than the whole one. What is left is compared in full, in double precision."""
    x = np.frombuffer(b"".join(pdf["unit"]), dtype=np.float64).reshape(len(pdf), -1)
    names, node = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    copies, is_mine = pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
    mine, rest = np.nonzero(is_mine)[0], np.nonzero(~is_mine)[0]
    head = np.ascontiguousarray(x[:, :16], dtype=np.float32)
    half = (head * head).sum(axis=1) / 2
    far = np.float32(1 - cosine + _SLACK)
    links, parent = np.zeros(len(pdf), dtype=np.int64), np.arange(len(names))
    for at in range(0, len(mine), BLOCK):
        rows = mine[at : at + BLOCK]
        for start in range(0, len(rest), 8 * BLOCK):
            part = rest[start : start + 8 * BLOCK]
            apart = head[rows] @ head[part].T
            apart *= -1
            apart += half[rows][:, None]
            apart += half[part][None, :]
            i, j = np.nonzero(apart <= far)
            i, j = rows[i], part[j]
            other = node[i] != node[j]
            i, j = i[other], j[other]
            for cut in range(0, len(i), 65536):
                a, b = i[cut : cut + 65536], j[cut : cut + 65536]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                parent = _unite(parent, node[a], node[b])
    moved = np.nonzero(parent != np.arange(len(names)))[0]
    counted = mine[links[mine] > 0]
    return pd.DataFrame({"node": np.concatenate([names[node[counted]], names[moved]]), "links": np.concatenate([links[counted], np.full(len(moved), -1)]), "other": np.concatenate([names[node[counted]], names[parent[moved]]])})


def _pivots(classes: DataFrame, number: int, a_cell: int, seed: int) -> np.ndarray | None:
    """Vectors far from each other, as many as there are cells of a_cell vectors, at most the square root of their
    number and PIVOT_SAMPLE; None if there are no vectors."""
    drawn = classes.orderBy(F.xxhash64(F.lit(seed), "unit"), "unit").select("unit").limit(PIVOT_SAMPLE).collect()
    sample = [np.frombuffer(r.unit, dtype=np.float64) for r in drawn]
    if not sample:
        return None
    size = max({len(v) for v in sample}, key=lambda n: (sum(len(v) == n for v in sample), n))
    sample = np.array([v for v in sample if len(v) == size])
    wanted, chosen = min(1 + number // a_cell, 1 + math.isqrt(number), len(sample)), [0]
    apart = np.full(len(sample), -np.inf)
    while len(chosen) < wanted:  # each pivot is the vector farthest from those before
        apart = np.maximum(apart, sample @ sample[chosen[-1]])
        chosen.append(int(apart.argmin()))
    return sample[sorted(set(chosen))]


def vector_components(vectors: DataFrame, cosine: float = 0.95, a_cell: int = 8192, seed: int = 1) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal unit vectors are one node with a count through the join. Pivots are drawn from a sample of at most
    PIVOT_SAMPLE vectors; any pivots give the same links. Each cell's own vectors are compared with all vectors that
    reach the cell, in groups of bounded size, so every link of a vector is found, once, in that vector's own cell.
    A group returns counts and a spanning star of links, never all pairs.

    Null, zero or non-finite vectors link with nothing; vectors of different lengths never link; a row with a null
    vec_id stays and links with nothing; rows that repeat a vec_id are a vector each, and link with each other too if
    they are near; other columns are ignored; an empty table gives an empty result."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    each = stored(rows.mapInArrow(_unit_rows, "vec_id long, unit binary"), "vectors")
    classes = each.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    number = classes.count()
    pivots, reach = _pivots(classes, number, a_cell, seed), math.sqrt(2 - 2 * cosine)
    if pivots is None:
        return each.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cells = stored(classes.select("node", "unit", "copies").mapInArrow(partial(_to_cells, pivots=pivots, reach=reach), "cell long, node long, unit binary, copies long, own boolean"), "cells")
    # A cell's own vectors are dealt to parts, all its vectors to blocks; a group is a part against a block.
    bound = lambda n, most: F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("int")
    sizes = cells.groupBy("cell").agg(F.sum(F.col("own").cast("int")).alias("n"), F.count("*").alias("m")).where("n > 0")
    sizes = sizes.select("cell", bound(F.col("n"), a_cell).alias("parts"), bound(F.col("m"), 2 * a_cell).alias("blocks"))
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("hash", F.xxhash64("node"))  # a row for each pivot or length
    part, block = F.pmod("hash", "parts").cast("int"), F.pmod("hash", "blocks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = dealt.where("own").select("cell", part.alias("part"), every("blocks").alias("block"), "node", "unit", "copies", F.lit(True).alias("mine"))
    rest = dealt.select("cell", every("parts").alias("part"), block.alias("block"), "node", "unit", "copies", F.lit(False).alias("mine"))
    joined = mine.unionByName(rest).groupBy("cell", "part", "block").applyInPandas(lambda pdf: _join_block(pdf, cosine), "node long, links long, other long")
    joined = stored(joined, "links")
    drop_stored(cells)
    counts = joined.where("links > 0").groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    label = components(joined.where("links < 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    label = label.select(F.col("node").alias("c_node"), "component")
    full = classes.join(counts, F.col("node") == F.col("l_node"), "left").join(label, F.col("node") == F.col("c_node"), "left")
    full = stored(full.select("unit", "vec_id", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "full")
    least = stored(full.where("component is not null").groupBy(F.col("component").alias("of")).agg(F.min("vec_id").alias("least")), "least")
    full = full.join(least, F.col("component") == F.col("of"), "left").select(F.col("unit").alias("f_unit"), "n_links", F.coalesce("least", "vec_id").alias("component_id"))
    out = each.join(full, F.col("unit") == F.col("f_unit"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: The rows of vector_components() over `embeddings`, by all pairs.
SQL = """
WITH RECURSIVE u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM u WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r AS (SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, least(node, min(seen)) AS comp FROM r GROUP BY 1),
d AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(comp, vec_id) AS component_id, coalesce(comp, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN m ON node = vec_id LEFT JOIN d ON a = vec_id
"""
