"""Embedding near-dedup (operator 5): an exact metric range join over pivot cells.

Unit vectors of cosine c lie sqrt(2 - 2 c) apart. Pivots, a bounded sample of
the vectors, cut space into cells of nearest pivots. A vector x of cell i can
have a partner y in cell j only if its distance to the hyperplane between the
two pivots is at most the radius r: as y is nearer to j than to i, the triangle
inequality gives d(x, j) - d(x, i) <= 2 r, and on the hyperplane the sharper
d(x, j)^2 - d(x, i)^2 <= 2 r d(i, j). Vectors are replicated to the cells of a
larger number that both bounds allow, so every pair meets in exactly one cell.
Cells join independently: a task holds a share of a cell, bounded in bytes, and
streams what was replicated there past it, in blocks. There are four pivots for
each share that the vectors fill, so that bounds prune before cells are cut; those
that are still larger are cut into shares that count as cells of one pivot, so a
dense cluster is spread as well. A vector travels as its id, its class's size and its
components as they were given, floats as floats, at most once to each share.

Equal vectors are one class; a class's size counts in its partners' n_links. A
task returns only counts and, for the components, one star edge for each vector
of a connected block, never the pairs. Products are taken in single precision
first, and every pair near or above the threshold again in double precision.

Where the data have no clusters (random vectors of many dimensions) no metric
bound prunes anything; the join is then complete but quadratic, and each vector is
copied to half of all shares.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing. Vectors of different dimension never link. A null vec_id is
kept with a null component. Repeated rows count as vectors of their own. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import drop, materialise, small_enough
from lodestrata.llm.components import components, union_find
from lodestrata.llm.textops import ragged_index

THRESHOLD = 0.9
#: Bytes of vectors in double precision of one share of a cell, pivots for each share, and pivots at most.
SHARE_BYTES, PIVOTS_PER_SHARE, MAX_PIVOTS = 8 << 20, 4, 1024
#: Rows compared with each other at once, and by how much single precision may err.
STREAM, HELD, ERROR = 1024, 4096, 1e-4
#: Bytes of labels by vector that may be broadcast.
LABEL_BYTES = 16 << 20


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision of an Arrow list column whose rows have one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _deal_cells(counts: dict[tuple[int, int], int], pivots: dict[int, np.ndarray], share: int) -> tuple[dict, dict, int]:
    """First share and number of shares of each cell (dimension, pivot), and the number of all shares.

    Cells of more than ``share`` vectors are cut; smaller ones, taken along a chain of near pivots, fill shares together.
    """
    first: dict[tuple[int, int], int] = {}
    number: dict[tuple[int, int], int] = {}
    total = 0
    for d in sorted({d for d, _ in counts}):
        todo = sorted(h for x, h in counts if x == d)
        chain = [todo.pop(0)]
        while todo:
            likeness = pivots[d][todo] @ pivots[d][chain[-1]]
            chain.append(todo.pop(int(likeness.argmax())))
        filled = share
        for h in chain:
            n = counts[d, h]
            if n > share:
                first[d, h], number[d, h] = total, -(-n // share)
                total, filled = total + number[d, h], share
            else:
                if filled + n > share:
                    total, filled = total + 1, 0
                first[d, h], number[d, h] = total - 1, 1
                filled += n
    return first, number, total


def near_vectors(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD, share: int | None = None, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    given = vectors.schema[embedding].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind = "float" if single else "double"
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: x.cast(kind)).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Doubles are scaled by the largest component, so that very small or large vectors keep their direction. Squares of
    # floats fit doubles as they are; they travel in half the bytes.
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    valid = F.when(finite & (F.size("v") > 0) & (top > 0), F.col("v") if single else F.transform("v", lambda x: x / top))
    own = materialise(own.withColumn("v", valid), "vectors")
    classes = materialise(own.filter("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    share = share or max(256, SHARE_BYTES // (8 * (width or 1)))
    k = max(1, min(max_pivots, PIVOTS_PER_SHARE * (n // share)))
    # A bounded sample of at most max_pivots vectors, the same at every run.
    pivots = classes.orderBy(F.xxhash64("rep"), "rep").limit(k).select("v").collect()
    by_size: dict[int, np.ndarray] = {}
    for d in {len(p.v) for p in pivots}:
        p = np.array([p.v for p in pivots if len(p.v) == d], np.float64)
        by_size[d] = p / np.sqrt((p * p).sum(1, keepdims=True))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def home_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the pivots of this dimension (one zero column where there are none), and the nearest."""
        p = by_size.get(x.shape[1])
        d = np.maximum(0, 2 - 2 * x @ p.T) if p is not None else np.zeros((len(x), 1))
        return d, d.argmin(1)

    def homes(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column(0)).to_numpy()
            home = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                home[at] = home_of(_matrix(batch.column(0).take(pa.array(at))))[1]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array(size.astype(np.int32)), pa.array(home)], ["rep", "copies", "v", "dim", "home"])

    placed = materialise(classes.select("v", "rep", "copies").mapInArrow(homes, f"rep long, copies long, v array<{kind}>, dim int, home int"), "homes")
    # At most one row for each pivot and dimension.
    counts = {(r.dim, r.home): r["count"] for r in placed.groupBy("dim", "home").count().collect()}
    first, shares, total = _deal_cells(counts, by_size, share)

    def deal(batches):
        """A vector's own share of its cell, and all later shares it may have partners in."""
        for batch in batches:
            size, home = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            rep = batch.column(0).to_numpy()
            part = ((rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            rows, cells, native = [], [], []
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                dist, _ = home_of(_matrix(batch.column(2).take(pa.array(at))))
                h, j = home[at], np.arange(dist.shape[1])
                starts = np.array([first.get((d, x), 0) for x in j])
                count = np.array([shares.get((d, x), 0) for x in j])
                own_share = starts[h] + part[at] % count[h]
                rows.append(at)
                cells.append(own_share)
                native.append(np.ones(len(at), bool))
                near = np.zeros(dist.shape, bool)
                near[np.arange(len(h)), h] = True
                p = by_size.get(int(d))
                if p is not None:
                    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[h]
                    dh = dist[np.arange(len(h)), h][:, None]
                    near |= (np.sqrt(dist) - np.sqrt(dh) <= 2 * radius) & (dist - dh <= 2 * radius * between + 1e-9)
                i, cell = np.nonzero(near & (count > 0)[None, :])
                i, to = np.repeat(i, count[cell]), ragged_index(starts[cell], count[cell])
                i, to = np.divmod(np.unique(i * total + to), total)  # several cells can lie in one share
                later = to > own_share[i]
                rows.append(at[i[later]])
                cells.append(to[later])
                native.append(np.zeros(int(later.sum()), bool))
            rows, cells, native = np.concatenate(rows), np.concatenate(cells), np.concatenate(native)
            for a in range(0, len(rows), 10_000):
                take = pa.array(rows[a : a + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[a : a + 10_000].astype(np.int32)), pa.array(native[a : a + 10_000]), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                    ["cell", "native", "rep", "copies", "v"],
                )

    def join(batches):
        """Counts and star edges of each cell; its own vectors come first."""
        cell, ids, weight, x, x4, links = None, [], [], None, None, None
        held: list[tuple] = []

        def compare(a_ids, a_w, a, b_ids, b_w, b, same):
            """Counts of both sides and edges, from the products of two blocks."""
            s = a.astype(np.float32) @ b.astype(np.float32).T
            i, j = np.nonzero(s >= threshold - ERROR)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                near = np.zeros(len(i), bool)
                for k in range(0, len(i), 1 << 16):
                    near[k : k + (1 << 16)] = (a[i[k : k + (1 << 16)]] * b[j[k : k + (1 << 16)]]).sum(1) >= threshold
                i, j = i[near], j[near]
            out = (np.bincount(i, b_w[j], len(a_ids)), np.bincount(j, a_w[i], len(b_ids)))
            return *out, a_ids[i], b_ids[j]

        def result(ids_, n_, u, v):
            """Rows (id, links, edge): edges as stars on the least vector of what is connected in the block."""
            some = n_ > 0
            rows = [(ids_[some], n_[some].astype(np.int64), np.full(int(some.sum()), -1), np.zeros(int(some.sum()), bool))]
            if len(u):
                nodes, least = union_find(u, v)
                rows.append((nodes, np.zeros(len(nodes), np.int64), least, np.ones(len(nodes), bool)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in range(4)], ["id", "links", "least", "edge"])

        def close():
            """Join what a share holds with itself, once it is complete."""
            nonlocal ids, weight, x
            ids, weight, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            for a in range(0, len(ids), STREAM):
                for b in range(a, len(ids), STREAM):
                    m, o, u, v = compare(ids[a : a + STREAM], weight[a : a + STREAM], x[a : a + STREAM], ids[b : b + STREAM], weight[b : b + STREAM], x[b : b + STREAM], a == b)
                    if a == b:
                        yield result(ids[a : a + STREAM], m + o, u, v)
                    else:
                        yield result(np.concatenate([ids[a : a + STREAM], ids[b : b + STREAM]]), np.concatenate([m, o]), u, v)

        for batch in batches:
            cells, native = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((cells[1:] != cells[:-1]) | (native[1:] != native[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(cells)], strict=True):
                if a == b:
                    continue
                if held and (cells[a] != cell or not native[a]):
                    yield from close()
                if cells[a] != cell:
                    cell, ids = cells[a], np.zeros(0, np.int64)
                part = batch.slice(a, b - a)
                bi, bw, bx = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4))
                if native[a]:
                    held.append((bi, bw, bx))
                    continue
                for c in range(0, len(bi) if len(ids) else 0, STREAM):
                    for e in range(0, len(ids), HELD):
                        m, o, u, v = compare(ids[e : e + HELD], weight[e : e + HELD], x[e : e + HELD], bi[c : c + STREAM], bw[c : c + STREAM], bx[c : c + STREAM], False)
                        yield result(np.concatenate([ids[e : e + HELD], bi[c : c + STREAM]]), np.concatenate([m, o]), u, v)
        if held:
            yield from close()

    dealt = placed.mapInArrow(deal, f"cell int, native boolean, rep long, copies long, v array<{kind}>")
    cells = dealt.repartition(max(1, total), "cell").sortWithinPartitions("cell", F.col("native").desc(), "rep")
    met = materialise(cells.mapInArrow(join, "id long, links long, least long, edge boolean"), "met")
    found = components(met.filter("edge and id != least"), "id", "least")
    links = met.filter("not edge").groupBy("id").agg(F.sum("links").alias("links"))
    label = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    label = materialise(label.select("v", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links")).filter("copies > 1 or links > 0"), "label")
    # A common vector makes no task hot where its label is broadcast; a larger table is a plain side of a join that Spark can split.
    few = small_enough(label, LABEL_BYTES // (8 * (width or 1) + 32))
    out = own.join(F.broadcast(label) if few else label, "v", "left")
    drop(classes, placed, met)
    valid = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    return out.select(
        "vec_id",
        F.when(valid, F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(valid, F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
