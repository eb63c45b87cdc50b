"""Embedding near-dedup: a navigable small-world graph per shard, searched by every vector.

Every shard's graph is built once and written; the vectors of all shards then stream past each graph. What leaves a task is the
number of links of each vector and a spanning forest of the links, never all pairs of a group.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import releasing, written
from varloom.llm.components import connected_components

#: Neighbours of a node (twice as many on the ground level), beam while building, vectors inserted or searched in step.
LINKS, BUILD_BEAM, STEP = 12, 48, 512
#: Bytes that a search marks seen nodes with, and that the vectors of candidates take at once.
HELD = 32 << 20
#: Vectors and graphs are written in small row groups, which a task holds whole while it writes.
GROUPS = {"parquet.block.size": str(16 << 20)}


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors in step.

    Inside, nodes are numbered by falling level, so the table of a level has rows only for the nodes that reach it.
    """

    def __init__(self, unit: np.ndarray, level: np.ndarray | None = None, seed: int = 7):
        """level: the vectors' highest levels, falling; without it levels are drawn and the vectors put in their order."""
        n = len(unit)
        self.given = None  # the place of each node among the vectors as given
        if level is None:
            level = np.minimum(8, (-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64))
            self.given = np.argsort(-level, kind="stable")
            unit, level = unit[self.given], level[self.given]
        self.unit = np.ascontiguousarray(unit, np.float32)
        self.levels: list[np.ndarray] = []  # from the ground up: nodes x links, -1 where free
        for lev in range(int(level[0]) + 1 if n else 0):
            self.levels.append(np.full((int((level >= lev).sum()), LINKS * (2 if lev == 0 else 1)), -1, np.int32))
        done = 0
        step = 1
        while done < n:
            many = min(step, n - done)
            if done:
                self._insert(np.arange(done, done + many))
            done += many
            step = min(STEP, max(1, done // 2))

    def links(self, node: int) -> bytes:
        """The links of a node on all its levels, from the ground up."""
        return b"".join(t[node].tobytes() for t in self.levels if node < len(t))

    @classmethod
    def load(cls, unit: np.ndarray, links: list[np.ndarray]) -> SmallWorld:
        """The graph over unit whose tables of links, from the ground up, are given."""
        self = cls.__new__(cls)
        self.given, self.unit, self.levels = None, unit, links
        return self

    def _rows(self) -> int:
        """So many vectors are searched in step that what a search holds stays bounded, however large or wide the shard is."""
        n, dims = self.unit.shape
        return max(1, min(STEP, HELD // max(n, 4 * dims * (BUILD_BEAM + LINKS))))

    def _insert(self, batch: np.ndarray) -> None:
        q = self.unit[batch]
        at = np.zeros(len(batch), np.int64)
        for lev in range(len(self.levels) - 1, -1, -1):
            table = self.levels[lev]
            width = table.shape[1]
            m = int((batch < len(table)).sum())  # the first of the batch are those that reach this level
            ids = self._beam(q, at, lev, BUILD_BEAM if m else 1)[0]
            at = np.where(ids[:, 0] >= 0, ids[:, 0], at)
            if not m:
                continue
            # Those inserted together look at each other directly.
            peers = batch[:m]
            sim = q[:m] @ q[:m].T
            np.fill_diagonal(sim, -2)
            few = min(LINKS, m)
            own = np.argpartition(-sim, few - 1, axis=1)[:, :few]
            near = np.concatenate([ids[:m], np.where(np.take_along_axis(sim, own, 1) > -2, peers[own], -1)], 1)
            rows = self._rows()
            chosen = np.concatenate([self._diverse(q[i : min(m, i + rows)], near[i : i + rows], LINKS) for i in range(0, m, rows)])
            table[peers, : chosen.shape[1]] = chosen
            self._link_back(lev, peers, chosen, width)

    def _diverse(self, q: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
        """For each row the nearest candidates that are nearer to it than to those taken before, filled up with the next."""
        vec = self.unit[np.maximum(near, 0)]
        sims = np.where(near >= 0, np.matmul(vec, q[:, :, None])[:, :, 0], -2)
        by = np.argsort(-sims, axis=1, kind="stable")
        near, sims = np.take_along_axis(near, by, 1), np.take_along_axis(sims, by, 1)
        vec = vec.reshape(-1, vec.shape[2]).take(by + np.arange(len(by))[:, None] * by.shape[1], 0)
        cross = np.matmul(vec, vec.transpose(0, 2, 1))
        taken, many = np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
        for k in range(near.shape[1]):
            closer = (taken[:, :k] & (cross[:, k, :k] > sims[:, k, None])).any(1)
            taken[:, k] = (near[:, k] >= 0) & ~closer & (many < keep)
            many += taken[:, k]
        rank = np.argsort(np.where(near < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(near, rank, 1)

    def _link_back(self, lev: int, peers: np.ndarray, chosen: np.ndarray, width: int) -> None:
        src, dst = np.repeat(peers, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, start, n = np.unique(dst, return_index=True, return_counts=True)
        few = np.argsort(n, kind="stable")
        nodes, start, n = nodes[few], start[few], n[few]
        table = self.levels[lev]
        at = 0
        while at < len(nodes):
            # Rows of like length together, and few of the long ones: the table of distances among candidates stays small.
            rows = min(self._rows(), len(nodes) - at)
            while rows > 1 and rows * (width + int(n[at + rows - 1])) ** 2 > 4_000_000:
                rows //= 2
            some = slice(at, at + rows)
            at += rows
            new = np.full((rows, int(n[some].max())), -1, np.int64)
            for i, (s, c) in enumerate(zip(start[some], n[some], strict=True)):
                new[i, :c] = src[s : s + c]
            every = np.concatenate([table[nodes[some]], new], 1)
            every[np.tril(every[:, :, None] == every[:, None, :], -1).any(2)] = -1  # peers that chose each other
            full = (every >= 0).sum(1) > width
            packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)[:, :width]
            if full.any():
                packed[full] = self._diverse(self.unit[nodes[some][full]], every[full], width)
            table[nodes[some]] = packed

    def _beam(self, q: np.ndarray, start: np.ndarray, lev: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest nodes that a beam of that width reaches from start, for all rows of q in step."""
        rows = max(1, min(self._rows(), STEP * BUILD_BEAM // width))
        if len(q) > rows:
            parts = [self._beam(q[i : i + rows], start[i : i + rows], lev, width) for i in range(0, len(q), rows)]
            return np.concatenate([i for i, _ in parts]), np.concatenate([s for _, s in parts])
        n, table = len(q), self.levels[lev]
        rows = np.arange(n)
        seen = np.zeros(n * len(table), bool)
        ids = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -2.0, np.float32)
        open_ = np.zeros((n, width), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", q, self.unit[start]), True
        seen[rows * len(table) + start] = True
        live = rows
        while len(live):
            best = np.argmax(open_[live], 1)  # a beam is sorted, so its first open node is its nearest
            near = table.take(ids[live, best], 0)
            open_[live, best] = False
            cell = np.flatnonzero(near >= 0)
            node = near.take(cell)
            row = live.take(cell // near.shape[1])
            mark = row * len(table) + node
            new = np.flatnonzero(~seen.take(mark))
            seen[mark.take(new)] = True
            cell, node, row = cell.take(new), node.take(new), row.take(new)
            s = np.einsum("ij,ij->i", q.take(row, 0), self.unit.take(node, 0))
            good = np.flatnonzero(s > sims[row, -1])
            if len(good):
                more = np.full(near.shape, -2.0, np.float32)
                more.put(cell.take(good), s.take(good))
                hit = np.flatnonzero((more > -2).any(1))
                to, more, more_ids = live.take(hit), more.take(hit, 0), near.take(hit, 0)
                all_ids, all_sims = np.concatenate([ids[to], more_ids], 1), np.concatenate([sims[to], more], 1)
                all_open = np.concatenate([open_[to], more > -2], 1)
                by = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
                ids[to], sims[to] = np.take_along_axis(all_ids, by, 1), np.take_along_axis(all_sims, by, 1)
                open_[to] = np.take_along_axis(all_open, by, 1)
            live = live[open_[live].any(1)]
        return np.where(sims > -2, ids, -1), sims

    def search(self, q: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row, nodes at or above threshold) of the rows that have any. A row whose beam holds nothing but such nodes searches again with
        one four times as wide, until its beam ends below the threshold or holds the whole shard."""
        q = np.ascontiguousarray(q, np.float32)
        start = np.zeros(len(q), np.int64)
        for lev in range(len(self.levels) - 1, 0, -1):
            start = self._beam(q, start, lev, 1)[0][:, 0]
        todo, width = np.arange(len(q)), min(beam, len(self.unit))
        while len(todo):
            later = []
            step = max(1, STEP * beam // width)
            for at in range(0, len(todo), step):
                some = todo[at : at + step]
                ids, sims = self._beam(q[some], start[some], 0, width)
                full = (sims[:, -1] >= threshold) & (width < len(self.unit))
                later.append(some[full])
                for k in np.flatnonzero(~full & (sims[:, 0] >= threshold)).tolist():
                    found = np.unique(ids[k][sims[k] >= threshold])
                    yield int(some[k]), found if self.given is None else self.given[found]
            todo, width = np.concatenate(later), min(4 * width, len(self.unit))


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vectors scaled to length 1 in double precision, as the bytes of their components; v is NULL for those that link with nothing."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()  # a NULL component is NaN
            dims = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            out: list[bytes | None] = [None] * len(dims)
            for dim in np.unique(dims[dims > 0]).tolist():
                rows = np.flatnonzero(dims == dim)
                x = flat[ends[rows][:, None] + np.arange(dim)]
                most = np.abs(x).max(1)
                good = np.isfinite(most) & (most > 0)
                x = x[good] / most[good, None]  # no overflow in the squares
                norm = np.zeros(len(x))
                for j in range(dim):
                    norm += x[:, j] * x[:, j]
                held = (x / np.sqrt(norm)[:, None] + 0.0).tobytes()  # 0.0 in place of -0.0
                for i, r in enumerate(rows[good].tolist()):
                    out[r] = held[i * 8 * dim : (i + 1) * 8 * dim]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(releasing(scale), T.StructType([rows.schema["id"], T.StructField("v", T.BinaryType())]))


def by_length(column: pa.Array, item: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(items, rows, matrix) for each length that binary values of the column have: which rows have it, and their items."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        held = column if len(rows) == len(column) else column.take(pa.array(rows))
        wide = np.int64 if pa.types.is_large_binary(held.type) else np.int32
        first = int(np.frombuffer(held.buffers()[1], wide)[held.offset])
        items = size // np.dtype(item).itemsize
        yield items, rows, np.frombuffer(held.buffers()[2], item, len(rows) * items, first).reshape(len(rows), items)


def shard_of(nodes: DataFrame, shards: int) -> DataFrame:
    return nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))


def drawn_level(node: Column) -> Column:
    """The highest level of a node in its graph: one node in LINKS of each level reaches the next."""
    u = (F.xxhash64(node, F.lit("level")) / F.lit(2.0**64) + F.lit(0.5)).cast("double")
    return F.least(F.lit(8), F.floor(-F.log(F.greatest(u, F.lit(2.0**-60))) / F.lit(float(np.log(LINKS))))).cast("int")


GRAPH = "shard int, at int, node long, copies long, v binary, links binary"


def build_graphs(nodes: DataFrame, shards: int) -> DataFrame:
    """(shard, at, node, copies, v, links): for each shard and vector length a graph, built once; a row for each of its nodes, in the order of
    `at`, and a row with the links of that node.

    A task is passed its shard's nodes by falling level. It sends the vectors on as they come and keeps them in single precision only, so it never
    holds a graph as one value, nor does the JVM.
    """
    schema = pa.schema([("shard", pa.int32()), ("at", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("v", pa.binary()), ("links", pa.binary())])

    def graphs(shard: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for dim in sorted(held):
            units, levels = held.pop(dim)
            n, level = sum(map(len, units)), np.concatenate(levels)
            unit, at = np.empty((n, dim), np.float32), 0
            while units:
                part = units.pop(0)
                unit[at : at + len(part)], at = part, at + len(part)
            world = SmallWorld(unit, level)
            for at in range(0, n, 4096):
                some = range(at, min(n, at + 4096))
                # The length of v tells the rows of one graph from those of another.
                rows = [[shard] * len(some), list(some), [None] * len(some), [dim] * len(some), [None] * len(some), [world.links(i) for i in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            of = batch.column("shard").to_numpy()
            for shard in np.unique(of).tolist():
                if shard != now:
                    yield from graphs(now, held)
                    now, held = shard, {}
                own = batch if (of == shard).all() else batch.filter(pa.array(of == shard))
                level, node, copies = (own.column(c).to_numpy() for c in ("level", "node", "copies"))
                for dim, rows, x in by_length(own.column("v"), np.float64):
                    units, levels = held.setdefault(dim, ([], []))
                    at = sum(map(len, units)) + np.arange(len(rows))
                    units.append(x.astype(np.float32))
                    levels.append(level[rows])
                    v = own.column("v") if len(rows) == len(own) else own.column("v").take(pa.array(rows))
                    columns = [np.full(len(rows), shard), at, node[rows], copies[rows], v, pa.nulls(len(rows), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        yield from graphs(now, held)

    dealt = shard_of(nodes.withColumn("level", drawn_level(F.col("node"))), shards).repartitionById(shards, "shard")
    return dealt.sortWithinPartitions("shard", F.desc("level"), "node").mapInArrow(releasing(build), GRAPH)


class Shard:
    """The graph of a shard over vectors of one length, as its rows come in, and the union-find of what its searches have linked so far.

    Vectors in double precision, which only verify what a search has found, lie in a temporary file without a name.
    """

    def __init__(self, dims: int):
        self.dims, self.n = dims, 0
        self.parts: list = []
        self.names, self.many, self.tables = [], [], {}
        self.file = tempfile.TemporaryFile()

    def add(self, name: np.ndarray, copies: np.ndarray, v: np.ndarray) -> None:
        self.file.write(v.tobytes())
        self.parts.append(v.astype(np.float32))
        self.names.append(name)
        self.many.append(copies)
        self.n += len(v)

    def join(self, links: np.ndarray) -> None:
        """links: rows of nodes that reach the same level."""
        self.tables.setdefault(links.shape[1], []).append(links.copy())

    def close(self) -> None:
        """All rows are in."""
        self.file.flush()
        self.base = np.memmap(self.file, np.float64, "r", shape=(self.n, self.dims))
        self.name, self.copies, self.root = np.concatenate(self.names), np.concatenate(self.many), np.arange(self.n)
        unit, at = np.empty((self.n, self.dims), np.float32), 0
        while self.parts:
            part = self.parts.pop(0)
            unit[at : at + len(part)], at = part, at + len(part)
        levels: list[list[np.ndarray]] = []
        for size in sorted(self.tables, reverse=True):  # nodes are in the order of falling levels, and so of falling numbers of links
            rows = self.tables.pop(size)
            for lev in range((size - LINKS) // LINKS):
                begin = LINKS * (lev + 1) if lev else 0
                if lev == len(levels):
                    levels.append([])
                levels[lev] += [r[:, begin : LINKS * (lev + 2)] for r in rows]
        self.world = SmallWorld.load(unit, [np.concatenate(t) for t in levels])

    def links(self, q: np.ndarray, names: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[int, int, list[int]]]:
        """(row, copies of all nodes at or above threshold, those nodes whose link to the row joins something new)."""
        for r, found in self.world.search(q, threshold - 1e-4, beam):
            found = found[self.name[found] != names[r]]
            found = found[self.base[found] @ q[r] >= threshold]
            if not len(found):
                continue
            roots = self.root[found]
            while (deeper := self.root[roots]).tolist() != roots.tolist():
                roots = deeper
            self.root[found] = roots
            apart, first = np.unique(roots, return_index=True)
            self.root[apart] = apart[0]
            yield r, int(self.copies[found].sum()), self.name[found[first]].tolist()


def near_links(nodes: DataFrame, graphs: DataFrame, shards: int, threshold: float, beam: int, parts: int = 0) -> DataFrame:
    """(a, near, b): for every node (a) and shard the copies of the shard's nodes with cosine >= threshold, verified in double,
    and with b links that connect whatever these do: at most a row a node and one a union of the shard's nodes.

    A graph goes to `parts` tasks, or as many as it takes to keep all shuffle partitions busy, but to no more than there are shards, so that
    graphs take about as much of the shuffle as nodes do; each node goes to one task a shard. Both are sorted so that the graph's vectors come first, then its links, and the nodes stream past it.
    """
    parts = parts or max(1, min(shards, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    index = graphs.select("shard", each(parts, "part"), F.col("links").isNotNull().cast("int").alias("kind"), "at", "node", "copies", F.coalesce("v", "links").alias("v"))
    asked = nodes.select("node", "v", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    asked = asked.select(each(shards, "shard"), "part", F.lit(2).alias("kind"), F.lit(None).cast("int").alias("at"), "node", F.lit(None).cast("long").alias("copies"), "v")
    dealt = index.unionByName(asked).withColumn("to", F.col("shard") * F.lit(parts) + F.col("part")).repartitionById(shards * parts, "to")
    dealt = dealt.sortWithinPartitions("to", "kind", "at").select("to", "kind", "node", "copies", "v")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, closed = None, {}, False
        for batch in batches:
            to, kind = batch.column("to").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(to) | np.diff(kind)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(to)], strict=True):
                own = batch.slice(begin, end - begin)
                if to[begin] != now:
                    now, held, closed = to[begin], {}, False
                if kind[begin] == 1:
                    dims = own.column("copies").to_numpy()
                    for dim in np.unique(dims).tolist():
                        for _, _, links in by_length(own.column("v").filter(pa.array(dims == dim)), np.int32):
                            held[dim].join(links)
                    continue
                if kind[begin] == 2 and not closed:
                    closed = True
                    for shard in held.values():
                        shard.close()
                names = own.column("node").to_numpy()
                for dim, rows, x in by_length(own.column("v"), np.float64):
                    if kind[begin] == 0:
                        if dim not in held:
                            held[dim] = Shard(dim)
                        held[dim].add(names[rows], own.column("copies").to_numpy()[rows], x)
                    elif dim in held:
                        out = [(names[rows[r]], near if i == 0 else 0, b) for r, near, news in held[dim].links(x, names[rows], threshold, beam) for i, b in enumerate(news)]
                        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["a", "near", "b"])

    return dealt.mapInArrow(releasing(stream), "a long, near long, b long")


#: The audit asks so many random vectors and so many that a link was found for, from either of its ends; recall counts as measured from LINKS_SEEN true
#: links on.
RANDOM_PROBES, LINKED_PROBES, LINKS_SEEN = 1024, 4096, 20
#: From so many nodes on, random probes choose the beam that all vectors search with first.
PILOT_FROM = 64 * RANDOM_PROBES


def _first(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(n)


def first_beam(nodes: DataFrame, graphs: DataFrame, shards: int, threshold: float, beam: int, recall: float, n: int) -> int:
    """The narrowest of beam, 2 beam, ... with which the audit's random probes reach `recall`, so that all vectors need not search with one that the
    audit would turn down; beam itself where the probes see fewer than LINKS_SEEN true links."""
    probes = written(_first(nodes.select("node", "v"), RANDOM_PROBES), "vector-probes")
    held = probes.toPandas()
    true = {r["a"]: r["true"] for r in _true_counts(nodes, held["node"].to_numpy(np.int64), [bytes(v) for v in held["v"]], threshold).collect()}
    while sum(true.values()) >= LINKS_SEEN and beam < n:
        near = {r["a"]: r["near"] for r in near_links(probes, graphs, shards, threshold, beam, 1).groupBy("a").agg(F.sum("near").alias("near")).collect()}
        if sum(min(1.0, near.get(a, 0) / t) for a, t in true.items()) >= recall * len(true):
            break
        beam *= 2
    return beam


def audit(nodes: DataFrame, near: DataFrame, threshold: float) -> tuple[float | None, int]:
    """(recall, true links seen) of the counts `near` (a, near, b) against brute force over all nodes; recall is averaged over the probes that have
    a true link, None if none has.

    Where links are rare random probes see none, so the ends of links that were found are probed as well: a node that another one's search
    has found tells whether its own search found that one. Found links are verified, so a count falls short by what was missed.
    """
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    asked = _first(nodes.select("node"), RANDOM_PROBES).unionByName(_first(ends, LINKED_PROBES)).distinct()
    held = nodes.join(asked, "node", "left_semi").select("node", "v").toPandas()  # at most 5,120 rows
    truth = _true_counts(nodes, held["node"].to_numpy(np.int64), [bytes(v) for v in held["v"]], threshold)
    rows = truth.join(near.groupBy("a").agg(F.sum("near").alias("near")), "a", "left").select("true", F.coalesce("near", F.lit(0)).alias("near")).collect()
    return sum(min(1.0, r["near"] / r["true"]) for r in rows) / len(rows) if rows else None, sum(r["true"] for r in rows)


def _true_counts(nodes: DataFrame, names: np.ndarray, vectors: list[bytes], threshold: float) -> DataFrame:
    """(a, true): for each probe that has any, the copies of the other nodes with cosine >= threshold."""

    probes = {d: [i for i, v in enumerate(vectors) if len(v) == 8 * d] for d in {len(v) // 8 for v in vectors}}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            for dim, rows, x in by_length(batch.column("v"), np.float64):
                if dim not in probes:
                    continue
                mine = names[probes[dim]]
                asked, total = np.stack([np.frombuffer(vectors[i]) for i in probes[dim]]).T, np.zeros(len(mine), np.int64)
                for at in range(0, len(rows), 1000):  # at most 1,000 rows by all probes at once
                    r, c = np.nonzero(x[at : at + 1000] @ asked >= threshold)
                    some = rows[at : at + 1000][r]
                    np.add.at(total, c, np.where(node[some] != mine[c], copies[some], 0))
                yield pa.RecordBatch.from_arrays([pa.array(mine[total > 0]), pa.array(total[total > 0])], ["a", "true"])

    return nodes.mapInArrow(releasing(count), "a long, true long").groupBy("a").agg(F.sum("true").alias("true"))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_mb: int = 128,
    least_shards: int = 6,
    beam: int = 24,
    recall: float = 0.97,
) -> DataFrame:
    """(id, n_links, component_id, kept, audited_recall, audited_links) for every row of vectors.

    Rows with the same direction are one node of the graphs, so that copies of one vector cost nothing; they link with each
    other and share their node's links. NULL, zero and non-finite vectors link with nothing. Vectors of different length
    never link. Beams double until an audit that has seen LINKS_SEEN true links finds `recall` of them, or, where there are too few
    links to measure, until a beam twice as wide finds no link more than the one before; from PILOT_FROM nodes on, random probes choose the first beam. audited_recall is what the last audit found (NULL
    where no probe had a link), from audited_links true links. A pair at the threshold counts. Components are joined over nodes; the smallest id names them. A NULL id is a row that links
    like any other but names no component unless all ids of it are NULL; repeated rows and ids are rows each for itself. A
    shard holds shard_mb of vectors, so every vector is sent to all vectors / shard_mb shards.
    """
    units = written(unit_vectors(vectors, id_col, vec_col), "unit-vectors", GROUPS)
    good = units.where("v IS NOT NULL")
    nodes = written(good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes", GROUPS)
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("v")), F.lit(0)).alias("bytes")).first()
    n, shards = int(size["n"]), max(least_shards, -(-int(size["bytes"]) // (shard_mb << 20)))
    graphs = written(build_graphs(nodes.select("node", "v", "copies"), shards), "vector-graphs", GROUPS)
    if n >= PILOT_FROM:
        beam = first_beam(nodes, graphs, shards, threshold, beam, recall, n)
    before = None
    while True:
        links = written(near_links(nodes.select("node", "v"), graphs, shards, threshold, beam), "vector-links")
        total = links.agg(F.coalesce(F.sum("near"), F.lit(0))).first()[0]
        found, seen = audit(nodes, links, threshold)
        enough = found is None or found >= recall
        if beam >= n or (enough and (seen >= LINKS_SEEN or total == before)):
            break
        beam, before = 2 * beam, total
    groups = connected_components(links)
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("near").alias("near"))
    key = F.sha2("v", 256).alias("key")  # rows find their node by it
    placed = nodes.select(key, "node", "least", "copies").join(groups, "node", "left").join(degree, "node", "left")
    placed = written(placed.select("key", "least", "copies", F.coalesce("component", "node").alias("label"), F.coalesce("near", F.lit(0)).alias("near")), "vector-placed")
    named = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = placed.join(named, "label").select("key", "component_id", (F.col("near") + F.col("copies") - 1).alias("n_links"))
    linked = good.select("id", key).join(by_node, "key").select("id", "n_links", "component_id")
    alone = units.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumns({"kept": F.col("id").eqNullSafe(F.col("component_id")), "audited_recall": F.lit(found).cast("double"), "audited_links": F.lit(seen).cast("long")})
