"""Approximate nearest neighbours: navigable small-world graphs per shard, and merged answers.

Vectors are dealt into shards by a hash. A task builds a shard's hierarchical graphs and keeps them as flat arrays (a row
of neighbour numbers a node and layer) in a file of the shared folder. Then each group of TASK_SHARDS shards and each part of
the queries (ASKED_ROWS or so) are a task: it searches many queries at a time, descends through the sparse layers, then
does a best-first search of width EF on the full one (WIDER times as wide among near copies). Equal vectors are one node. A task merges the answers of its shards (and
keeps HELD_BYTES of graphs at most) before anything is shuffled; a window over each query merges those of all groups. Scores are
inner products in double precision on the original vectors. All shards are searched through their graphs, whatever their size.

A node is linked, in a random order, to those of its EF_BUILD nearest predecessors in the shard that spread. These are found by
products of blocks of vectors, which for SHARD_ROWS is faster than to search the unfinished graph, and exact.

For largest inner products, a shard has a graph for each band of lengths, in which none is BAND times another. A graph
links vectors that are near in direction, where lengths can't outweigh it (they are one small component more, so that vectors of
one direction are linked by length), and is searched by inner product. Bands are
searched from the longest down; one whose length times the query's is below the k-th best score so far holds no
answer, and neither do those after it.

SHARD_ROWS bounds what one graph takes. Only vectors (once), queries (once a group of shards) and answers (k a query and
group) are shuffled. Work is queries x shards x log(rows of a shard), in as many tasks as there are parts and groups.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows of
null id; vectors meet only vectors of as many components; a query's own id is never among its answers, so rows that
repeat an id aren't each other's answers, and an id of several vectors counts with its best score, as a candidate and
as a query; ties go to smaller ids; repeated rows count once and take no memory; a vector that a third of all rows
share is one node of each shard, and the vectors of one id are dealt like others; vectors may be as long as an Arrow
batch; empty tables give no rows; only the two named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateroll.llm.common import column, file_system, shared_dir, table, written

K = 20
#: Links of a node on an upper layer (twice as many on the lowest), and the widths of searches: while building, and for answers.
LINKS, EF_BUILD, EF = 16, 80, 250
#: A search whose last score differs from its k-th by no more than this part is among near copies, and is done again so many times as wide.
DENSE, WIDER = 1e-3, 8
#: Vectors of one shard, and shards at least (so that a small table still has several tasks).
SHARD_ROWS, LEAST_SHARDS = 20_000, 6
#: How many times as long the longest vector of a graph may be as the shortest, and what part a length has in nearness for links.
BAND, LENGTH = 1.5, 0.3
#: How much nearer to a chosen link a candidate must be than to the node, to be left out.
ALPHA = np.float32(1.05)
#: Shards of one task, and bytes of graphs that it holds at most (one shard at least).
TASK_SHARDS, HELD_BYTES = 8, 256 << 20
#: Queries of one task, about, and tasks at least.
ASKED_ROWS, LEAST_TASKS = 1_000, 24
#: Bytes of the arrays of a step, links added to a node at a time, queries searched at a time, and nodes of each that a step takes.
STEP_BYTES, ADDED, AT_A_TIME, AT_ONCE = 8 << 20, 64, 128, 6
#: How far equal nearness is drawn apart while building (some units of single precision's last place), and lots in store.
LOT, LOTS = np.float32(2.0**-21), 4096
_NONE = np.int64(0x7FFFFFFFFFFFFFFF)


def _keys(scores: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Scores and nodes as whole numbers that sort nearest first, ties to smaller nodes; the last bit is left for a mark."""
    bits = scores.view(np.int32)
    return (~(bits ^ ((bits >> 31) & 0x7FFFFFFF))).astype(np.int64) << 32 | nodes.astype(np.int64) << 1


def _unkeyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = ~(keys >> 32).astype(np.int32)
    return (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.float32), (keys >> 1 & 0x7FFFFFFF).astype(np.int64)


def _places(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted row numbers below n: how many each row has, and each one's place in its row."""
    many = np.bincount(of, minlength=n)
    return many, np.arange(len(of)) - (np.cumsum(many) - many)[of]


def _spread(x: np.ndarray, near: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first (-1: none), those that are nearer to its node than to any chosen before; filled up with the nearest others."""
    out = np.full((len(near), most), -1, np.int32)
    n, c = near.shape
    step = max(1, STEP_BYTES // (4 * c * (c + x.shape[1])))
    for s in range(0, n, step):
        some, score = near[s : s + step], scores[s : s + step]
        there = some >= 0
        bar = 1 - (1 - score) / ALPHA
        v = x.take(np.maximum(some, 0), 0)
        own = v @ v.transpose(0, 2, 1)
        free, chosen, left = there.copy(), np.zeros(there.shape, bool), np.full(len(some), most)
        for k in range(c):
            take = free[:, k] & (left > 0)
            chosen[:, k] = take
            left -= take
            free &= ~(take[:, None] & (own[:, k] > bar))
        order = np.argsort(np.where(chosen, 0, np.where(there, c, 2 * c)) + np.arange(c), axis=1)[:, :most]
        out[s : s + step, : order.shape[1]] = np.take_along_axis(np.where(there, some, -1), order, 1)
    return out


def _linked(x: np.ndarray, width: int, ef: int, rng: np.random.Generator) -> np.ndarray:
    """Links of the nodes of one layer, which come in the order of x; -1 fills up.

    A node is linked to LINKS of its ef nearest predecessors, found by products of blocks, and these to it. A node that
    gets more than width links keeps those that spread, as they come. What single precision can't tell is drawn by lot: else
    the same few of many would get all links, and the others none.
    """
    n = len(x)
    lots = sliding_window_view(LOT * rng.random(n + LOTS, np.float32), n)
    near = np.full((n, width), -1, np.int32)
    at = 1
    while at < n:
        end = min(n, at + max(1, min(at, STEP_BYTES // (4 * at))))
        scores = x[at:end] @ x[:end].T + lots[rng.integers(0, LOTS, end - at), :end]
        scores[:, at:][np.triu_indices(end - at)] = -np.inf
        found = np.argpartition(scores, end - ef, axis=1)[:, end - ef :] if end > ef else np.broadcast_to(np.arange(end), scores.shape)
        got = np.take_along_axis(scores, found, 1)
        order = np.argsort(-got, axis=1, kind="stable")
        found, got = np.take_along_axis(found, order, 1), np.take_along_axis(got, order, 1)
        near[at:end, :LINKS] = _spread(x, np.where(got > -np.inf, found, -1), got, LINKS)
        at = end
    node, place = np.nonzero(near >= 0)
    to = near[node, place]
    order = np.argsort(to, kind="stable")
    to, node = to[order], node[order]
    many = np.bincount(to, minlength=n)
    at, end = np.cumsum(many) - many, np.cumsum(many)
    step = max(1, STEP_BYTES // (4 * (width + ADDED) * x.shape[1]))
    while len(full := np.flatnonzero(at < end)):
        for s in range(0, len(full), step):
            some = full[s : s + step]
            which = at[some, None] + np.arange(ADDED)
            new = np.where(which < end[some, None], node[np.minimum(which, len(node) - 1)], -1)
            both = np.concatenate([near[some], new], 1)
            score = (x.take(np.maximum(both, 0), 0) @ x[some][:, :, None])[:, :, 0] + LOT * rng.random(both.shape, np.float32)
            score[both < 0] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")
            both, score = np.take_along_axis(both, order, 1), np.take_along_axis(score, order, 1)
            over = both[:, width] >= 0
            near[some[~over]] = both[~over, :width]
            near[some[over]] = _spread(x, both[over], score[over], width)
        at[full] += ADDED
    return near


class Graph:
    """A hierarchical navigable small-world graph over rows of equal length; nearness is the inner product.

    Nodes come in a random order, each layer has a sixteenth of the nodes of the one below. Many queries are searched at a
    time: a step takes the best open nodes of each, and scores the neighbours that it has not met.
    """

    def __init__(self, x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 1) -> None:
        n = len(x)
        self.x = np.ascontiguousarray(x, np.float32)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64), 8)
        order = rng.permutation(n)
        #: Of each layer a node's row (n: none) and its neighbours (n: none).
        self.row, self.near = [], []
        for layer in range(int(level.max()) + 1):
            nodes = order[level[order] >= layer]
            near = _linked(self.x[nodes], (1 + (layer == 0)) * links, ef, rng)
            row = np.full(n, n, np.int32)
            row[nodes] = np.arange(len(nodes))
            self.row.append(row)
            self.near.append(np.where(near >= 0, nodes[near], n).astype(np.int32))
        self.enter = int(nodes[0])
        self.near[0] = self.near[0][self.row.pop(0)]

    @property
    def bytes(self) -> int:
        return self.x.nbytes + sum(a.nbytes for a in (*self.near, *self.row))

    def _descended(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the node where greedy steps through the upper layers end, and its score."""
        at = np.full(len(q), self.enter)
        best = q @ self.x[self.enter]
        for row, near in zip(self.row[::-1], self.near[:0:-1], strict=True):
            live = np.arange(len(q))
            while len(live):
                to = near[row[at[live]]]
                there = to < len(self.x)
                s = np.where(there, (self.x[np.where(there, to, 0)] @ q[live][:, :, None])[:, :, 0], -np.inf)
                k = s.argmax(1)
                s, to = s[np.arange(len(k)), k], to[np.arange(len(k)), k]
                better = s > best[live]
                live = live[better]
                at[live], best[live] = to[better], s[better]
        return at, best

    def nearest(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes that each query's best-first search meets, nearest first (-1: no more), and their scores."""
        n = len(self.x)
        pool = np.full((len(q), ef), _NONE)
        at, best = self._descended(q)
        pool[:, 0] = _keys(best, at)
        seen = np.zeros(len(q) * (n + 1), bool)
        seen[n :: n + 1] = True
        seen[np.arange(len(q)) * (n + 1) + at] = True
        out, live = pool.copy(), np.arange(len(q))
        while len(live):
            todo = (pool & 1) == 0
            nth = todo.cumsum(1, dtype=np.int32)
            if not (on := nth[:, -1] > 0).all():
                out[live[~on]] = pool[~on]
                live, pool, todo, nth = live[on], pool[on], todo[on], nth[on]
            row, place = np.nonzero(todo & (nth <= AT_ONCE))
            near = self.near[0].take(pool[row, place] >> 1 & 0x7FFFFFFF, 0)
            pool[row, place] |= 1
            met = ((live[row] * (n + 1))[:, None] + near).ravel()
            new = np.flatnonzero(~seen.take(met))
            met, near, row = met.take(new), near.ravel().take(new), row.take(new // near.shape[1])
            seen[met] = True
            key = _keys(np.einsum("ij,ij->i", self.x.take(near, 0), q.take(live.take(row), 0)), near)
            better = np.flatnonzero(key < pool[:, -1].take(row))
            better = better[np.unique(met.take(better), return_index=True)[1]]  # a node may be met twice in a step
            key, row = key.take(better), row.take(better)
            if len(key):
                many, place = _places(row, len(live))
                more = np.full((len(live), many.max()), _NONE)
                more[row, place] = key
                pool = np.sort(np.concatenate([pool, more], 1), axis=1)[:, :ef]
        scores, nodes = _unkeyed(out)
        return np.where(out == _NONE, -1, nodes), scores


def _lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _scaled(x: np.ndarray, most: float | np.ndarray) -> np.ndarray:
    """x in single precision, divided by the power of two that is next above its greatest length, which rounds nothing."""
    return np.ldexp(x.astype(np.float64), -np.frexp(most)[1]).astype(np.float32)


def _widened(graph: Graph, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """As Graph.nearest (a score without node is least), but WIDER times as wide where the whole search has met hardly any difference."""
    nodes, near = graph.nearest(q, ef)
    near = np.where(nodes < 0, -np.inf, near)
    dense = np.flatnonzero(near[:, -1] > near[:, k] - DENSE * np.abs(near[:, k]))
    if len(dense):
        more = ((0, 0), (0, (WIDER - 1) * ef))
        nodes, near = np.pad(nodes, more, constant_values=-1), np.pad(near, more, constant_values=-np.inf)
        step = max(1, AT_A_TIME // WIDER)
        for s in range(0, len(dense), step):
            some = dense[s : s + step]
            nodes[some], near[some] = graph.nearest(q[some], WIDER * ef)
        near[nodes < 0] = -np.inf
    return nodes, near


class Shard:
    """Vectors of as many components with their ids, and a graph over the different ones of each band of lengths."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x + 0)  # zeros have one sign
        _, first, node = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        self.ids, node = ids[order], node.ravel()[order]
        again = np.r_[False, (node[1:] == node[:-1]) & (self.ids[1:] == self.ids[:-1])]
        self.ids, node = self.ids[~again], node[~again]
        self.start = np.searchsorted(node, np.arange(len(first) + 1))
        self.several = len(np.unique(self.ids)) < len(self.ids)  # some id has several vectors
        self.x = x[first]
        length = _lengths(self.x)
        by_length = np.argsort(-length, kind="stable")
        #: Of each band the greatest length, its nodes and their graph.
        self.bands: list[tuple[float, np.ndarray, Graph]] = []
        at = 0
        while at < len(by_length):
            most = float(length[by_length[at]])
            end = max(at + 1, int(np.searchsorted(-length[by_length], -most / BAND, "right")))
            nodes = by_length[at:end]
            relative = LENGTH * length[nodes, None] / most
            direction = self.x[nodes] / length[nodes, None]
            graph = Graph(np.concatenate([direction * np.sqrt(1 - relative**2), relative], 1))  # links by direction, then by length
            graph.x = _scaled(self.x[nodes], most)  # searches by inner product
            self.bands.append((most, nodes, graph))
            at = end

    @property
    def bytes(self) -> int:
        return self.x.nbytes + self.ids.nbytes + self.start.nbytes + sum(nodes.nbytes + g.bytes for _, nodes, g in self.bands)

    def answers(self, own: int, q: np.ndarray, k: int, ef: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids, the query's own left out, and their scores, best first; those below `least` may be missing."""
        return self.answers_of(np.array([own]), q[None], k, ef, np.array([least]))[1:]

    def answers_of(self, own: np.ndarray, q: np.ndarray, k: int, ef: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The answers of many queries: the query's place, id and score, by place and best first."""
        size = _lengths(q)
        asked, least, ef = _scaled(q, size[:, None]), least.copy(), max(ef, k + 1)
        rounding = 2.0**-22 * (q.shape[1] + 4)  # of single precision, where lengths are 1 at most
        all_ = _NO_ANSWERS
        for most, members, graph in self.bands:
            live = np.flatnonzero(most * size * (1 + 1e-9) >= least)
            if not len(live):
                break
            step = max(1, min(AT_A_TIME, STEP_BYTES // len(members), STEP_BYTES // (4 * AT_ONCE * LINKS * q.shape[1])))
            for s in range(0, len(live), step):
                some = live[s : s + step]
                nodes, near = _widened(graph, asked[some], k, ef)
                # unless ids have several vectors, the k + 1 nearest nodes hold all answers, as one may be the query's own
                enough = -np.inf if self.several else near[:, k, None] - rounding
                row, place = np.nonzero((nodes >= 0) & (near >= enough))
                node, row = members[nodes[row, place]], some[row]
                got = (self.x[node].astype(np.float64) * q[row]).sum(1)
                good = got >= least[row]
                node, row, got = node[good], row[good], got[good]
                # a node's smallest k + 1 ids decide, as ties go to smaller ids and one of them may be the query
                many = np.minimum(self.start[node + 1] - self.start[node], k + 1)
                each = np.repeat(np.arange(len(node)), many)
                new = self.ids[self.start[node][each] + np.arange(len(each)) - (np.cumsum(many) - many)[each]]
                each, new = each[new != own[row[each]]], new[new != own[row[each]]]
                all_ = best(*(np.concatenate(c) for c in zip(all_, (row[each], new, got[each]), strict=True)), k)
            least = np.maximum(least, kth(*all_, k, len(q)))
        return all_


_NO_ANSWERS = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, each id once with its best score, ties to smaller ids."""
    order = np.lexsort((-scores, ids, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.r_[True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])][: len(rows)]
    rows, ids, scores = rows[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    kept = _places(rows, int(rows.max()) + 1 if len(rows) else 0)[1] < k
    return rows[kept], ids[kept], scores[kept]


def kth(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, n: int) -> np.ndarray:
    """The score of the k-th answer of each of n rows, whose answers are best first."""
    out = np.full(n, -np.inf)
    last = _places(rows, n)[1] == k - 1
    out[rows[last]] = scores[last]
    return out


def _vectors(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _built(folder: str):
    """Over rows (shard, size, id, vector) that lie in this order: the names of the files of their graphs (shard, size, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if ids:
                store, base = file_system(folder)
                store.create_dir(base, recursive=True)
                name = uuid.uuid4().hex  # a new one each time, so that a task run twice overwrites nothing
                with store.open_output_stream(f"{base}/{name}") as out:
                    pickle.dump(Shard(np.concatenate(ids), np.concatenate(vectors)), out, protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([name])], names=["shard", "size", "name"])

        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("shard", "size")], 1)
            cuts = np.r_[0, np.flatnonzero((now[1:] != now[:-1]).any(1)) + 1, len(now)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(now[s]) != key:
                    yield from done()
                    key, ids, vectors = tuple(now[s].tolist()), [], []
                part = b.slice(s, e - s)
                own, x = part.column("id").to_numpy(), _vectors(part.column("vector"))
                new = np.r_[True, (own[1:] != own[:-1]) | (x[1:] != x[:-1]).any(1)]  # repeated rows lie together
                if ids and own[0] == ids[-1][-1] and (x[0] == vectors[-1][-1]).all():
                    new[0] = False
                if new.any():
                    ids.append(own[new])
                    vectors.append(x[new])
        yield from done()

    return run


_HELD: OrderedDict[str, Shard] = OrderedDict()


def held(folder: str, name: str, most: int) -> Shard:
    """A shard's file; those used last stay in memory, most bytes of them."""
    if name not in _HELD:
        store, base = file_system(folder)
        with store.open_input_stream(f"{base}/{name}") as source:
            got = pickle.loads(source.read())
        while _HELD and sum(x.bytes for x in _HELD.values()) + got.bytes > most:
            _HELD.popitem(last=False)
        _HELD[name] = got
    _HELD.move_to_end(name)
    return _HELD[name]


def _answered(k: int, ef: int, folder: str):
    """Over queries (names of shards, with blanks between, id, vector): their answers in these shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = pc.dictionary_encode(b.column("names"))
            for code, names in enumerate(of.dictionary.to_pylist()):
                part = b.filter(pc.equal(of.indices, code))
                own, q = part.column("id").to_numpy(), _vectors(part.column("vector")).astype(np.float64)
                found = _NO_ANSWERS
                for name in names.split():
                    new = held(folder, name, HELD_BYTES).answers_of(own, q, k, ef, kth(*found, k, len(q)))
                    found = best(*(np.concatenate(c) for c in zip(found, new, strict=True)), k)
                row, ids, scores = found
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, ef: int = EF) -> DataFrame:
    """Of each query its k nearest found, by largest inner product: query_id, rank (from 1), vec_id, score."""
    v = column(vector_col)
    fit = column(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    take = lambda df: df.where(fit).select(column(id_col).cast("long").alias("id"), v.alias("vector"), F.size(v).alias("size"))
    base, asked, folder = take(vectors), take(queries), shared_dir(vectors.sparkSession)
    n = max(LEAST_SHARDS, -(-base.count() // SHARD_ROWS))
    rows = base.select(F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int").alias("shard"), "size", "id", "vector")
    dealt = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "size", "id", F.xxhash64("vector"))
    built = written(dealt.mapInArrow(_built(folder), "shard int, size int, name string"))
    groups = -(-n // TASK_SHARDS)
    group = F.floor(F.col("shard") * groups / n).cast("int").alias("group")
    names = built.groupBy(group, "size").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))
    # each group of shards meets each part of the queries in a task of its own
    parts = max(-(-LEAST_TASKS // groups), -(-asked.count() // ASKED_ROWS))
    task = F.col("group") * parts + F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int")
    meeting = asked.join(names, "size").repartitionById(groups * parts, task).select("names", "id", "vector")
    found = meeting.mapInArrow(_answered(k, ef, folder), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
