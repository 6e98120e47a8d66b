"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are turned into integers first, floor(scale * x), so scores are exact. Each task reads its rows in shards of
`SHARD_ROWS` and builds a ball tree on each (split at the median of the direction between two far points) once; trees, and the queries in
blocks of `BLOCK_QUERIES`, are files in the shared folder, so neither the driver nor a broadcast holds any of them. No point of
a node scores more than <q, centre> + |q| * radius, so nodes below a query's current kth score are cut, level by level, and the
leaves are visited in the order of their bound. The kth score is shared: a task carries it from tree to tree, and between tasks it
goes in two waves: one shard in `FIRST_WAVE` is searched first, and the kth scores merged from there bound the search of the others.

Scores are computed in floating point where all products and sums are below 2**53, and so exact, else in 64-bit integers, exact where
the score fits a long. Defined cases: a vector that is null or empty or holds a null or a non-finite component, and a row without an id,
takes no part; vectors are compared with those of their own length only; rows that share the query's id are its own; of
several rows with one query id the smallest vector is the query; repeated candidates count each; ties go to the
smaller id; fewer candidates than k give fewer rows; further columns are ignored; a component whose scaled value leaves the
range of a long is cut to it.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import discard, work_folder, written

SHARD_ROWS = 8_192
LEAF_ROWS = 128
BLOCK_QUERIES = 4_096
#: Trees that a task holds at a time.
HELD_TREES = 8
FIRST_WAVE = 8
_NONE = np.iinfo(np.int64).min


@dataclass
class BallTree:
    points: np.ndarray  # int64, rows in leaf order
    ids: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # centres, radii, row bounds of the nodes of each level

    @classmethod
    def build(cls, ints: np.ndarray, ids: np.ndarray) -> BallTree:
        points = ints.astype(np.float64)
        order = np.arange(len(points))
        bounds = [0, len(points)]
        levels = []
        while True:
            centres = np.array([points[order[a:b]].mean(0) for a, b in zip(bounds, bounds[1:])])
            radii = np.array([np.sqrt(((points[order[a:b]] - c) ** 2).sum(1).max()) for a, b, c in zip(bounds, bounds[1:], centres)])
            levels.append((centres, radii, np.array(bounds)))
            if max(b - a for a, b in zip(bounds, bounds[1:])) <= LEAF_ROWS:
                return cls(ints[order], ids[order], levels)
            cut = [0]
            for a, b, c in zip(bounds, bounds[1:], centres):
                part = points[order[a:b]]
                far = part[((part - c) ** 2).sum(1).argmax()]
                other = part[((part - far) ** 2).sum(1).argmax()]
                order[a:b] = order[a:b][np.argsort(part @ (far - other), kind="stable")]
                cut += [(a + b) // 2, b]  # both halves hold rows, as every node of a level has 2 at least
            bounds = cut

    def search(self, ints: np.ndarray, q_ids: np.ndarray, best: Best) -> None:
        q = ints.astype(np.float64)
        points = self.points.astype(np.float64)
        exact = q.shape[1] * np.abs(q).max(initial=0) * np.abs(points).max(initial=0) < 2**53
        norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        who = np.arange(len(q))
        node = np.zeros(len(q), int)
        for depth, (centres, radii, _) in enumerate(self.levels):
            if depth:  # both children of every pair that is left
                who, node = np.repeat(who, 2), (2 * node[:, None] + [0, 1]).ravel()
            reach = np.sqrt((centres * centres).sum(1)) + radii
            bound = _dots(q, who, centres, node) + norm[who] * radii[node] + 1e-9 * norm[who] * reach[node] + 1
            keep = bound >= best.kth[who]  # an equal score may have a smaller id
            who, node, bound = who[keep], node[keep], bound[keep]
        rows = self.levels[-1][2]
        order = np.lexsort((-bound, who))
        who, node, bound = who[order], node[order], bound[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        for t in range(turn.max() + 1 if len(turn) else 0):  # each query's t-th best leaf
            now = np.flatnonzero((turn == t) & (bound >= best.kth[who]))
            if len(now) == 0:
                continue
            for leaf in np.unique(node[now]):
                w = who[now[node[now] == leaf]]
                a, b = rows[leaf], rows[leaf + 1]
                scores = (q[w] @ points[a:b].T).astype(np.int64) if exact else ints[w] @ self.points[a:b].T
                best.offer(w, scores, self.ids[a:b], q_ids[w])


def _dots(q: np.ndarray, who: np.ndarray, centres: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.empty(len(who))
    for at in range(0, len(who), 16_384):
        part = slice(at, at + 16_384)
        out[part] = np.einsum("ij,ij->i", q[who[part]], centres[node[part]])
    return out


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), _NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, _NONE) if floor is None else floor
        self.kth = self.floor.copy()

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        k = self.score.shape[1]
        scores = np.where(ids[None, :] == own[:, None], _NONE, scores)
        hit = np.flatnonzero(((scores >= self.kth[who][:, None]) & (scores > _NONE)).any(1))
        if len(hit) == 0:
            return
        who, scores = who[hit], scores[hit]
        all_scores = np.hstack([self.score[who], scores])
        all_ids = np.hstack([self.id[who], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~x falls as x rises, without overflow
        self.score[who] = np.take_along_axis(all_scores, order, 1)
        self.id[who] = np.take_along_axis(all_ids, order, 1)
        self.kth[who] = np.maximum(self.floor[who], self.score[who, -1])


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id and v, array<long>, of the rows that take part."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    # the condition holds null vectors back too, as size() of null is not above 0
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _files(rows: DataFrame, folder: str, size: int, pack) -> DataFrame:
    """Rows (id, v, ...) of each task in files of up to `size` rows of one length, packed by `pack(vectors, ids, rest)`: dim, path. A
    task that runs again writes other files; only those of the run that counts are in the table."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        waiting: dict[int, list[pa.RecordBatch]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting.pop(dim)).combine_chunks()
            columns = [t.column(k).combine_chunks() for k in range(t.num_columns)]
            path = f"{root}/{uuid.uuid4().hex}"
            with fs.open_output_stream(path) as f:
                f.write(pickle.dumps(pack(_matrix(columns[1]), columns[0].to_numpy(), [c.to_numpy(zero_copy_only=False) for c in columns[2:]])))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "path": pa.array([path])})

        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1))
            for dim in pa.compute.unique(sizes).to_pylist():
                mine = batch.filter(pa.compute.equal(sizes, dim))
                while mine.num_rows:
                    room = size - sum(b.num_rows for b in waiting.get(dim, []))
                    waiting.setdefault(dim, []).append(mine.slice(0, room))
                    mine = mine.slice(room)
                    if sum(b.num_rows for b in waiting[dim]) >= size:
                        yield flush(dim)
        for dim in list(waiting):
            yield flush(dim)

    return rows.mapInArrow(run, "dim int, path string")


def top_k(vectors: DataFrame, query_rows, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row that `query_rows`, a condition, selects."""
    folder = work_folder(vectors.sparkSession)
    candidates = integer_vectors(vectors, scale)
    shards = written(_files(candidates, f"{folder}/trees", SHARD_ROWS, lambda v, ids, _: BallTree.build(v, ids)), "shards")
    queries = written(integer_vectors(vectors.where(query_rows), scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    first = F.pmod(F.xxhash64("path"), F.lit(FIRST_WAVE)) == 0
    none = F.lit(_NONE).cast("long").alias("floor")
    early = _search(shards.where(first), queries.select("id", "v", none), f"{folder}/blocks-1", k)
    kth = early.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = queries.join(kth, "id", "left").select("id", "v", F.coalesce("floor", none).alias("floor"))
    late = _search(shards.where(~first), bounded, f"{folder}/blocks-2", k)
    out = _best(early.drop("rank").unionByName(late.drop("rank")), k)
    discard(queries)
    return out


def _best(hits: DataFrame, k: int) -> DataFrame:
    # Spark limits each map task's groups to k rows before the shuffle
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return written(hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")


def _search(shards: DataFrame, queries: DataFrame, folder: str, k: int) -> DataFrame:
    """The k best of the points in shards for each of queries (id, v, floor), from the floor on."""
    spark = shards.sparkSession
    blocks = _files(queries, folder, BLOCK_QUERIES, lambda v, ids, rest: (v, ids, rest[0])).collect()  # a path for each block of queries
    of_dim: dict[int, list[str]] = {}
    for r in sorted(blocks):
        of_dim.setdefault(r["dim"], []).append(r["path"])
    n = shards.count()

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)

        def load(path: str):
            with fs.open_input_stream(path) as f:
                return pickle.loads(f.read())

        for batch in batches:
            found: dict[int, list[str]] = {}
            for dim, path in zip(*[c.to_pylist() for c in batch.columns]):
                found.setdefault(dim, []).append(path)
            for dim, paths in found.items():
                for at in range(0, len(paths), HELD_TREES):
                    trees = [load(p) for p in paths[at : at + HELD_TREES]]
                    for block in of_dim.get(dim, []):
                        q, q_ids, floor = load(block)
                        best = Best(len(q), k, floor)
                        for tree in trees:
                            tree.search(q, q_ids, best)
                        row, rank = np.nonzero((best.score > _NONE) & (best.score >= floor[:, None]))
                        yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[row], pa.int64()), "vec_id": pa.array(best.id[row, rank], pa.int64()), "score": pa.array(best.score[row, rank], pa.int64())})

    if not n or not of_dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _best(shards.repartition(max(1, -(-n // HELD_TREES)), "path").mapInArrow(run, "query_id long, vec_id long, score long"), k)
