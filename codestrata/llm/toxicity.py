"""Toxicity by a factorization machine over hashed terms.

A term is a word of a text (letters, digits, underscore; lower case), its first four and its first five characters.
Terms are hashed into 2**18 buckets; a text is the set of its buckets. A factorization machine is fitted to labelled texts:

    logit = b + sum_i w_i + sum_{i<j} <v_i, v_j>

so that a pair of terms, such as an insult and the mention of a group, can weigh more than the two alone. It holds the buckets that
can carry a weight: those whose own share differs between toxic and other texts (z of LEAST_Z or more), and those
that matter only with another, found over all pairs of the PAIR_TERMS most frequent buckets by how far the label follows the two
together beyond each alone (z of LEAST_PAIR_Z or more).

The fit uses at most about `MAX_ROWS` labelled rows of each class, chosen by hash of doc_id; scoring covers every
whole text in one pass without a shuffle. Defined cases: null and empty texts have no terms and get the score of the
bias; labels that are null are ignored, of several labels for one doc_id the highest counts; rows that repeat a labelled text
count once in the fit and are scored each; without a label of both classes every score is 0; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import map_rows, per_worker

#: About as many labelled rows of each class enter the fit; a bound, whatever the size of the tables.
MAX_ROWS = 6_000
BUCKETS = 1 << 18
#: Least z scores of a bucket by itself and of a pair, and the buckets whose pairs are tried.
LEAST_Z, LEAST_PAIR_Z = 4.0, 6.0
PAIR_TERMS = 1_024
FACTORS = 8
EPOCHS = 12
#: Words of at most MEMO_CHARS characters whose buckets a worker remembers: some 16 MB.
MEMO, MEMO_CHARS = 100_000, 24

_WORD = re.compile(r"\w+")


def buckets_of(word: str) -> tuple[int, ...]:
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) % BUCKETS]
    for n in (4, 5):
        if len(word) >= n:
            out.append(zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "replace")) % BUCKETS)
    return tuple(out)


def informative(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Buckets, ascending, that tell the classes apart by themselves or with another one."""
    n, n1 = len(texts), int(toxic.sum())
    count = np.zeros((2, BUCKETS))
    for t, y in zip(texts, toxic):
        count[int(y)][t] += 1
    pooled = count.sum(0) / n
    z = np.abs(count[1] / n1 - count[0] / (n - n1)) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / (n - n1)) + 1e-12)
    alone = np.flatnonzero((z >= LEAST_Z) & (pooled < 1))
    often = np.sort(np.argsort(-count.sum(0), kind="stable")[:PAIR_TERMS])
    often = often[(pooled[often] > 0) & (pooled[often] < 1)]
    place = np.full(BUCKETS, -1)
    place[often] = np.arange(len(often))
    mean, spread = pooled[often].astype(np.float32), np.sqrt(pooled[often] * (1 - pooled[often])).astype(np.float32)

    def parts():
        """Which texts hold which buckets, some texts at a time."""
        for at in range(0, n, 1024):
            held = np.zeros((min(1024, n - at), len(often)), np.float32)
            for k, t in enumerate(texts[at : at + 1024]):
                found = place[t]
                held[k, found[found >= 0]] = 1
            yield at, held

    # of each pair: the label's share against what the two lead to expect, over its spread
    rest = (toxic - n1 / n).astype(np.float32)
    slope = sum(((held - mean) / spread).T @ rest[at : at + len(held)] for at, held in parts()) / n / max(1.0, len(often) ** 0.5)
    together, square, both = (np.zeros((len(often), len(often)), np.float32) for _ in range(3))
    for at, held in parts():
        z_held = (held - mean) / spread
        left = (rest[at : at + len(held)] - z_held @ slope)[:, None]
        together += z_held.T @ (z_held * left)
        square += (z_held * z_held).T @ (z_held * z_held * left * left)
        both += held.T @ held
    np.fill_diagonal(together, 0)
    # a pair that few texts hold tells nothing by the normal law
    strong = (np.abs(together) / (np.sqrt(square) + 1e-6) >= LEAST_PAIR_Z) & (both >= 20)
    return np.union1d(alone, often[strong.any(1)])


@dataclass
class Machine:
    bias: float
    kept: np.ndarray  # bucket numbers, ascending
    weight: np.ndarray
    factor: np.ndarray  # kept x FACTORS

    def logit(self, rows: list[list[int]]) -> np.ndarray:
        """Of texts given as positions in `kept`, without repeats."""
        out = np.full(len(rows), self.bias)
        for k, row in enumerate(rows):
            if row:
                v = self.factor[row]
                total = v.sum(0)
                out[k] += self.weight[row].sum() + 0.5 * float(total @ total - (v * v).sum())
        return out


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """texts: the distinct buckets of each text. AdaGrad on log loss, classes weighted alike."""
    n = len(texts)
    toxic = labels.astype(bool)
    if n == 0 or toxic.all() or not toxic.any():
        return Machine(-np.inf, np.empty(0, int), np.empty(0), np.empty((0, FACTORS)))
    n1, n0 = toxic.sum(), (~toxic).sum()
    kept = informative(texts, toxic)
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    rows = [np.unique(p[p >= 0]) for p in (place[t] for t in texts)]
    rng = np.random.default_rng(seed)
    m = Machine(0.0, kept, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)))
    importance = np.where(toxic, n / (2 * n1), n / (2 * n0))
    gb, gw, gv = 1e-6, np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6)
    rate, l2 = 0.1, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            flat = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            total = np.zeros((len(batch), FACTORS))
            square = np.zeros(len(batch))
            linear = np.zeros(len(batch))
            v = m.factor[flat]
            np.add.at(total, of, v)
            np.add.at(square, of, (v * v).sum(1))
            np.add.at(linear, of, m.weight[flat])
            logit = m.bias + linear + 0.5 * ((total * total).sum(1) - square)
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[batch]) * importance[batch] / len(batch)
            g = slope.sum()
            gb += g * g
            m.bias -= rate * g / np.sqrt(gb)
            used, inverse = np.unique(flat, return_inverse=True)
            dw = np.zeros(len(used))
            np.add.at(dw, inverse, slope[of])
            dw += l2 * m.weight[used]
            gw[used] += dw * dw
            m.weight[used] -= rate * dw / np.sqrt(gw[used])
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, inverse, slope[of][:, None] * (total[of] - v))
            dv += l2 * m.factor[used]
            gv[used] += dv * dv
            m.factor[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
    return m


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is held out, as no label can be its own."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fit on labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.lit(0)
    for label, rows in n.items():
        share = F.when(F.col("toxic") == label, F.lit(int(min(1.0, max_rows / rows) * (1 << 20)))).otherwise(share)
    chosen = known.where(slot < share)

    def start():
        return lambda toxic, texts: (toxic, [np.asarray(sorted({b for w in set(_WORD.findall((t or "").lower())) for b in buckets_of(w)}), "<i4").tobytes() for t in texts])

    # about 2 * max_rows rows, so the broadcast has a fixed bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int"), "text")
    got = map_rows(rows, start, "toxic int, buckets binary").distinct()
    # one doc_id may stand for many rows: the driver takes those of the smallest hashes
    got = got.orderBy(F.xxhash64("buckets"), "buckets", "toxic").limit(4 * max_rows).collect()
    got = sorted((bytes(r["buckets"]), r["toxic"]) for r in got)  # the same fit in whatever order rows arrive
    return fit([np.frombuffer(b, "<i4") for b, _ in got], np.array([y for _, y in got]))


def _scorer(machine: bytes):
    return per_worker(("toxicity", machine), lambda: _build_scorer(machine))


def _build_scorer(machine: bytes):
    m: Machine = pickle.loads(machine)
    place = {int(b): k for k, b in enumerate(m.kept)}
    memo: dict[str, tuple[int, ...]] = {}

    def score(texts: list[str | None]) -> list[float]:
        rows = []
        for text in texts:
            found: set[int] = set()
            for word in set(_WORD.findall(text.lower())) if text else ():
                at = memo.get(word)
                if at is None:
                    at = tuple(place[b] for b in buckets_of(word) if b in place)
                    if len(memo) < MEMO and len(word) <= MEMO_CHARS:
                        memo[word] = at
                if at:
                    found.update(at)
            rows.append(sorted(found))
        with np.errstate(over="ignore"):
            return (1 / (1 + np.exp(-m.logit(rows)))).tolist()

    return score


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, text and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))  # a row for each informative bucket

    def start():
        score = _scorer(model.value)
        return lambda doc_ids, texts: (doc_ids, score(texts))

    return map_rows(docs.select("doc_id", "text"), start, "doc_id long, score double", rows=256)


def kept_documents(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))
    text_at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        from codestrata.llm.common import slices

        score = _scorer(model.value)
        for piece in slices(batches, 256):
            yield piece.filter(pa.array([s < threshold for s in score(piece.column(text_at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
