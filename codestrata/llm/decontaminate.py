"""Benchmark decontamination: CGK walks and bit-sampling LSH over item-sized windows, then exact edits.

Words are runs of letters, digits and underscores in lower case. An item of n words leaks into a document if some
stretch of the document is within n // 5 word edits of it.

1. Windows. At every place of every whole text stands a window of each item length n. An edit destroys at most q of the n - q + 1
   runs of q words, so a window within e = n // 5 edits of an item has at least n - q + 1 - q * e runs that occur in items at all; windows
   with fewer runs of one, two or three words, found by running counts over the whole text, are passed over without loss.
2. Every other window, and each item, is embedded by CGK random walks: at step j a random bit of the symbol under the cursor
   says whether the cursor moves on, so that edit distance turns into Hamming distance between walks. The symbols that a walk meets at BITS
   sampled steps are the key of a bucket; a window that falls into an item's bucket in one of the walks is a candidate. Steps are sampled
   where walks rarely have come to the end of an item; a walk whose sample lies beyond it gives the item no bucket.
3. The number of walks follows from TARGET: copies of items with n // 5 random edits show how often a walk finds them, and
   as many walks are taken as make the expected recall TARGET (MOST_WALKS at most; `Items.expected` has what is reached).
4. Candidates are verified by the exact edit distance of the item to the best stretch around the window.

Items reach the executors in blocks of about `BLOCK_WORDS` words, each block in one pass; documents are never shuffled.
Defined cases: null and empty texts and items without words match nothing; equal items match each; repeated rows are
reported each; items under five words match without edits only; further columns are kept or ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import per_worker, slices, written

#: Share of an item's words that may differ: one in EDITS.
EDITS = 5
#: Recall that the walks are to reach on items with the most edits, the most walks, and items that it is estimated from.
TARGET, MOST_WALKS, TRIALS = 0.99, 64, 256
BITS = 2
#: Steps of a walk over an item of n words: STEPS * n; a cursor is expected at half of them.
STEPS = 1.5
#: Words of the items in a broadcast block.
BLOCK_WORDS = 500_000
_SYMBOLS = 64
#: Steps of walks that are held at a time.
PATH_CELLS = 2_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """The items of a block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int = 11):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, w in items if w]
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for _, w in items if w]
        self.size = len(self.vocabulary) + 1
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.edits = self.lengths // EDITS
        rng = np.random.default_rng(seed)
        steps = int(STEPS * self.lengths.max()) + 1 if len(self.ids) else 0
        self.bits = rng.integers(0, 2, (steps, MOST_WALKS, _SYMBOLS)).astype(np.int32)
        self.share = (rng.random((MOST_WALKS, BITS)) + np.arange(BITS)) / BITS  # one step from each part of a walk
        self.walks, self.expected = self._needed(rng)
        # a bitmap of the runs of two and three words of items; runs that share a bit only let more windows pass
        self.mask = (1 << max(16, int(32 * self.lengths.sum()).bit_length())) - 1
        self.runs = {q: np.zeros(self.mask + 1, bool) for q in (2, 3)}
        for w in self.words:
            for q, bitmap in self.runs.items():
                bitmap[self._run_codes(w, q)] = True
        self.sizes = sorted(set(self.lengths.tolist()))
        self.table = self._table()

    def symbols(self, words: list[str]) -> np.ndarray:
        """The words by number, 0 where no item has them."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def steps(self, n: int) -> np.ndarray:
        """The sampled steps of each walk over n words."""
        return (self.share * STEPS * n).astype(np.int64)

    def paths(self, flat: np.ndarray, starts: np.ndarray, steps: int, walks: int) -> np.ndarray:
        """steps x starts x walks: where in flat each walk stands at each step. A walk is the same for windows of all sizes."""
        symbol = np.concatenate([flat, np.zeros(steps, flat.dtype)]) % _SYMBOLS
        symbol = symbol.astype(np.int32)
        offset = (np.arange(walks, dtype=np.int32) * _SYMBOLS)[None, :]
        cursor = np.repeat(starts[:, None], walks, 1).astype(np.int32)
        out = np.empty((steps, *cursor.shape), np.int32)
        for j in range(steps):
            out[j] = cursor
            cursor += self.bits[j, :walks].ravel().take(symbol.take(cursor) + offset)
        return out

    def sampled(self, flat: np.ndarray, paths: np.ndarray, rows: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """rows x walks x BITS: the symbols that the walks from starts, rows of paths, meet at the sampled steps; -1 beyond n words."""
        walks = paths.shape[2]
        at, walk, last = self.steps(n)[:walks], np.arange(walks)[None, :], (starts + n)[:, None]
        out = np.empty((len(rows), walks, BITS), np.int64)
        for b in range(BITS):
            cursor = paths[at[None, :, b], rows[:, None], walk]
            out[:, :, b] = np.where(cursor < last, flat.take(np.minimum(cursor, len(flat) - 1)), -1)
        return out

    def embed(self, flat: np.ndarray, starts: np.ndarray, n: int, walks: int) -> np.ndarray:
        return self.sampled(flat, self.paths(flat, starts, int(STEPS * n) + 1, walks), np.arange(len(starts)), starts, n)

    def _needed(self, rng: np.random.Generator) -> tuple[int, float]:
        """Walks that find an item with the most edits with probability TARGET, and the recall expected of them."""
        chosen = np.unique(np.linspace(0, len(self.ids) - 1, min(TRIALS, len(self.ids))).astype(int)) if self.ids else []
        rates = []
        for k in chosen:
            item, n = self.words[k], int(self.lengths[k])
            copy = item.tolist()
            for kind, where in zip(rng.random(int(self.edits[k])), rng.random(int(self.edits[k]))):
                p = int(where * len(copy))
                if kind < 1 / 3:
                    copy[p] = 0
                elif kind < 2 / 3:
                    copy.insert(p, 0)
                elif len(copy) > 1:
                    del copy[p]
            flat = np.concatenate([item, np.zeros(n, np.int64), copy, np.zeros(2 * n, np.int64)])
            got = self.embed(flat, np.array([0, 2 * n]), n, MOST_WALKS)
            rates.append(float(((got[0] == got[1]) & (got[0] >= 0)).all(1).mean()))
        missed = 1 - np.array(rates)
        for walks in range(4, MOST_WALKS, 4):
            if not rates or 1 - (missed**walks).mean() >= TARGET:
                return walks, 1 - float((missed**walks).mean()) if rates else 1.0
        return MOST_WALKS, 1 - float((missed**MOST_WALKS).mean())

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all items in all walks, ascending, and the items."""
        keys, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in self.sizes:
            members = np.flatnonzero(self.lengths == n)
            got = self.embed(np.concatenate([self.words[k] for k in members]), np.arange(len(members)) * n, n, self.walks)
            found = self._keys(got, n)
            fine = (got >= 0).all(2)
            keys.append(found[fine])
            items.append(np.broadcast_to(members[:, None], fine.shape)[fine])
        key, item = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(key, kind="stable")
        return key[order], item[order]

    def _keys(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """One number for size, walk and sampled symbols."""
        out = self.sizes.index(n) * self.walks + np.arange(symbols.shape[1], dtype=np.int64)[None, :]
        for b in range(BITS):
            out = out * self.size + symbols[:, :, b]
        return out

    def _run_codes(self, words: np.ndarray, q: int) -> np.ndarray:
        code = words[: max(0, len(words) - q + 1)].astype(np.uint64)
        for k in range(1, q):
            code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - q + 1 + k].astype(np.uint64)  # an odd multiplier
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (code >> np.uint64(20)).astype(np.int64) & self.mask

    def candidates(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows of flat that share a bucket with an item of their size."""
        known = flat > 0
        counts = {1: np.concatenate([[0], np.cumsum(known, dtype=np.int32)])}
        for q, bitmap in self.runs.items():
            seen = bitmap[self._run_codes(flat, q)]
            for k in range(q):
                seen &= known[k : len(flat) - q + 1 + k]
            counts[q] = np.concatenate([[0], np.cumsum(seen, dtype=np.int32)])
        # where the longest window holds too few runs of three for any size, no window begins
        found, longest = {}, int(self.lengths.max())
        least = min(n - 2 - 3 * (n // EDITS) for n in self.sizes)
        upto = counts[3]
        every = np.flatnonzero(upto[np.minimum(np.arange(len(flat)) + longest, len(upto) - 1)] - upto[np.minimum(np.arange(len(flat)), len(upto) - 1)] >= max(0, least))
        for n in self.sizes:
            if len(flat) <= n:
                continue
            places = every[: np.searchsorted(every, len(flat) - n, "right")]
            for q in (3, 2, 1):
                least = n - q + 1 - q * (n // EDITS)
                if least > 0:
                    places = places[counts[q].take(places + n - q + 1) - counts[q].take(places) >= least]
            if len(places):
                found[n] = places
        items, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        keys, members = self.table
        every = np.unique(np.concatenate([*found.values()])) if found else np.empty(0, np.int64)
        steps = int(STEPS * max(found, default=0)) + 1
        width = max(16, PATH_CELLS // (steps * self.walks))
        for at in range(0, len(every), width):
            here = every[at : at + width]
            wanted, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            paths = self.paths(flat[here[0] : here[-1] + steps + 1], here - here[0], steps, self.walks) + here[0]
            for n, places in found.items():
                part = places[np.searchsorted(places, here[0]) : np.searchsorted(places, here[-1], "right")]
                if len(part):
                    got = self.sampled(flat, paths, np.searchsorted(here, part), part, n)
                    fine = (got > 0).all(2)
                    wanted.append(self._keys(got, n)[fine])
                    of.append(np.broadcast_to(part[:, None], fine.shape)[fine])
            want = np.concatenate(wanted)
            low, high = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                m = (high - low)[hit]
                items.append(members[np.repeat(low[hit] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))])
                starts.append(np.repeat(np.concatenate(of)[hit], m))
        both = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)], 1), axis=0)
        return both[:, 0], both[:, 1]

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, distance, first word, word after the last) of every item that leaks into it."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.ids:
            return out
        gap = np.zeros(int(self.lengths.max()), np.int64)  # between texts: no window of one reaches into the next
        parts, begin, at = [], [], 0
        for text in texts:
            words = words_of(text)
            begin.append(at)
            parts += [self.symbols(words), gap]
            at += len(words) + len(gap)
        flat = np.concatenate([*parts, gap]) if parts else gap
        end = np.append(begin[1:], at) - len(gap)
        begin = np.array(begin, np.int64)
        near: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item, start in zip(*[x.tolist() for x in self.candidates(flat)]):
            k = int(np.searchsorted(begin, start, "right")) - 1
            near[k, item].append(start)
        for (k, i), starts in sorted(near.items()):
            best = None
            e, n = int(self.edits[i]), int(self.lengths[i])
            starts.sort()
            low = starts[0]
            for s, after in zip(starts, [*starts[1:], None]):
                if after is None or after > s + n:  # windows that overlap are verified as one stretch
                    a, b = max(int(begin[k]), low - e), min(int(end[k]), s + n + e)
                    # each word that the stretch lacks is an edit
                    if np.isin(self.words[i], flat[a:b]).sum() >= n - e:
                        hit = distance(self.words[i], flat[a:b])
                        if hit[0] <= e and (best is None or hit[0] < best[0]):
                            best = (hit[0], a - int(begin[k]) + hit[1], a - int(begin[k]) + hit[2])
                    low = after
            if best is not None:
                out[k].append((self.ids[i], *best))
        return out


def distance(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(edits, from, to) of the stretch of doc nearest to the item; free start and end, leftmost end on ties."""
    m = len(doc)
    cost = np.zeros(m + 1, np.int64)  # of the best stretch that ends here
    first = np.arange(m + 1)  # and where it starts
    step = np.arange(m + 1)
    for x in item:
        with_ = cost[:-1] + (doc != x)
        drop = cost + 1
        new, start = drop.copy(), first.copy()
        better = with_ <= new[1:]
        new[1:][better] = with_[better]
        start[1:][better] = first[:-1][better]
        # an extra word of doc costs one: a running minimum of cost - position
        level = new - step
        low = np.minimum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == low, step, 0))
        cost, first = low + step, start[origin]
    end = int(cost.argmin())
    return int(cost[end]), int(first[end]), end


def item_blocks(benchmark: DataFrame) -> Iterator[bytes]:
    """The items, pickled in blocks of about BLOCK_WORDS words, dealt by hash; one block at a time is on the driver."""
    rows = written(benchmark.select("item_id", "text").where("text is not null"), "items")
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-words // (6 * BLOCK_WORDS))  # some six bytes a word
    for block in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").collect()
        if mine:
            yield pickle.dumps([(r["item_id"], words_of(r["text"])) for r in mine])


def _items(block: bytes) -> Items:
    return per_worker(("items", block), lambda: Items(pickle.loads(block)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, n_words, first_word, end_word: one row for each document and item that leaks into it."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, n_words int, first_word int, end_word int"
    out = None
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def find(batches, sent=sent):
            items = _items(sent.value)
            length = dict(zip(items.ids, items.lengths.tolist()))
            for piece in slices(batches, 1024, 1):
                rows = [(d, i, e, length[i], a, b) for d, hits in zip(piece.column(0).to_pylist(), items.search(piece.column(1).to_pylist())) for i, e, a, b in hits]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(find, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, into which no item leaks."""
    for block in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        at = docs.columns.index("text")

        def keep(batches, sent=sent):
            items = _items(sent.value)
            for piece in slices(batches, 1024, at):
                yield piece.filter(pa.array([not hits for hits in items.search(piece.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
