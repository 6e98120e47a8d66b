"""Exact Jaccard join of documents on word n-grams: a grouped prefix join.

A document's set holds the distinct shingles of `words` words. Two documents link when den * |x & y| >= num * |x | y|.

1. Documents with equal sets form one class; only classes are joined.
2. Shingles are ordered by hash, with frequent ones (in more than `FREQUENT` prefixes) moved to the end. Two classes that
   link share a shingle within their prefixes of |x| - ceil(num/den |x|) + 1 shingles. Each class gives its prefix
   and some shingles more, to make up for the frequent ones; frequencies are counted over all of them.
3. Classes of one size with the same shared prefix are collapsed into one group. Groups that share an infrequent prefix shingle make candidate
   pairs; size, position, and the number of prefix shingles that a pair shares bound its overlap, and pairs of groups that
   cannot reach the threshold go. Only then are groups expanded to their members.
4. Classes whose prefix reaches into their frequent shingles ("deep": near copies by the hundred, texts of
   common passages) are joined among themselves by group: every shingle of their prefixes, rarest first, ties its
   holders to one hub, which takes a row for each holder, not for each pair. Against the groups they are joined
   as in step 3, by the infrequent part of their prefix.
5. Candidate pairs and ties are closed into families; the whole sets of a family's members are read once and verified exactly. In a
   family over `TILE_ROWS` members or `TILE_SHINGLES` shingles all members are first verified against one pivot, each in a row of
   its own: those that link with it are connected and need no other link among them. The others are dealt out in blocks,
   and each pair of such blocks, and each with a block of the connected ones, is verified in a task of its own, so that rows grow with the
   members that the pivot leaves. A tile returns a spanning forest of its links.
6. The links are closed into components.

Defined cases: null text is like empty: no shingles, linked with nothing, its own component; repeated rows fall into one
class; a null doc_id is ignored in the smallest id of a component unless there is no other; further columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import discard, map_rows, small, written
from codestrata.llm.components import connected

#: A shingle in more prefixes than this is frequent.
FREQUENT = 32
#: Members and shingles of a block of a family.
TILE_ROWS = 512
TILE_SHINGLES = 2_000_000

# Odd multipliers of the 64-bit mix.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _word_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of `data` at these places, from all their bytes and their length."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    eight = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))
    h = size.astype(np.uint64) * _MIX
    for k in range(3):
        h = (h ^ (h >> np.uint64(29))) + (eight[at + 8 * k] & _LOW[np.clip(size - 8 * k, 0, 8)])
        h *= _MIX2 if k % 2 else _MIX
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size > 24).tolist():
        h[k] = xxhash.xxh64_intdigest(data[at[k] : at[k] + size[k]].tobytes())
    return h


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The set of each text, as ascending 64-bit hashes. A text with fewer words gives one shingle of all its words."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)  # a space behind each text
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    gap = _SPACE[data]
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    size = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]])) - begin
    h = _word_hashes(data, begin, size)
    first = np.searchsorted(begin, np.concatenate([[0], ends[:-1]])).tolist() + [len(begin)]
    x = h * _MIX
    if len(h) >= words:
        x = x[: len(h) - words + 1]
        for k in range(1, words):
            x ^= x >> np.uint64(29)
            x = (x + h[k : k + len(x)]) * _MIX2
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= words:
            out.append(np.unique(x[a : b - words + 1].view(np.int64)))
        elif b > a:
            found = b" ".join(data[begin[k] : begin[k] + size[k]].tobytes() for k in range(a, b))
            out.append(np.array([xxhash.xxh64_intdigest(found, seed=b - a)], np.uint64).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def _prefix_length(n, num: int, den: int):
    """|x| - ceil(num/den |x|) + 1, of an int or a column."""
    if isinstance(n, int):
        return n - -(-num * n // den) + 1
    return (n - F.ceil(n * F.lit(num) / F.lit(den)) + 1).cast("int")


def _given(n, num: int, den: int):
    """Shingles that a class gives: its prefix, a quarter more and eight."""
    if isinstance(n, int):
        p = _prefix_length(n, num, den)
        return min(n, p + p // 4 + 8)
    p = _prefix_length(n, num, den)
    return F.least(n, p + F.floor(p / 4).cast("int") + 8)


def _full_sets(docs: DataFrame, classes: DataFrame, rids: DataFrame, words: int) -> DataFrame:
    """rid, n, tokens: the whole sets of some classes, from the text of one document each."""
    wanted = written(classes.join(small(rids), "rid", "left_semi").select("rid", "cid", "n", F.col("min_doc").alias("_id")), "wanted")
    chosen = docs.join(small(wanted.select("_id").distinct()), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")

    def start():
        def step(texts):
            sets = shingle_sets(texts, words)
            return [_digest(s) for s in sets], sets

        return step

    sets = map_rows(chosen.select("text"), start, "cid binary, tokens array<long>", rows=128)
    return sets.join(small(wanted.drop("_id")), "cid").select("rid", "n", "tokens")


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return _labelled(docs, words, num, den).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """components with cid, the class of a row, and label, that of its component: two components may have one smallest doc_id."""
    docs = docs.select("doc_id", "text")

    def start():
        def step(doc_ids, texts):
            sets = shingle_sets(texts, words)
            return doc_ids, [_digest(s) for s in sets], [len(s) for s in sets], [s[: _given(len(s), num, den)] for s in sets]

        return step

    sets = written(map_rows(docs, start, "doc_id long, cid binary, n int, given array<long>", rows=128), "sets")
    classes = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("min_doc"), F.first("n").alias("n"), F.first("given").alias("given"))
    giving = written(classes.withColumn("rid", F.monotonically_increasing_id()), "giving")
    # the shingles are most of the bytes: rows and classes go on without them, and those of the classes only until they are posted
    rows, classes = written(sets.select("doc_id", "cid", "n"), "rows"), written(giving.drop("given"), "classes")
    discard(sets)

    links = _links(docs, classes, giving, words, num, den)
    labels = connected(links)
    of_class = classes.select("rid", "cid", "min_doc").join(labels, classes["rid"] == labels["node"], "left").withColumn("label", F.coalesce("label", "rid"))
    smallest = of_class.groupBy("label").agg(F.min("min_doc").alias("component_id"))
    of_class = written(of_class.join(smallest, "label").select("cid", "component_id", "label"), "labels")
    out = rows.select("doc_id", "cid", "n").join(small(of_class), "cid", "left")
    return out.select("doc_id", "cid", "label", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _links(docs: DataFrame, classes: DataFrame, giving: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) of classes, enough to connect all that link. giving has the shingles that they give; it is deleted once they are posted."""
    tokens = giving.select("rid", "n", F.posexplode("given").alias("pos", "h"))
    shared = written(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "df")
    posts = written(tokens.join(shared, "h"), "posts")
    discard(giving)

    # where each prefix ends once the frequent shingles before its end are passed over
    n = F.col("n")
    p = _prefix_length(n, num, den)
    passed = posts.where(F.col("df") > FREQUENT).groupBy("rid", "n").agg(F.array_sort(F.collect_list("pos")).alias("z"))
    cuts = passed.select("rid", F.aggregate("z", p, lambda cut, z: F.when(z < cut, cut + 1).otherwise(cut)).alias("cut"), _given(n, num, den).alias("given"))
    cuts = written(cuts.select("rid", "cut", (F.col("cut") > F.col("given")).alias("deep")), "cuts")
    deep = cuts.where("deep").select("rid")
    light = posts.where(F.col("df") <= FREQUENT).join(small(cuts), "rid", "left")
    light = light.where((F.col("pos") < F.coalesce("cut", p)) & ~F.coalesce("deep", F.lit(False)))
    # classes of one size and one shared prefix, in the order of infrequent shingles, are one group; members of a group that
    # differ in shingles that nobody shares stand at its places at the least
    prefixes = written(light.groupBy("rid", "n").agg(F.array_sort(F.collect_list("h")).alias("prefix")), "prefixes")
    discard(posts)
    groups = prefixes.groupBy("n", "prefix").agg(F.min("rid").alias("gid"), F.count("*").alias("members"))
    groups = written(groups, "groups")
    light = written(groups.select("gid", "n", F.posexplode("prefix").alias("pos", "h")).select("h", F.col("gid").alias("rid"), "n", "pos"), "light")
    pairs = _pairs(light, light, "l.rid < r.rid", num, den)
    crowded = groups.where("members > 1").select("gid", "n", "prefix")
    expanded = prefixes.join(small(crowded), ["n", "prefix"]).where("rid <> gid").select(F.col("rid").alias("a"), F.col("gid").alias("b"))
    pairs = pairs.unionAll(expanded)

    deep_sets = _full_sets(docs, classes, deep, words).groupBy("rid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    deep_sets = written(deep_sets, "deep")
    ties = None
    if deep_sets.limit(1).count():
        each = deep_sets.select("rid", "n", F.explode("tokens").alias("h"))
        frequent = shared.where(F.col("df") > FREQUENT).select("h")
        of_doc = Window.partitionBy("rid")  # one document's set
        infrequent = each.join(frequent, "h", "left_anti").withColumn("pos", F.row_number().over(of_doc.orderBy("h")) - 1)
        infrequent = infrequent.where(F.col("pos") < p).select("h", "rid", "n", "pos")
        pairs = pairs.unionAll(_pairs(light, infrequent, "true", num, den))
        holders = each.groupBy("h").agg(F.count("*").alias("df"), F.min("rid").alias("hub"))
        ranked = each.join(holders, "h").withColumn("rank", F.row_number().over(of_doc.orderBy("df", "h")))
        ties = ranked.where((F.col("rank") <= p) & (F.col("df") > 1) & (F.col("rid") != F.col("hub"))).select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = written(pairs if ties is None else pairs.unionAll(ties), "pairs")
    discard(light, groups, prefixes)

    families = written(connected(pairs), "families")
    others = families.select(F.col("node").alias("rid")).join(small(deep), "rid", "left_anti")
    sets = written(_full_sets(docs, classes, others, words).unionAll(deep_sets.select("rid", "n", "tokens")), "members")
    links = written(_verified(sets, families, num, den), "links")
    discard(sets)
    return links


def _pairs(left: DataFrame, right: DataFrame, order: str, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that share a prefix shingle and can reach the threshold."""
    smaller, larger = F.least("l.n", "r.n"), F.greatest("l.n", "r.n")
    cond = (F.col("l.h") == F.col("r.h")) & F.expr(order) & (smaller * den >= larger * num)
    # for the first shingle that a pair shares, what is left of either set bounds the overlap
    reach = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))
    met = left.alias("l").join(right.alias("r"), cond).select(F.col("l.rid").alias("a"), F.col("r.rid").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb"), reach.alias("reach"))
    met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("reach").alias("reach"))
    # beyond the prefix that ends first, at most the rest of that set can be shared
    rest = F.greatest(F.col("na") - _prefix_length(F.col("na"), num, den), F.col("nb") - _prefix_length(F.col("nb"), num, den))
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(num) / F.lit(num + den))
    return met.where((F.col("reach") >= need) & (F.col("c") + rest >= need)).select("a", "b")


def _blocks() -> Column:
    return F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")


def _pivot_links(sets: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the members of large families that link with the pivot, the family's label. Its set goes to one row for each
    block of members, so that no task takes a family whole."""
    salt = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    members = placed.withColumn("salt", salt).join(sets, "rid")
    pivots = placed.where("rid = label").select("label", "blocks").join(sets.select(F.col("rid").alias("label"), F.col("n").alias("m"), F.col("tokens").alias("of_pivot")), "label")
    pivots = pivots.select("label", "m", "of_pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    both = members.join(pivots, ["label", "salt"]).withColumn("shared", F.size(F.array_intersect("tokens", "of_pivot")).cast("long"))
    return both.where((F.col("shared") * den >= (F.col("n") + F.col("m") - F.col("shared")) * num) & (F.col("rid") != F.col("label"))).select(F.col("rid").alias("a"), F.col("label").alias("b"))


def _verified(sets: DataFrame, families: DataFrame, num: int, den: int) -> DataFrame:
    sized = families.join(sets.select(F.col("rid").alias("node"), "n"), "node").withColumnRenamed("node", "rid")
    weight = sized.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    large = written(weight.withColumn("blocks", _blocks()).where("blocks > 1").select("label", "blocks"), "large")
    placed = sized.withColumn("connected", F.lit(False))
    found = None
    if large.limit(1).count():
        found = written(_pivot_links(sets, sized.join(small(large), "label").select("rid", "label", "blocks"), num, den), "pivot_links")
        core = found.select(F.col("a").alias("rid")).unionAll(found.select(F.col("b").alias("rid")).distinct()).withColumn("_core", F.lit(True))
        placed = sized.join(core, "rid", "left").withColumn("connected", F.coalesce("_core", F.lit(False))).drop("_core")
    # blocks 0 to r - 1 hold what is not connected, c more the connected members; tiles pair each of the former with every block
    parts = placed.groupBy("label", "connected").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).withColumn("blocks", _blocks())
    count = lambda side: F.coalesce(F.max(F.when(F.col("connected") == F.lit(side), F.col("blocks"))), F.lit(0))
    parts = parts.groupBy("label").agg(count(False).alias("r"), count(True).alias("c")).where("r > 0")
    placed = placed.join(parts, "label")
    h = F.xxhash64("rid")
    placed = placed.withColumn("block", F.when(F.col("connected"), F.col("r") + F.pmod(h, F.greatest("c", F.lit(1)))).otherwise(F.pmod(h, F.col("r"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("connected"), F.col("r") - 1).otherwise(F.col("r") + F.col("c") - 1))))
    placed = placed.select("rid", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def verify(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_numpy()
        _, first = np.unique(rid, return_index=True)  # a repeated id gives its set once
        table = table.take(pa.array(first))
        rid = table.column("rid").to_numpy()
        parts = table.column("tokens").combine_chunks()
        a, b = forest(parts.flatten().to_numpy(), np.diff(parts.offsets.to_numpy()), table.column("block").to_numpy(), num, den)
        return pa.table({"a": pa.array(rid[a], pa.int64()), "b": pa.array(rid[b], pa.int64())})

    tiles = sets.join(placed, "rid").select("label", "i", "j", "rid", "block", "tokens").groupBy("label", "i", "j").applyInArrow(verify, "a long, b long")
    return tiles if found is None else tiles.unionAll(found)


def forest(flat: np.ndarray, n: np.ndarray, block: np.ndarray, num: int, den: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among sets, given one after another in flat; n are their sizes. If two blocks
    meet, pairs within a block are another tile's."""
    members = len(n)
    of = np.repeat(np.arange(members), n)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    renumber = np.cumsum(count > 1) - 1
    token, of = renumber[token[shared]], of[shared]
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    common = np.zeros((members, members), np.float32)
    n_tokens = int(token[-1]) + 1 if len(token) else 0
    width = max(1, min(n_tokens, 4_000_000 // max(members, 1)))
    for low in range(0, n_tokens, width):
        part = slice(*np.searchsorted(token, [low, low + width]))
        held = np.zeros((members, width), np.float32)
        held[of[part], token[part] - low] = 1
        common += held @ held.T  # counts below 2**24 are exact
    total = n[:, None].astype(np.int64) + n[None, :]
    inter = common.astype(np.int64)
    linked = np.triu(den * inter >= num * (total - inter), 1)
    if len(np.unique(block)) > 1:
        linked &= block[:, None] != block[None, :]
    root = list(range(members))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out_a, out_b = [], []
    for x, y in zip(*np.nonzero(linked)):
        rx, ry = find(int(x)), find(int(y))
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out_a.append(int(x))
            out_b.append(int(y))
    return out_a, out_b


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, without the rows whose component holds a smaller doc_id. Of rows that share the smallest
    doc_id of their component one stays; rows without a doc_id stay. Rows of a repeated doc_id are judged by their classes."""
    found = _labelled(docs, words, num, den)
    gone = written(found.where("component_id < doc_id").select("doc_id").distinct(), "copies")
    twice = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if twice.limit(1).count() == 0:
        return left

    def start():
        def step(doc_ids, keys, texts):
            return doc_ids, keys, [_digest(s) for s in shingle_sets(texts, words)]

        return step

    repeated = docs.join(small(twice), "doc_id", "left_semi").withColumn("_key", F.coalesce(F.sha2("text", 256), F.lit("")))
    classes = map_rows(repeated.select("doc_id", "_key", "text"), start, "doc_id long, _key string, _cid binary", rows=128).distinct()
    stay = found.join(small(twice), "doc_id", "left_semi").where("component_id = doc_id").groupBy("doc_id", "label").agg(F.min("cid").alias("_cid"))
    stay = written(classes.join(stay.select("doc_id", "_cid"), ["doc_id", "_cid"], "left_semi"), "stay")
    repeated = repeated.join(small(stay), ["doc_id", "_key"]).dropDuplicates(["doc_id", "_cid"]).select(*docs.columns)
    return left.join(small(twice), "doc_id", "left_anti").select(*docs.columns).unionAll(repeated)
