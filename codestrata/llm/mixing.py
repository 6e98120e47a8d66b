"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only on the main path.

Steps: (1) one light row per document: source, size, 64-bit hash; (2) totals per source give the targets: weights, caps of
`max_repeat` times the source, excess shared again, found as the level at which the shares sum to the budget, by a few aggregates
over the table of sources; (3) words are summed by source and hash bucket, and the bucket in which a source's target falls is found from
the histogram alone; that bucket is cut again by the next bits of the hash until it holds few documents; (4) documents below
the threshold are taken by a filter, without sorting; in the last bucket a fold takes each document that still fits. The mix
itself needs the thresholds only: texts are neither shuffled nor joined with one another.

Defined cases: null or empty text has size 0 and is never taken from; null source is a source of its own, last in
order; rows that repeat a doc_id and its text have one hash and are taken or left together; an empty table gives an empty result;
further columns, whatever their names, are ignored by `mix_plan` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import WORD, small, written

#: Bits of the hash that each histogram level uses, from the top, and the number of levels: 60 bits in all.
LEVEL_BITS = 12
LEVELS = 5
#: A boundary bucket with no more documents than this is settled by the fold; documents that still share a bucket
#: after the last level have equal hashes and are folded as one.
SETTLE_ROWS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(keys: list[str]) -> Column:
    """60 bits, never negative: the order in which documents are taken."""
    return F.xxhash64(*[F.col(k) for k in keys], F.col("text")).bitwiseAND(F.lit((1 << (LEVEL_BITS * LEVELS)) - 1))


def _targets(light: DataFrame, weights: tuple[float, ...], share: float, max_repeat: int) -> DataFrame:
    """One row per source: _s, source_size, target, _whole (copies that every document is taken), _rest (words still to be taken), _n."""
    totals = light.groupBy("_s").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    # in order of code points; a window over the table of sources, not of documents
    turn = (F.row_number().over(Window.orderBy(F.col("_s").isNull(), "_s")) - 1) % len(weights)
    cap = (F.col("source_size") * max_repeat).cast("double")
    totals = written(totals.withColumns({"_w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1), "_cap": cap}), "sources")
    # a source gets level * weight, or its cap where that is more
    level, stopped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("_w") > F.col("_cap") if stopped >= 0 else F.lit(False)
        r = totals.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("stopped"), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)).alias("given"), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))).alias("open")
        ).first()
        if r["stopped"] == stopped or r["all"] is None:
            break
        stopped = r["stopped"]
        level = (share * r["all"] - r["given"]) / r["open"] if r["open"] else float("inf")
    target = F.least(F.col("_cap"), F.when(F.col("_w") > 0, F.lit(level) * F.col("_w")).otherwise(0.0))
    out = totals.select("_s", "source_size", "_n", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(0).cast("int")
    out = out.withColumn("_whole", whole)
    rest = F.when(F.col("source_size") > 0, F.floor(F.col("target") - F.col("_whole") * F.col("source_size"))).otherwise(0)
    return written(out.withColumn("_rest", rest.cast("long")), "plan")


def _cuts(light: DataFrame, weights: tuple[float, ...], share: float, max_repeat: int) -> DataFrame:
    """One row per source: its plan, `_below` and `_fits`."""
    plan = _targets(light, weights, share, max_repeat)
    more = _boundary(light.join(small(plan.select("_s", "_rest")).alias("o"), light["_s"].eqNullSafe(F.col("o._s"))).select(light["_s"], "size", "_h", "_rest"), plan)
    joined = plan.alias("p").join(more.alias("m"), F.col("p._s").eqNullSafe(F.col("m._s")), "left")
    return written(joined.select("p.*", "m._below", "m._fits"), "cuts")


def _copies() -> Column:
    """Copies of a document, by its hash and the cut of its source."""
    more = F.when(F.col("_h") < F.col("_below"), 1).when(F.coalesce(F.array_contains("_fits", F.col("_h")), F.lit(False)), 1).otherwise(0)
    return F.col("_whole") + F.when(F.col("_rest") > 0, more).otherwise(0)


def _light(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.col("source").alias("_s"), word_count(F.col("text")).alias("size"), row_hash(keys).alias("_h"))


def mix_plan(
    docs: DataFrame,
    keys: list[str],
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_repeat: int = 2,
) -> DataFrame:
    """Per row of docs: its keys, source, size, source_size, target, taken, hash `_h` and `_copies`.

    Sources in code point order, null last, weigh `weights` in turn and share `share` times all words.
    `keys` are carried through and, with the text, decide the hash. taken is a whole number of copies of a document, at most max_repeat.
    """
    light = written(_light(docs, keys), "light")
    cuts = _cuts(light, weights, share, max_repeat).withColumnRenamed("_s", "_of")
    joined = light.join(small(cuts), light["_s"].eqNullSafe(F.col("_of"))).withColumn("_copies", _copies())
    return joined.select(*keys, F.col("_s").alias("source"), "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"), "_h", "_copies")


def _boundary(light: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: `_below`, the hash below which every document is taken once more, and `_fits`, the hashes taken
    in the boundary bucket. Each level reads only the boundary buckets of the level before that are still too large."""
    rows = light.where("_rest > 0").select("_s", "size", "_h")
    # at first the boundary bucket is the whole source
    whole = F.lit(1 << (LEVEL_BITS * LEVELS))
    state = plan.where("_rest > 0").select("_s", F.lit(0).cast("long").alias("_low"), whole.alias("_span"), F.col("_rest").alias("_left"), "_n")
    state = written(state, "cut")
    for level in range(LEVELS):
        large = state.where(F.col("_n") > SETTLE_ROWS)
        if large.limit(1).count() == 0:
            break
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        bucket = F.shiftright(F.col("_h") - F.col("_low"), shift)
        sums = _inside(rows, large).groupBy("_s", "_low", "_left", bucket.alias("_b")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"))
        # the first bucket that reaches beyond what is left; a window of at most 4,096 rows
        sums = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_s", "_low").orderBy("_b")))
        cut = (
            sums.where(F.col("_upto") > F.col("_left"))
            .groupBy("_s", "_low", "_left")
            .agg(F.min(F.struct("_b", "_upto", "_sum", "_n")).alias("c"))
            .select("_s", (F.col("_low") + F.shiftleft(F.col("c._b"), shift)).alias("_low"), F.lit(1 << shift).alias("_span"), (F.col("_left") - F.col("c._upto") + F.col("c._sum")).alias("_left"), F.col("c._n").alias("_n"))
        )
        state = written(state.where(F.col("_n") <= SETTLE_ROWS).unionByName(cut), "cut")
    last = (
        _inside(rows, state)
        .groupBy("_s", "_low", "_left", "_h")
        .agg(F.sum("size").alias("_sum"))  # equal hashes are taken together
        .groupBy("_s", "_low", "_left")
        .agg(F.array_sort(F.collect_list(F.struct("_h", "_sum"))).alias("_rows"))
    )
    # in hash order, take what fits; then, if one more document comes nearer to the target than none, take it too
    fold = F.aggregate(
        "_rows",
        F.struct(F.col("_left").alias("left"), F.array().cast("array<long>").alias("fits")),
        lambda a, r: F.when(r["_sum"] <= a["left"], F.struct((a["left"] - r["_sum"]).alias("left"), F.concat(a["fits"], F.array(r["_h"])).alias("fits"))).otherwise(a),
    )
    last = last.withColumn("_f", fold)
    nearest = F.array_sort(F.transform(F.filter("_rows", lambda r: ~F.array_contains(F.col("_f.fits"), r["_h"])), lambda r: F.struct(r["_sum"].alias("_sum"), r["_h"].alias("_h"))))[0]
    last = last.withColumn("_next", nearest)
    near = F.coalesce(F.col("_next._sum") < 2 * F.col("_f.left"), F.lit(False))
    fits = last.select("_s", F.col("_low").alias("_below"), F.when(near, F.concat("_f.fits", F.array("_next._h"))).otherwise(F.col("_f.fits")).alias("_fits"))
    return written(fits, "fits")


def _inside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows whose hash lies in the boundary bucket of their source."""
    r, o = rows.alias("r"), small(state).alias("o")
    cond = F.col("r._s").eqNullSafe(F.col("o._s")) & (F.col("r._h") >= F.col("o._low")) & (F.col("r._h") < F.col("o._low") + F.col("o._span"))
    return r.join(o, cond).select("r._s", "r.size", "r._h", "o._low", "o._left")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken. Needs doc_id, text and source."""
    light = written(_light(docs, ["doc_id"]).select("_s", "size", "_h"), "light")
    cuts = _cuts(light, weights, share, max_repeat).select("_s", "_whole", "_rest", "_below", "_fits")
    row = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_of"), word_count(F.col("text")).alias("_n"), row_hash(["doc_id"]).alias("_h"))
    joined = row.join(small(cuts), F.col("_of").eqNullSafe(F.col("_s"))).withColumn("_copies", F.when(F.col("_n") > 0, _copies()).otherwise(0))
    return joined.where("_copies > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).select("_row.*")
