"""Personal data by candidate gradient boosting. DataFrame and SQL functions only on the main path.

1. Generators. For each kind a base pattern and a wider one (spelled-out, bracketed or spaced separators, any groups of digits) propose
   spans, which may overlap. Positions are code points: the pieces that split() leaves between the matches and the matches
   themselves add up to offsets, in blocks, so that nothing leaves the JVM and the work is near linear in the matches.
2. Base spans are those of the base patterns that pass the kind's check; they always stay.
3. Boosted trees score candidates by format and context: number, length and case of groups, separators and spaces, the characters on both
   sides, a cue word before. What the checks test (checksums, ranges, numbers of digits) is withheld from them. Positive are base spans; negative are the
   look-alikes of the corpus: base matches that fail their check, and wide matches that are no base match, such as lists, versions, cards and long
   numbers for phones, or "look at home. The" for e-mail. Wide matches in an obfuscated form (bracketed separators) have no label.
4. The fit uses documents that are not in the calibration fold (FOLD), counted by binned features. Up to FEATURE_ROWS distinct rows are fitted on the
   driver; beyond, all of them stay where they are and each level of a tree comes from sums by node, feature and bin. On the fold, each kind gets the lowest threshold with a precision of PRECISION, half way to the next
   score below it and never below even odds.
5. A wide match is added if its plain form passes the kind's check, its score reaches the threshold and it overlaps no base span, longest first.

Candidates are found once and written as one light row per document; there is no shuffle of documents.
Defined cases: null text is like empty: no spans; repeated rows are reported each; a kind without base spans in the corpus adds
nothing; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import discard, written

#: Distinct feature rows that the driver fits; more are fitted by the executors, all of them.
FEATURE_ROWS = 20_000
TREES = 20
DEPTH = 4
RATE = 0.3
PRECISION = 0.98
#: One document of FOLD, by hash, calibrates; the others are fitted to.
FOLD = 3
#: Matches whose offsets are added up at a time.
BLOCK = 256

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans. Written with possessive repeats and look-behinds, they match what the plain patterns of
#: the contract match, in linear time and without recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?: at | ?(?:\(at\)|\[at\]|\{at\}|@) ?)[a-z0-9-]++(?:(?: dot | ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?)[a-z0-9-]++){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,4}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|[.,:/ -])[0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{2,7}(?:[./_ -][0-9]{2,7}){2,4}|[0-9]{12,19})(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}|\(0?[0-9]{1,4}\)|[0-9]{1,4})(?:[ ./-]{0,2}\(?[0-9]{2,7}\)?){2,5}+(?![0-9])",
}
#: What a text must have for a pattern to match at all; cheap to test.
NEEDS = {
    "email": "contains(t, '@')",
    "ip": "rlike(t, '[0-9][.][0-9]')",
    "card": "rlike(t, '[0-9]')",
    "phone": "contains(t, '+')",
}
WIDE_NEEDS = {
    "email": "contains(t, '@') OR contains(t, ' at ') OR rlike(t, '(?i)[(\\\\[{]at[)\\\\]}]')",
    "ip": "rlike(t, '[0-9]')",
    "card": "rlike(t, '[0-9]{2}')",
    "phone": "rlike(t, '[0-9]{2}')",
}
#: The plain form of a match: bracketed separators are written out, leading 00 is a plus.
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(x.m, '(?i) ?[(\\\\[{]at[)\\\\]}] ?', '@'), '(?i) ?[(\\\\[{](?:dot|[.])[)\\\\]}] ?', '.'), '^00', '+')"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace(c.d, '[^0-9]', '')"
_LUHN = (
    "(aggregate(transform(split(reverse({d}), ''), (x, i) -> "
    "CASE WHEN i % 2 = 0 THEN int(nullif(x, '')) WHEN int(nullif(x, '')) < 5 THEN 2 * int(nullif(x, '')) ELSE 2 * int(nullif(x, '')) - 9 END), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0)"
).format(d=_DIGITS)
VALID = {
    "email": "rlike(c.d, '^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++$')",
    "ip": f"rlike(c.d, '^{_PART}(?:[.]{_PART}){{3}}$')",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_SIDE = "CASE WHEN {c} = '' OR {c} IS NULL OR rlike({c}, '\\\\s') THEN 0 WHEN rlike({c}, '[A-Za-z0-9]') THEN 2 ELSE 1 END"
_GROUPS = "split(regexp_replace(c.d, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', ''), '[^A-Za-z0-9]+')"
#: Binned features of a candidate c (s: start, m: match, d: plain form) of text t.
FEATURES = {
    "groups": f"least(size({_GROUPS}), 8)",
    "first": f"least(length(element_at({_GROUPS}, 1)), 8)",
    "last": f"least(length(element_at({_GROUPS}, -1)), 8)",
    "longest": f"least(array_max(transform({_GROUPS}, g -> length(g))), 20)",
    "shortest": f"least(array_min(transform({_GROUPS}, g -> length(g))), 8)",
    "spaces": "least(length(c.d) - length(replace(c.d, ' ', '')), 5)",
    "other": "least(length(regexp_replace(c.d, '[A-Za-z0-9 .@()+_%-]', '')), 3)",
    "dots": "least(length(c.d) - length(replace(c.d, '.', '')), 5)",
    "hyphens": "least(length(c.d) - length(replace(c.d, '-', '')), 4)",
    "brackets": "int(contains(c.d, '('))",
    "upper": "int(rlike(c.d, '[A-Z]'))",
    "before": _SIDE.format(c="substring(t, c.s, int(c.s > 0))"),
    "after": _SIDE.format(c="substring(t, c.s + length(c.m) + 1, 1)"),
    "cue": "int(rlike(substring(t, greatest(c.s - 15, 1), least(c.s, 16)), '(?i)(?:mail|tel|phone|fax|mobil|call|card|visa|account|server|host|addr)'))",
}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, needs: str) -> str:
    """array<struct<s: start, m: match>> of the leftmost matches in t that don't overlap."""
    p = _sql(pattern)
    none = "CAST(array() AS array<struct<s: int, m: string>>)"
    found = f"arrays_zip(split(t, {p}, -1), regexp_extract_all(t, {p}, 0))"
    blocks = f"transform(sequence(0, int((size(z) - 1) / {BLOCK})), k -> slice(z, k * {BLOCK} + 1, {BLOCK}))"
    # where each block starts, then the matches of each block from there
    length = "length(x['0']) + coalesce(length(x['1']), 0)"
    starts = f"aggregate(b, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (a, q) -> named_struct('at', a.at + aggregate(q, 0, (n, x) -> n + {length}), 'out', concat(a.out, array(a.at))), a -> a.out)"
    inner = f"""aggregate(q.block, named_struct('at', q.start, 'out', {none}), (a, x) -> named_struct(
            'at', a.at + {length},
            'out', CASE WHEN x['1'] IS NULL THEN a.out ELSE concat(a.out, array(named_struct('s', a.at + length(x['0']), 'm', x['1']))) END), a -> a.out)"""
    placed = f"flatten(element_at(transform(array({blocks}), b -> transform(arrays_zip(b, {starts}), w -> element_at(transform(array(named_struct('block', w.b, 'start', w['1'])), q -> {inner}), 1))), 1))"
    return f"CASE WHEN {needs} THEN element_at(transform(array({found}), z -> {placed}), 1) ELSE {none} END"


def candidates(docs: DataFrame) -> DataFrame:
    """One light row per document: doc_id, base (spans that stay), tried (base matches with their features, whether they are valid) and
    wide (other matches with features, whether their plain form is valid and whether they count as look-alikes), fold."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    plain = f"x -> named_struct('s', x.s, 'm', x.m, 'd', {_PLAIN})"
    found = text.select(
        "doc_id", "t", *[F.expr(f"transform({_matches(BASE[k], NEEDS[k])}, x -> named_struct('s', x.s, 'm', x.m, 'd', x.m))").alias(f"b_{k}") for k in KINDS], *[F.expr(f"transform({_matches(WIDE[k], WIDE_NEEDS[k])}, {plain})").alias(f"w_{k}") for k in KINDS]
    )
    features = ", ".join(f"'{name}', {value}" for name, value in FEATURES.items())

    def described(column: str, k: int, label: str) -> str:
        return f"transform({column}, c -> named_struct('s', c.s, 'k', {k}, 'e', c.s + length(c.m), 'ok', coalesce({VALID[KINDS[k]]}, false), 'label', {label}, {features}))"

    base = "concat(" + ", ".join(described(f"b_{name}", k, f"int(coalesce({VALID[name]}, false))") for k, name in enumerate(KINDS)) + ")"
    # no label: an obfuscated form, or a base match, which has its label as such
    unknown = [f"c.d <> c.m OR rlike(c.m, {_sql('^(?:' + BASE[name] + ')$')})" for name in KINDS]
    wide = "concat(" + ", ".join(described(f"w_{name}", k, f"CASE WHEN {unknown[k]} THEN -1 ELSE 0 END") for k, name in enumerate(KINDS)) + ")"
    fold = F.pmod(F.xxhash64("doc_id", F.lit(FOLD)), F.lit(FOLD)) == 0
    out = found.select("doc_id", F.expr(base).alias("tried"), F.expr(wide).alias("wide"), fold.alias("fold"))
    return written(out.withColumn("base", F.expr("array_sort(transform(filter(tried, c -> c.ok), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)))")), "candidates")


# Boosting on counted rows -----------------------------------------------------------------------------------------------


def _split(rows: list[tuple], grad: list[float], hess: list[float], members: list[int], depth: int, n_features: int):
    """A tree as nested tuples (feature, bin, left, right) or a leaf value; left: feature <= bin."""
    g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
    leaf = -g / (h + 1.0)
    if depth == 0 or len(members) < 2:
        return leaf
    best = (1e-6, None, None)
    for f in range(n_features):
        bins: dict[int, list[float]] = {}
        for i in members:
            b = bins.setdefault(rows[i][f], [0.0, 0.0])
            b[0] += grad[i]
            b[1] += hess[i]
        gl = hl = 0.0
        for value in sorted(bins)[:-1]:
            gl += bins[value][0]
            hl += bins[value][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, f, value)
    if best[1] is None:
        return leaf
    _, f, value = best
    left = [i for i in members if rows[i][f] <= value]
    right = [i for i in members if rows[i][f] > value]
    return f, value, _split(rows, grad, hess, left, depth - 1, n_features), _split(rows, grad, hess, right, depth - 1, n_features)


def _value(tree, row: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(rows: list[tuple], valid: list[float], count: list[float]) -> tuple[float, list]:
    """Trees on log loss; rows are distinct feature rows, count how often each stands, valid how often it is valid."""
    if not rows:
        return 0.0, []
    bias = math.log((sum(valid) + 1) / (sum(count) - sum(valid) + 1))
    score = [bias] * len(rows)
    trees = []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [n * q - v for n, q, v in zip(count, p, valid)]
        hess = [n * q * (1 - q) for n, q in zip(count, p)]
        tree = _split(rows, grad, hess, list(range(len(rows))), DEPTH, len(rows[0]))
        trees.append(tree)
        score = [s + RATE * _value(tree, r) for s, r in zip(score, rows)]
    return bias, trees


def _tree_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"double({tree!r})"
    f, value, left, right = tree
    return f"CASE WHEN c.{names[f]} <= {value} THEN {_tree_sql(left, names)} ELSE {_tree_sql(right, names)} END"


def _score_sql(bias: float, trees: list, names: list[str]) -> str:
    return " + ".join([f"double({bias!r})", *[f"{RATE} * ({_tree_sql(t, names)})" for t in trees]])


def _grown(rows: DataFrame, names: list[str]):
    """The tree of _split over rows (c: features, g, h), by levels; what is collected is a sum for each node, feature and bin."""
    leaf = lambda g, h: -g / (h + 1.0)
    conds, open_, splits, leaves = {"": "true"}, [""], {}, {}
    for level in range(DEPTH):
        node = "CASE " + " ".join(f"WHEN {conds[p]} THEN '{p}'" for p in open_) + " END"
        bins = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"c.{n}").cast("int").alias("b")) for f, n in enumerate(names)])
        each = rows.select(F.expr(node).alias("p"), "g", "h", F.explode(bins).alias("x")).where("p is not null")
        sums: dict = {}
        for r in each.groupBy("p", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():
            sums.setdefault(r["p"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"], r["n"])
        following = []
        for p in open_:
            g, h, n = (sum(x[i] for x in sums[p][0].values()) for i in range(3))
            best = (1e-6, None, None, 0.0, 0.0)
            for f in range(len(names)):
                gl = hl = 0.0
                for value in sorted(sums[p][f])[:-1]:
                    gl, hl = gl + sums[p][f][value][0], hl + sums[p][f][value][1]
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, f, value, gl, hl)
            _, f, value, gl, hl = best
            if f is None or n < 2:
                leaves[p] = leaf(g, h)
                continue
            splits[p] = (f, value)
            for side, sign, gs, hs in (("l", "<=", gl, hl), ("r", ">", g - gl, h - hl)):
                conds[p + side] = f"{conds[p]} AND c.{names[f]} {sign} {value}"
                leaves[p + side] = leaf(gs, hs)
                following.append(p + side)
        open_ = following
        if not open_:
            break

    def built(p: str):
        return (*splits[p], built(p + "l"), built(p + "r")) if p in splits else leaves[p]

    return built("")


def _fit_spread(counted: DataFrame, names: list[str]) -> tuple[str, list[float]]:
    """fit() over any number of distinct feature rows (fold, names, n, valid)."""
    rows = written(counted.select("fold", F.struct(*names).alias("c"), F.col("n").cast("double").alias("n"), F.col("valid").cast("double").alias("valid")), "features")
    fitted = rows.where("NOT fold")
    n, valid = (x or 0.0 for x in fitted.agg(F.sum("n"), F.sum("valid")).first())
    bias, trees = (math.log((valid + 1) / (n - valid + 1)), []) if n else (0.0, [])
    for _ in range(TREES if n else 0):
        p = F.expr(f"1 / (1 + exp(-({_score_sql(bias, trees, names)})))")
        trees.append(_grown(fitted.withColumn("p", p).select("c", F.expr("n * p - valid").alias("g"), F.expr("n * p * (1 - p)").alias("h")), names))
    score = _score_sql(bias, trees, names)
    # threshold() by cumulated sums of each kind
    scored = rows.where("fold").select("c.k", F.expr(score).alias("s"), "valid", "n").groupBy("k", "s").agg(F.sum("valid").alias("v"), F.sum("n").alias("n"))
    order = Window.partitionBy("k").orderBy(F.desc("s"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = scored.select("k", "s", F.sum("v").over(upto).alias("v"), F.sum("n").over(upto).alias("n"), F.coalesce(F.lead("s").over(order), F.least("s", F.lit(0.0))).alias("below"))
    best = {r["k"]: r["best"] for r in summed.where(f"v > 0 AND v >= {PRECISION} * n").groupBy("k").agg(F.min(F.expr("(s + below) / 2")).alias("best")).collect()}
    discard(rows)
    return score, [max(best.get(k, 1e9), 0.0) for k in range(len(KINDS))]


def fit(found: DataFrame) -> tuple[str, list[float]]:
    """SQL of a candidate's score and the threshold of each kind."""
    names = ["k", *FEATURES]
    each = found.select("fold", F.explode(F.concat("tried", "wide")).alias("c")).where("c.label >= 0").select("fold", "c.label", *[f"c.{n}" for n in names])
    counted = each.groupBy("fold", *names).agg(F.count("*").alias("n"), F.sum("label").alias("valid"))
    got = counted.limit(FEATURE_ROWS + 1).collect()
    if len(got) > FEATURE_ROWS:
        return _fit_spread(counted, names)
    got.sort(key=lambda r: (-r["n"], r["fold"], *[r[n] for n in names]))
    fitted = [r for r in got if not r["fold"]]
    rows = [tuple(r[n] for n in names) for r in fitted]
    bias, trees = boost(rows, [float(r["valid"]) for r in fitted], [float(r["n"]) for r in fitted])
    thresholds = []
    for k in range(len(KINDS)):
        mine = [(bias + RATE * sum(_value(t, tuple(r[n] for n in names)) for t in trees), r["valid"], r["n"]) for r in got if r["fold"] and r["k"] == k]
        thresholds.append(threshold(mine))
    return _score_sql(bias, trees, names), thresholds


def threshold(scored: list[tuple[float, float, float]]) -> float:
    """Half way between the lowest score from which on PRECISION of the rows (score, valid, all) are valid and the next one below;
    never below even odds, out of reach where none is valid."""
    scored = sorted(scored, reverse=True)
    best, v_sum, n_sum = 1e9, 0.0, 0.0
    for at, (s, v, n) in enumerate(scored):
        v_sum, n_sum = v_sum + v, n_sum + n
        last = at + 1 == len(scored)
        below = min(s, 0.0) if last else scored[at + 1][0]
        if (below < s or last) and v_sum and v_sum >= PRECISION * n_sum:
            best = (s + below) / 2
    return max(best, 0.0)


def _joined(spans: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, c -> concat_ws(':', element_at({kinds}, c.k + 1), c.s, c.e)), ',')"


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, and n_added."""
    found = candidates(docs)
    score, thresholds = fit(found)
    limit = "element_at(array(" + ", ".join(f"double({t!r})" for t in thresholds) + "), c.k + 1)"
    added = f"filter(wide, c -> c.ok AND ({score}) >= {limit} AND NOT exists(base, b -> b.s < c.e AND c.s < b.e))"
    # longest first, an added span keeps out others that overlap it
    ordered = f"array_sort(transform({added}, c -> named_struct('n', c.s - c.e, 's', c.s, 'k', c.k, 'e', c.e)))"
    none = "CAST(array() AS array<struct<s: int, k: int, e: int>>)"
    kept = f"aggregate({ordered}, {none}, (a, c) -> CASE WHEN exists(a, b -> b.s < c.e AND c.s < b.e) THEN a ELSE concat(a, array(named_struct('s', c.s, 'k', c.k, 'e', c.e))) END)"
    out = found.select("doc_id", "base", F.expr(f"CASE WHEN size(wide) > 0 THEN {kept} ELSE {none} END").alias("added"))
    counts = [F.expr(f"bigint(size(filter(base, c -> c.k = {k})))").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"), F.expr(_joined("array_sort(concat(base, added))")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redacted(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with every span of `spans` replaced by its kind in brackets; key must tell rows apart."""
    by = spans.select(F.col(key).alias("_key"), F.expr("CASE WHEN spans = '' THEN CAST(array() AS array<array<string>>) ELSE transform(split(spans, ','), x -> split(x, ':')) END").alias("_spans"))
    text = F.expr(
        "aggregate(_spans, named_struct('at', 0, 'out', ''), (a, x) -> CASE WHEN int(x[1]) < a.at THEN a ELSE named_struct('at', int(x[2]),"
        " 'out', concat(a.out, substring(text, a.at + 1, int(x[1]) - a.at), '[', x[0], ']')) END, a -> concat(a.out, substring(text, a.at + 1)))"
    )
    joined = docs.join(by, docs[key].eqNullSafe(by["_key"]), "left")
    return joined.withColumn("text", F.when(F.size("_spans") > 0, text).otherwise(F.col("text"))).select(*docs.columns)
