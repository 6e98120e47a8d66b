"""Quality metrics (A1-A12). All of them read three small tables that are computed once: edge counts between
components (G12), distinct component edges (G11) and component sizes. Rounded to 4 places, as Spark and SQL round."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.model import Architecture, CodeGraph, component_edges, edge_counts

# Fixed values of the balanced score.
PRINCIPLE_WEIGHTS = {
    "AcyclicDependencies": 0.18, "LayeringHealth": 0.17, "ResponsibilityFocus": 0.15, "InterfaceSegregation": 0.12,
    "ComponentBalance": 0.10, "HubBalance": 0.10, "BoundaryClarity": 0.10, "DependencyDistribution": 0.08,
}
COHESION_WEIGHTS = {"TurboMQNormalised": 0.40, "RCI": 0.35, "BasicMQ": 0.25}
BALANCED_WEIGHTS = {"cohesion": 0.50, "alignment": 0.35, "discipline": 0.15}
SEVERITY_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
CORE = ("RCI", "TurboMQ", "BasicMQ", "IntraConnectivity", "InterConnectivity", "TwoWayPairRatio")


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is missing."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


class Measures:
    """The shared tables of a graph under an architecture, and the metrics over them."""

    def __init__(self, graph: CodeGraph, arch: Architecture):
        self.graph, self.arch = graph, arch

    @cached_property
    def counts(self) -> DataFrame:
        return edge_counts(self.graph, self.arch)

    @cached_property
    def pairs(self) -> DataFrame:
        return component_edges(self.graph, self.arch)

    @cached_property
    def sizes(self) -> DataFrame:
        """By name: components that share one are measured as one."""
        return self.arch.sizes().groupBy("component").agg(F.sum("n").alias("n"))

    @cached_property
    def factors(self) -> DataFrame:
        """component, n, mu (inner edges), epsilon (outer edges that touch it), cf, mf."""
        ends = F.when(F.col("src") == F.col("tgt"), F.array("src")).otherwise(F.array("src", "tgt"))
        touched = self.counts.select(F.explode(ends).alias("component"), (F.col("src") == F.col("tgt")).alias("inner_"), "n_edges")
        sums = touched.groupBy("component").agg(
            F.coalesce(F.sum(F.when(F.col("inner_"), F.col("n_edges"))), F.lit(0)).alias("mu"),
            F.coalesce(F.sum(F.when(~F.col("inner_"), F.col("n_edges"))), F.lit(0)).alias("epsilon"),
        )
        out = self.sizes.join(sums, "component", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mu", "epsilon")})
        mu, eps = F.col("mu"), F.col("epsilon")
        return out.withColumns({"cf": _share(2 * mu, 2 * mu + eps), "mf": _share(mu, mu + 0.5 * eps)})

    def rci(self) -> DataFrame:
        """A1."""
        inner = F.sum(F.when(F.col("src") == F.col("tgt"), F.col("n_edges")).otherwise(0))
        return self.counts.agg(F.round(_share(inner, F.sum("n_edges")), 4).alias("value"))

    def turbo_mq(self) -> DataFrame:
        """A2, with the number of components and the value per component."""
        return self.factors.agg(F.round(F.coalesce(F.sum("cf"), F.lit(0.0)), 4).alias("value"), F.count("*").alias("k"), F.round(F.coalesce(F.avg("cf"), F.lit(0.0)), 4).alias("normalised"))

    def basic_mq(self) -> DataFrame:
        """A3."""
        return self.factors.agg(F.round(F.coalesce(F.avg("mf"), F.lit(0.0)), 4).alias("value"))

    def intra_connectivity(self) -> DataFrame:
        """A4: components of fewer than two entities add 0 but count."""
        each = _share(F.col("mu"), F.col("n") * (F.col("n") - 1))
        return self.factors.agg(F.round(F.coalesce(F.avg(each), F.lit(0.0)), 4).alias("value"))

    def inter_connectivity(self) -> DataFrame:
        """A5: over ordered pairs that are connected."""
        a = self.sizes.select(F.col("component").alias("src"), F.col("n").alias("na"))
        b = self.sizes.select(F.col("component").alias("tgt"), F.col("n").alias("nb"))
        each = _share(F.col("n_edges"), F.col("na") * F.col("nb"))
        return self.counts.where("src <> tgt").join(a, "src").join(b, "tgt").agg(F.round(F.coalesce(F.avg(each), F.lit(0.0)), 4).alias("value"))

    def two_way_pair_ratio(self) -> DataFrame:
        """A6."""
        pairs = self.counts.where("src <> tgt").groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.count("*").alias("ways"))
        return pairs.agg(F.round(_share(F.sum((F.col("ways") == 2).cast("int")), F.count("*")), 4).alias("value"))

    def core(self) -> DataFrame:
        """The six metrics in their order."""
        parts = [self.rci(), self.turbo_mq().select("value"), self.basic_mq(), self.intra_connectivity(), self.inter_connectivity(), self.two_way_pair_ratio()]
        rows = [p.select(F.lit(k).alias("seq"), F.lit(n).alias("name"), "value") for k, (n, p) in enumerate(zip(CORE, parts))]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionAll(r)
        return out

    def fan_profile(self) -> DataFrame:
        """Fan-in and fan-out over distinct component pairs, ratios against the other components."""
        into = self.pairs.groupBy(F.col("target").alias("component")).agg(F.count("*").alias("fan_in"))
        out_of = self.pairs.groupBy(F.col("source").alias("component")).agg(F.count("*").alias("fan_out"))
        k = self.sizes.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
        out = self.sizes.select("component").join(into, "component", "left").join(out_of, "component", "left").join(F.broadcast(k))  # k is one row
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "fan_out")})
        return out.select("component", "fan_in", "fan_out", (F.col("fan_in") / F.col("others")).alias("in_ratio"), (F.col("fan_out") / F.col("others")).alias("out_ratio"))

    def signals(self, smells: DataFrame) -> DataFrame:
        """A10: one row with the nine principle signals. smells: smell_type, severity, n_affected."""
        k = self.sizes.agg(F.count("*").alias("k"))
        burden = smell_burden(smells, k)
        sizes = gini(self.sizes.select(F.col("n").alias("x"))).withColumnRenamed("gini", "size_gini")
        fans = self.fan_profile()
        fan = gini(fans.select((F.col("fan_in") + F.col("fan_out")).alias("x"))).withColumnRenamed("gini", "fan_gini")
        hub = fans.agg(
            F.coalesce(F.max(F.greatest("in_ratio", "out_ratio")), F.lit(0.0)).alias("hub"),
            (F.coalesce(F.sum(F.least("in_ratio", "out_ratio")), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("both"),
        )
        core = self.core().groupBy().pivot("name", list(CORE)).agg(F.first("value"))
        row = core
        for other in (burden, sizes, fan, hub):  # one row each
            row = row.join(F.broadcast(other))
        healthy = 0.55 * (1 - F.col("InterConnectivity")) + 0.45 * (1 - F.col("TwoWayPairRatio"))
        unit = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)
        return row.select(
            *CORE,
            unit(1 - F.col("b_cycle")).alias("AcyclicDependencies"),
            unit(0.75 * healthy + 0.25 * (1 - F.col("b_cycle"))).alias("LayeringHealth"),
            unit(1 - F.col("b_focus")).alias("ResponsibilityFocus"),
            unit(1 - F.col("b_link")).alias("InterfaceSegregation"),
            unit(1 - F.col("size_gini")).alias("ComponentBalance"),
            unit(1 - F.col("hub")).alias("HubBalance"),
            unit(1 - F.col("both")).alias("BoundaryClarity"),
            unit(1 - F.col("fan_gini")).alias("DependencyDistribution"),
            unit(1 - F.col("b_all")).alias("SmellDiscipline"),
            F.col("k"),
        )

    def balanced(self, smells: DataFrame) -> DataFrame:
        """The balanced score and what it is made of, from the rounded core metrics."""
        s = self.signals(smells)
        turbo = F.col("TurboMQ") / F.greatest(F.col("k"), F.lit(1))
        cohesion = COHESION_WEIGHTS["TurboMQNormalised"] * F.least(turbo, F.lit(1.0)) + COHESION_WEIGHTS["RCI"] * F.col("RCI") + COHESION_WEIGHTS["BasicMQ"] * F.col("BasicMQ")
        alignment = sum((F.col(n) * w for n, w in PRINCIPLE_WEIGHTS.items()), F.lit(0.0))
        s = s.withColumns({"cohesion": cohesion, "alignment": alignment})
        score = BALANCED_WEIGHTS["cohesion"] * F.col("cohesion") + BALANCED_WEIGHTS["alignment"] * F.col("alignment") + BALANCED_WEIGHTS["discipline"] * F.col("SmellDiscipline")
        return s.select(F.round("cohesion", 4).alias("CohesionFamily"), F.round("alignment", 4).alias("PrincipleAlignment"), "SmellDiscipline", F.round(score, 4).alias("BalancedArchitectureScore"))

    def drivers(self, smells: DataFrame, n: int = 3) -> DataFrame:
        """The n lowest and the n highest of the nine signals, with the gap to 1."""
        names = [*PRINCIPLE_WEIGHTS, "SmellDiscipline"]
        long = self.signals(smells).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("signal", "value"))
        low = long.orderBy("value", "signal").limit(n).select(F.lit("lowest").alias("side"), "signal", "value")
        high = long.orderBy(F.desc("value"), "signal").limit(n).select(F.lit("highest").alias("side"), "signal", "value")
        return low.unionAll(high).select("side", "signal", "value", F.round(1 - F.col("value"), 4).alias("gap"))


def gini(values: DataFrame) -> DataFrame:
    """A8 of column x, one row. Ranks come from counts of equal values, so no row-level global sort is needed."""
    by_value = values.groupBy("x").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one row per distinct value
    ranked = by_value.withColumn("upto", upto)
    # the ranks of c equal values that end at rank u add up to c * (2u - c + 1) / 2
    weighted = F.sum(F.col("x") * F.col("c") * (2 * F.col("upto") - F.col("c") + 1) / 2.0)
    n, total = F.sum("c"), F.sum(F.col("x") * F.col("c"))
    value = F.coalesce(2 * weighted / F.nullif((n * total).cast("double"), F.lit(0.0)) - (n + 1) / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(0.0))
    return ranked.agg(F.when(total > 0, value).otherwise(0.0).alias("gini"))


def smell_burden(smells: DataFrame, k: DataFrame) -> DataFrame:
    """K and the burdens of all smells, cycles, unfocused components and link overload, each within 0 and 1."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in SEVERITY_WEIGHTS.items()], F.lit(0.3))
    each = smells.select("smell_type", (weight * F.col("n_affected")).alias("w"))
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0.0))
    sums = each.agg(
        share(F.lit(True)).alias("b_all"),
        share(F.col("smell_type") == "dependency_cycle").alias("b_cycle"),
        share(F.col("smell_type").isin("concern_overload", "scattered_functionality")).alias("b_focus"),
        share(F.col("smell_type") == "link_overload").alias("b_link"),
    )
    out = k.join(F.broadcast(sums))  # one row each
    return out.select("k", *[F.least(F.lit(1.0), F.col(c) / F.greatest(F.col("k"), F.lit(1))).alias(c) for c in ("b_all", "b_cycle", "b_focus", "b_link")])
