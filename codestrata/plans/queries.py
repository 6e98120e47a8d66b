"""Queries over the driver's tables, one or more for each operator, and their SQL.

Every query is (name, function, SQL or None); the SQL is put together from the same few pieces as the fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import component_title, tokens
from codestrata.operators import clusters, compare, inspect, merge, packages, search, smells, traverse
from codestrata.operators.metrics import Measures, gini
from codestrata.operators.similarity import similar_pairs
from codestrata.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL pieces --------------------------------------------------------------------------------------------------------------

_ENT = """ent AS (
  SELECT *, package || '.' || name AS fqn, 'src/' || replace(package, '.', '/') || '/' || w2 || '.java' AS file_path FROM (
    SELECT *, w1 || w2 || p_partkey AS name FROM (
      SELECT p_partkey, p_type, p_brand, p_size, p_partkey AS entity_seq,
        'shop.' || lower(p_type) || '.' || lower(replace(p_brand, '#', '')) AS package,
        upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS w1,
        upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS w2,
        CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'enum' ELSE 'method' END AS kind,
        CASE p_partkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'kotlin' ELSE 'python' END AS language
      FROM part))
)"""


def _edges() -> str:
    return """edges AS (
  SELECT s.fqn AS source, t.fqn AS target, relation, x * 8589934592 + y * 4 + CASE relation WHEN 'extends' THEN 0 WHEN 'implements' THEN 1 ELSE 2 END AS edge_seq FROM (
    SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y, CASE a.l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'extends' ELSE 'implements' END AS relation
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)
  JOIN ent s ON s.p_partkey = x JOIN ent t ON t.p_partkey = y
)"""


_EC = """ec AS (SELECT a.component AS src, b.component AS tgt, count(*) AS n_edges FROM edges e JOIN m a ON e.source = a.fqn JOIN m b ON e.target = b.fqn GROUP BY ALL),
ce AS (SELECT src AS source, tgt AS target FROM ec WHERE src <> tgt),
sizes AS (SELECT component, count(*) AS n FROM m GROUP BY ALL),
factors AS (
  SELECT s.component, s.n, coalesce(mu, 0) AS mu, coalesce(epsilon, 0) AS epsilon,
    CASE WHEN coalesce(2 * mu + epsilon, 0) > 0 THEN 2.0::DOUBLE * mu / (2 * mu + epsilon) ELSE 0::DOUBLE END AS cf,
    CASE WHEN coalesce(2 * mu + epsilon, 0) > 0 THEN mu / (mu + 0.5::DOUBLE * epsilon) ELSE 0::DOUBLE END AS mf
  FROM sizes s LEFT JOIN (
    SELECT component, CAST(sum(CASE WHEN inside THEN n_edges ELSE 0 END) AS BIGINT) AS mu, CAST(sum(CASE WHEN inside THEN 0 ELSE n_edges END) AS BIGINT) AS epsilon FROM (
      SELECT src AS component, src = tgt AS inside, n_edges FROM ec UNION ALL SELECT tgt, false, n_edges FROM ec WHERE src <> tgt) GROUP BY ALL) x USING (component))"""


def _gp(component: str | None = "p_type") -> str:
    parts = [_ENT, _edges()]
    if component:
        parts += [f"m AS (SELECT fqn, {component} AS component, entity_seq FROM ent)", _EC]
    return "WITH RECURSIVE " + ",\n".join(parts)


def _gn(top: int) -> str:
    return f"""WITH RECURSIVE ent AS (SELECT n_name AS fqn, n_name AS name, r_name AS package, n_nationkey AS entity_seq FROM nation JOIN region ON n_regionkey = r_regionkey),
heavy AS (
  SELECT cn, sn, row_number() OVER (PARTITION BY cn ORDER BY q DESC, sn) AS r FROM (
    SELECT c_nationkey AS cn, s_nationkey AS sn, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE c_nationkey <> s_nationkey GROUP BY ALL)),
edges AS (SELECT a.n_name AS source, b.n_name AS target, 'uses' AS relation FROM heavy JOIN nation a ON a.n_nationkey = cn JOIN nation b ON b.n_nationkey = sn WHERE r <= {top}),
m AS (SELECT fqn, package AS component FROM ent),
{_EC}"""


_CORE = """core AS (
  SELECT 0 AS seq, 'RCI' AS name, (SELECT round(coalesce(sum(CASE WHEN src = tgt THEN n_edges END)::DOUBLE / sum(n_edges), 0), 4) FROM ec) AS value
  UNION ALL SELECT 1, 'TurboMQ', (SELECT round(sum(cf), 4) FROM factors)
  UNION ALL SELECT 2, 'BasicMQ', (SELECT round(avg(mf), 4) FROM factors)
  UNION ALL SELECT 3, 'IntraConnectivity', (SELECT round(avg(CASE WHEN n > 1 THEN mu::DOUBLE / (n * (n - 1)) ELSE 0 END), 4) FROM factors)
  UNION ALL SELECT 4, 'InterConnectivity', (SELECT round(coalesce(avg(n_edges::DOUBLE / (a.n * b.n)), 0), 4) FROM ec JOIN sizes a ON a.component = src JOIN sizes b ON b.component = tgt WHERE src <> tgt)
  UNION ALL SELECT 5, 'TwoWayPairRatio', (SELECT round(coalesce(avg(CASE WHEN ways = 2 THEN 1.0::DOUBLE ELSE 0 END), 0), 4) FROM (SELECT count(*) AS ways FROM ce GROUP BY least(source, target), greatest(source, target)))
)"""

_FANS = """fans AS (
  SELECT s.component, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0)::DOUBLE / k AS in_ratio, coalesce(o.n, 0)::DOUBLE / k AS out_ratio
  FROM sizes s LEFT JOIN (SELECT target AS component, count(*) AS n FROM ce GROUP BY ALL) i USING (component)
  LEFT JOIN (SELECT source AS component, count(*) AS n FROM ce GROUP BY ALL) o USING (component), (SELECT greatest(count(*) - 1, 1) AS k FROM sizes) kk)"""

_SCC = """reach AS (SELECT source, target FROM ce UNION SELECT r.source, c.target FROM reach r JOIN ce c ON r.target = c.source),
scc AS (SELECT least(a.source, min(a.target)) AS scc, a.source AS member FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.source),
cycles AS (SELECT string_agg(member, ',' ORDER BY member) AS affected, CAST(count(*) AS INTEGER) AS size, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM scc GROUP BY scc),
links AS (
  SELECT component, dependents, round(ratio, 4) AS ratio, CASE WHEN ratio >= 0.75 THEN 'high' ELSE 'medium' END AS severity FROM (
    SELECT target AS component, count(*) AS dependents, count(*)::DOUBLE / greatest((SELECT count(*) FROM sizes) - 1, 1) AS ratio FROM ce GROUP BY ALL)
  WHERE (SELECT count(*) FROM sizes) > 2 AND dependents >= 3 AND ratio >= 0.5),
inner_ AS (SELECT src AS component, n_edges FROM ec WHERE src = tgt),
overload AS (
  SELECT s.component, s.n AS entity_count, CASE WHEN s.n > 40 THEN 'high' ELSE 'medium' END AS severity, coalesce(i.n_edges, 0) AS internal_edges, round(coalesce(i.n_edges, 0)::DOUBLE / s.n, 2) AS density
  FROM sizes s LEFT JOIN inner_ i USING (component) WHERE s.n > 20 AND coalesce(i.n_edges, 0)::DOUBLE / s.n < 0.4)"""

_GINI = """(SELECT CASE WHEN sum(x) > 0 THEN 2 * sum(i * x)::DOUBLE / (count(*) * sum(x)) - (count(*) + 1)::DOUBLE / count(*) ELSE 0 END FROM (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT {x} AS x FROM {t})))"""

_SIGNALS = f"""{_CORE}, {_FANS}, {_SCC},
allsmells AS (SELECT 'c' AS t, severity, size AS n FROM cycles UNION ALL SELECT 'o', severity, 1 FROM overload UNION ALL SELECT 'l', severity, 1 FROM links),
burden AS (SELECT k, least(1, coalesce(sum(w), 0) / k) AS b_all, least(1, coalesce(sum(CASE WHEN t = 'c' THEN w END), 0) / k) AS b_cycle,
    least(1, coalesce(sum(CASE WHEN t = 'o' THEN w END), 0) / k) AS b_focus, least(1, coalesce(sum(CASE WHEN t = 'l' THEN w END), 0) / k) AS b_link
  FROM (SELECT count(*) AS k FROM sizes) LEFT JOIN (SELECT t, n * CASE severity WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS w FROM allsmells) ON true GROUP BY k),
row_ AS (
  SELECT (SELECT value FROM core WHERE seq = 0) AS RCI, (SELECT value FROM core WHERE seq = 1) AS TurboMQ, (SELECT value FROM core WHERE seq = 2) AS BasicMQ,
    (SELECT value FROM core WHERE seq = 3) AS IntraConnectivity, (SELECT value FROM core WHERE seq = 4) AS InterConnectivity, (SELECT value FROM core WHERE seq = 5) AS TwoWayPairRatio,
    k, b_all, b_cycle, b_focus, b_link, {_GINI.format(x='n', t='sizes')} AS size_gini, {_GINI.format(x='fan_in + fan_out', t='fans')} AS fan_gini,
    (SELECT max(greatest(in_ratio, out_ratio)) FROM fans) AS hub, (SELECT sum(least(in_ratio, out_ratio)) / count(*) FROM fans) AS both_
  FROM burden),
signals AS (
  SELECT RCI, TurboMQ, BasicMQ, IntraConnectivity, InterConnectivity, TwoWayPairRatio, k,
    round(1 - b_cycle, 4) AS AcyclicDependencies,
    round(greatest(0, least(1, 0.75::DOUBLE * (0.55::DOUBLE * (1 - InterConnectivity) + 0.45::DOUBLE * (1 - TwoWayPairRatio)) + 0.25::DOUBLE * (1 - b_cycle))), 4) AS LayeringHealth,
    round(1 - b_focus, 4) AS ResponsibilityFocus, round(1 - b_link, 4) AS InterfaceSegregation, round(greatest(0, least(1, 1 - size_gini)), 4) AS ComponentBalance,
    round(greatest(0, least(1, 1 - hub)), 4) AS HubBalance, round(greatest(0, least(1, 1 - both_)), 4) AS BoundaryClarity, round(greatest(0, least(1, 1 - fan_gini)), 4) AS DependencyDistribution, round(1 - b_all, 4) AS SmellDiscipline
  FROM row_)"""
_NAMES = "AcyclicDependencies LayeringHealth ResponsibilityFocus InterfaceSegregation ComponentBalance HubBalance BoundaryClarity DependencyDistribution SmellDiscipline".split()
_WEIGHTED = " + ".join(f"{w}::DOUBLE * {n}" for n, w in zip(_NAMES, (0.18, 0.17, 0.15, 0.12, 0.10, 0.10, 0.10, 0.08)))


def _nation_smells(spark: SparkSession, sf_dir: str, top: int = 2) -> tuple[Measures, DataFrame]:
    graph, arch = fx.nation_graph(spark, sf_dir, top)
    return Measures(graph, arch), smells.counted(smells.detect(graph, arch))


def _by(name: str) -> Callable:
    return {"type": fx.by_type, "brand": fx.by_brand, "package": fx.by_package}[name]


def _measures(spark: SparkSession, sf_dir: str, by: str = "type") -> Measures:
    graph = fx.part_graph(spark, sf_dir)
    return Measures(graph, _by(by)(graph))


# Metrics -----------------------------------------------------------------------------------------------------------------


@query(_gp("p_brand") + f", {_CORE} SELECT value FROM core WHERE seq = 0")
def rci(spark, sf_dir):
    return _measures(spark, sf_dir, "brand").rci()


@query(_gp() + " SELECT component, n, mu, epsilon, round(cf, 6) AS cf FROM factors")
def turbo_mq_cf(spark, sf_dir):
    return _measures(spark, sf_dir).factors.select("component", "n", "mu", "epsilon", F.round("cf", 6).alias("cf"))


@query(_gp("package") + " SELECT round(sum(cf), 4) AS value, count(*) AS k, round(avg(cf), 4) AS normalised FROM factors")
def turbo_mq(spark, sf_dir):
    return _measures(spark, sf_dir, "package").turbo_mq()


@query(_gp("p_brand") + f", {_CORE} SELECT value FROM core WHERE seq = 2")
def basic_mq(spark, sf_dir):
    return _measures(spark, sf_dir, "brand").basic_mq()


@query(_gp("p_brand") + f", {_CORE} SELECT value FROM core WHERE seq = 3")
def intra_connectivity(spark, sf_dir):
    return _measures(spark, sf_dir, "brand").intra_connectivity()


@query(_gp("p_brand") + f", {_CORE} SELECT value FROM core WHERE seq = 4")
def inter_connectivity(spark, sf_dir):
    return _measures(spark, sf_dir, "brand").inter_connectivity()


@query(_gn(2) + f", {_CORE} SELECT value FROM core WHERE seq = 5")
def two_way_pair_ratio(spark, sf_dir):
    return Measures(*fx.nation_graph(spark, sf_dir, 2)).two_way_pair_ratio()


@query(_gp() + f", {_CORE} SELECT seq, name, value FROM core")
def all_metrics(spark, sf_dir):
    return _measures(spark, sf_dir).core()


@query(_gp("package") + f" SELECT round({_GINI.format(x='n', t='sizes')}, 6) AS gini")
def gini_sizes(spark, sf_dir):
    return gini(_measures(spark, sf_dir, "package").sizes.select(F.col("n").alias("x"))).select(F.round("gini", 6).alias("gini"))


@query(_gn(2) + f", {_FANS} SELECT component, fan_in, fan_out, round(in_ratio, 4) AS in_ratio, round(out_ratio, 4) AS out_ratio FROM fans")
def fan_profile(spark, sf_dir):
    out = Measures(*fx.nation_graph(spark, sf_dir, 2)).fan_profile()
    return out.select("component", "fan_in", "fan_out", F.round("in_ratio", 4).alias("in_ratio"), F.round("out_ratio", 4).alias("out_ratio"))


@query(_gn(2) + f", {_SIGNALS} SELECT {', '.join(_NAMES)} FROM signals")
def principle_signals(spark, sf_dir):
    m, s = _nation_smells(spark, sf_dir)
    return m.signals(s).select(*_NAMES)


@query(
    _gn(2)
    + f""", {_SIGNALS}, fam AS (SELECT *, 0.40::DOUBLE * least(TurboMQ / k, 1) + 0.35::DOUBLE * RCI + 0.25::DOUBLE * BasicMQ AS c, {_WEIGHTED} AS a FROM signals)
SELECT round(c, 4) AS CohesionFamily, round(a, 4) AS PrincipleAlignment, SmellDiscipline, round(0.5::DOUBLE * c + 0.35::DOUBLE * a + 0.15::DOUBLE * SmellDiscipline, 4) AS BalancedArchitectureScore FROM fam"""
)
def balanced_score(spark, sf_dir):
    m, s = _nation_smells(spark, sf_dir)
    return m.balanced(s)


@query(
    _gn(2)
    + f""", {_SIGNALS}, long AS ({' UNION ALL '.join(f"SELECT '{n}' AS signal, {n} AS value FROM signals" for n in _NAMES)})
SELECT side, signal, value, round(1 - value, 4) AS gap FROM (
  (SELECT 'lowest' AS side, * FROM long ORDER BY value, signal LIMIT 3) UNION ALL (SELECT 'highest', * FROM long ORDER BY value DESC, signal LIMIT 3))"""
)
def score_drivers(spark, sf_dir):
    m, s = _nation_smells(spark, sf_dir)
    return m.drivers(s)


# Components --------------------------------------------------------------------------------------------------------------


@query(_gp("package") + " SELECT source, target FROM ce")
def component_edges(spark, sf_dir):
    return _measures(spark, sf_dir, "package").pairs


@query(_gp("p_brand") + " SELECT src, tgt, n_edges FROM ec")
def edge_counts(spark, sf_dir):
    return _measures(spark, sf_dir, "brand").counts


@query(
    _gp("p_brand")
    + """ SELECT a.component AS source, b.component AS target, count(*) AS n_edges FROM edges e JOIN m a ON e.source = a.fqn JOIN m b ON e.target = b.fqn
WHERE a.component <> b.component GROUP BY ALL ORDER BY n_edges DESC, min(edge_seq), source, target LIMIT 10"""
)
def most_coupled(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return inspect.most_coupled(graph, fx.by_brand(graph))


@query(_gp("package") + " SELECT component, n AS num_entities FROM sizes ORDER BY n DESC, component LIMIT 10")
def largest_components(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return inspect.largest(fx.by_package(graph))


@query("WITH " + _ENT + " SELECT fqn, p_type AS component FROM ent")
def component_of(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return fx.by_type(graph).membership_first()


@query(_gn(2) + " SELECT target FROM ce WHERE source = 'ASIA'")
def dependencies(spark, sf_dir):
    return Measures(*fx.nation_graph(spark, sf_dir, 2)).pairs.where("source = 'ASIA'").select("target")


@query(_gn(2) + " SELECT source FROM ce WHERE target = 'ASIA'")
def dependents(spark, sf_dir):
    return Measures(*fx.nation_graph(spark, sf_dir, 2)).pairs.where("target = 'ASIA'").select("source")


@query(_gp("p_brand") + " SELECT (SELECT count(*) FROM sizes) AS num_components, (SELECT count(*) FROM ent) AS num_entities, (SELECT count(*) FROM edges) AS num_edges, (SELECT count(*) FROM ce) AS num_component_edges")
def arch_summary(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return inspect.arch_summary(graph, fx.by_brand(graph))


@query(
    """SELECT n.n_name AS component, count(*) AS n_edges FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
JOIN customer ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey GROUP BY ALL"""
)
def trade_fan_out(spark, sf_dir):
    graph = fx.trade_graph(spark, sf_dir)
    e = graph.entities.select(F.col("fqn").alias("source"), F.col("package").alias("component"))
    return graph.edges.join(e, "source").groupBy("component").agg(F.count("*").alias("n_edges"))


# Packages ----------------------------------------------------------------------------------------------------------------


@query("WITH " + _ENT + ", s AS (SELECT DISTINCT split_part(package, '.', 1) AS a FROM ent) SELECT CASE WHEN count(*) = 1 THEN min(a) ELSE '' END AS prefix FROM s")
def pkg_prefix(spark, sf_dir):
    return spark.createDataFrame([(".".join(packages.common_prefix(fx.part_entities(spark, sf_dir))),)], "prefix string")


@query("WITH " + _ENT + " SELECT CASE WHEN count(DISTINCT split_part(package, '.', 2)) >= 5 THEN 1 WHEN count(DISTINCT package) >= 5 THEN 2 ELSE 4 END AS depth FROM ent")
def pkg_auto_depth(spark, sf_dir):
    return spark.createDataFrame([(packages.auto_depth(fx.part_entities(spark, sf_dir), 1),)], "depth int")


@query("WITH " + _ENT + " SELECT fqn, split_part(package, '.', 2) AS grp FROM ent")
def pkg_groups(spark, sf_dir):
    return packages.package_groups(fx.part_entities(spark, sf_dir), 1, 1).select("fqn", "grp")


_GROUPED = _gp(None) + """, g AS (SELECT fqn, split_part(package, '.', 2) AS grp FROM ent),
x AS (SELECT source, target, a.grp AS src, b.grp AS tgt FROM edges JOIN g a ON source = a.fqn JOIN g b ON target = b.fqn),
hubs AS (SELECT fqn FROM (SELECT target AS fqn, (src = tgt)::INT AS i, (src <> tgt)::INT AS a FROM x UNION ALL SELECT source, 0, 1 FROM x WHERE src <> tgt) GROUP BY fqn HAVING sum(i) >= 2 AND sum(a) = 0),
moves AS (
  SELECT fqn, own AS grp, max(far) FILTER (o AND own <> far) AS to_grp FROM (
    SELECT source AS fqn, target AS other, src AS own, tgt AS far, true AS o FROM x UNION ALL SELECT target, source, tgt, src, false FROM x)
  GROUP BY fqn, own
  HAVING count(*) FILTER (own = far AND other NOT IN (SELECT fqn FROM hubs)) = 0 AND count(*) FILTER (own <> far AND NOT o) = 0 AND count(DISTINCT far) FILTER (own <> far AND o) = 1
    AND own IN (SELECT grp FROM g GROUP BY grp HAVING count(*) > 1)),
refined AS (SELECT fqn, coalesce(to_grp, g.grp) AS grp FROM g LEFT JOIN moves USING (fqn))"""


def _grouped(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return graph, packages.package_groups(graph.entities, 1, 1)


@query(_GROUPED + " SELECT fqn FROM hubs")
def utility_hubs(spark, sf_dir):
    graph, groups = _grouped(spark, sf_dir)
    return packages.utility_hubs(graph.edges, groups)


@query(_GROUPED + " SELECT fqn, grp, to_grp FROM moves")
def facade_moves(spark, sf_dir):
    graph, groups = _grouped(spark, sf_dir)
    return packages.facade_moves(graph.edges, groups)


@query(_GROUPED + " SELECT upper(substr(grp, 1, 1)) || substr(grp, 2) AS name, count(*) AS n FROM refined GROUP BY ALL")
def pkg_components(spark, sf_dir):
    return packages.recover_packages(fx.part_graph(spark, sf_dir)).membership.groupBy("name").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT p_name FROM part) SELECT p_name, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS title FROM w")
def component_titles(spark, sf_dir):
    return fx.read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", component_title(F.regexp_replace("p_name", " ", "_")).alias("title"))


# Smells ------------------------------------------------------------------------------------------------------------------


@query(_gn(2) + f", {_SCC} SELECT * FROM cycles")
def dependency_cycles(spark, sf_dir):
    out = smells.dependency_cycles(*fx.nation_graph(spark, sf_dir, 2))
    return out.withColumn("affected", F.array_join("affected", ","))


@query(_gn(2) + ", reach AS (SELECT source, target FROM edges UNION SELECT r.source, c.target FROM reach r JOIN edges c ON r.target = c.source) SELECT least(a.source, min(a.target)) AS scc, a.source AS member FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.source")
def entity_cycles(spark, sf_dir):
    return smells.strong_components(fx.nation_graph(spark, sf_dir, 2)[0].edges)


@query(_gp("p_brand") + f", {_SCC} SELECT * FROM overload")
def concern_overload(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return smells.concern_overload(graph, fx.by_brand(graph))


@query(
    "WITH " + _ENT + """, ends AS (SELECT DISTINCT p_brand, CASE WHEN name LIKE '%0' THEN '0' WHEN name LIKE '%1' THEN '1' WHEN name LIKE '%2' THEN '2' END AS pattern FROM ent)
SELECT pattern, string_agg(p_brand, ',' ORDER BY p_brand) AS components, CAST(count(*) AS INTEGER) AS n_components, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END AS severity FROM ends WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 3"""
)
def scattered_functionality(spark, sf_dir):
    """Part names end in digits, so digits stand in for the endings here."""
    graph = fx.part_graph(spark, sf_dir)
    out = smells.scattered_functionality(graph, fx.by_brand(graph), suffixes=["0", "1", "2"])
    return out.withColumn("components", F.array_join("components", ","))


@query(_gn(2) + f", {_SCC} SELECT * FROM links")
def link_overload(spark, sf_dir):
    return smells.link_overload(*fx.nation_graph(spark, sf_dir, 2))


@query(
    _gn(2)
    + f""", {_SCC} SELECT 0 AS detector_seq, 'dependency_cycle' AS smell_type, severity, affected FROM cycles UNION ALL SELECT 1, 'concern_overload', severity, component FROM overload UNION ALL SELECT 3, 'link_overload', severity, component FROM links"""
)
def detect_smells(spark, sf_dir):
    out = smells.detect(*fx.nation_graph(spark, sf_dir, 2))
    return out.select("detector_seq", "smell_type", "severity", F.array_join("affected", ",").alias("affected"))


# Traversal ---------------------------------------------------------------------------------------------------------------

_CONE = """, seed AS (SELECT fqn FROM ent WHERE p_partkey = 0), walk AS (
  SELECT fqn, 0 AS distance FROM seed UNION SELECT {far}, distance + 1 FROM walk JOIN edges ON {near} = fqn WHERE distance < {depth}),
cone AS (SELECT fqn, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY fqn HAVING min(distance) > 0)"""


def _seed(graph):
    return graph.entities.where("p_partkey = 0").select("fqn")


@query(_gp(None) + _CONE.format(near="source", far="target", depth=2) + " SELECT fqn, distance FROM cone")
def cone_upstream(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return traverse.walk_cone(graph.edges, _seed(graph), 2, None, graph.entities).nodes.select("fqn", "distance")


@query(_gp(None) + _CONE.format(near="target", far="source", depth=2) + " SELECT fqn, distance FROM cone")
def cone_downstream(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return traverse.walk_cone(graph.reverse_edges(), _seed(graph), 2, None, graph.entities).nodes.select("fqn", "distance")


@query(
    _gp(None)
    + _CONE.format(near="source", far="target", depth=1)
    + ", best AS (SELECT target AS fqn, relation, row_number() OVER (PARTITION BY target ORDER BY edge_seq) AS r FROM edges WHERE source IN (SELECT fqn FROM seed)) SELECT fqn, distance, relation AS via_relation FROM cone JOIN best USING (fqn) WHERE r = 1"
)
def cone_via_relation(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return traverse.walk_cone(graph.edges, _seed(graph), 1, None, graph.entities).nodes


@query(_gp(None) + _CONE.format(near="source", far="target", depth=2) + " SELECT DISTINCT file_path FROM cone JOIN ent USING (fqn)")
def cone_files(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return traverse.cone_files(graph, traverse.walk_cone(graph.edges, _seed(graph), 2, None, graph.entities).nodes)


_CHANGED = ["economy/brand2/Ring.java", "src/shop/promo/brand1/Mint.java", "nowhere/src/shop/standard/brand3/Ring.java"]
_CHANGED_SQL = """, changed AS (SELECT unnest(['economy/brand2/Ring.java', 'src/shop/promo/brand1/Mint.java', 'nowhere/src/shop/standard/brand3/Ring.java']) AS changed),
hit AS (SELECT DISTINCT fqn, changed FROM ent, changed WHERE file_path = changed OR ends_with(file_path, '/' || changed) OR ends_with(changed, '/' || file_path))"""


def _changed(spark, graph):
    return traverse.changed_entities(graph, spark.createDataFrame([(c,) for c in _CHANGED], "file_path string"))


@query("WITH " + _ENT + _CHANGED_SQL + " SELECT fqn, changed FROM hit")
def path_match(spark, sf_dir):
    return _changed(spark, fx.part_graph(spark, sf_dir))


@query(_gp(None) + _CHANGED_SQL + " SELECT target AS fqn, count(DISTINCT source) AS num_dependents FROM edges WHERE target IN (SELECT fqn FROM hit) AND source NOT IN (SELECT fqn FROM hit) GROUP BY ALL")
def broken_contracts(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return traverse.broken_contracts(graph, _changed(spark, graph).select("fqn").distinct()).select("fqn", "num_dependents")


@query(
    _gp(None)
    + _CHANGED_SQL
    + """, walk AS (SELECT DISTINCT fqn, 0 AS distance FROM hit UNION SELECT source, distance + 1 FROM walk JOIN edges ON target = fqn WHERE distance < 2)
SELECT fqn, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY fqn HAVING min(distance) > 0"""
)
def diff_impact(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    seeds = _changed(spark, graph).select("fqn").distinct()
    return traverse.walk_cone(graph.reverse_edges(), seeds, 2, None, graph.entities).nodes.select("fqn", "distance")


# Retrieval ---------------------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) > 1)"
_WORDS = ("ring", "small", "promo")


def _score_sql() -> str:
    parts = []
    for k in _WORDS:
        parts.append(f"CASE WHEN lower(name) = '{k}' THEN 10.0::DOUBLE WHEN list_contains({_TOKENS.format(c='name')}, '{k}') THEN 5 WHEN contains(lower(name), '{k}') THEN 3 ELSE 0 END")
        parts.append(f"CASE WHEN contains(lower(package), '{k}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(file_path), '{k}') THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query("WITH " + _ENT + f" SELECT fqn, array_to_string({_TOKENS.format(c='name')}, ' ') AS tokens FROM ent")
def tokenize(spark, sf_dir):
    return fx.part_entities(spark, sf_dir).select("fqn", F.array_join(tokens(F.col("name")), " ").alias("tokens"))


@query("WITH " + _ENT + f" SELECT fqn, name, kind, package, file_path, round(score, 1) AS score FROM (SELECT *, {_score_sql()} AS score FROM ent) WHERE score > 0 ORDER BY score DESC, entity_seq LIMIT 10")
def find_relevant(spark, sf_dir):
    return search.find_relevant(fx.part_graph(spark, sf_dir), " ".join(_WORDS)).drop("component")


@query(
    "WITH " + _ENT + f""", s AS (SELECT fqn, name, kind, package, file_path, p_type, entity_seq, {_score_sql()} AS direct FROM ent),
b AS (SELECT *, direct + CASE WHEN lower(p_type) IN ('promo', 'small') THEN 8 ELSE 0 END AS total, row_number() OVER (PARTITION BY p_type ORDER BY entity_seq) - 1 AS pos, dense_rank() OVER (ORDER BY p_type) - 1 AS comp FROM s)
SELECT fqn, name, kind, package, file_path, round(total, 1) AS score, p_type AS component FROM b WHERE total > 0
ORDER BY total DESC, (direct <= 0)::INT, CASE WHEN direct > 0 THEN entity_seq ELSE comp END, pos, fqn LIMIT 10"""
)
def find_relevant_boosted(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return search.find_relevant(graph, " ".join(_WORDS), fx.by_type(graph))


@query(
    "WITH " + _ENT + ", h AS (SELECT fqn, concat_ws(',', " + ", ".join(f"CASE WHEN list_contains({_TOKENS.format(c='name')}, '{k}') OR contains(lower(name), '{k}') OR contains(lower(package), '{k}') OR contains(lower(file_path), '{k}') THEN '{k}' END" for k in sorted(_WORDS)) + ") AS hits FROM ent) SELECT * FROM h WHERE hits <> ''"
)
def matched_keywords(spark, sf_dir):
    return fx.part_entities(spark, sf_dir).select("fqn", F.array_join(search.matched(list(_WORDS)), ",").alias("hits")).where("hits <> ''")


@query()
def context_for_task(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return search.context_for_task(graph, "find the small promo ring", fx.by_type(graph))


# Summaries ---------------------------------------------------------------------------------------------------------------

_OWNED = "WITH " + _ENT + ", own AS (SELECT *, CASE WHEN kind = 'method' THEN min_by(fqn, entity_seq) FILTER (kind <> 'method') OVER (PARTITION BY package) END AS owner FROM ent)"


@query("WITH " + _ENT + " SELECT package, kind, n_kind, n_entities FROM (SELECT package, kind, count(*) AS n_kind FROM ent GROUP BY ALL) JOIN (SELECT package, count(*) AS n_entities FROM ent GROUP BY ALL) USING (package)")
def package_tree(spark, sf_dir):
    return inspect.package_tree(fx.part_graph(spark, sf_dir))


@query(
    _gp(None)
    + """, d AS (SELECT fqn, entity_seq, (SELECT count(*) FROM edges WHERE target = fqn) AS in_degree, (SELECT count(*) FROM edges WHERE source = fqn) AS out_degree FROM ent)
SELECT fqn, in_degree, out_degree, in_degree + out_degree AS degree FROM d ORDER BY degree DESC, entity_seq LIMIT 10"""
)
def hotspots(spark, sf_dir):
    return inspect.hotspots(fx.part_graph(spark, sf_dir))


@query("WITH " + _ENT + " SELECT fqn, name, kind, file_path FROM ent WHERE name LIKE 'SmallRing%' AND name IN ('SmallRing0', 'SmallRing64', 'SmallRing128')")
def entry_points(spark, sf_dir):
    return inspect.entry_points(fx.part_graph(spark, sf_dir), ("SmallRing0", "SmallRing64", "SmallRing128"))


@query(
    _gp(None)
    + """, mine AS (SELECT * FROM ent WHERE package = 'shop.promo' OR starts_with(package, 'shop.promo.'))
SELECT 'shop.promo' AS package, (SELECT count(*) FROM mine) AS num_entities, (SELECT count(DISTINCT file_path) FROM mine) AS num_files,
  (SELECT count(*) FROM edges WHERE target IN (SELECT fqn FROM mine) AND source NOT IN (SELECT fqn FROM mine)) AS num_deps_in,
  (SELECT count(*) FROM edges WHERE source IN (SELECT fqn FROM mine) AND target NOT IN (SELECT fqn FROM mine)) AS num_deps_out"""
)
def package_drilldown(spark, sf_dir):
    return inspect.package_drilldown(fx.part_graph(spark, sf_dir), "shop.promo")


@query(
    _OWNED
    + ", "
    + _edges()
    + """ SELECT package, fqn, name, kind, EXISTS (SELECT 1 FROM edges e JOIN own s ON s.fqn = e.source WHERE e.target = o.fqn AND s.file_path <> o.file_path) AS depended_on,
  (SELECT count(*) FROM own x WHERE x.owner = o.fqn) AS n_members FROM own o WHERE owner IS NULL AND starts_with(package, 'shop.promo')"""
)
def api_surface(spark, sf_dir):
    """The owner of a part's method is of its own package, so the scope keeps members and owners together."""
    return inspect.api_surface(fx.part_graph(spark, sf_dir), "shop.promo").drop("members")


@query(
    _gp()
    + """, b AS (SELECT component, count(*) FILTER (a AND b) AS internal_edges, count(*) FILTER (b AND NOT a) AS incoming_edges, count(*) FILTER (a AND NOT b) AS outgoing_edges, count(DISTINCT target) FILTER (b AND NOT a) AS api_size FROM (
  SELECT s.component, e.target, x.component = s.component AS a, y.component = s.component AS b FROM sizes s, edges e JOIN m x ON e.source = x.fqn JOIN m y ON e.target = y.fqn) GROUP BY ALL)
SELECT component, n AS num_entities, internal_edges, incoming_edges, outgoing_edges, api_size, round(internal_edges::DOUBLE / (internal_edges + incoming_edges + outgoing_edges), 3) AS cohesion FROM sizes JOIN b USING (component)"""
)
def explain_components(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return inspect.component_boundary(graph, fx.by_type(graph))


@query("WITH " + _ENT + " SELECT kind, count(*) AS n FROM ent GROUP BY ALL")
def kind_counts(spark, sf_dir):
    return inspect.kind_counts(fx.part_entities(spark, sf_dir))


@query(
    _OWNED
    + """ SELECT component, kind, count(*) AS n FROM (SELECT o.p_type AS component, o.fqn, o.kind FROM own o UNION SELECT x.p_type, o.fqn, o.kind FROM own o JOIN own x ON o.owner = x.fqn) GROUP BY ALL"""
)
def component_kinds(spark, sf_dir):
    graph = fx.part_graph(spark, sf_dir)
    return inspect.component_kinds(graph, fx.by_type(graph))


@query(_gp(None) + " SELECT count(*) AS num_entities, count(*) FILTER (kind = 'method') AS method_count, count(*) FILTER (kind = 'function') AS function_count, count(*) FILTER (kind = 'class') AS class_count, (SELECT count(*) FROM edges) AS num_edges, count(DISTINCT package) AS num_packages FROM ent")
def graph_summary(spark, sf_dir):
    return inspect.graph_summary(fx.part_graph(spark, sf_dir))


@query(_gp(None) + ", k AS (SELECT * FROM ent WHERE kind <> 'method') SELECT count(*) AS num_entities, (SELECT count(*) FROM edges WHERE source IN (SELECT fqn FROM k) AND target IN (SELECT fqn FROM k)) AS num_edges FROM k")
def architectural_filter(spark, sf_dir):
    graph = inspect.architectural(fx.part_graph(spark, sf_dir))
    return graph.entities.agg(F.count("*").alias("num_entities")).join(F.broadcast(graph.edges.agg(F.count("*").alias("num_edges"))))  # one row each


# Similarity and clustering -----------------------------------------------------------------------------------------------

_PAIRS = """, l AS (SELECT DISTINCT source AS x, target AS y FROM edges),
f AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM l a JOIN l b ON a.y = b.y AND a.x < b.x GROUP BY ALL), fs AS (SELECT x, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT a.y AS a, b.y AS b, count(*) AS n FROM l a JOIN l b ON a.x = b.x AND a.y < b.y GROUP BY ALL), rs AS (SELECT y AS x, count(*) AS n FROM l GROUP BY ALL),
fj AS (SELECT f.a, f.b, f.n::DOUBLE / (p.n + q.n - f.n) AS j, 2.0::DOUBLE * f.n / (p.n + q.n) AS u FROM f JOIN fs p ON p.x = f.a JOIN fs q ON q.x = f.b),
rj AS (SELECT r.a, r.b, r.n::DOUBLE / (p.n + q.n - r.n) AS j FROM r JOIN rs p ON p.x = r.a JOIN rs q ON q.x = r.b)"""
_SIM = _gp(None) + _PAIRS
_JACCARD, _UEM = " SELECT a, b, round(j, 6) AS similarity FROM fj", " SELECT a, b, round(u, 6) AS similarity FROM fj"
_SCM = " SELECT coalesce(fj.a, rj.a) AS a, coalesce(fj.b, rj.b) AS b, round((coalesce(fj.j, 0) + coalesce(rj.j, 0)) / 2, 6) AS similarity FROM fj FULL JOIN rj ON fj.a = rj.a AND fj.b = rj.b"


def _sim(spark, sf_dir, measure):
    return similar_pairs(fx.part_graph(spark, sf_dir).edges, measure).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_SIM + _JACCARD)
def sim_jaccard(spark, sf_dir):
    return _sim(spark, sf_dir, "jaccard")


@query(_SIM + _UEM)
def sim_uem(spark, sf_dir):
    return _sim(spark, sf_dir, "uem")


@query(_SIM + _SCM)
def sim_scm(spark, sf_dir):
    return _sim(spark, sf_dir, "scm")


@query("WITH " + _ENT + " SELECT fqn, split_part(package, '.', 3) AS tags FROM ent")
def concern_tags(spark, sf_dir):
    return clusters.concern_tags(fx.part_entities(spark, sf_dir)).select("fqn", F.array_join("tags", ",").alias("tags"))


@query("WITH " + _ENT + " SELECT fqn, split_part(package, '.', 3) AS label, 1.0::DOUBLE AS weight FROM ent")
def concern_vectors(spark, sf_dir):
    return clusters.concern_vectors(clusters.concern_tags(fx.part_entities(spark, sf_dir)))


_MIX = """WITH s AS (SELECT p_brand, p_type, count(*)::DOUBLE AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, sum(n) AS t FROM s GROUP BY ALL),
v AS (SELECT b.p_brand, y.p_type, coalesce(s.n, 0) / t.t AS w, t.t FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) y JOIN t ON t.p_brand = b.p_brand LEFT JOIN s ON s.p_brand = b.p_brand AND s.p_type = y.p_type),
d AS (SELECT a.p_brand AS a, b.p_brand AS b, any_value(a.t) AS na, any_value(b.t) AS nb, sum(CASE WHEN a.w > 0 THEN a.w * ln(a.w / ((a.w + b.w) / 2)) ELSE 0 END + CASE WHEN b.w > 0 THEN b.w * ln(b.w / ((a.w + b.w) / 2)) ELSE 0 END) / 2 AS js FROM v a JOIN v b ON a.p_type = b.p_type AND a.p_brand < b.p_brand GROUP BY 1, 2)"""


def _brand_mix(spark, sf_dir):
    """Brands as clusters with the mix of their types as concern vector."""
    part = fx.read(spark, sf_dir, "part")
    kinds = [r[0] for r in part.select("p_type").distinct().orderBy("p_type").collect()]  # six types
    wide = part.groupBy("p_brand").agg(F.count("*").alias("t"), *[F.count_if(F.col("p_type") == k).alias(f"k{i}") for i, k in enumerate(kinds)])
    v = wide.select("p_brand", "t", F.array(*[F.col(f"k{i}") / F.col("t") for i in range(len(kinds))]).alias("v"))
    a, b = v.select(*[F.col(c).alias(f"{c}_a") for c in v.columns]), v.select(*[F.col(c).alias(f"{c}_b") for c in v.columns])
    return a.join(b, F.col("p_brand_a") < F.col("p_brand_b"))  # 25 brands


@query(_MIX + " SELECT a, b, round(js, 6) AS js FROM d")
def js_divergence(spark, sf_dir):
    return _brand_mix(spark, sf_dir).select(F.col("p_brand_a").alias("a"), F.col("p_brand_b").alias("b"), F.round(clusters.js_divergence(F.col("v_a"), F.col("v_b")), 6).alias("js"))


@query(_MIX + " SELECT a, b, round((na + nb) / (SELECT count(*) FROM part) * js, 6) AS loss FROM d")
def info_loss(spark, sf_dir):
    pairs = _brand_mix(spark, sf_dir)
    total = fx.read(spark, sf_dir, "part").agg(F.count("*").alias("total"))
    loss = clusters.info_loss(F.col("v_a"), F.col("t_a"), F.col("v_b"), F.col("t_b"), F.col("total"))
    return pairs.join(F.broadcast(total)).select(F.col("p_brand_a").alias("a"), F.col("p_brand_b").alias("b"), F.round(loss, 6).alias("loss"))  # total is one row


@query(_gn(1) + " SELECT source AS fqn, min(target) AS dominator FROM edges GROUP BY source HAVING count(*) = 1")
def acdc_dominators(spark, sf_dir):
    return clusters.dominated(fx.nation_graph(spark, sf_dir, 1)[0])


def _sized(arch) -> DataFrame:
    return arch.sizes().select("comp_seq", "component", "n")


@query()
def wca(spark, sf_dir):
    return _sized(clusters.wca(fx.nation_graph(spark, sf_dir, 2)[0], "uem", 5))


@query()
def acdc(spark, sf_dir):
    return _sized(clusters.acdc(fx.part_graph(spark, sf_dir)))


@query()
def arc(spark, sf_dir):
    return _sized(clusters.arc(fx.nation_graph(spark, sf_dir, 2)[0], 5))


@query()
def limbo(spark, sf_dir):
    return _sized(clusters.limbo(fx.nation_graph(spark, sf_dir, 2)[0], 5, 0.5))


# Comparison --------------------------------------------------------------------------------------------------------------


def _groupings(spark, sf_dir):
    from codestrata.model import architecture_by

    graph = fx.part_graph(spark, sf_dir)
    return fx.by_type(graph), architecture_by(graph, F.concat(F.lit("size"), (F.col("p_size") % 6).cast("string")))


@query(
    """WITH p AS (SELECT p_partkey, p_type AS a, 'size' || (p_size % 6) AS b FROM part), na AS (SELECT a, count(*) AS n FROM p GROUP BY ALL), nb AS (SELECT b, count(*) AS n FROM p GROUP BY ALL)
SELECT p.a AS comp_a, p.b AS comp_b, round(count(*)::DOUBLE / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS similarity FROM p JOIN na ON na.a = p.a JOIN nb ON nb.b = p.b GROUP BY p.a, p.b"""
)
def component_jaccard(spark, sf_dir):
    return compare.component_jaccard(*_groupings(spark, sf_dir)).select("comp_a", "comp_b", F.round("similarity", 6).alias("similarity"))


@query()
def a2a_match(spark, sf_dir):
    out = compare.match(*_groupings(spark, sf_dir))
    return out.select("source", "target", "similarity", F.size("entities_added").alias("n_added"), F.size("entities_removed").alias("n_removed"))


@query()
def component_delta(spark, sf_dir):
    a, b = _groupings(spark, sf_dir)
    return compare.component_delta(compare.match(a, b), a, b)


def _two(spark, sf_dir):
    return fx.nation_graph(spark, sf_dir, 1), fx.nation_graph(spark, sf_dir, 2)


def _split_sql(piece: str, select: str) -> str:
    """The same piece over GN top-1 and top-2."""
    return f"WITH old AS ({_gn(1)}{piece} {select}), new AS ({_gn(2)}{piece} {select}) "


@query(
    _split_sql(f", {_CORE}", "SELECT name, value FROM core")
    + """SELECT name, o.value AS baseline, n.value AS current, round(n.value - o.value, 4) AS delta,
  CASE WHEN abs(n.value - o.value) < 1e-4 THEN 'unchanged' WHEN (n.value > o.value) <> (name IN ('InterConnectivity', 'TwoWayPairRatio')) THEN 'better' ELSE 'worse' END AS status FROM old o JOIN new n USING (name)"""
)
def metric_delta(spark, sf_dir):
    old, new = _two(spark, sf_dir)
    return compare.metric_delta(Measures(*old).core().select("name", "value"), Measures(*new).core().select("name", "value"))


@query(_split_sql("", "SELECT source, target FROM ce") + "(SELECT *, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old)) UNION ALL (SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new))")
def dependency_delta(spark, sf_dir):
    old, new = _two(spark, sf_dir)
    return compare.set_delta(Measures(*old).pairs, Measures(*new).pairs)


@query(
    _split_sql(f", {_SCC}", "SELECT DISTINCT t FROM (SELECT 'dependency_cycle' AS t FROM cycles UNION ALL SELECT 'link_overload' FROM links UNION ALL SELECT 'concern_overload' FROM overload)")
    + "(SELECT t AS smell_type, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old)) UNION ALL (SELECT t, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new))"
)
def smell_delta(spark, sf_dir):
    old, new = _two(spark, sf_dir)
    return compare.set_delta(smells.detect(*old).select("smell_type").distinct(), smells.detect(*new).select("smell_type").distinct())


# Merging -----------------------------------------------------------------------------------------------------------------


def polyglot(spark):
    from codestrata.model import CodeGraph

    graphs = []
    for g in range(3):
        rows = [(fqn, name, package, f"{package}/{name}", "class", lang, imports, sup, faces, k) for k, (n, fqn, name, package, lang, imports, sup, faces) in enumerate(fx.POLYGLOT_ENTITIES) if n == g]
        entities = spark.createDataFrame(rows, "fqn string, name string, package string, file_path string, kind string, language string, imports array<string>, superclass string, interfaces array<string>, entity_seq long")
        edges = spark.createDataFrame([(s, t, r, k) for k, (n, s, t, r) in enumerate(fx.POLYGLOT_EDGES) if n == g], "source string, target string, relation string, edge_seq long")
        graphs.append(CodeGraph(entities, edges))
    return graphs


@query("SELECT * FROM (VALUES ('app.core.Base', 'java'), ('app.core.Api', 'java'), ('app.util', 'java'), ('app.ui.Screen', 'kotlin'), ('app.util#python', 'python'), ('app.tool.Base', 'python')) t(fqn, language)")
def graph_merge(spark, sf_dir):
    return merge.merge(polyglot(spark)).entities.select("fqn", "language")


@query(
    """SELECT * FROM (VALUES ('app.core.Api', 'app.core.Base', 'extends'), ('app.ui.Screen', 'app.core.Base', 'import'), ('app.tool.Base', 'app.util#python', 'import'),
  ('app.ui.Screen', 'app.core.Base', 'extends'), ('app.ui.Screen', 'app.core.Api', 'implements')) t(source, target, relation)"""
)
def relink_edges(spark, sf_dir):
    return merge.merge(polyglot(spark)).edges.select("source", "target", "relation")


@query("SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 2::BIGINT)) t(same_family, cross_family, total)")
def fqn_collisions(spark, sf_dir):
    meta = merge.merge(polyglot(spark)).meta
    row = (meta["fqn_collisions_same_family"], meta["fqn_collisions_cross_family"], meta["fqn_collisions"])
    return spark.createDataFrame([row], "same_family long, cross_family long, total long")
