"""Graph operators on small graphs with results worked out by hand, and on the driver's tables against DuckDB."""

import glob
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.model import Architecture, CodeGraph
from codestrata.operators import clusters, compare, inspect, merge, packages, search, smells, traverse
from codestrata.operators.metrics import Measures, gini

SF = "/root/testdata/sf0.001"


def graph_of(spark, entities, edges):
    """entities: (fqn, kind, language, package, file) ; edges: (source, target, relation)."""
    rows = [(f, f.split(".")[-1], p, file, kind, lang, [], None, [], None, k) for k, (f, kind, lang, p, file) in enumerate(entities)]
    e = spark.createDataFrame(rows, "fqn string, name string, package string, file_path string, kind string, language string, imports array<string>, superclass string, interfaces array<string>, owner string, entity_seq long")
    d = spark.createDataFrame([(*x, k) for k, x in enumerate(edges)], "source string, target string, relation string, edge_seq long")
    return CodeGraph(e, d)


def simple(spark, names, edges, package="p"):
    return graph_of(spark, [(n, "class", "java", package, f"src/{n}.java") for n in names], [(a, b, "import") for a, b in edges])


def arch_of(spark, groups):
    c = spark.createDataFrame([(k, n, f"Entities of {n}") for k, n in enumerate(groups)], "comp_seq int, name string, responsibility string")
    m = spark.createDataFrame([(f, k, n, i) for k, (n, fs) in enumerate(groups.items()) for i, f in enumerate(fs)], "fqn string, comp_seq int, name string, member_pos long")
    return Architecture(c, m)


@pytest.fixture(scope="module")
def sample(spark):
    names = ["com.example.calc.Calculator", "com.example.calc.AdvancedCalculator", "com.example.util.MathHelper"]
    g = graph_of(spark, [(n, "class", "java", n.rsplit(".", 1)[0], n.replace(".", "/") + ".java") for n in names], [(names[0], names[2], "import"), (names[1], names[2], "import"), (names[1], names[0], "extends")])
    return g, arch_of(spark, {"Calc": names[:2], "Util": names[2:]})


def test_sample_metrics(sample):
    m = Measures(*sample)
    got = {r["name"]: r["value"] for r in m.core().collect()}
    assert got == pytest.approx({"RCI": 0.3333, "TurboMQ": 0.5, "BasicMQ": 0.25, "IntraConnectivity": 0.25, "InterConnectivity": 1.0, "TwoWayPairRatio": 0.0})
    assert {r["component"]: r["cf"] for r in m.factors.collect()} == {"Calc": 0.5, "Util": 0.0}
    assert {(r["source"], r["target"]) for r in m.pairs.collect()} == {("Calc", "Util")}


def test_metrics_of_nothing(spark):
    g = simple(spark, [], [])
    assert [r["value"] for r in Measures(g, arch_of(spark, {"A": []})).core().collect()] == [0, 0, 0, 0, 0, 0]


def test_gini(spark):
    of = lambda xs: gini(spark.createDataFrame([(x,) for x in xs], "x long")).first()[0]
    assert of([]) == 0 and of([0, 0]) == 0 and of([3, 3, 3]) == pytest.approx(0)
    assert of([1, 2, 2, 5]) == pytest.approx(2 * (1 + 4 + 6 + 20) / (4 * 10) - 5 / 4)


def test_scores_fall_with_smells(sample, spark):
    m = Measures(*sample)
    none = spark.createDataFrame([], "smell_type string, severity string, n_affected int")
    bad = spark.createDataFrame([("dependency_cycle", "high", 2)], none.schema)
    a, b = m.balanced(none).first(), m.balanced(bad).first()
    assert 0 <= b["BalancedArchitectureScore"] < a["BalancedArchitectureScore"] <= 1
    assert len(m.drivers(none).collect()) == 6


def test_membership_first_and_last(spark):
    a = arch_of(spark, {"A": ["x", "y"], "B": ["y", "z"]})
    assert {r["fqn"]: r["component"] for r in a.membership_first().collect()} == {"x": "A", "y": "A", "z": "B"}
    assert {r["fqn"]: r["component"] for r in a.membership_last().collect()} == {"x": "A", "y": "B", "z": "B"}


def test_three_cycle_is_medium(spark):
    g = simple(spark, list("abc"), [("a", "b"), ("b", "c"), ("c", "a")])
    out = smells.dependency_cycles(g, arch_of(spark, {"A": ["a"], "B": ["b"], "C": ["c"]})).collect()
    assert [(r["affected"], r["severity"]) for r in out] == [(["A", "B", "C"], "medium")]


def test_strong_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e"), ("d", "f")], "source string, target string")
    assert sorted((r["scc"], r["member"]) for r in smells.strong_components(e).collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")]


def test_overload_needs_sparse_insides(spark):
    names = [f"n{i:02d}" for i in range(25)]
    a = arch_of(spark, {"Big": names})
    assert smells.concern_overload(simple(spark, names, []), a).count() == 1
    assert smells.concern_overload(simple(spark, names, list(zip(names, names[1:]))), a).count() == 0


def test_cone(spark):
    e = spark.createDataFrame([("a", "b", "import", 1), ("a", "x", "extends", 2), ("b", "c", "uses", 3), ("x", "c", "import", 4), ("c", "a", "import", 5), ("c", "d", "import", 6)], "source string, target string, relation string, edge_seq long")
    seed = spark.createDataFrame([("a",)], "fqn string")
    got = {r["fqn"]: (r["distance"], r["via_relation"]) for r in traverse.walk_cone(e, seed, 5).nodes.collect()}
    assert got == {"b": (1, "import"), "x": (1, "extends"), "c": (2, "import"), "d": (3, "import")}
    cut = traverse.walk_cone(e, seed, 5, 2)
    assert cut.truncated and sorted(r["fqn"] for r in cut.nodes.collect()) == ["b", "x"]
    assert traverse.walk_cone(e, seed, 0).nodes.count() == 0
    known = spark.createDataFrame([("d",), ("a",)], "fqn string")
    assert [r["fqn"] for r in traverse.walk_cone(e, seed, 5, None, known).nodes.collect()] == ["d"]


def test_seed_resolution_and_impact(spark):
    g = graph_of(spark, [("m.A", "class", "java", "m", "src/m/A.java"), ("m.B", "class", "java", "m", "src/m/B.java"), ("n.A2", "class", "java", "n", "src/n/A.java")], [("m.B", "m.A", "import"), ("n.A2", "m.B", "import")])
    assert traverse.resolve_seed(g, "m.A")[1] == "entity" and traverse.resolve_seed(g, "src\\m\\A.java")[1] == "file" and traverse.resolve_seed(g, "/home/x/src/m/A.java")[1] == "file" and traverse.resolve_seed(g, "zzz")[1] is None
    assert traverse.dependency_cone(g, "A.java")["candidate_files"] == ["src/m/A.java", "src/n/A.java"]
    assert traverse.dependency_cone(g, "m/A.java")["downstream"]["num_nodes"] == 2
    assert "note" in traverse.dependency_cone(g, "zzz") and "error" in traverse.dependency_cone(g, "m.A", "sideways")
    out = traverse.diff_impact(g, ["repo/src/m/A.java", "X.java", "ava"], arch_of(spark, {"M": ["m.A", "m.B"]}))
    assert out["changed_entities"] == ["m.A"] and out["unmatched_files"] == ["X.java", "ava"] and out["affected_components"] == ["M"]
    assert out["num_downstream"] == 2 and out["broken_contracts"] == [{"fqn": "m.A", "num_dependents": 1, "dependents": ["m.B"]}]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_changed_paths_are_the_broadcast_side(spark):
    from codestrata.functions.storage import sized
    from codestrata.plans import fixtures as fx
    from codestrata.plans.queries import _changed

    assert "BuildLeft" not in _plan(_changed(spark, fx.part_graph(spark, SF)))
    few, many = spark.range(5).toDF("x"), spark.range(50).toDF("x")
    assert "SortMergeJoin" in _plan(few.join(sized(many, 49), "x")) and "BroadcastHashJoin" in _plan(many.join(sized(few, 5), "x"))


def test_broken_contracts_of_unknown_sources(spark, monkeypatch):
    g = graph_of(spark, [("m.A", "class", "java", "m", "A.java"), ("m.B", "class", "java", "m", "B.java"), ("m.C", "class", "java", "m", "C.java")], [("m.B", "m.A", "import"), ("m.B", "m.A", "uses"), ("z.Q", "m.A", "import"), ("m.C", "m.A", "import"), ("m.A", "m.C", "import")])
    changed = spark.createDataFrame([("m.A",), ("m.C",)], "fqn string")
    assert [(r["fqn"], r["num_dependents"], r["dependents"]) for r in traverse.broken_contracts(g, changed).collect()] == [("m.A", 1, ["m.B"])]
    big = lambda df, rows=0: df.hint("merge")
    monkeypatch.setattr(traverse, "sized", big)
    out = traverse.broken_contracts(g, changed)
    assert [(r["fqn"], r["num_dependents"], r["dependents"]) for r in out.collect()] == [("m.A", 1, ["m.B"])]


def test_part_names_beyond_a_broadcast_are_shuffled(spark, monkeypatch):
    from codestrata.functions import storage
    from codestrata.plans import fixtures as fx

    want = sorted(map(tuple, fx.part_graph(spark, SF).edges.collect()))
    monkeypatch.setattr(fx, "sized", lambda df: storage.sized(df, 199))  # 200 parts
    edges = fx.part_graph(spark, SF).edges
    assert _plan(edges).count("SortMergeJoin [l_partkey") == 1 and _plan(edges).count("SortMergeJoin [b_part") == 1 and sorted(map(tuple, edges.collect())) == want


def test_thin_facade_moves(spark):
    e = [("pkg.api.facade", "function", "python", "pkg.api", "a.py"), ("pkg.api.registry", "function", "python", "pkg.api", "r.py"), ("pkg.impl.tool", "function", "python", "pkg.impl", "t.py"), ("pkg.impl.worker", "function", "python", "pkg.impl", "w.py")]
    g = graph_of(spark, e, [("pkg.api.facade", "pkg.impl.tool", "import"), ("pkg.impl.tool", "pkg.api.registry", "import"), ("pkg.api.facade", "pkg.impl.worker", "import")])
    a = packages.recover_packages(g)
    assert {r["fqn"]: r["component"] for r in a.membership_first().collect()} == {"pkg.api.facade": "Impl", "pkg.api.registry": "Api", "pkg.impl.tool": "Impl", "pkg.impl.worker": "Impl"}
    assert "facade refinement (1 " in a.rationale
    assert packages.unique_names(["X", "X", "X2", "X"]) == ["X", "X2", "X22", "X3"]


def test_single_package_groups_by_name(spark):
    g = simple(spark, ["p.A", "p.B"], [], "p")
    assert sorted(r["name"] for r in packages.recover_packages(g).components.collect()) == ["A", "B"]


def test_queries_and_explain(sample):
    g, a = sample
    assert inspect.query(g, a, "component_of", entity="com.example.util.MathHelper")["component"] == "Util"
    assert inspect.query(g, a, "dependencies", component="Calc")["dependencies"] == ["Util"]
    assert inspect.query(g, a, "dependents", component="Util")["dependents"] == ["Calc"]
    assert "error" in inspect.query(g, a, "entities", component="No") and "error" in inspect.query(g, a, "why")
    assert inspect.query(g, a, "most_coupled")["most_coupled"] == [{"source": "Calc", "target": "Util", "n_edges": 2}]
    assert inspect.query(g, a, "summary")["num_edges"] == 3 and len(inspect.query(g, a, "largest")["largest"]) == 2
    out = inspect.explain_component(g, a, "Util")
    assert out["api_surface"] == ["com.example.util.MathHelper"] and out["cohesion"] == 0.0 and out["depended_on_by"] == ["Calc"]
    assert "error" in inspect.explain_component(g, a, "No")
    assert inspect.summarize(g, "x")["num_packages"] == 2 and inspect.summarize(g, "x", "com.example.util")["num_deps_in"] == 2
    assert "error" in inspect.summarize(g, "x", "none")


def test_search(spark):
    g = graph_of(spark, [("a.LoginService", "class", "java", "a", "src/LoginService.java"), ("a.RateLimiter", "class", "java", "a", "src/RateLimiter.java"), ("b.Other", "class", "java", "b", "src/Other.java")], [("a.LoginService", "a.RateLimiter", "import"), ("b.Other", "a.LoginService", "import")])
    assert search.keywords_of("add rateLimiting to a login-page") == ["add", "rate", "limiting", "to", "login", "page"]
    rows = search.find_relevant(g, "login").collect()
    assert [(r["fqn"], r["score"]) for r in rows] == [("a.LoginService", 6.0)]
    files = {r["file_path"]: (r["score"], r["primary_role"]) for r in search.context_for_task(g, "login").collect()}
    assert files == {"src/LoginService.java": (6.0, "direct"), "src/RateLimiter.java": (3.0, "dependency"), "src/Other.java": (3.0, "dependent")}
    boosted = search.find_relevant(g, "login", arch_of(spark, {"Login": ["a.RateLimiter", "gone"]})).collect()
    assert {r["fqn"]: r["score"] for r in boosted} == {"a.RateLimiter": 8.0, "a.LoginService": 6.0}


def average_link(n, sim, k, stop, to_end):
    """Plain version of the WCA loop."""
    groups = [[i] for i in range(n)]
    while len(groups) > (k or 1):
        best, pair = -1, None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                s = sum(sim[a][b] for a in groups[i] for b in groups[j]) / (len(groups[i]) * len(groups[j]))
                if s > best + 1e-12:
                    best, pair = s, (i, j)
        if k is None and best <= stop:
            break
        i, j = pair
        merged = groups[i] + groups[j]
        if to_end:
            groups = [g for x, g in enumerate(groups) if x not in (i, j)] + [merged]
        else:
            groups[i] = merged
            del groups[j]
    return groups


def test_merge_loop_against_plain_version():
    r = np.random.default_rng(0)
    for n, k in ((6, None), (9, 3), (12, 1)):
        s = r.integers(0, 4, (n, n)) / 4
        s = np.triu(s, 1) + np.triu(s, 1).T
        for to_end in (True, False):
            assert clusters.merge_loop(n, s, None, k, 0.0, 1.0, "link", to_end) == average_link(n, s, k, 0.0, to_end)


def test_js_divergence(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(clusters.js_divergence(F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([math.log(2), 0.0])


def _acdc_by_sets(names, package, edges):
    """ACDC on Python sets, in entity order; edges (source, target) with repeats."""
    out = Counter(a for a, b in edges if a in package and b in package)
    dom = {a: b for a, b in edges if out[a] == 1 and a in package and b in package}
    near: dict[str, set[str]] = {}
    for a, b in edges:
        if a in package:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    followers: dict[str, list[str]] = {}
    for f in names:
        if f in dom:
            followers.setdefault(dom[f], []).append(f)
    clusters: dict[str, list[str]] = {}
    assigned: set[str] = set()
    for target in (f for f in names if f in followers):
        assigned.add(target)
        clusters[target] = [target]
        for f in followers[target]:
            if f not in assigned:
                clusters[target].append(f)
                assigned.add(f)
    sets = {key: set(m) for key, m in clusters.items()}
    for f in names:
        if f in assigned or not near.get(f):
            continue
        best, top = None, 0
        for key, held in sets.items():
            shared = len(near[f] & held)
            if shared > top:
                best, top = key, shared
        if best is not None:
            clusters[best].append(f)
            sets[best].add(f)
            assigned.add(f)
    rest: dict[str, list[str]] = {}
    for f in names:
        if f not in assigned:
            rest.setdefault(package[f], []).append(f)
    for m in rest.values():
        clusters[m[0]] = m
    ordered = sorted(clusters.values(), key=lambda m: -len(m))
    return [(f, c) for c, m in enumerate(ordered) for f in m]


@pytest.mark.parametrize("seed", range(4))
def test_acdc_kernel_streams_edges(seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    n = 60
    names = [f"n{k}" for k in range(n)]
    package = {f: f"p{k % 3}" for k, f in enumerate(names)}
    edges = [(names[a], (names + ["gone"])[b]) for a, b in zip(rng.integers(0, 50, 70 if seed else 12).tolist(), rng.integers(0, n - 4, 70 if seed else 12).tolist())] + [("gone", "n1"), ("n58", "gone"), ("n57", "n57")]
    code = {f: int(x) for f, x in zip([*names, "gone"], rng.permutation(10**6)[: n + 1] - 500_000)}
    rows = [(k, code[f], int(package[f][1])) for k, f in enumerate(names)] + [(None, code[a], code[b]) for a, b in edges]
    rows = [rows[k] for k in rng.permutation(len(rows))]  # links may come before entities
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 40])], names=["x", "a", "b"]) for k in range(0, len(rows), 40)]
    back = {v: f for f, v in code.items()}
    got = [(back[r["id"]], r["cluster"]) for out in clusters._adopt(iter(batches)) for r in out.to_pylist()]
    assert sorted(got) == sorted(_acdc_by_sets(names, package, edges))


@pytest.mark.parametrize("recover", ["wca", "acdc", "arc", "limbo"])
def test_clusterings_cover_all(spark, recover):
    names = [f"p{i % 3}.N{i}" for i in range(12)]
    g = graph_of(spark, [(n, "class", "java", n.split(".")[0], f"{n}.java") for n in names], [(names[i], names[(i * 5 + 1) % 12], "import") for i in range(12)])
    a = {"wca": lambda: clusters.wca(g, "uem", 3), "acdc": lambda: clusters.acdc(g), "arc": lambda: clusters.arc(g, 3), "limbo": lambda: clusters.limbo(g, 3, 0.5)}[recover]()
    assert {r["fqn"] for r in a.membership.collect()} == set(names)
    if recover != "acdc":
        assert a.components.count() == 3
    with pytest.raises(ValueError):
        clusters.wca(g, "no such measure")


def test_assignment_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        cost = r.random((n, n))
        got = compare.assignment(cost)
        assert sorted(got) == list(range(n))
        assert sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_compare(spark):
    a, b = arch_of(spark, {"X": ["1", "2", "3"], "Y": ["4"]}), arch_of(spark, {"U": ["2", "3", "4"], "V": ["9"], "W": ["1"]})
    same = compare.compare(a, a)
    assert same["overall_similarity"] == 1.0 and same["summary"]["total_matches"] == 2
    out = compare.compare(a, b)
    # 1/3 + 1/3 beats 1/2 + 0
    assert {(m["source"], m["target"], m["similarity"]) for m in out["matches"]} == {("X", "W", 0.3333), ("Y", "U", 0.3333)}
    assert out["summary"]["components_added"] == 1 and out["summary"]["components_removed"] == 0


def test_snapshot_names(spark):
    rows = [(0, "Core", ["a.b.x.F", "a.b.x.G"]), (1, "Core2", ["a.c.H"]), (2, "Api", ["z.Y", "q.T"]), (3, "Api", ["web.http2api.V", "web.http2api.W"]), (4, "Api", ["m.n.o.K", "m.x.T", "q.r.T"]), (5, "default", []), (6, "default", None), (7, "cluster_3", ["s.t.A", "s.t.B"]), (8, "C", ["u.V"])]
    c = compare.comparison_names(spark.createDataFrame(rows, "pos int, name string, entities array<string>"))
    found = {r["pos"]: r["comparison_name"] for r in c.collect()}
    assert found == {0: "Core", 1: "C", 2: "Q", 3: "Http2Api", 4: "MN", 5: "default", 6: "default2", 7: "T", 8: "C2"}
    deps = spark.createDataFrame([(0, "Core", "Core2"), (1, "Api", "Api"), (2, "Api", "Api"), (3, "gone", "Core")], "pos int, source string, target string")
    got = [tuple(r) for r in compare.compared_dependencies(c, deps).orderBy("pos").collect()]
    assert got == [(0, "Core", "C"), (1, "Q", "Http2Api"), (2, "MN", "MN"), (3, "gone", "Core")]
    assert compare.comparison_names(spark.createDataFrame([], "pos int, name string, entities array<string>")).count() == 0


def test_relink_is_idempotent(spark):
    from codestrata.plans.queries import polyglot

    g = merge.merge(polyglot(spark))
    again = merge.relinked(g)
    assert again.count() == g.edges.count()
    u = merge.union(polyglot(spark))
    assert {r["fqn"]: r["language"] for r in u.entities.collect()}["app.core.Base"] == "kotlin"


# The driver's tables -----------------------------------------------------------------------------------------------------


def test_known_counts(spark):
    from codestrata.plans import fixtures as fx

    g = fx.part_graph(spark, SF)
    assert (g.entities.count(), g.edges.count()) == (200, 2801)
    m = Measures(g, fx.by_brand(g))
    assert m.rci().first()[0] == pytest.approx(0.0428) and m.turbo_mq().first()["value"] == pytest.approx(0.9613) and m.pairs.count() == 582
    s = fx.part_graph(spark, SF, 48)
    groups = packages.package_groups(s.entities, 1, 1)
    assert (s.edges.count(), packages.utility_hubs(s.edges, groups).count(), packages.facade_moves(s.edges, groups).count(), clusters.dominated(s).count()) == (167, 0, 31, 56)


def rows_of(df):
    return sorted(map(str, df[sorted(df.columns)].astype(str).values.tolist()))


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from codestrata.plans.queries import QUERIES, SQL

    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name in ("all_metrics", "fan_profile", "facade_moves", "dependency_cycles", "cone_upstream", "path_match", "find_relevant_boosted", "sim_scm", "api_surface", "metric_delta", "package_tree", "score_drivers"):
        got, want = QUERIES[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows_of(got) == rows_of(want), name


def test_similar_pairs_are_shuffled_once(spark):
    from codestrata.operators.similarity import similar_pairs

    g = simple(spark, "abcdx", [("a", "x"), ("b", "x"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")])
    pairs = {(r["a"], r["b"]): r["similarity"] for r in similar_pairs(g.edges, "scm").collect()}
    # successors: a {x, c}, b {x, c, d}, c {d}; predecessors: x {a, b}, c {a, b}, d {b, c}
    assert pairs == pytest.approx({("a", "b"): 1 / 3, ("b", "c"): 1 / 6, ("c", "x"): 1 / 2, ("c", "d"): 1 / 6, ("d", "x"): 1 / 6})
    plan = similar_pairs(g.edges.hint("merge"), "scm")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().split("Union")[0].count("Join") == 0 and plan.toString().split("Union")[0].count("Aggregate") == 1


def test_whole_graph_queries(spark):
    from codestrata.plans import fixtures as fx
    from codestrata.plans.queries import QUERIES

    graph = fx.part_graph(spark, SF)
    out, into = {}, {}
    for e in graph.edges.select("source", "target").distinct().collect():
        out.setdefault(e["source"], set()).add(e["target"])
        into.setdefault(e["target"], set()).add(e["source"])

    def pairs(of):
        return {(a, b): (len(of[a] & of[b]), len(of[a]), len(of[b])) for a in of for b in of if a < b and of[a] & of[b]}

    forward, backward = pairs(out), pairs(into)
    jaccard = {k: n / (p + q - n) for k, (n, p, q) in forward.items()}
    back = {k: n / (p + q - n) for k, (n, p, q) in backward.items()}
    want = {
        "jaccard": jaccard,
        "uem": {k: 2 * n / (p + q) for k, (n, p, q) in forward.items()},
        "scm": {k: (jaccard.get(k, 0) + back.get(k, 0)) / 2 for k in jaccard.keys() | back.keys()},
    }
    for measure, expected in want.items():
        got = {(r["a"], r["b"]): r["similarity"] for r in QUERIES[f"sim_{measure}"](spark, SF).collect()}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())

    members = {r["fqn"]: r["p_brand"] for r in graph.entities.select("fqn", "p_brand").collect()}
    sizes = Counter(members.values())
    inside = Counter(members[e["source"]] for e in graph.edges.collect() if members[e["source"]] == members[e["target"]])
    assert {r["component"] for r in QUERIES["concern_overload"](spark, SF).collect()} == {c for c, n in sizes.items() if n > 20 and inside[c] / n < 0.4}
    files = [tuple(r) for r in QUERIES["context_for_task"](spark, SF).collect()]
    assert files == [tuple(r) for r in search.context_for_task(graph, "find the small promo ring", fx.by_type(graph)).collect()]
