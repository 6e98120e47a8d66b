"""Extraction and linking of small projects in every language, the facts cache, the stream, exports and the service."""

import asyncio
import json

import pytest

from codestrata import export, service
from codestrata.operators import packages
from codestrata.sources import files
from codestrata.sources.extract import extract

JAVA = {
    "com/ex/calc/Calculator.java": "package com.ex.calc;\nimport com.ex.util.MathHelper;\n/* class Fake { } */\npublic class Calculator {\n  private final int n = 1;\n  public Calculator() { }\n  public int add(int a, int b) { return MathHelper.sum(a, b); }\n}\n",
    "com/ex/calc/Advanced.java": "package com.ex.calc;\npublic class Advanced extends Calculator implements Op {\n  int pow(int a) throws Exception { if (a > 1) { return a; } return 0; }\n}\ninterface Op { int pow(int a); }\n",
    "com/ex/util/MathHelper.java": 'package com.ex.util;\npublic class MathHelper { static int sum(int a, int b) { String s = "class X {"; return a + b; } }\n',
}
PYTHON = {
    "app/__init__.py": "", "app/models.py": "class Base:\n    pass\n\nclass User(Base):\n    def name(self):\n        return 1\n",
    "app/main.py": "from app.models import User, Base\nimport app.util\n\n@deco\ndef run(x: Base) -> Base:\n    return User()\n\ndef other():\n    return util.help()\n", "app/util.py": "X = 1\n", "app/broken.py": "def (:\n",
}
KOTLIN = {
    "ui/Screen.kt": "package ui\nimport core.Base as Root\nimport core.Api\n\nsealed class Screen(val x: Int) : Root(x), Api {\n  data class Item(val a: Int)\n  companion object { fun make(): Screen? = null }\n  fun draw() { }\n}\nfun top(a: Int): Int = a\n",
    "core/Core.kt": "package core\nopen class Base(val x: Int)\ninterface Api\nenum class Kind { A, B }\nobject Single\n",
}
GO = {"svc/store/store.go": "package store\n\ntype Store struct { n int }\n\nfunc New() *Store { return &Store{} }\nfunc (s *Store) Get() int { return helper() }\nfunc helper() int { return 1 }\n", "svc/api/api.go": 'package api\n\nimport (\n\t"fmt"\n\t"example.com/x/svc/store"\n)\n\nfunc Serve() { s := store.New(); fmt.Println(s) }\n', "svc/api/api_test.go": "package api\nfunc TestX() {}\n"}
TS = {"src/models/user.ts": "export interface Named { name: string }\nexport class User implements Named {\n  name = 'x';\n  greet(): string { return this.name; }\n}\nexport enum Role { A }\n", "src/app/main.ts": "import { User, Role } from '../models/user';\nimport fs from 'fs';\nexport function run() { return new User(); }\nexport const go = (a: number) => { return a; };\n"}
C = {"main.c": '#include <stdio.h>\n#include "shapes.h"\nint main(void) {\n  return area(1);\n}\n', "shapes.h": "struct Shape { int a; };\nint area(int x);\n", "more/circle.hpp": '#include "../shapes.h"\nclass Circle : public Shape {\n public:\n  int r;\n};\n'}


def project(tmp_path, sources):
    for name, text in sources.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def parsed(spark, tmp_path, sources, **more):
    g = files.parse(spark, project(tmp_path, sources), **more)
    kinds = {r["fqn"]: r["kind"] for r in g.entities.collect()}
    return kinds, {(r["source"], r["target"], r["relation"]) for r in g.edges.collect()}


def test_java(spark, tmp_path):
    kinds, edges = parsed(spark, tmp_path, JAVA)
    assert kinds == {
        "com.ex.calc.Calculator": "class", "com.ex.calc.Calculator.Calculator": "method", "com.ex.calc.Calculator.add": "method", "com.ex.calc.Advanced": "class", "com.ex.calc.Advanced.pow": "method",
        "com.ex.calc.Op": "interface", "com.ex.calc.Op.pow": "method", "com.ex.util.MathHelper": "class", "com.ex.util.MathHelper.sum": "method",
    }
    assert ("com.ex.calc.Calculator", "com.ex.util.MathHelper", "import") in edges
    assert ("com.ex.calc.Advanced", "com.ex.calc.Calculator", "extends") in edges and ("com.ex.calc.Advanced", "com.ex.calc.Op", "implements") in edges


def test_python(spark, tmp_path):
    kinds, edges = parsed(spark, tmp_path, PYTHON)
    assert kinds == {"app.models.Base": "class", "app.models.User": "class", "app.models.User.name": "method", "app.main.run": "function", "app.main.other": "function", "app.util": "module"}
    assert edges == {("app.main.run", "app.models.User", "import"), ("app.main.other", "app.util", "import"), ("app.models.User", "app.models.Base", "extends")}


def test_kotlin(spark, tmp_path):
    kinds, edges = parsed(spark, tmp_path, KOTLIN)
    assert kinds == {
        "ui.Screen": "class", "ui.Screen.Item": "class", "ui.Screen.Companion": "object", "ui.Screen.Companion.make": "method", "ui.Screen.draw": "method", "ui.top": "function",
        "core.Base": "class", "core.Api": "interface", "core.Kind": "enum", "core.Single": "object",
    }
    assert ("ui.Screen", "core.Base", "extends") in edges and ("ui.Screen", "core.Api", "implements") in edges and ("ui.Screen", "core.Api", "import") in edges
    f = extract("kotlin", "ui/Screen.kt", KOTLIN["ui/Screen.kt"])
    assert f.entities[0].is_sealed and f.entities[1].is_data and f.aliases == {"Root": "core.Base"}


def test_go(spark, tmp_path):
    kinds, edges = parsed(spark, tmp_path, GO)
    assert kinds == {"svc.store.Store": "struct", "svc.store.New": "function", "svc.store.Store.Get": "method", "svc.store.helper": "function", "svc.api.Serve": "function"}
    assert ("svc.api.Serve", "svc.store.New", "uses") in edges and ("svc.store.Store.Get", "svc.store.helper", "uses") in edges and ("svc.store.New", "svc.store.Store", "uses") in edges


def test_typescript(spark, tmp_path):
    kinds, edges = parsed(spark, tmp_path, TS)
    assert kinds == {"src/models/user.Named": "interface", "src/models/user.User": "class", "src/models/user.User.greet": "method", "src/models/user.Role": "enum", "src/app/main.run": "function", "src/app/main.go": "function"}
    assert edges == {("src/app/main.run", "src/models/user.User", "import"), ("src/models/user.User", "src/models/user.Named", "implements")}


def test_c(spark, tmp_path):
    kinds, edges = parsed(spark, tmp_path, C)
    assert kinds == {"main::main": "function", "shapes::Shape": "struct", "more/circle::Circle": "class"}
    assert edges == {("main::main", "shapes::Shape", "import"), ("more/circle::Circle", "shapes::Shape", "import"), ("more/circle::Circle", "shapes::Shape", "extends")}


def test_polyglot_and_ingest(spark, tmp_path):
    root = project(tmp_path, JAVA | KOTLIN | {"test/T.java": "class T {}", "node_modules/x.ts": "export class No {}"})
    kinds = {r["fqn"] for r in files.parse(spark, root).entities.collect()}
    assert "ui.Screen" in kinds and "com.ex.calc.Calculator" in kinds and not any(k in ("T", "node_modules/x.No") for k in kinds)
    found = files.ingest(spark, root)
    assert files.all_languages(found) == ["java", "kotlin"] and files.dominant_language(found) == "java"
    assert len(files.cache_key(found, root, ["java"])) == 64
    for bad in ({"language": "java", "languages": ["java"]}, {"languages": []}, {"language": "cobol"}):
        with pytest.raises(ValueError):
            files.ingest(spark, root, **bad)


def test_cache_gives_the_same_graph(spark, tmp_path):
    root, cache = project(tmp_path / "p", PYTHON), "file://" + str(tmp_path / "facts")
    sign = lambda g: (sorted(r["fqn"] for r in g.entities.collect()), sorted((r["source"], r["target"], r["relation"]) for r in g.edges.collect()))
    full = sign(files.parse(spark, root))
    assert sign(files.parse(spark, root, cache=cache)) == full
    n = spark.read.parquet(cache).count()
    assert sign(files.parse(spark, root, cache=cache)) == full and spark.read.parquet(cache).count() == n
    (tmp_path / "p/app/util.py").write_text("def help():\n    return 2\n")
    assert sign(files.parse(spark, root, cache=cache)) == sign(files.parse(spark, root))
    assert spark.read.parquet(cache).count() == n + 1


def test_stream_fills_the_cache(spark, tmp_path):
    from codestrata.streaming.incremental import follow

    root, cache = project(tmp_path / "p", PYTHON), "file://" + str(tmp_path / "facts")
    follow(spark, root, cache, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(cache).count() == 4  # all but the empty __init__.py
    (tmp_path / "p/app/__init__.py").write_text("def made():\n    pass\n")
    assert "app.made" in {r["fqn"] for r in files.parse(spark, root, cache=cache).entities.collect()}


def test_exports_and_service(spark, tmp_path):
    root = project(tmp_path / "p", JAVA)
    g = files.parse(spark, root)
    a = packages.recover_packages(g)
    assert "digraph" in export.dot(g, a) and "graph TD" in export.mermaid(g, a) and export.rsf(a).count() == g.entities.count()
    back = export.graph_from_dict(spark, json.loads(json.dumps(export.graph_dict(g), default=str)))
    assert back.edges.count() == g.edges.count() and back.entities.count() == g.entities.count()
    same = export.architecture_from_dict(spark, export.architecture_dict(g, a))
    assert same.membership.count() == a.membership.count()
    export.save_graph(g, str(tmp_path / "saved"))
    assert export.load_graph(spark, str(tmp_path / "saved")).edges.count() == g.edges.count()
    for name in ("r.html", "r.json", "r.dot", "r.mmd", "r.rsf"):
        assert export.visualize("repo", "1", g, a, output=str(tmp_path / name)).endswith(name)
    with pytest.raises(ValueError):
        export.visualize("repo", "1", g, a, output=str(tmp_path / "x"), format="pdf")

    done = asyncio.run(service.analyze(root))
    assert done["graph"]["num_entities"] == 9 and len(done["metrics"]) == 6
    parsed_ = service.parse_tool(root)
    arch = service.recover_tool(parsed_["session_id"])
    assert service.query_tool(arch["session_id"], parsed_["session_id"], "summary")["num_entities"] == 9
    assert service.find_tool(parsed_["session_id"], "calculator")["num_results"] > 0 and "error" in service.find_tool(parsed_["session_id"], "!")
    assert service.api_tool(parsed_["session_id"])["num_public_entities"] == 4
    assert service.get_full_result("none")["available"] and len(service.list_sessions()) >= 3
    assert service.TOOLS["find_relevant"].input_schema["properties"]["top_k"] == {"type": "integer", "default": 10}
    with pytest.raises(service.PartialAnalysisError) as failed:
        service.run_analysis(root, algorithm="none")
    assert failed.value.stage == "recover" and failed.value.partial.graph is not None


def test_budget():
    data = {"graph": {"entities": {f"e{i}": {"kind": "class", "x": "y" * 20} for i in range(100)}, "edges": [{"relation": "import"}] * 50, "packages": {f"p{i}": [] for i in range(10)}}, "architecture": {"components": [{"name": f"c{i}", "entities": [f"e{j}" for j in range(20)]} for i in range(10)]}}
    sizes = [service.estimate_tokens(service.truncate_result(data, n)) for n in (10_000, 1500, 1000, 700, 400, 200, 100)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == service.estimate_tokens(data)
    assert service.truncate_result(data, 1) == {
        "graph": {"num_entities": 100, "num_edges": 50, "edge_summary": {"import": 50}, "entity_summary": {"class": 100}, "num_packages": 10},
        "architecture": {"components": [{"name": f"c{i}", "num_entities": 10} for i in range(10)]},
    }
    assert len(data["graph"]["edges"]) == 50 and service.truncate_result({"graph": None}, 0) == {"graph": None}
    out = service.enforce_budget({"session_id": "s", "type": "t", "big": "x" * 1000, "n": 1}, 40)
    assert out == {"session_id": "s", "type": "t", "n": 1, "_budget_truncated": True}
    assert service.ModelClient().ask_json("x") is None and service.ModelClient(lambda p: '```json\n{"a": 1}\n```').ask_json("x") == {"a": 1}


def test_java_type_parameters_and_annotation_types():
    from codestrata.sources.extract import java

    found = {e.name: e for e in java("A.java", "package p;\n@interface Mark { }\nclass A<T extends B> extends C<T> implements D<T, E>, F { }").entities}
    assert "Mark" not in found
    assert (found["A"].superclass, found["A"].interfaces) == ("C", ["D", "F"])


def test_go_grouped_types():
    from codestrata.sources.extract import go

    found = {e.name: e.kind for e in go("p/a.go", "package p\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB interface{ M() }\n\tC = int\n)\nfunc F() {}\n").entities}
    assert found == {"A": "struct", "B": "interface", "C": "type", "F": "function"}


def test_typescript_patterns_and_imports():
    from codestrata.sources.extract import typescript

    out = typescript("a/b.ts", "import Base, { x as y } from './base';\nimport * as ns from './ns';\nconst r = /\"{/g;\nclass A extends Base { m() { return ns.run(1 / 2) / 3; } }\n")
    assert out.imports == [("./base", ["x", "Base"]), ("./ns", ["run"])]
    assert [e.name for e in out.entities] == ["A", "m"]


def test_a_cache_that_cannot_be_read_is_kept(spark, tmp_path):
    import pytest
    from codestrata.sources import files

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("class A:\n    pass\n")
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        files.parse(spark, str(tmp_path / "src"), cache=str(tmp_path / "cache"))
    assert (tmp_path / "cache/part-0.parquet").read_text() == "not a table"


def test_edges_of_several_graphs_keep_their_order(spark):
    from codestrata.operators import merge
    from codestrata.plans.queries import polyglot

    seqs = [r["edge_seq"] for r in merge.union(polyglot(spark)).edges.collect()]
    assert len(seqs) == len(set(seqs))
