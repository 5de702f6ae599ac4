"""A small repository from files to answers."""

from graphloom.sources import code, indexer
from graphloom.store import GraphStore

REPO = {
    "shop/__init__.py": "",
    "shop/store.py": '"""Store."""\nimport requests\nfrom shop.util import price\n\n\nclass Store:\n    """Keeps goods. More."""\n\n    def sell(self, item: str) -> int:\n        cost = price(item)\n        return self.log(cost)\n\n    def log(self, cost):\n        return cost\n\n\ndef main():\n    s = Store()\n    return s\n',
    "shop/util.py": "def price(item):\n    return 1\n",
    "web/app.ts": "import { paint } from './paint';\nimport React from 'react';\nexport class App {\n  show(x) {\n    paint(x);\n    this.hide();\n  }\n  hide() {\n  }\n}\n",
    "web/paint.ts": "export function paint(x) {\n  return x;\n}\n",
    "go.mod": "module example.org/depot\n",
    "main.go": 'package main\n\nimport "example.org/depot/boxes"\n\nfunc main() {\n\tboxes.Pack()\n}\n',
    "boxes/box.go": "package boxes\n\ntype Box struct {\n}\n\nfunc Pack() {\n}\n\nfunc (b *Box) Shut() {\n\tb.lock()\n}\n\nfunc (b *Box) lock() {\n}\n",
    "requirements.txt": "requests>=2\n",
}


def test_index_and_query(spark):
    tree = spark.createDataFrame([(p, bytearray(c.encode()), len(c)) for p, c in REPO.items()], "path string, content binary, bytes long")
    nodes, edges = indexer.index_files(tree, "r")
    kinds = {r["id"]: r["type"] for r in nodes.collect()}
    assert kinds["r/shop/store.py::Store"] == "Class" and kinds["r/shop/store.py::Store::sell(str)"] == "Function" and kinds["pkg:pypi:requests"] == "Dependency"
    assert kinds["r/web/app.ts::App"] == "Class" and kinds["r/shop/store.py::Store::sell(str)::cost"] == "Variable"
    got = {(r["type"], r["source_id"], r["target_id"]) for r in edges.collect()}
    assert {
        ("IMPORTS", "r/shop/store.py", "r/shop/util.py"), ("IMPORTS", "r/shop/store.py", "pkg:pypi:requests"), ("DEPENDS_ON", "r", "pkg:pypi:requests"),
        ("CALLS", "r/shop/store.py::Store::sell(str)", "r/shop/util.py::price"), ("CALLS", "r/shop/store.py::Store::sell(str)", "r/shop/store.py::Store::log"),
        ("CALLS", "r/shop/store.py::main()", "r/shop/store.py::Store"), ("DEFINES", "r/shop", "r/shop/store.py"),
        ("DERIVED_FROM", "r/shop/store.py::Store::sell(str)::cost", "r/shop/util.py::price"),
        ("IMPORTS", "r/web/app.ts", "r/web/paint.ts"), ("IMPORTS", "r/web/app.ts", "pkg:npm:react"), ("IMPORTS", "r/main.go", "r/boxes/box.go"),
        ("CALLS", "r/web/app.ts::App::show", "r/web/paint.ts::paint"), ("CALLS", "r/web/app.ts::App::show", "r/web/app.ts::App::hide"),
        ("CALLS", "r/main.go::main", "r/boxes/box.go::Pack"), ("CALLS", "r/boxes/box.go::Box.Shut", "r/boxes/box.go::Box.lock"),
    } <= got, got
    store = GraphStore(nodes, edges)
    assert {r["id"] for r in store.impact("shop/util.py").collect()} >= {"r/shop/store.py::Store::sell(str)"}
    assert [r["id"] for r in store.search_nodes("keeps goods").collect()] == ["r/shop/store.py::Store"]
    meta = indexer.index_metadata(nodes, edges, "r", branch="main")
    assert meta.first()["n_class"] == 3 and indexer.repositories(nodes, meta.union(meta)).first()["branch"] == "main"


def test_files_that_do_not_parse_are_told_and_harm_no_other(spark):
    files = {"ok.py": "def f():\n    return g()\n\n\ndef g():\n    return 1\n", "bad.py": "x = 1\ndef (:\n", "nul.py": "a = 'x\0'\n", "deep.py": "-" * 200_000 + "1\n"}
    sources = spark.createDataFrame([(f"r/{p}", c, "python") for p, c in files.items()] + [("r/none.py", None, "python")], "file_id string, content string, language string")
    facts = code.python_facts(sources)
    told = {r["file_id"]: r for r in code.errors(facts).collect()}
    assert set(told) == {"r/bad.py", "r/nul.py", "r/deep.py", "r/none.py"} and told["r/bad.py"]["line"] == 2 and told["r/bad.py"]["error"] == "SyntaxError"
    assert {r["file_id"] for r in facts.where("what <> 'error'").collect()} == {"r/ok.py"}
