"""Text functions, search, sources, resolution, streaming."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.functions import fixed_values as fixed
from graphloom.functions import text
from graphloom.operators import search
from graphloom.plans import registry
from graphloom.sources import archive, benchmarks, blocks, code, files, lexer, manifests, pulls, syntax
from graphloom.streaming import events


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    t = lambda s: one(spark, text.tokenize(F.col("s")), s=s)
    assert t("coms-license-service") == ["coms-license-service", "coms", "license", "service"]
    assert t("call getUserById now") == ["getuserbyid", "get", "user", "by", "id", "call", "now"]
    assert t("the a x of sqlite3_open") == ["sqlite3_open"] and t("") == []


def test_tokens_are_those_of_the_fixed_patterns(spark):
    """On odd texts; the separators are one predefined class, as a negated one of its own is six times slower."""
    words = lambda low: [w for w in re.split("[^a-z0-9_]+", low) if len(w) > 1 and w not in fixed.STOP_WORDS]

    def want(s):
        low, out = s.lower(), []
        for c in re.findall(fixed.COMPOUND, low):
            out += [c, *[p for p in c.split("-") if len(p) > 1]]
        for c in re.findall(fixed.CAMEL, s):
            out += [p for p in [c.lower(), *[q.lower() for q in re.split("(?=[A-Z])", c)]] if len(p) > 1]
        return list(dict.fromkeys(out + words(re.sub(fixed.COMPOUND, " ", low))))

    odd = ["9ab-cd 9-ab_x-y1-2 a--b-c- -d-e", "xABcD9eF aB9Cd __aXb 1aB2", "Stra\u00dfe-Bahn na\u00efve-text \u212aelvin-x", "a" * 3000 + "-b aaZ" + "9" * 2000 + "Q", "plain words and_more \u0130x caf\u00e9 x1"]
    got = [one(spark, text.tokenize(F.col("s")), s=s) for s in odd]
    assert got == [want(s) for s in odd]
    assert "[^a-z0-9_]" not in str(text.tokenize(F.col("s"))) + str(text.domain_tags(F.col("s")))


def test_patterns_of_domains_are_matched_where_their_literals_are(spark):
    """Each pattern says which texts its matches hold, and tags stay those of the patterns."""
    assert text._literals(r"\bUPDATE\b.*\bSET\b") == ["UPDATE", "SET"] and text._literals(r"(?i)\bfetch\s*\(") == ["fetch", "("] and text._literals(r"(?i)\.env\b") == [".env"]
    said = ["DB.open", "xdb.open", "UPDATE t\nSET x", "UPDATE t SET x", "Fetch  (u)", "prefetch(u)", "a.ENV", "a.envy", "try", "Try", "emit\n(", "see Path.x WS.y", "log. password token cursor Error", "_sql sql_", "caf\u00e9try \u00e9log.", ""]
    edge = lambda p: re.search(p, s, re.ASCII)
    for s in said:
        assert one(spark, text.domain_tags(F.col("s")), s=s) == [d for d, ps in fixed.DOMAINS.items() if any(edge(p) for p in ps)][:4], s
    parts = sum(len(text._literals(p)) for ps in fixed.DOMAINS.values() for p in ps if not re.fullmatch(r"\(\?i\)\\b(\w+)\\b", p))
    assert str(text.domain_tags(F.col("s"))).count("contains") == parts > 0  # asked before the pattern


def test_identifiers_and_phrases(spark):
    split = lambda s: one(spark, text.split_identifier(F.col("s")), s=s)
    assert split("parseHTTPResponse2xx") == ["parse", "HTTP", "Response", "2", "xx"]
    assert split("_private__name-part") == ["private", "name", "part"] and split("___") == ["___"]
    assert [one(spark, text.pluralize(F.col("s")), s=s) for s in ("Class", "Directory", "File")] == ["Classes", "Directories", "Files"]
    summary = lambda name, receiver=None: one(spark, text.summarise_function(F.col("n"), F.col("r"), F.lit("")), n=name, r=receiver)
    assert summary("loadConfig") == "Retrieves config" and summary("save", "Store") == "Store method that saves"
    folder = spark.createDataFrame([("utils", ["a", "b", "c", "d", "e", "f"]), ("odd", [])], "n string, c array<string>")
    assert [r["x"] for r in folder.select(text.summarise_folder(F.col("n"), F.col("c")).alias("x")).collect()] == ["Utility functions containing a, b, c, d, e and 1 more", "Directory odd"]
    file = spark.createDataFrame([("user_test.go", [], None), ("shop.py", ["Shop", "sell"], "python"), ("x.bin", [], None)], "n string, s array<string>, l string")
    assert [r["x"] for r in file.select(text.summarise_file(F.col("n"), F.col("s"), F.col("l")).alias("x")).collect()] == ["Tests for user", "Defines python Shop, sell", "Source file x.bin"]
    assert one(spark, text.first_sentence(F.col("d")), d="Does a thing. And more.") == "Does a thing"


def test_paths(spark):
    assert one(spark, text.extension(F.col("p")), p="a/Dockerfile") == ".dockerfile" and one(spark, text.extension(F.col("p")), p="a/.env") == ""
    p = one(spark, text.parse_node_id(F.col("p")), p="repo/src/a.py::C::m")
    assert (p["repo"], p["path"], p["symbol"]) == ("repo", "src/a.py", "C::m")
    assert one(spark, text.normalise_url(F.col("u")), u="git@host.org:me/it.git") == "https://host.org/me/it"
    rx = text.glob_pattern("src/**/*.py")
    assert [one(spark, F.col("p").rlike(rx).cast("string"), p=p) for p in ("src/a.py", "src/b/c.py", "lib/a.py")] == ["true", "true", "false"]


def test_bm25_orders_and_expands(spark):
    docs = spark.createDataFrame([("a", "auth", "login with token"), ("b", "db", "token store and sqlite3 tables"), ("c", "misc", "nothing here at all")], "id string, name string, text string")
    got = [r["id"] for r in search.bm25(docs, "token").collect()]
    assert set(got) == {"a", "b"} and got[0] == "a"  # the shorter one
    assert [r["id"] for r in search.bm25(docs, "sqlite").collect()] == ["b"]
    assert [r["id"] for r in search.bm25(docs, "logim").collect()] == ["a"]
    boosted = search.bm25(docs.withColumn("name", F.when(F.col("id") == "b", "token").otherwise("x")), "token").collect()
    assert boosted[0]["id"] == "b"


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("short", [1.0])], "id string, vec array<float>")
    assert [(r["id"], round(r["score"], 4)) for r in search.nearest(v, [1.0, 0.0]).collect()] == [("a", 1.0), ("b", 0.7071), ("z", 0.0)]
    lists = [spark.createDataFrame(rows, "id string, score double") for rows in ([("a", 9.0), ("b", 1.0)], [("b", 0.5), ("c", 0.4)])]
    assert [r["id"] for r in search.fuse(lists).collect()] == ["b", "a", "c"]


def test_grep_and_slices(spark):
    f = spark.createDataFrame([("r/a.py", "a.py", "one\n  TODO: x\ntodo y", "r"), ("r/b.md", "b.md", "todo", "r")], "id string, path string, content string, repo string")
    assert [(r["id"], r["line"], r["text"]) for r in search.grep(f, "todo", include="*.py").collect()] == [("r/a.py", 2, "TODO: x"), ("r/a.py", 3, "todo y")]
    assert search.grep(f, "(").collect() == [] and search.grep(f, "todo", case_sensitive=True).count() == 2
    assert {r["truncated"] for r in search.grep_per_group(f, "todo", "repo", 2).collect()} == {True}
    got = search.source_slice(f, "r/a.py::x", 2, 3).first()
    assert got["content"] == "  TODO: x\ntodo y" and got["line_count"] == 3


FILES = {
    "package.json": '{"dependencies": {"react": "^18", "@scope/x": "1"}, "devDependencies": {"jest": "29"}}',
    "web/package.json": "not json",
    "requirements.txt": "# c\nFlask_Login>=2.0  # why\nrequests[security]==2.1; python_version>'3'\n-r other.txt\nnumpy",
    "go.mod": "module example.org/me\n\nrequire single.org/x v1.0.0\nrequire (\n\tgithub.com/a/b v1.2.3\n\tplain v0.1.0 // indirect\n)\nreplace x => y v9.9.9\n",
    "Cargo.toml": '[package]\nname = "me"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["full"] }\n[dev-dependencies]\nrand = { git = "x" }\n',
    "pyproject.toml": '[project]\nname = "me"\ndependencies = [\n  "Click>=8",\n  "attrs",\n]\n[project.optional-dependencies]\ndev = ["pytest>=7"]\n[tool.poetry.dependencies]\npython = "^3.9"\nhttpx = "^0.2"\n',
}
WANTED = {
    ("npm", "react", "^18", "runtime"), ("npm", "@scope/x", "1", "runtime"), ("npm", "jest", "29", "dev"), ("pypi", "flask-login", ">=2.0", "runtime"),
    ("pypi", "requests", "==2.1", "runtime"), ("pypi", "numpy", "*", "runtime"), ("go", "single.org/x", "v1.0.0", "runtime"), ("go", "github.com/a/b", "v1.2.3", "runtime"),
    ("go", "plain", "v0.1.0", "indirect"), ("crates", "serde", "1.0", "runtime"), ("crates", "tokio", "1.2", "runtime"), ("crates", "rand", "*", "dev"),
    ("pypi", "click", ">=8", "runtime"), ("pypi", "attrs", "*", "runtime"), ("pypi", "pytest", ">=7", "optional"), ("pypi", "httpx", "^0.2", "runtime"),
}


def test_manifests(spark):
    rows = spark.createDataFrame(list(FILES.items()), "path string, content string")
    found = manifests.dependencies(rows)
    assert {tuple(r)[1:] for r in found.collect()} == WANTED
    nodes, edges = manifests.dependency_graph(found, "repo")
    assert nodes.count() == edges.count() == len(WANTED)


def test_tree_scan(spark, tmp_path):
    for path, body in {"src/a.py": b"x = 1\n", "src/deep/b.ts": b"let x", "node_modules/c.js": b"1", "bin.py": b"a\x00b", "pic.png": b"1", "Dockerfile": b"FROM x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    found = files.sources(files.read_tree(spark, str(tmp_path)), "repo")
    assert {r["path"]: r["language"] for r in found.collect()} == {"src/a.py": "python", "src/deep/b.ts": "typescript", "Dockerfile": None}
    nodes, edges = files.tree(found, "repo")
    assert {r["id"] for r in nodes.collect()} == {"repo", "repo/src", "repo/src/deep", "repo/src/a.py", "repo/src/deep/b.ts", "repo/Dockerfile"}
    assert ("repo/src", "repo/src/deep") in {(r["source_id"], r["target_id"]) for r in edges.collect()} and edges.count() == 5
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/a.py", "x")
        z.writestr("top/b/c.py", "y")
    (tmp_path / "src.zip").write_bytes(data.getvalue())
    assert {r["path"] for r in files.read_zip(spark, str(tmp_path / "src.zip")).collect()} == {"a.py", "b/c.py"}


SOURCE = '''"""Doc."""
import os
from pkg.util import helper as h


class Shop(Base):
    """Sells."""

    stock: int

    def sell(self, n: int) -> int:
        price = compute(n)
        self.log(price)
        return price


def compute(x, y=1):
    return h(x)
'''


def test_python_facts(spark):
    rows = spark.createDataFrame([("r/a.py", SOURCE, "python"), ("r/bad.py", "def (", "python")], "file_id string, content string, language string")
    facts = code.python_facts(rows).collect()
    pick = lambda what: [r for r in facts if r["what"] == what]
    assert [(r["name"], r["kind"], r["signature"]) for r in pick("symbol")] == [("Shop", "class", None), ("sell", "function", "(int)"), ("compute", "function", None)]
    assert {(r["name"], r["receiver"]) for r in pick("call")} == {("compute", None), ("log", "self"), ("h", None)}
    assert {(r["name"], r["receiver"]) for r in pick("import")} == {("os", "os"), ("h", "pkg.util")}
    assert {("price", "local"), ("n", "parameter"), ("stock", "field")} <= {(r["name"], r["kind"]) for r in pick("variable")}
    assert ("price", "compute", "call") in {(r["signature"], r["name"], r["kind"]) for r in pick("derives")}


def test_pattern_symbols(spark):
    rows = [("a.ts", "typescript", "export class A {}\nconst f = async (x) => 1\nexport function g() {}"), ("a.go", "go", "type T struct {\n}\nfunc (t *T) Run() {"), ("A.java", "java", "public class A {\n  public static int f(int x) {"), ("a.rs", "rust", "pub struct S;\npub fn go() {}"), ("a.rb", "ruby", "class A\n  def b?\n  end"), ("a.c", "c", "int main(int a) {\n  if (x) {\n")]
    sources = spark.createDataFrame(rows, "file_id string, language string, content string")
    found = syntax.symbols(sources, syntax.in_blocks(lexer.tokens(sources)))
    got = {}
    for r in found.collect():
        got.setdefault(r["file_id"], []).append((r["name"], r["kind"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        "a.ts": [("A", "class"), ("f", "function"), ("g", "function")], "a.go": [("Run", "function"), ("T", "class")], "A.java": [("A", "class"), ("f", "function")],
        "a.rs": [("S", "class"), ("go", "function")], "a.rb": [("A", "class"), ("b?", "function")], "a.c": [("main", "function")],
    }


def test_pull_requests(spark):
    prs = spark.createDataFrame([(7, "Fix", "open", "me")], "number int, title string, state string, author string")
    changed = spark.createDataFrame([(7, "src/a.py", "modified", 2, 1, "x" * 6000, None), (7, "new/b.py", "added", 1, 0, None, None)], "number int, path string, status string, additions int, deletions int, patch string, previous_path string")
    have = spark.createDataFrame([("r/src/a.py",), ("r/src",)], "id string")
    nodes, edges = pulls.pull_graph(prs, changed, have, "r")
    assert {(r["id"], r["type"]) for r in nodes.collect()} == {("r/pr/7", "PullRequest"), ("r/new", "Directory"), ("r/new/b.py", "File")}
    assert sorted(r["type"] for r in edges.collect()) == ["CHANGES", "CHANGES", "TARGETS_REPO", "defined_in", "defined_in"]
    patch = "@@ -1,3 +10,4 @@ f\n same\n-old\n+new\n+more\n same\n@@ -20 +30 @@\n+x"
    lines = pulls.patch_lines(spark.createDataFrame([("a", patch)], "path string, patch string"))
    assert [(r["line"], r["added"]) for r in lines.orderBy("line").collect()] == [(10, False), (11, True), (12, True), (13, False), (30, True)]
    snapped = pulls.snap(lines, spark.createDataFrame([("a", 20), ("a", 31)], "path string, target int"))
    assert {(r["target"], r["line"]) for r in snapped.collect()} == {(20, 13), (31, 30)}


def test_archive_round_trip(spark, seeded, tmp_path):
    path = str(tmp_path / "g.zip")
    archive.export_graph(seeded.nodes, seeded.edges.withColumn("properties", F.lit('{"w": 1}')), path)
    nodes, edges = archive.import_graph(spark, path)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, seeded.nodes.collect())) and edges.count() == 7
    with pytest.raises(ValueError):
        archive.export_graph(seeded.nodes.where("false"), seeded.edges, path)
    with zipfile.ZipFile(str(tmp_path / "empty.zip"), "w"):
        pass
    with pytest.raises(ValueError):
        archive.import_graph(spark, str(tmp_path / "empty.zip"))


def test_archive_in_parts_of_odd_types(spark, tmp_path, monkeypatch):
    """Tables of several files, types that are no file names, nulls, repeated rows, no edges; what other writers compress."""
    monkeypatch.setattr(archive, "ROWS_A_FILE", 10)
    rows = [(f"n{i}", "a/b: 1.parquet" if i % 3 else "File", None if i % 7 == 0 else f"name {i}", None if i % 5 == 0 else f'{{"i": {i}}}') for i in range(60)]
    rows += [("n1", "File", "again", "{}")] * 2
    nodes = spark.createDataFrame(rows, "id string, type string, name string, properties string")
    none = spark.createDataFrame([], "id string, type string, source_id string, target_id string")
    texts = spark.createDataFrame([(f"f{i}", "f", "x" * i) for i in range(25)], "id string, name string, source_text string")
    path = str(tmp_path / "parts.zip")
    archive.export_graph(nodes, none, path, texts)
    with zipfile.ZipFile(path) as packed:
        names = packed.namelist()
        assert "nodes_File.parquet" in names and "nodes_File/1.parquet" in names and "relationships.parquet" in names and len(set(names)) == len(names)
        again = str(tmp_path / "deflated.zip")
        with zipfile.ZipFile(again, "w", zipfile.ZIP_DEFLATED) as other:
            for n in names:
                other.writestr(f"top/{n}", packed.read(n))
    key = lambda r: tuple(x or "" for x in r)
    for p in (path, again):
        got, edges = archive.import_graph(spark, p)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key) and edges.count() == 0
        assert sorted(map(tuple, archive.import_source_text(spark, p).collect())) == sorted(map(tuple, texts.collect()))
    assert archive.import_source_text(spark, _typed_archive(tmp_path)) is None
    got, edges = archive.import_graph(spark, _typed_archive(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("pkg:x", "Dependency", "x", '{"registry":"npm","stars":3}')] and edges.count() == 0
    with pytest.raises(ValueError):
        archive.export_graph(nodes.withColumn("type", F.lit(None).cast("string")), none, path)
    assert zipfile.ZipFile(path).namelist() == names  # a failed export leaves the archive as it was
    assert sorted(p.name for p in tmp_path.iterdir()) == ["deflated.zip", "parts.zip", "typed.zip"]


def _typed_archive(folder) -> str:
    """An archive with an older name of a type and typed columns."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.BufferOutputStream()
    pq.write_table(pa.table({"id": ["pkg:x"], "name": ["x"], "registry": ["npm"], "stars": [3]}), table)
    path = str(folder / "typed.zip")
    with zipfile.ZipFile(path, "w") as packed:
        packed.writestr("nodes_Package.parquet", table.getvalue().to_pybytes())
    return path


def test_stream_equals_batch_and_drops_repeats(spark):
    sf = "/root/testdata/sf0.001"
    batch = events.tumbling(spark.read.parquet(f"{sf}/events.parquet"))
    stream = events.run_to_end(events.tumbling(events.event_stream(spark, sf)))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))
    once = events.run_to_end(events.deduplicated(events.event_stream(spark, sf), ["event_id"], "10 days"), "append")
    assert once.count() == spark.read.parquet(f"{sf}/events.parquet").count()


SAMPLES = {
"r/a.ts":("typescript",'''import React, { useState as state, type Kind } from 'react';
import {
  load,
  save,
} from "./disk";
const fs = require('fs');

/** Keeps boxes.
 * More. */
export class Shelf extends Board<Row, Cell> implements Holder, Named {
  private boxes: Box[] = [];

  constructor(private size: number) {
    super(size);
  }

  // Puts one in.
  put(box: Box): void {
    if (box.ok("}{")) {
      this.boxes.push(box);
    } else {
      load(box);
    }
  }
}

export const wrap = async (x: number): Promise<number> => {
  return save(x);
};
function one() { return wrap(1); }
'''),
"r/b.go":("go",'''package depot

import (
	"fmt"
	box "example.org/depot/boxes"
)

// Depot holds boxes.
type Depot struct {
	Base
	*boxes.Lid
	name string
}

// Open opens it.
func (d *Depot) Open(key string) error {
	fmt.Println("}")
	return d.turn(key)
}

func helper() {}
'''),
"r/A.java":("java",'''package x;

@Deprecated
public class A extends B implements C, D<E> {
    /** Says. */
    @Override
    public int f(int x)
    {
        if (x > 1) {
            return g(x);
        }
        return 0;
    }

    static class Inner {
        void h() {
        }
    }

    private void last() {
    }
}
'''),
"r/m.rs":("rust",'''use crate::util::parse;
/// A point.
pub struct Point {
    x: i32,
}

impl Shape for Point {
    fn area(&self) -> i32 {
        self.x
    }
}
fn lone() {}
'''),
"r/s.rb":("ruby",'''require_relative 'util'
require 'json'
# A shop.
class Shop < Base
  def sell?(x)
    if x
      1
    end
    [1].each do |y|
      y
    end
  end

  def self.all
  end
end
'''),
"r/c.kt":("kotlin","class Car(val n: Int) : Vehicle(n), Named {\n  override fun go(x: Int): Int {\n    return 1\n  }\n}\n"),
"r/p.php":("php","<?php\nclass P extends Q {\n  public function run($x) {\n    foo('{');\n  }\n}\n"),
}


def test_blocks(spark):
    sources = spark.createDataFrame([(k, *v) for k, v in SAMPLES.items()], "file_id string, language string, content string")
    rows = syntax.in_blocks(lexer.tokens(sources)).cache()
    found = syntax.symbols(sources, rows)
    got = {(r["file_id"], r["scope"].removeprefix(r["file_id"]).removeprefix("::"), r["name"]): r for r in found.collect()}
    assert {k: (r["kind"], r["start_line"], r["end_line"]) for k, r in got.items()} == {
        ("r/a.ts", "", "Shelf"): ("class", 10, 25), ("r/a.ts", "Shelf", "boxes"): ("function", 11, 11), ("r/a.ts", "Shelf", "constructor"): ("function", 13, 15), ("r/a.ts", "Shelf", "put"): ("function", 18, 24),
        ("r/a.ts", "", "wrap"): ("function", 27, 29), ("r/a.ts", "", "one"): ("function", 30, 30),
        ("r/b.go", "", "Depot"): ("class", 9, 13), ("r/b.go", "", "Open"): ("function", 16, 19), ("r/b.go", "", "helper"): ("function", 21, 21),
        ("r/A.java", "", "A"): ("class", 3, 22), ("r/A.java", "A", "f"): ("function", 6, 13), ("r/A.java", "A", "Inner"): ("class", 15, 18),
        ("r/A.java", "A::Inner", "h"): ("function", 16, 17), ("r/A.java", "A", "last"): ("function", 20, 21),
        ("r/m.rs", "", "Point"): ("class", 3, 5), ("r/m.rs", "", "area"): ("function", 8, 10), ("r/m.rs", "", "lone"): ("function", 12, 12),
        ("r/s.rb", "", "Shop"): ("class", 4, 16), ("r/s.rb", "Shop", "sell?"): ("function", 5, 12), ("r/s.rb", "Shop", "all"): ("function", 14, 15),
        ("r/c.kt", "", "Car"): ("class", 1, 5), ("r/c.kt", "Car", "go"): ("function", 2, 4), ("r/p.php", "", "P"): ("class", 2, 6), ("r/p.php", "P", "run"): ("function", 3, 5),
    }
    bases = {k[2]: (r["superclasses"] or []) + (r["interfaces"] or []) for k, r in got.items()}
    assert {k: v for k, v in bases.items() if v} == {"Shelf": ["Board", "Holder", "Named"], "Depot": ["Base", "boxes.Lid"], "A": ["B", "C", "D"], "Shop": ["Base"], "Car": ["Vehicle", "Named"], "P": ["Q"]}
    opened, put = got["r/b.go", "", "Open"], got["r/a.ts", "Shelf", "put"]
    assert (opened["receiver_var"], opened["receiver_type"], opened["signature"], opened["docs"]) == ("d", "Depot", "(key string)", "Open opens it.")
    assert (put["signature"], put["docs"], got["r/A.java", "A", "f"]["docs"]) == ("(box: Box)", "Puts one in.", "Says.")
    called = syntax.call_refs(sources, rows, found).join(found.select("file_id", F.col("seq").alias("caller"), F.concat("scope", F.lit("::"), "name").alias("caller_id")), ["file_id", "caller"]).collect()
    assert sorted((r["caller_id"].split("::")[-1], r["name"], r["receiver"]) for r in called if r["receiver"]) == [("Open", "Println", "fmt"), ("Open", "turn", "d"), ("put", "ok", "box"), ("put", "push", "this.boxes")]
    assert sorted((r["caller_id"].split("::")[-1], r["name"]) for r in called if not r["receiver"]) == [("one", "wrap"), ("put", "load"), ("wrap", "save")]
    assert {(r["alias"], r["module"], r["member"]) for r in blocks.imports(sources).collect()} == {
        ("React", "react", None), ("state", "react", None), ("Kind", "react", None), ("load", "./disk", None), ("save", "./disk", None), ("fs", "fs", None),
        ("fmt", "fmt", None), ("box", "example.org/depot/boxes", None), ("parse", "crate::util", "parse"), ("util", "./util", None), ("json", "json", None),
    }


def test_blocks_of_odd_files(spark):
    rows = [("r/e.ts", "typescript", ""), ("r/n.ts", "typescript", None), ("r/u.go", "go", "func Open() {\n  a(\n"), ("r/x.c", "c", "}}}\n" + '"' + "x" * 200_000), ("r/q.md", None, "class A {}")]
    sources = spark.createDataFrame(rows, "file_id string, language string, content string")
    assert [(r["file_id"], r["name"], r["end_line"]) for r in syntax.symbols(sources, syntax.in_blocks(lexer.tokens(sources))).collect()] == [("r/u.go", "Open", 2)]
    assert blocks.imports(sources).count() == 0


def test_benchmark_files(spark, tmp_path):
    import json

    rows = [{"instance_id": "a", "repo": "x"}, {"instance_id": "b", "repo": "y"}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "held.json").write_text(json.dumps({"instances": rows}))
    for name in ("list.json", "held.json"):
        assert sorted(r["instance_id"] for r in benchmarks.load_instances(spark, str(tmp_path / name)).collect()) == ["a", "b"]
    task = {"id": "t", "category": "c", "tool": "stats", "tool_args": {"k": 1}, "assertions": [{"type": "min_count", "value": 3}]}
    (tmp_path / "suite.json").write_text(json.dumps({"suite_name": "s", "repo_id": "r", "tasks": [task]}))
    got = benchmarks.load_suite(spark, str(tmp_path / "suite.json")).collect()
    assert [(r["suite_name"], r["id"], r["tool_args"], r["assertions"][0]["value"]) for r in got] == [("s", "t", {"k": "1"}, "3")]
