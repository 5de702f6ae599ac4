"""Symbols and calls by tokens, against goldens of our own (tests/goldens: a source and, in JSON, what it holds)."""

import json
import os

import pytest

from graphloom.session import written
from graphloom.sources import lexer, syntax

GOLDENS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "goldens")
LANGUAGES = {"ts": "typescript", "js": "javascript", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "rs": "rust", "rb": "ruby", "swift": "swift", "php": "php", "c": "c", "cpp": "cpp"}
FIELDS = ["subtype", "signature", "type_signature", "return_type", "docs", "superclasses", "interfaces", "receiver_var", "receiver_type"]


def sources_in(spark, rows):
    return spark.createDataFrame(rows, "file_id string, language string, content string")


def parse(sources):
    tokens = written(syntax.in_blocks(lexer.tokens(sources)), "tokens")
    symbols = written(syntax.symbols(sources, tokens), "symbols")
    return symbols, syntax.call_refs(sources, tokens, symbols)


def nested(symbols, calls):
    """The rows as files of symbols with children and calls; fields that say nothing are left out."""
    of, files = {}, {}
    for r in sorted(symbols, key=lambda r: (r["file_id"], r["seq"])):
        one = {"name": r["name"], "kind": r["kind"], "start_line": r["start_line"], "end_line": r["end_line"]} | {f: r[f] for f in FIELDS if r[f]}
        of[r["file_id"], r["seq"]] = one
        above = of[r["file_id"], r["parent"]].setdefault("children", []) if r["parent"] else files.setdefault(r["file_id"], [])
        above.append(one)
    for c in sorted(calls, key=lambda c: (c["file_id"], c["ord"])):
        of[c["file_id"], c["caller"]].setdefault("calls", []).append({"name": c["name"], "kind": c["kind"]} | ({"receiver": c["receiver"]} if c["receiver"] else {}))
    return files


def test_goldens(spark):
    names = sorted(n for n in os.listdir(GOLDENS) if not n.endswith(".json"))
    assert {LANGUAGES[n.rsplit(".")[-1]] for n in names} == set(LANGUAGES.values())
    rows = []
    for n in names:
        with open(os.path.join(GOLDENS, n), encoding="utf-8") as source:
            rows.append((n, LANGUAGES[n.rsplit(".")[-1]], source.read()))
    symbols, calls = parse(sources_in(spark, rows))
    got = nested(symbols.collect(), calls.collect())
    for n in names:
        with open(os.path.join(GOLDENS, f"{n}.expected.json"), encoding="utf-8") as expected:
            assert got[n] == json.load(expected), n


@pytest.mark.parametrize(
    ("family", "text", "kinds"),
    [
        ("typescript", "a `x ${b + `y ${c}` } z` d", "name string open name mark string open name close string close string name"),
        ("typescript", "x = a / b / c; y = /[/]\"/g", "name mark name mark name mark name mark name mark string"),
        ("typescript", "it's fine // end", "name mark name name comment"),
        ("rust", "/* a /* b */ c */ fn f<'a>(c: char) { 'x' r#\"a\"b\"# }", "comment name name mark mark name mark open name mark name close open string string close"),
        ("go", "`a\n\"b` '\"' \"c\\\"d\"", "string string string"),
        ("python", None, None),
        ("csharp", 'x = @"a""b\\" + $"c"', "name mark string mark mark string"),
        ("cpp", 'R"z(a)" )z" 1\'000 #x', "string number name"),
        ("java", '"""\n a "b" \n""" @A', "string name"),
        ("ruby", "x = 1 if y\nif z then 2 end\nwhile a do\nend\n[1].each do |q| end", "name mark number name name open name name number close open name name close open number close mark name open mark name mark close"),
        ("ruby", "a = <<~T\ndef x\nT\nb", "name mark string name"),
        ("php", "$a = \"x\"; # note\n#[Attr] /* b", "name mark string mark comment mark open name close comment"),
        ("c", "#define A { \\\n {\nint x; \"open", "directive name name mark mark name"),
        ("kotlin", "/* /* */", "comment"),
        ("swift", '#"a"b"# """\n"c"\n"""', "string string"),
    ],
)
def test_tokens(family, text, kinds):
    if text is None:
        assert family not in lexer.RULES
        return
    found = list(lexer.lex(text, family))
    assert " ".join(k for k, _, _ in found) == kinds
    assert all(a < b for _, a, b in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:]))


def test_definitions_over_several_lines(spark):
    rows = [
        ("a.ts", "typescript", "export\nasync\nfunction\nfar(\n  a: number,\n)\n{\n  call(`\n} ${deep({ a: `}` })}\n`)\n}\n"),
        ("b.go", "go", "func\n(\n  s *S,\n)\nFar(\n  a int,\n) (\n  n int,\n  err error,\n) {\n  /* } */ call(\"}\")\n}\n"),
        ("c.java", "java", "class A {\n  int\n  far(\n    int a\n  )\n  {\n    /* } */\n  }\n}\n"),
    ]
    symbols, calls = parse(sources_in(spark, rows))
    got = {(r["file_id"], r["name"]): r for r in symbols.collect()}
    assert {k: (r["start_line"], r["end_line"]) for k, r in got.items()} == {("a.ts", "far"): (2, 11), ("b.go", "Far"): (1, 12), ("c.java", "A"): (1, 9), ("c.java", "far"): (2, 8)}
    far = got["b.go", "Far"]
    assert (far["receiver_var"], far["receiver_type"], far["type_signature"], far["return_type"]) == ("s", "S", "(int)", "(int,error)")
    assert [(c["file_id"], c["name"]) for c in sorted(calls.collect(), key=lambda c: (c["file_id"], c["ord"]))] == [("a.ts", "call"), ("a.ts", "deep"), ("b.go", "call")]


def test_broken_and_empty_files(spark):
    rows = [("a.ts", "typescript", ""), ("b.ts", "typescript", None), ("c.go", "go", "}}} func A() { b("), ("d.rb", "ruby", "end end class A\n def b"), ("e.c", "c", "{" * 3000), ("f.txt", None, "class A {}"), ("g.ts", "typescript", "`${`${`${")]
    symbols, _ = parse(sources_in(spark, rows))
    assert {(r["file_id"], r["name"]) for r in symbols.collect()} >= {("d.rb", "A"), ("d.rb", "b")}
    symbols, calls = parse(sources_in(spark, []))
    assert symbols.collect() == [] and calls.collect() == []
