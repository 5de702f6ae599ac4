"""Stems against the published examples and an own word-by-word version; full text against brute force."""

import math
import random
import re
from collections import Counter

from graphloom.functions.fixed_values import STOP_WORDS
from graphloom.functions.stemming import STEP_2, STEP_3, stem
from graphloom.operators import fulltext, search
from graphloom.operators.fulltext import FullText, Scan, search_nodes, source_docs
from graphloom.operators.search import bm25, fuse, hybrid
from graphloom.plans import registry
from graphloom.store import GraphStore

#: Words with their stems from the paper's examples, after all steps.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def measured(word):
    """Consonants (True) and vowels of a word."""
    kinds = []
    for i, c in enumerate(word):
        kinds.append(c not in "aeiou" and not (c == "y" and i > 0 and kinds[-1]))
    return kinds


def m(word):
    kinds = measured(word)
    return sum(a is False and b for a, b in zip(kinds, kinds[1:]))


def short(word):
    kinds = measured(word)
    return len(word) >= 3 and kinds[-3:] == [True, False, True] and word[-1] not in "wxy"


def by_hand(w):
    if len(w) <= 2:
        return w
    vowel = lambda x: not all(measured(x))
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and measured(w)[-1] and w[-1] not in "lszy":
                    w = w[:-1]
                elif m(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if m(w[: -len(end)]) > 0 else w
                break
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end) and (end != "ion" or w[-4:-3] in ("s", "t")):
            w = w[: -len(end)] if m(w[: -len(end)]) > 1 else w
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


def stems(spark, words):
    rows = stem(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    return {r["word"]: r["stem"] for r in rows}


def test_stems_of_the_published_examples(spark):
    want = dict(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert stems(spark, list(want)) == want
    assert {w: by_hand(w) for w in want} == want


def test_stems_equal_the_word_by_word_version(spark):
    draw = random.Random(6)
    ends = [*STEP_2, *STEP_3, "ed", "ing", "eed", "s", "es", "sses", "y", "e", "ll", "ement", "ion", "ness", "ate", ""]
    made = {"".join(draw.choices("abcdeiouylstnrkz1", k=draw.randint(1, 6))) + draw.choice(ends) + draw.choice(["", "", "s", "ed", "ing", "ly"]) for _ in range(4000)} - {""}
    # 1b drops one of two equal consonants; whether y is one depends on what stands before it
    made = {w for w in made if "yy" not in w}
    got = stems(spark, sorted(made))
    assert {w: s for w, s in got.items() if s != by_hand(w)} == {}


WORDS = re.compile("[a-z0-9]+")


def brute(docs, query, weights=(1, 1), k1=1.2, b=0.75, conjunctive=False):
    counted, df, sizes = {}, Counter(), {}
    for i, *fields in docs:
        tf = Counter()
        sizes[i] = 0
        for weight, text in zip(weights, fields, strict=False):
            for w in WORDS.findall((text or "").lower()):
                if w not in STOP_WORDS:
                    tf[by_hand(w)] += weight
                    sizes[i] += 1
        counted[i] = tf
        df.update(tf.keys())
    mean = sum(sizes.values()) / len(docs)
    terms = {by_hand(w) for w in WORDS.findall(query.lower()) if w not in STOP_WORDS}
    out = {}
    for i, tf in counted.items():
        hit = terms & tf.keys()
        if hit and (not conjunctive or hit == terms):
            out[i] = sum(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * sizes[i] / mean)) for t in hit)
    return out


DOCS = [("a", "Parsers.py", "parsing parsed the parser parse"), ("b", "notes", "A parser of relational tables"), ("c", "relate", None), ("d", "", ""), ("e", "x", "nothing of the kind " * 40)]


def test_full_text_equals_brute_force(spark):
    index = FullText.build(spark.createDataFrame(DOCS, "id string, name string, source_text string"))
    for query, options in [("the parsers", {}), ("relating parse", {}), ("relations parsing", {"conjunctive": True}), ("zebra", {}), ("", {}), ("the of", {})]:
        got = {r["id"]: r["score"] for r in index.search(query, None, **options).collect()}
        want = brute(DOCS, query, **options)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    weighed = {r["id"]: r["score"] for r in index.search("parse", None, weights={"name": 3.0}).collect()}
    want = brute(DOCS, "parse", weights=(3, 1))
    assert all(math.isclose(weighed[i], want[i], rel_tol=1e-9) for i in want) and weighed.keys() == want.keys()
    within = spark.createDataFrame([("b",), ("e",)], "id string")
    assert [r["id"] for r in index.search("relating", within=within).collect()] == ["b"]


def test_full_text_of_nothing(spark):
    index = FullText.build(spark.createDataFrame([], "id string, text string"))
    assert index.search("anything").collect() == []


def test_snippets_hold_the_first_characters(spark):
    sources = spark.createDataFrame([("r/a.py", "src/a.py", "x" * 10_000 + " tail"), ("r/b.py", "b.py", None)], "id string, path string, content string")
    got = {r["id"]: r for r in source_docs(sources).collect()}
    assert len(got["r/a.py"]["source_text"]) == 10_000 and got["r/a.py"]["name"] == "a.py" and got["r/b.py"]["source_text"] is None


def test_types_are_filtered_after_the_ranking(spark):
    nodes = spark.createDataFrame([(f"n{i}", "Function" if i % 2 else "Class", "walked", "{}") for i in range(6)] + [("z", "Module", "zebraland", "{}")], "id string, type string, name string, properties string")
    store = GraphStore(nodes, spark.createDataFrame([], "id string, type string, source_id string, target_id string"))
    assert [r["id"] for r in store.full_text_nodes("walking", limit=2).collect()] == ["n0", "n1"]
    assert [r["id"] for r in store.full_text_nodes("walking", ["Function"], limit=2).collect()] == ["n1", "n3"]
    assert store.full_text_nodes("walking", ["Module"]).collect() == []  # found, but of other types: no names instead
    assert [r["id"] for r in store.full_text_nodes("ebral").collect()] == ["z"]  # nothing found: names that hold it


def test_hybrid_fuses_three_lists(spark):
    docs = spark.createDataFrame([(i, n, t, "File") for i, n, t in DOCS], "id string, name string, text string, type string")
    full_text = FullText.build(docs.select("id", "name", "text"))
    vectors = spark.createDataFrame([("e", [1.0, 0.0]), ("d", [0.0, 1.0])], "id string, vec array<double>")
    got = {r["id"]: r["score"] for r in hybrid(docs, "parsers", vectors, [1.0, 0.1], full_text=full_text).collect()}
    lists = [bm25(docs, "parsers", 100), full_text.search("parsers", 100), spark.createDataFrame([("e", 0.9)], "id string, score double")]
    want = {r["id"]: r["score"] for r in fuse(lists).collect()}
    assert got == want and "e" in got and "b" in got
    assert set(r["id"] for r in hybrid(docs, "parsers", types=["Other"], full_text=full_text).collect()) == set()


def test_store_searches_sources(spark):
    nodes = spark.createDataFrame([("r/a.py", "File", "a.py", "{}"), ("r/b.py", "File", "b.py", "{}")], "id string, type string, name string, properties string")
    sources = spark.createDataFrame([("r/a.py", "a.py", "def retrying(): pass"), ("r/b.py", "b.py", "nothing")], "id string, path string, content string")
    store = GraphStore(nodes, spark.createDataFrame([], "id string, type string, source_id string, target_id string"), sources)
    assert [r["id"] for r in store.full_text_sources("retries").collect()] == ["r/a.py"]
    assert [r["id"] for r in store.search_nodes("retries").collect()] == ["r/a.py"]


def test_a_scan_finds_what_the_index_finds(spark):
    docs = spark.createDataFrame(DOCS, "id string, name string, source_text string")
    index, within = FullText.build(docs), spark.createDataFrame([("b",), ("e",)], "id string")
    for query, options in [("the parsers", {}), ("relating parse", {}), ("relations parsing", {"conjunctive": True}), ("parse", {"weights": {"name": 3.0}}), ("relating", {"within": within}), ("zebra", {}), ("", {}), ("the of", {})]:
        got = {r["id"]: r["score"] for r in Scan(docs).search(query, None, **options).collect()}
        want = {r["id"]: r["score"] for r in index.search(query, None, **options).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert [r["id"] for r in Scan(docs).search("parse", 2).collect()] == [r["id"] for r in index.search("parse", 2).collect()]
    assert Scan(docs.where("false")).search("parse").collect() == []


def test_one_query_writes_no_index(spark, monkeypatch):
    """What a fused search of three lists writes is vocabularies and what it found: no tokens, words or postings of all documents."""
    docs = spark.createDataFrame([(i, n, t) for i, n, t in DOCS], "id string, name string, text string")
    names = []
    for module in (search, fulltext):
        monkeypatch.setattr(module, "written", lambda df, name="table", own=module.written: names.append(name) or own(df, name))
    assert not hybrid(docs, "parsers", full_text=Scan(docs)).isEmpty()
    assert set(names) == {"frequencies", "query-tokens", "vocabulary", "stems", "full-text-found", "found"}


def test_three_lists_read_whole_texts(spark, tmp_path):
    """A word past the first 10,000 characters counts in the full text as it does in the other list."""
    late = "filler " * 2_000 + "passwords"
    spark.createDataFrame([(1, late, "src0"), (2, "nothing here", "src1")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["score"] for r in registry.hybrid_three_lists(spark, str(tmp_path)).collect()}
    assert got == {1: round(2 / 61, 8), 0: round(1 / 61, 8)}
