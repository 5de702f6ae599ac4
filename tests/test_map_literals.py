"""Map literals against a small parser of our own."""

import json
import random

from pyspark.sql import functions as F

from graphloom.operators.store_ops import parse_map_literal


def parsed(spark, literals):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(literals)], "i int, x string").select("i", parse_map_literal(F.col("x")).alias("m"))
    return [r["m"] for r in rows.orderBy("i").collect()]


def made(rng, depth):
    """A random value, as a literal and as what it means."""
    kind = rng.randrange(6 if depth else 4)
    if kind == 0:
        n = rng.choice([0, -3, 17, 2.5])
        return str(n), n
    if kind == 1:
        w = rng.choice(["oak", "dark green", "true", "null", "x-1"])
        return w, {"true": True, "null": None}.get(w, w)
    if kind in (2, 3):
        w = rng.choice(["", "a, b", "{not: one}", "x: y", "[", 'say "hi"', "back\\slash"])
        mark = rng.choice("\"'")
        return mark + w.replace("\\", "\\\\").replace(mark, "\\" + mark) + mark, w
    space = lambda: rng.choice(["", " ", "\n"])
    if kind == 4:
        own = [made(rng, depth - 1) for _ in range(rng.randrange(4))]
        return "[" + ",".join(space() + a + space() for a, _ in own) + "]", [b for _, b in own]
    text, means = literal(rng, depth - 1)
    return text, means


def literal(rng, depth):
    keys = rng.sample(["a", "b2", "some_key", "'quoted key'", '"d"', "e"], rng.randrange(5))
    own = [(k, *made(rng, depth)) for k in keys]
    return "{" + ",".join(f" {k} : {v}" for k, v, _ in own) + "}", {k.strip("'\""): m for k, _, m in own}


def test_nested_literals_equal_what_they_were_made_of(spark):
    rng = random.Random(9)
    cases = [literal(rng, 3) for _ in range(300)]
    for (text, means), got in zip(cases, parsed(spark, [c[0] for c in cases]), strict=True):
        assert set(got) == set(means), text
        for k, want in means.items():
            if isinstance(want, (dict, list)):
                assert json.loads(got[k]) == want, text
            else:
                assert got[k] == (want if isinstance(want, str) else json.dumps(want)), text


def test_odd_literals(spark):
    odd = [None, "", "x", "{}", "{a: 1, a: 2}", "{a: {b: 1}}", "{a: 1", "{a: [1}", "{a: 1} {b: 2}", "{a, b: 1, : 3, c:}", "{url: http://x.org/y, at: 10:30}", "  {a: 1}  ", "{a: {}, b: []}", "{it: don't, k: 1}"]
    got = parsed(spark, odd)
    assert got[:4] == [None, None, None, {}] and got[4] == {"a": "2"} and got[5] == {"a": '{"b":1}'}
    assert got[6] is None and got[8] is None and got[9] == {"b": "1"} and got[10] == {"url": "http://x.org/y", "at": "10:30"}
    assert got[11] == {"a": "1"} and got[12] == {"a": "{}", "b": "[]"} and got[13] == {"it": "don't", "k": "1"}


def test_very_long_literal(spark):
    text = "{" + ", ".join(f"k{i}: {{v: {i}}}" for i in range(400)) + "}"
    (got,) = parsed(spark, [text])
    assert len(got) == 400 and got["k399"] == '{"v":399}'
