"""Stages of the pipeline leave columns of any name alone; sums of windows lose no digits."""

import glob
import os
import random
import re

import numpy as np
import pytest

from graphloom.llm.decontaminate import window_sums

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def internal_names():
    """Every name in quotes that begins with an underscore, and the plain ones that stages use beside a row."""
    names = set()
    for path in glob.glob(os.path.join(ROOT, "graphloom", "llm", "*.py")):
        with open(path, encoding="utf-8") as source:
            names |= set(re.findall(r"[\"'](_[a-z0-9_]+)[\"']", source.read()))
    return sorted(names | {"_gone", "_found", "_leaks", "_d", "_t", "_text", "row", "found", "leaks", "hit", "kept", "range", "a.b", "Row x"})


def documents(spark, names):
    draw = random.Random(12)
    common = "the of and to in that is was for it with as his on be at by had not are but from or have an they which".split()
    rows = []
    for i in range(40):
        words = " ".join(draw.choice([*common, f"thing{draw.randint(0, 400)}"]) for _ in range(60))
        rows.append((i, f"{words}\na line that every document shares with the others\n{words[::2]}", "en", f"s{i % 3}"))
    rows += [rows[4], (90, None, "en", "s0"), (91, "", "en", None), (None, "a text without an id but with words of its own", "en", "s1")]
    extra = [f"own {n}" for n in names]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], schema)


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_leave_other_columns_alone(spark, stage, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a passage of a benchmark that no document of this test holds at all, by any means"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = internal_names()
    docs = documents(spark, names)
    found = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert found.columns[: len(docs.columns)] == docs.columns
    rows = found.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
    assert stage == 4 or {r["doc_id"] for r in rows} >= {i for i in range(5, 20)}  # the mix draws


def test_window_sums_keep_small_windows():
    values = np.array([1e-18, 2e-18, 1e9, 3.0, 1e-18, 0.0])
    begin, end = np.array([0, 1, 2, 4, 4]), np.array([2, 3, 4, 5, 6])
    assert np.allclose(window_sums(values, begin, end), [3e-18, 1e9, 1e9 + 3, 1e-18, 1e-18], rtol=1e-12, atol=0)
    assert len(window_sums(values, begin[:0], end[:0])) == 0
