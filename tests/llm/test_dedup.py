"""Line, substring and near dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash
from graphloom.llm.line_dedup import dedup_lines, drop_repeated_lines
from graphloom.llm.simhash import block_masks, cell_links, components, distances, fingerprint, near_dedup, near_duplicates, pivots, shared_blocks
from graphloom.llm.substring_dedup import dedup_substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 2) for i, t in rows], SCHEMA)


def corpus(seed, n=60, vocabulary=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(draw.choices(words, k=70))
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(words, k=draw.randint(0, 120)))
        if i % 3 == 0:
            text = f"{text} {passage}\n{text[:30]}"
        if i % 5 == 0 and rows:
            text = rows[-1][1] or ""
        rows.append((i, text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "a " * 90), (n + 4, "a " * 90), (None, rows[0][1]), (3, rows[3][1]), (n + 5, passage)]


def test_substring_matches_brute_force(spark):
    rows = corpus(1)
    length = 12
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    want = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        want.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    for seed_words in (4, 8):
        got = [tuple(r) for r in dedup_substrings(table(spark, rows), length, seed_words).select("doc_id", "n_words", "n_removed", "kept").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_substring_empty_table(spark):
    assert dedup_substrings(table(spark, []), 12).collect() == []


def line_brute_force(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: 2**63 - 1 if d is None else d
    docs = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(docs[key(x)]) > 1 and order(d) > min(docs[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_match_brute_force(spark):
    rows = [(0, "Hello there friend\nshort\nonly here, really"), (1, "  hello THERE friend \nshort\nhello there friend"), (2, None), (3, ""), (4, "ÉTÉ lines keep case\n\n"), (5, "été lines keep case"), (None, "hello there friend\nx"), (None, "hello there friend\ny"), (1, "  hello THERE friend \nshort\nhello there friend"), (7, "only here, really\n" * 3)]
    got = [tuple(r) for r in dedup_lines(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(line_brute_force(rows), key=repr)
    assert dedup_lines(table(spark, [])).collect() == []


def test_lines_threshold_of_documents(spark):
    rows = [(0, "a line in three"), (1, "a line in three\na line in two"), (2, "a line in three\na line in two")]
    got = {r["doc_id"]: r["kept"] for r in dedup_lines(table(spark, rows), min_docs=3).collect()}
    assert got == {0: "a line in three", 1: "a line in two", 2: "a line in two"}


def test_drop_repeated_lines_keeps_columns_and_clean_rows(spark):
    docs = table(spark, [(0, "some words of a line\nok"), (1, "some words of a line\nok"), (2, "some words of a line\n" + "own words " * 9), (3, "clean")])
    out = drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "some words of a line\nok", 2: "own words " * 9, 3: "clean"}


def test_drop_repeated_lines_keeps_what_is_left_of_its_own(spark):
    licence = "\n".join(f"line {i} of a long licence that many documents share" for i in range(40))
    docs = table(spark, [(0, licence + "\nend"), (1, licence + "\na line of its own"), (2, licence + "\nown"), (3, licence + "\n end\n\t"), (4, licence + "\nend\nx"), (4, licence + "\nend\nx")])
    out = sorted((r["doc_id"], r["text"]) for r in drop_repeated_lines(docs).collect())
    assert out == [(0, licence + "\nend"), (1, "a line of its own"), (2, "own"), (4, "end\nx"), (4, "end\nx")]


def simhash_brute_force(text, words):
    parts = [w for w in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not parts:
        return 0
    shingles = [" ".join(parts)] if len(parts) < words else [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_matches_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(40):
        base = [f"w{draw.randint(0, 900)}" for _ in range(200)]
        for j in range(3):
            copy = list(base)
            for _ in range(j):
                copy[draw.randrange(200)] = "CHANGED"
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, "A b"), (4, "a B"), (None, rows[0][1]), (500, rows[0][1]), (None, "nothing like it"), (10, rows[0][1])]
    prints = [simhash_brute_force(t, 4) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)
    got = sorted((tuple(r) for r in near_duplicates(table(spark, rows), 4, 4).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want
    assert near_duplicates(table(spark, []), 4, 4).collect() == []


def test_simhash_with_crowded_keys(spark, monkeypatch):
    """Lists over many cells: every pair that shares a key is compared or already linked."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 6)
    draw = random.Random(8)
    base = [f"w{draw.randint(0, 900)}" for _ in range(400)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(i % 12):
            copy[draw.randrange(400)] = f"x{draw.random()}"
        rows.append((i, " ".join(copy)))
    prints = [int(fingerprint(t, 4).hex(), 16) for _, t in rows]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, rows), 4, 4).collect()}
    assert got == least_of_components(120, near)
    assert len(set(prints)) > 12


def least_of_components(n, linked):
    """The smallest number of the component of each of n things."""
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label))


def test_cells_find_all_links_of_dense_groups():
    draw = np.random.default_rng(3)
    fps = draw.integers(0, 2**63, (300, 1)).astype(np.uint64)
    fps[100:] = fps[0] ^ (np.uint64(1) << draw.integers(0, 64, 200).astype(np.uint64))[:, None]
    label = cell_links(fps, 4, pivots(1))
    near = distances(fps[:, None, :], fps[None, :, :]) <= 4
    for i in range(300):
        assert (label[near[i]] == label[i]).all()
    assert len(set(label)) == 100
    assert len(block_masks(4, 2)) == 15 and len(block_masks(4, 3)) == 35


def test_block_keys_grow_with_the_classes_and_lose_no_link():
    assert shared_blocks(10**6, 4) == 2 and shared_blocks(10**9, 4) == 3 and shared_blocks(10**11, 4) == 4
    draw = random.Random(2)
    for shared in (2, 3, 4):
        masks = block_masks(4, shared)
        for _ in range(300):
            a = draw.getrandbits(64)
            b = a
            for at in draw.sample(range(64), 4):
                b ^= 1 << at
            assert ((np.uint64(a) & masks) == (np.uint64(b) & masks)).any()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {(r["node"], r["label"]) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def jaccard(a, b, words=5):
    def shingles(text):
        parts = (text or "").lower().split()
        return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def near_copies(draw, groups=100):
    """Texts and copies with words replaced, of many lengths and similarities."""
    rows = []
    for _ in range(groups):
        base = [f"w{draw.randint(0, 50000)}" for _ in range(draw.choice([6, 12, 40, 120, 300]))]
        copy = list(base)
        for _ in range(1 + draw.randint(0, 6) * len(base) // 150):
            copy[draw.randrange(len(copy))] = f"x{draw.random()}"
        rows += [" ".join(base), " ".join(copy)]
    return rows


@pytest.mark.parametrize("cell_rows", [1024, 5])
def test_near_dedup_matches_brute_force(spark, monkeypatch, cell_rows):
    """Groups by exact similarity. With tiny cells lists go through all levels and many cells."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    draw = random.Random(21)
    texts = near_copies(draw)
    base = [f"b{i}" for i in range(120)]
    for _ in range(60):  # a large group, some of it linked through others only
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(120)] = f"x{draw.random()}"
        texts.append(" ".join(copy))
    shared = " ".join(f"line{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"own{i}y{k}" for k in range(60)) for i in range(40)]  # a third alike is not near
    pairs = {(i, j): jaccard(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)}
    want = least_of_components(len(texts), lambda i, j: pairs[i, j] >= 0.8)
    kept = {r["doc_id"] for r in near_dedup(table(spark, list(enumerate(texts)))).collect()}
    # each group has one left, its smallest id; no key is shared with a chance below one in a million
    assert kept == set(want.values())
    assert sum(0.8 <= s < 0.9 for s in pairs.values()) > 20 and len(kept) < len(texts) - 60


def test_near_dedup_recall_at_80_and_90(spark):
    """Recall over pairs of one similarity each, against brute force."""
    draw = random.Random(33)
    for low, high, least in ((0.8, 0.84, 0.97), (0.9, 0.94, 0.99)):
        rows, pairs = [], 0
        while pairs < 150:
            base = [f"w{draw.randint(0, 50000)}" for _ in range(300)]
            copy = list(base)
            for _ in range(round(300 * (1 - low) / 9)):
                copy[draw.randrange(300)] = f"x{draw.random()}"
            if low <= jaccard(" ".join(base), " ".join(copy)) < high:
                rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(copy))]
                pairs += 1
        kept = {r["doc_id"] for r in near_dedup(table(spark, rows)).collect()}
        assert sum(2 * i + 1 not in kept for i in range(pairs)) >= least * pairs
        assert all(2 * i in kept for i in range(pairs))


def test_near_dedup_special_rows(spark):
    same = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (5, same, "x", 1), (5, same, "y", 1), (3, same.upper().replace("W", "w"), "z", 2), (None, same, "n", 3), (None, None, "n", 4), (7, "", "e", 5), (8, " \t\n", "e", 6),
        (20, long, "l", 7), (21, long + " end", "l", 8), (30, "a b", "s", 9), (31, "A\nb", "s", 10), (32, "a b c", "s", 11),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, at int")
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 20, 30, 32]
    assert near_dedup(docs.limit(0)).collect() == []
    repeated = spark.createDataFrame([(1, same, {"k": i}) for i in range(3)], "doc_id long, text string, extra map<string,int>")
    assert [r["doc_id"] for r in near_dedup(repeated).collect()] == [1]  # rows that agree in id and text are one
    assert [r["text"] for r in near_dedup(spark.createDataFrame([(None, "one text of five words here"), (None, "one text of five words here")], "doc_id long, text string")).collect()] == ["one text of five words here"]
