"""Conversation trie, phrases and token files against brute force and the tokenizer's library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import conversation_trie as trie
from graphloom.llm import phrases, token_files, words
from graphloom.llm.conversation_trie import conversation_trie, prefix_trie
from graphloom.llm.phrases import mine_phrases
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.token_files import WordIds, encode_texts, new_folder, read_tokens, tokenizer, write_tokens

VOCABULARY = tokenizer_path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# conversations


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = tuple(own.get(head, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        worth = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += not kids[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, a string, owner long, n long"


def conversation_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 3, 4) for r in rows], CONVERSATIONS)


def found_trie(spark, rows):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in columns) for r in conversation_trie(conversation_rows(spark, rows)).collect())


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 3)
    draw = random.Random(3)
    rows = []
    for c in [*range(-21, 25), 40, 41, 43, 61, 10**12 + 7]:
        for t in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, draw.choice([t, t, None, 2]), draw.choice(["user", "assistant", None]), draw.choice(["", None, "yes", "no way", "a b c", "naïve ☃ text"])))
    rows += rows[:5] + [(None, 1, "user", "lost")]
    rows += [(7, 100 + i, "user", f"turn {i % 4}") for i in range(40)]
    assert found_trie(spark, rows) == brute_trie(rows)


def test_trie_of_growing_logs(spark):
    """Chains that hang on one another, as deep as there are conversations."""
    turns = [("user", f"line {i} of it") for i in range(12)]
    rows = [(20 * c, i, *turns[i]) for c in range(12) for i in range(c + 1)]
    rows += [(20 * c + 1000, i, *turns[i]) for c in range(6) for i in range(4)]
    rows += [(20 * c + 1001, 1, "user", "only one of its own") for c in range(3)]
    assert found_trie(spark, rows) == brute_trie(rows)


def test_trie_of_little(spark):
    assert conversation_trie(conversation_rows(spark, [])).collect() == []
    assert found_trie(spark, [(None, 1, "user", "x")]) == []
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 1, "user", "goes with the rebuild")]
    assert found_trie(spark, rows) == brute_trie(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_trie_general_interface(spark):
    turns = spark.createDataFrame([(1, 1, "k", 2), (2, 1, "k", 2), (2, 2, "l", 5)], "conv_id long, pos long, key string, words long")
    convs = spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "conv_id long, length long")
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie(turns, convs).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 2)}
    assert got[1, 1]["saved_tokens"] == 2 and got[1, 0]["n_leaves"] == 1 and got[2, 2]["parent_conv_id"] == 1


# phrases


def brute_phrases(rows, longest, least, share, top):
    """rows: (text, lang)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for i in range(len(ws)):
                for m in range(1, longest + 1):
                    if i + m <= len(ws):
                        f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in good.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


DOCUMENTS = "doc_id long, text string, lang string, words int, n long, phrase string"


def document_rows(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "z") for i, (t, lang) in enumerate(rows)], DOCUMENTS)


@pytest.mark.parametrize(("range_bytes", "chunk", "portion"), [(1 << 20, 1 << 20, 1 << 20), (700, 37, 300), (200, 11, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, range_bytes, chunk, portion):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "SAMPLE_STEP", 3)
    monkeypatch.setattr(words.portions, "__defaults__", (portion,))
    draw = random.Random(9)
    common = ["the", "The", "of", "x" * 30, "né", "ß☃", "a\x00b", "-", "\x1f"]
    rows = []
    for i in range(120):
        ws = [draw.choice(common + [f"w{draw.randint(0, 60)}"]) for _ in range(draw.randint(0, 40))]
        rows.append(("".join(w + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for w in ws), draw.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [("the of the of the of " * 30, "en")] * 4 + [("a rare but repeated line of text\n" * 3, "de")] * 6 + [(None, "en"), ("", None), (".,;", "en"), (" ", "xx"), ("word", "xx")]
    got = mine_phrases(document_rows(spark, rows).repartition(3), longest=5, least=6, share=100, top=50, range_bytes=range_bytes)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 5, 6, 100, 50)


def test_phrases_share_and_length(spark):
    rows = [("one two three", "en")] * 9 + [("one two", "en")] * 2
    got = mine_phrases(document_rows(spark, rows), longest=3, least=2, share=80, top=10)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 3, 2, 80, 10)
    assert mine_phrases(document_rows(spark, []), least=1).collect() == []


def test_phrase_ranges_split_hot_words(spark):
    """All suffixes begin with one word; ranges cut it by the words after it."""
    rows = [(f"hot {i % 97} {i % 89} cold", "en") for i in range(400)]
    cuts = phrases.borders(document_rows(spark, rows).select("text", "lang"), 5, 500)
    assert len([c for c in cuts if c[1][0] == b"hot"]) >= 3


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", "", 0, 9 * 10**15), ("en", "x", 1, 3 * 10**14), ("en", "y", 1, 10**14 + 1), ("en", "x y", 2, 10**14)], "lang string, phrase string, words int, n long")
    (row,) = phrases.phrase_scores(counts).collect()
    assert row["score"] == 1000 * 10**14 * 9 * 10**15 // (3 * 10**14 * (10**14 + 1))


# token files

ODD = ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "I'll don't WE'VE 's", "naïve Ünïcode ΣΑΣ ΟΔΟΣ", "日本語 テキスト 🙂🙂", "é ́x", "tab\tnew\nline\r\x0b\x0c", "1234 5 6.7%", "\x1c\x1d a b　c d", "x" * 3000, "İstanbul ǅ ﬁ", "</w> a</w>", "\x00 \x7f"]


def library_ids(text):
    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_round_trip(spark):
    draw = random.Random(4)
    alphabet = " \n\tabcABCé'’s.0123日Σς́<|endoftext|> "
    rows = [(i, t) for i, t in enumerate([*ODD, *("".join(draw.choices(alphabet, k=draw.randint(0, 80))) for _ in range(300)), None, "long text " * 20000])]
    rows += [(3, "a second row of 3"), (3, "a second row of 3"), (None, "no id"), (None, None), (-5, "below")]
    docs = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], "doc_id long, text string, start int, part int, name string").repartition(5)
    path = new_folder(spark)
    manifest = write_tokens(docs, path, VOCABULARY, end_id=2, part_bytes=20_000)
    assert {r["bits"] for r in manifest.collect()} == {16} and manifest.count() > 4
    got = read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sum(r["n_ids"] for r in manifest.collect()) == at
    again = {(r["doc_id"], r["start"]): r["ids"] for r in read_tokens(spark, path).collect()}
    assert again == {(r["doc_id"], r["start"]): r["ids"] for r in got}


def test_token_files_of_an_empty_table(spark):
    path = new_folder(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert write_tokens(docs, path, VOCABULARY, end_id=2).collect() == []
    assert read_tokens(spark, path).collect() == []


def test_word_ids_are_bounded_and_right():
    library = tokenizer(VOCABULARY)
    known = WordIds(lambda ws: [e.ids for e in library.encode_batch(ws, add_special_tokens=False)], most=50)
    for i in range(40):
        texts = [f"qzx{i} the {'y' * 200} w{i % 7}" for _ in range(3)] + ["", f"{i}"]
        ((ids, ends),) = encode_texts(pa.array(texts), known, 2)
        assert ids.tolist() == [x for t in texts for x in library_ids(t)]
        assert ends.tolist() == np.cumsum([len(library_ids(t)) for t in texts]).tolist()
        assert len(known) < 60 and len(known.pool) < 1000
    assert len(known)


def test_word_ids_of_texts_cut_in_portions(monkeypatch):
    library = tokenizer(VOCABULARY)
    known = WordIds(lambda ws: [e.ids for e in library.encode_batch(ws, add_special_tokens=False)])
    monkeypatch.setattr(token_files, "TOGETHER", 12)
    texts = ["", "a text that is cut into portions of a few words", "", "", "b", "x" * 40 + " and more of it", ""]
    at, ends, ids = 0, [], []
    for some, where in encode_texts(pa.array(texts), known, 2):
        ids += some.tolist()
        ends += (at + where).tolist()
        at += len(some)
    assert ids == [x for t in texts for x in library_ids(t)]
    assert ends == np.cumsum([len(library_ids(t)) for t in texts]).tolist()


def test_token_ids_of_a_large_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(token_files, "token_type", lambda path: np.dtype("<u4"))
    path = new_folder(spark)
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert {r["bits"] for r in write_tokens(docs, path, VOCABULARY, end_id=70000).collect()} == {32}


def test_portions_cut_long_texts_at_separators():
    texts = pa.array(["", "aa bb cc", "", "x" * 50 + " y", "z z"])
    cuts = words.marks(b" ")
    seen = [(int(r), bytes(p.data[a:b])) for p in words.portions(texts, cuts, 10) for r, a, b in zip(p.rows, p.starts[:-1], p.starts[1:], strict=True)]
    joined = defaultdict(bytes)
    for r, part in seen:
        joined[r] += part
    assert [joined[i].decode() for i in range(5)] == texts.to_pylist()
    assert all(b" " in part or len(part) <= 50 for _, part in seen)
