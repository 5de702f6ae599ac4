"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for
each piece; a word's probability is the sum over all ways to cut it into pieces, found
by a forward pass, and a text's is the product over its words. Piece probabilities are
fitted by expectation maximisation (forward and backward passes over word counts):
each round is a Spark job that returns expected counts by language and piece, a table
bounded by the vocabulary and the number of languages.

The fit uses at most ``per_lang`` labelled documents of each language, those with the
smallest hashes; everything is scored. Words are maximal runs of letters of the
lower-cased text; those longer than ``WORD_CHARS`` are scored in parts of that length,
all of them.

Defined results: a null text, or one without letters, is ``und`` with score 0. Where
no labelled document exists every text is ``und``. Ties go to the first language by
code point. A null doc_id is neither learned from nor held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SLICE_TEXTS, give_back, saved, ship, whole_row
from graphloom.llm.token_counts import processor

UNKNOWN = "und"
#: Documents of each language that the fit reads, and its rounds.
PER_LANG, ROUNDS = 400, 3
#: Longest part of a word scored at once, words a worker keeps, letters scored at once (words times the longest).
WORD_CHARS, CACHE_WORDS, CHUNK_LETTERS = 40, 300_000, 64_000
#: Added to each piece's count; probability of a character that no piece covers.
SMOOTHING, FLOOR = 0.05, 1e-8
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(42)


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


class Pieces:
    """The vocabulary's pieces, found in many words at once by rolling hashes."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(x) for x in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> _SHIFT).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c)) * int(_BASE)) % 2**64
        return h

    @classmethod
    def of_model(cls, path: str) -> Pieces:
        """Pieces of letters, lower-cased, with or without the word start."""
        p = processor(path)
        found = {p.id_to_piece(i).lower() for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
        return cls(sorted(x for x in found if x.removeprefix(_START).isalpha() or x == _START))

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """word, start, end, piece of every place where a piece fits, by end; and lengths."""
        text = [_START + w for w in words]
        size = np.fromiter(map(len, text), np.int64, len(text))
        width = int(size.max(initial=1))
        codes = np.zeros((len(text), width), np.uint64)
        inside = np.arange(width)[None, :] < size[:, None]
        codes[inside] = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        out = []
        h = np.zeros_like(codes)
        for k in range(1, min(self.longest, width) + 1):
            n = width - k + 1
            h = (h[:, :n] + codes[:, k - 1 :]) * _BASE
            row, col = np.nonzero(self.maybe[(h >> _SHIFT).astype(np.int64)] & inside[:, k - 1 :])
            value = h[row, col]
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            hit = self.keys[at] == value
            out.append((row[hit], col[hit], col[hit] + k, self.ids[at[hit]]))
        word, start, end, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(end, kind="stable")
        return word[order], start[order], end[order], piece[order], size


def forward(edges: tuple[np.ndarray, ...], table: np.ndarray) -> np.ndarray:
    """Sums over segmentations: words x (longest + 1) x languages. ``table``: pieces x languages."""
    word, start, end, piece, size = edges
    width = int(size.max(initial=1))
    alpha = np.zeros((len(size), width + 1, table.shape[1]))
    alpha[:, 0] = 1
    cut = np.searchsorted(end, np.arange(1, width + 2))
    for j in range(1, width + 1):
        a, b = cut[j - 1], cut[j]
        w = word[a:b]
        gain = alpha[w, start[a:b]] * table[piece[a:b]]
        for lang in range(table.shape[1]):
            alpha[:, j, lang] = np.bincount(w, gain[:, lang], len(size))
        alpha[:, j] += FLOOR * alpha[:, j - 1]
    return alpha


def parts_of(words: list[str]) -> tuple[list[str], list[int]]:
    """The words in parts of at most WORD_CHARS letters, and the word of each part."""
    parts, owner = [], []
    for i, w in enumerate(words):
        for at in range(0, len(w), WORD_CHARS):
            parts.append(w[at : at + WORD_CHARS])
            owner.append(i)
    return parts, owner


def chunks_of(parts: list[str]) -> Iterator[list[int]]:
    """Numbers of the parts by length, in chunks that are as many times their longest as CHUNK_LETTERS allow."""
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]), reverse=True)
    at = 0
    while at < len(order):
        some = order[at : at + max(1, CHUNK_LETTERS // (len(parts[order[at]]) + 1))]
        yield some
        at += len(some)


def word_scores(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log-probability of each word in each language."""
    parts, owner = parts_of(words)
    out = np.zeros((len(words), table.shape[1]))
    for some in chunks_of(parts):
        edges = pieces.edges([parts[i] for i in some])
        alpha = forward(edges, table)
        np.add.at(out, np.array([owner[i] for i in some]), np.log(alpha[np.arange(len(some)), edges[4]]))
    return out


def expected_counts(pieces: Pieces, table: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece under a one-language table (pieces x 1)."""
    out = np.zeros(len(pieces.pieces))
    words, owner = parts_of(words)
    counts = counts[np.array(owner, np.int64)]
    for some in chunks_of(words):
        word, start, end, piece, size = edges = pieces.edges([words[i] for i in some])
        alpha = forward(edges, table)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(some)), size] = 1
        cut = np.searchsorted(end, np.arange(1, alpha.shape[1] + 1))
        # backward: all pieces that end at j, from the last j to the first
        for j in range(alpha.shape[1] - 1, 0, -1):
            a, b = cut[j - 1], cut[j] if j < len(cut) else len(end)
            np.add.at(beta, (word[a:b], start[a:b]), table[piece[a:b], 0] * beta[word[a:b], j])
            beta[:, j - 1] += FLOOR * beta[:, j]
        whole = alpha[np.arange(len(some)), size]
        use = alpha[word, start] * table[piece, 0] * beta[word, end] / whole[word] * counts[np.array(some)][word]
        out += np.bincount(piece, use, len(out))
    return out


@dataclass
class LanguageModel:
    """Languages in order, the vocabulary file and log-free piece probabilities."""

    langs: list[str]
    path: str
    table: np.ndarray


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string")) % mod


def training_words(docs: DataFrame, per_lang: int) -> DataFrame:
    """lang, word, n over the documents of the fit."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    # the window sees ids only, and keeps at most per_lang of a language in each task before it shuffles
    picked = rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.lit("fit")).alias("_h")).withColumn("_p", place).where(F.col("_p") <= per_lang).select("doc_id").distinct()
    chosen = rows.join(picked, "doc_id", "left_semi").select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = Counter(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    return chosen.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, model_path: str, per_lang: int = PER_LANG, rounds: int = ROUNDS) -> LanguageModel:
    """Learn from rows of docs with a lang; leave out beforehand what must not be seen."""
    spark = docs.sparkSession
    ship(spark)
    words = saved(training_words(docs, per_lang), "langid-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = Pieces.of_model(model_path)
    table = np.full((len(pieces.pieces), len(langs)), 1 / len(pieces.pieces))
    for _ in range(rounds if langs else 0):
        now = spark.sparkContext.broadcast((langs, table))

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            names, probabilities = now.value
            own, seen = Pieces.of_model(model_path), {x: ([], []) for x in names}
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    seen[lang][0].append(word)
                    seen[lang][1].append(n)
            for i, lang in enumerate(names):
                if seen[lang][0]:
                    c = expected_counts(own, probabilities[:, i : i + 1], seen[lang][0], np.array(seen[lang][1], float))
                    used = np.nonzero(c)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used])], ["lang", "piece", "n"])

        rows = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        table = np.full(table.shape, SMOOTHING)
        for r in rows:
            table[r["piece"], r["lang"]] += r["n"]
        table /= table.sum(axis=0)
    return LanguageModel(langs, model_path, table)


class Scorer:
    """Scores texts, keeping the words it has scored."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.pieces = model, Pieces.of_model(model.path)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((CACHE_WORDS, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > CACHE_WORDS:
            self.rows, new = {}, list(words)
        if len(new) > len(self.scores):  # one text of more words than are kept
            self.scores = np.zeros((len(new), len(self.model.langs)))
        if new:
            n = len(self.rows)
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
            self.scores[n : n + len(new)] = word_scores(self.pieces, self.model.table, new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(words_of(text))
            size += len(group[-1])
            if size > CACHE_WORDS // 4:
                out.extend(self._predict(group))
                group, size = [], 0
        return out + self._predict(group)

    def _predict(self, group: list[list[str]]) -> list[tuple[str, float]]:
        self.learn(set().union(*group))
        out = []
        for words in group:
            if not words or not self.model.langs:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.scores[list(map(self.rows.__getitem__, words))].sum(axis=0)
            p = np.exp(total - total.max())
            best = int(p.argmax())
            out.append((self.model.langs[best], float(p[best] / p.sum())))
        return out


def predictor(model: LanguageModel):
    """A function of text columns that returns struct<lang_pred, score>; score is the
    posterior probability of the predicted language."""
    spark = SparkSession.active()
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)  # a task's own: workers that go on to other work don't hold its words
        for batch in texts:
            found = [x for at in range(0, len(batch), SLICE_TEXTS) for x in scorer.predict(batch.slice(at, SLICE_TEXTS).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([lang for lang, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["lang_pred", "score"])
        del scorer
        give_back()

    return lambda text: run(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, the other columns of docs, lang_pred and score; columns of those two names are replaced."""
    found = docs.drop("lang_pred", "score").withColumn("_found", predictor(model)(F.col("text")))
    return found.select(*[c for c in found.columns if c != "_found"], "_found.lang_pred", "_found.score")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The rows of docs with a language more likely than all others together, with all their columns. Repeated rows fare
    alike; a null text, or one without letters, goes."""
    found = docs.select(whole_row(docs).alias("row"), predictor(model)(F.col("text")).alias("found"))
    return found.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= min_score)).select("row.*")
