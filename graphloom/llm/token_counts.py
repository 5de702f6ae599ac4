"""Token counts by a two-tier lookup on the map side, without any shuffle.

In the piece vocabulary a space starts a piece and never stands inside or at the end
of one (runs of spaces apart), and no piece holds a newline, so a text's count is the
sum over its pre-tokens: strings without spaces, cut before each newline. The first
tier is a compact table of the lengths of frequent pre-tokens, the vocabulary's own
words, which is as large as the vocabulary, whatever the input, and is broadcast. The
second is a bounded cache in each Python worker, filled by the library. Texts with
runs of spaces or other forms where the cut is not safe go to the library whole.

Defined results: a null text counts as empty; an empty text has 0 bytes and 0 tokens.
One row per input row, repeated rows included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import ship

#: Pre-tokens that a worker keeps besides the frequent ones, and the longest kept.
CACHE_SIZE = 200_000
CACHE_CHARS = 64
_SPACE = "▁"

_processors: dict[str, object] = {}


def processor(path: str):
    """The library's processor for a model file, once per worker."""
    if path not in _processors:
        import sentencepiece

        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


class PretokenLengths(dict):
    """Token counts by pre-token: the frequent table, then the library's answers."""

    def __init__(self, frequent: dict[str, int], encode) -> None:
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode
        self[""] = 1  # the space put before a text that starts with a newline

    def __missing__(self, part: str) -> int:
        n = len(self.encode(part)) - (part[0] == "\n")  # a newline has no space of its own before it
        if len(part) <= CACHE_CHARS:
            if len(self) > len(self.frequent) + CACHE_SIZE:
                self.clear()
                self.update(self.frequent)
                self[""] = 1
            self[part] = n
        return n


def frequent_lengths(path: str) -> dict[str, int]:
    """Lengths of the vocabulary's words, the most frequent pre-tokens of its training text."""
    p = processor(path)
    words = [x[1:] for x in map(p.id_to_piece, range(p.get_piece_size())) if x[0] == _SPACE and x[1:] and _SPACE not in x[1:]]
    return dict(zip(words, map(len, p.encode(words)), strict=True))


def count_text(text: str, lengths: PretokenLengths) -> int:
    if not text:
        return 0
    if "  " in text or " \n" in text or text[0] == " " or text[-1] == " " or _SPACE in text:
        return len(lengths.encode(text))
    return sum(map(lengths.__getitem__, text.replace("\n", " \n").split(" ")))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(model_path))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = PretokenLengths(table.value, processor(model_path).encode)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [count_text(x, lengths) for x in texts]
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
