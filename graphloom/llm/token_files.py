"""Token ids as flat binary files with 64-bit document offsets.

A dataset is a folder of parts, in ascending order of doc_id over parts and within them:

* ``<part>.ids``: the ids of its documents one after another, unsigned little-endian
  integers of 16 bits if the vocabulary fits, else of 32;
* ``<part>.offsets``: unsigned 64-bit integers, one more than documents: where each
  document starts in the part, counted in ids;
* ``<part>.docs``: signed 64-bit doc_ids (and ``<part>.nulls``, a byte each, 1 for null);
* ``manifest``, a Parquet table that Spark writes: one row for each part with its files'
  name, its counts and its bases, the ids and documents of all parts before it.

Texts are dealt by ranges of doc_id (hash of the text within one id, so that rows which
share an id, or have none, are split too) and sorted there. A task writes its files under
a name of its own and returns one row that names them; the rows that Spark commits are the
parts, whatever attempts were lost or ran twice. The bases are prefix sums over those rows.
Readers map the files of a part into memory where they are local to the mount, and read
them through pyarrow's file systems elsewhere.

Defined results: a null text counts as empty, so such a document holds the end id alone;
null ids come first; rows with one id stand next to each other, ordered by hash and text,
each with a range of its own; an empty table gives a manifest without rows. Very long
texts are cut at white space while they are encoded, which changes no id. Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, new_path, ship
from graphloom.llm.words import marks, portions, split_words

#: Words whose ids a worker keeps, and the longest kept (bytes).
CACHE_WORDS = 1_000_000
CACHE_BYTES = 64
#: Bytes of text that are encoded together.
TOGETHER = 8 << 20
#: Bytes of ids that a reader gives on at once.
READ_BYTES = 8 << 20
_BLANK = marks(SPACES.encode())
_NONE = marks(b"")
_PART = "part int, name string, n_docs long, n_ids long"
_tokenizers: dict[str, object] = {}
_known: dict[str, WordIds] = {}


class WordIds:
    """Ids of words: the library's answers, kept in flat arrays and found by 128-bit hashes of the words.
    White space is dropped by this vocabulary's normaliser and no token spans it, so the ids of a
    text are those of its words one after another."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = CACHE_WORDS) -> None:
        self.encode, self.most = encode, most
        self.keep(np.zeros(0, dtype=bool))

    def __len__(self) -> int:
        return len(self.low)

    def keep(self, which: np.ndarray) -> None:
        """Forget all words but some. Words stand in the order of the lower half of their hashes."""
        if not len(which):
            self.low, self.high = np.zeros((2, 0), dtype=np.uint64)
            self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
            self.hit, self.pool = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint32)
            return
        counts = self.counts[which]
        self.pool = self.pool[spans(self.starts[which], counts)]
        self.low, self.high, self.counts, self.starts = self.low[which], self.high[which], counts, np.cumsum(counts) - counts
        self.hit = np.zeros(len(counts), dtype=bool)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, and how many each word has."""
        if not len(words):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        low, high = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), dtype=np.uint64).reshape(-1, 2).T
        starts, counts = np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int32)
        known = np.zeros(len(low), dtype=bool)
        if len(self):
            at = np.minimum(np.searchsorted(self.low, low), len(self) - 1)
            known = (self.low[at] == low) & (self.high[at] == high)
            at = at[known]
            starts[known], counts[known], self.hit[at] = self.starts[at], self.counts[at], True
        missing = np.flatnonzero(~known)
        answers = self.encode(coded.dictionary.take(pa.array(missing)).cast(pa.string()).to_pylist())
        counts[missing] = n = np.fromiter(map(len, answers), np.int32, len(answers))
        starts[missing] = len(self.pool) + np.cumsum(n) - n
        pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(answers), np.uint32, int(n.sum()))))
        codes = coded.indices.to_numpy()
        n = counts[codes]
        found = pool[spans(starts[codes], n)]
        self.learn(low[missing], high[missing], starts[missing], counts[missing], np.array([len(distinct[i]) <= CACHE_BYTES for i in missing], dtype=bool), pool)
        return found, n

    def learn(self, low: np.ndarray, high: np.ndarray, starts: np.ndarray, counts: np.ndarray, short: np.ndarray, pool: np.ndarray) -> None:
        """Keep new words, one for each lower half. If they are too many, those met again since the last time stay."""
        order = np.argsort(low, kind="stable")
        order = order[short[order]]
        new = low[order]
        fresh = np.ones(len(new), dtype=bool)
        fresh[1:] = new[1:] != new[:-1]
        if len(self):
            fresh &= self.low[np.minimum(np.searchsorted(self.low, new), len(self) - 1)] != new
        order = order[fresh]
        merged = np.argsort(np.concatenate((self.low, low[order])), kind="stable")
        self.low, self.high, self.starts, self.counts, self.hit = (
            np.concatenate((a, b))[merged] for a, b in ((self.low, low[order]), (self.high, high[order]), (self.starts, starts[order]), (self.counts, counts[order]), (self.hit, np.zeros(len(order), dtype=bool)))
        )
        self.pool = pool
        if len(self) > self.most or len(pool) > 8 * self.most:
            self.keep(self.hit if 2 * self.hit.sum() <= self.most else np.zeros(0, dtype=bool))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans, one span after another."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def tokenizer(path: str):
    """The library's tokenizer for a file, once per worker, on one core."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def word_ids(path: str) -> WordIds:
    if path not in _known:
        library = tokenizer(path)
        _known[path] = WordIds(lambda words: [e.ids for e in library.encode_batch(words, add_special_tokens=False)])
    return _known[path]


def encode_texts(texts: pa.Array, known: WordIds, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of the ids of the texts, each text followed by the end id, and where in the stretch texts end."""
    for portion in portions(texts, _BLANK, TOGETHER):
        found = split_words(portion, _BLANK, _NONE, lower=False)
        ids, n = known.ids(found.words)
        closed = len(portion.rows) - (not portion.ends)
        ends = np.cumsum(np.bincount(found.part, weights=n, minlength=len(portion.rows)).astype(np.int64)[:closed] + 1)
        out = np.full(len(ids) + closed, end_id, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[ends - 1] = False
        out[inside] = ids
        yield out, ends


def token_type(path: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, part_bytes: int = 32 << 20) -> DataFrame:
    """Encode ``docs`` and write them below ``path`` (a folder that all executors share); returns
    the manifest. Parts hold about ``part_bytes`` of text."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    mixed = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), mixed).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), mixed, "text")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_docs, n_ids, name, files = 0, 0, 0, uuid.uuid4().hex, {}
        system, folder = pafs.FileSystem.from_uri(path)
        kind, known = token_type(tokenizer_path), word_ids(tokenizer_path)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not files:
                    part = batch.column(0)[0].as_py()
                    system.create_dir(folder, recursive=True)
                    files = {x: system.open_output_stream(f"{folder}/{name}.{x}") for x in ("ids", "offsets", "docs", "nulls")}
                    files["offsets"].write(np.zeros(1, dtype="<u8").tobytes())
                doc_ids = batch.column(1)
                for ids, ends in encode_texts(batch.column(2), known, end_id):
                    files["ids"].write(ids.astype(kind).tobytes())
                    files["offsets"].write((n_ids + ends).astype("<u8").tobytes())
                    n_ids += len(ids)
                files["docs"].write(doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes())
                files["nulls"].write(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                n_docs += batch.num_rows
        finally:
            for file in files.values():
                file.close()
        if files:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_ids": n_ids}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    staged = f"{path}/staged"
    dealt.mapInArrow(write, _PART).write.parquet(staged)
    committed = spark.read.schema(_PART).parquet(staged)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    zero = F.lit(0).cast("long")
    based = committed.select("*", F.coalesce(F.sum("n_docs").over(before), zero).alias("base_docs"), F.coalesce(F.sum("n_ids").over(before), zero).alias("base_ids"))
    based.withColumn("bits", F.lit(token_type(tokenizer_path).itemsize * 8)).coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def mapped(system: pafs.FileSystem, file: str, kind: str) -> np.ndarray:
    """The integers of a file: mapped into memory if it is on this machine's mounts."""
    if not system.get_file_info(file).size:
        return np.zeros(0, dtype=kind)
    if isinstance(system, pafs.LocalFileSystem):
        return np.memmap(file, dtype=kind, mode="r")
    with system.open_input_file(file) as source:
        return np.frombuffer(source.read_buffer(), dtype=kind)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary: little-endian
    unsigned 32-bit integers) of each document, from the files; a task for each part."""
    ship(spark)
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "name", "base_ids", "bits")
    parts = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(system, f"{folder}/{row['name']}.ids", f"<u{row['bits'] // 8}")
                offsets = mapped(system, f"{folder}/{row['name']}.offsets", "<u8").astype(np.int64)
                docs = mapped(system, f"{folder}/{row['name']}.docs", "<i8")
                nulls = mapped(system, f"{folder}/{row['name']}.nulls", "u1")
                a = 0
                while a < len(docs):
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ_BYTES // 4, side="right")) - 1)
                    ends = (offsets[a : b + 1] - offsets[a]) * 4
                    data = pa.py_buffer(ids[offsets[a] : offsets[b]].astype("<u4"))
                    if ends[-1] < 1 << 31:
                        values = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), data])
                    else:
                        raise ValueError(f"document {docs[a]} has {ends[-1]} bytes of ids, more than a row can hold")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a:b], mask=nulls[a:b].astype(bool)), pa.array(row["base_ids"] + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), values],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    a = b

    return manifest.repartitionByRange(max(1, parts), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A new folder for a dataset in the shared folder, as a URI."""
    path = new_path(spark, "tokens")
    return path if "://" in path else f"file://{path}"
