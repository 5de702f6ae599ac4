"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of about ``PASSAGE_WORDS`` words and weighed by
TF-IDF (IDF squared), with passage frequencies of the whole corpus. A distributed
randomised SVD of that matrix (a Spark job for each round of subspace iteration) gives
the latent space. Windows of that length, ``STRIDE`` words apart, cover each document;
a window whose words in the benchmark's vocabulary weigh too little for any passage is
passed over by exact bounds, the others are projected and compared by cosine with
all passages. Copies of a stretch of text count once in the frequencies, so that a passage
in many documents keeps its weight. Runs of ``SHINGLE_WORDS`` words of an item make a
candidate too, for items whose words weigh little. Candidates are verified around the window: the longest common subsequence
of item and document, weighed by IDF, and the share of the item's answer (its last
quarter) in it. A document holds an item if ``STRONG`` of it is there, or ``WEAK`` with
at least half of the answer, so paraphrases that keep most words are found.

The benchmark is read in blocks of about ``BLOCK_PASSAGES`` passages, by hash of the
item; what is broadcast (a block's passages and the latent rows of its words) is bounded
by that and by the longest item. The latent space of a block has a direction for each of
its passages, so that none of them falls out of it. Documents are not joined.

Defined results: null and empty texts hold nothing. Items with fewer than ``MIN_WORDS``
words, of which chance could match a part, are searched for as exact phrases; repeated items (same item_id and
text) count once. Matching ignores case and ASCII punctuation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ship, unpacked, whole_row
from graphloom.llm.substring_dedup import CHUNK_BYTES, Words, mixed

BUCKET_BITS = 18
OVERSAMPLE, ROUNDS = 16, 2
PASSAGE_WORDS, STRIDE, MIN_WORDS = 32, 8, 8
BLOCK_PASSAGES = 256
#: Cosine (and bound) for candidates; shares of an item for a hit.
CANDIDATE, STRONG, WEAK, ANSWER = 0.3, 0.75, 0.5, 0.5
#: Mean words of the stretches whose copies count once (a power of two), and how many a task remembers.
STRETCH_WORDS, SEEN_STRETCHES = 16, 500_000
#: Words in a row that make a candidate by themselves, whatever they weigh.
SHINGLE_WORDS = 5
HITS = "array<struct<item_id:long,share:double,answer:double>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("answer", pa.float64())]))
RUN_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKET_BITS)
_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def cleaned(text: str | None) -> bytes:
    """Lower-cased, with ASCII punctuation as spaces."""
    return (text or "").lower().encode().translate(_CLEAN)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SHIFT).astype(np.int64)


def chunked(texts: Iterable[str | None]) -> Iterator[Words]:
    """The words of some texts at a time, in order."""
    chunk, size = [], 0
    for x in texts:
        chunk.append(cleaned(x))
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            yield Words(chunk)
            chunk, size = [], 0
    if chunk:
        yield Words(chunk)


def stretches(words: Words) -> tuple[np.ndarray, ...]:
    """The words cut where their content says so, whatever stands around them: hash (the
    two words before included), start and end of each stretch."""
    n = len(words.hash)
    cuts = np.zeros(n + 1, bool)
    cuts[words.first] = True
    at = np.arange(max(0, n - 2))
    at = at[words.text[at] == words.text[at + 2]]
    cuts[at[words.runs(at, at + 3) & np.uint64(STRETCH_WORDS - 1) == 0] + 3] = True
    edge = np.nonzero(cuts)[0]
    start, end = edge[:-1], edge[1:]
    return words.runs(np.maximum(start - 2, words.first[words.text[start]]), end), start, end


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF by bucket over the passages of all texts: passages are so short that a word's
    occurrences are the passages it is in. Copies of a stretch of text count once, so a
    passage that many documents share does not make its own words frequent."""
    width = np.dtype("<i4").itemsize

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for words in chunked(batch.column(0).to_pylist()):
                if not len(words.hash):
                    continue
                key, start, end = stretches(words)
                key, first = np.unique(key, return_index=True)
                if len(seen) > SEEN_STRETCHES:
                    seen.clear()
                new = np.array([k not in seen for k in key.tolist()])
                seen.update(key.tolist())
                own, data = buckets(words.hash).astype("<i4").tobytes(), zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array([own[a * width : b * width] for a, b in data], pa.binary())], ["stretch", "words"])

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << BUCKET_BITS, np.int64)
        last = None  # rows are in the order of their hashes
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            new = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            last = key[-1]
            own = b"".join(batch.column(1).filter(pa.array(new)).to_pylist())
            count += np.bincount(np.frombuffer(own, "<i4"), minlength=len(count))
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used])], ["bucket", "n"])

    cuts = docs.select(F.col("text").cast("string")).mapInArrow(cut_up, "stretch long, words binary")
    once = cuts.repartition("stretch").sortWithinPartitions("stretch")
    rows = once.mapInArrow(count_up, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(1 << BUCKET_BITS)
    count[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.log((count.sum() / PASSAGE_WORDS + 2) / (count + 1)).clip(0.01).astype(np.float32)


def weights_of(idf: np.ndarray) -> np.ndarray:
    """What a word weighs in a passage: IDF squared, so that rare words tell passages
    apart; IDF is positive, so every word weighs something."""
    return idf.astype(np.float64) ** 2


@dataclass
class Item:
    item_id: object
    words: np.ndarray  # hashes


@dataclass
class Block:
    """A block of the benchmark in the latent space."""

    items: list[Item]
    owner: np.ndarray  # the item of each passage
    passages: np.ndarray  # unit vectors, projected
    vocabulary: np.ndarray  # hashes of the words with a latent row, ascending
    rows: np.ndarray  # latent rows of the vocabulary
    most: np.ndarray  # the largest share of each word in a passage
    shingles: np.ndarray  # hashes of the items' runs of SHINGLE_WORDS words, ascending
    holder: np.ndarray  # the item of each shingle
    short: list[Item]  # items found as exact phrases only


def passage_count(words: int) -> int:
    return max(1, round(words / PASSAGE_WORDS))


def cut(words: np.ndarray) -> list[np.ndarray]:
    """An item's passages: even parts of about PASSAGE_WORDS words."""
    return np.array_split(words, passage_count(len(words)))


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each feature in a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[f] = total.get(f, 0) + np.frombuffer(v)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["f", "v"])


def randomised_svd(matrix: DataFrame, features: np.ndarray, rank: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Right singular vectors (features x rank) of a matrix whose rows are arrays ``at``
    (places in features) and ``w``. Each round sums A'(AQ) over the partitions."""
    spark = matrix.sparkSession
    width = min(rank + OVERSAMPLE, len(features))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(features), width)))[0]
    for last in [False] * rounds + [True]:
        shared = spark.sparkContext.broadcast(basis.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            total = np.zeros(q.shape)
            for batch in batches:
                for at, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    weight = np.array(w)[:, None]
                    np.add.at(total, at, weight * (weight * q[at]).sum(axis=0))
            used = np.nonzero(total.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([x.tobytes() for x in total[used]], pa.binary())], ["f", "v"])

        rows = matrix.mapInArrow(run, "f long, v binary").repartition("f").mapInArrow(_row_sums, "f long, v binary").toArrow()
        image = np.zeros(basis.shape)
        for f, v in zip(rows["f"].to_pylist(), rows["v"].to_pylist(), strict=True):
            image[f] = np.frombuffer(v)
        if last:  # Rayleigh-Ritz: rotate the basis to the singular vectors and keep the largest
            values, turn = np.linalg.eigh(basis.T @ image)
            basis = basis @ turn[:, np.argsort(-values)[:rank]]
        else:
            basis = np.linalg.qr(image)[0]
    return basis


def load_block(items: DataFrame, idf: np.ndarray) -> Block | None:
    """Fit the latent space of a block's passages. ``items``: item_id and text, about BLOCK_PASSAGES passages."""
    spark = items.sparkSession
    found, short = [], []
    for r in items.toLocalIterator():
        words = Words([cleaned(r["text"])]).hash
        if len(words):
            (found if len(words) >= MIN_WORDS else short).append(Item(r["item_id"], words))
    if not found:
        no = np.zeros(0, np.int64)
        return Block([], no, no, no, no, no, no, no, short) if short else None
    vocabulary = np.unique(np.concatenate([x.words for x in found]))
    owner, lists = [], []
    for i, item in enumerate(found):
        for part in cut(item.words):
            owner.append(i)
            at, times = np.unique(np.searchsorted(vocabulary, part), return_counts=True)
            w = times * weights_of(idf[buckets(vocabulary[at])])
            lists.append((at, w / (np.linalg.norm(w) or 1)))
    matrix = spark.createDataFrame([(a.tolist(), w.tolist()) for a, w in lists], "at array<int>, w array<double>").repartition(4)
    rows = randomised_svd(matrix, vocabulary, len(lists))
    passages = np.stack([(w[:, None] * rows[a]).sum(axis=0) for a, w in lists])
    passages /= np.linalg.norm(passages, axis=1, keepdims=True).clip(1e-9)
    most = np.zeros(len(vocabulary))
    for a, w in lists:
        most[a] = np.maximum(most[a], w)
    shingles, holder = item_shingles(found)
    return Block(found, np.array(owner), passages.astype(np.float32), vocabulary, rows.astype(np.float32), most, shingles, holder, short)


def item_shingles(items: list[Item]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the items' runs of SHINGLE_WORDS words, ascending, and the item of each."""
    runs, holder = [], []
    for i, item in enumerate(items):
        own = np.unique(runs_of(item.words, SHINGLE_WORDS))
        runs.append(own)
        holder.append(np.full(len(own), i))
    order = np.argsort(flat := np.concatenate(runs), kind="stable")
    return flat[order], np.concatenate(holder)[order]


def window_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over windows that hold a value at least, each from its own values: what differs by many orders from the rest
    of a chunk would be lost in differences of running sums."""
    if not len(begin):
        return np.zeros(0)
    return np.add.reduceat(np.append(values, 0.0), np.stack([begin, end], axis=1).ravel())[::2]


def runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words, whatever text they are in."""
    n = max(0, len(hashes) - length + 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = mixed(total * RUN_BASE + hashes[k : k + n])
    return total


def common_weight(item: np.ndarray, weight: np.ndarray, doc: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of item and doc."""
    best = np.zeros(len(doc) + 1)
    for h, w in zip(item, weight, strict=True):
        step = best.copy()
        step[1:] = np.maximum(best[1:], np.where(doc == h, best[:-1] + w, 0))
        best = np.maximum.accumulate(step)
    return float(best[-1])


def phrases(items: list[Item], words: Words) -> set[tuple[int, object]]:
    """Number of the text and item_id wherever an item stands in a text word for word."""
    out = set()
    for length in {len(x.words) for x in items}:
        own = [x for x in items if len(x.words) == length]
        keys = np.array([runs_of(x.words, length)[0] for x in own])
        order = np.argsort(keys, kind="stable")
        runs = runs_of(words.hash, length)
        maybe = np.zeros(1 << BUCKET_BITS, bool)
        maybe[buckets(keys)] = True
        for i in np.nonzero(maybe[buckets(runs)])[0].tolist():
            if words.text[i] == words.text[i + length - 1]:
                for k in range(np.searchsorted(keys, runs[i], sorter=order), np.searchsorted(keys, runs[i], "right", sorter=order)):
                    out.add((int(words.text[i]), own[order[k]].item_id))
    return out


def search(block: Block, idf: np.ndarray, words: Words) -> list[list[tuple]]:
    """For each text, (item_id, share, answer share) of the items found in it."""
    out: list[list[tuple]] = [[] for _ in range(len(words.first) - 1)]
    n = len(words.hash)
    if not n:
        return out
    for text, item_id in phrases(block.short, words):
        out[text].append((item_id, 1.0, 1.0))
    if not block.items:
        return [sorted(x) for x in out]
    b = buckets(words.hash)
    weight = weights_of(idf[b])
    # few words share a bucket with one of the benchmark's; only those are looked up
    maybe = np.zeros(1 << BUCKET_BITS, bool)
    maybe[buckets(block.vocabulary)] = True
    near = np.nonzero(maybe[b])[0]
    at = np.minimum(np.searchsorted(block.vocabulary, words.hash[near]), len(block.vocabulary) - 1)
    hit = block.vocabulary[at] == words.hash[near]
    known, place = np.zeros(n, bool), np.zeros(n, np.int64)
    known[near[hit]] = True
    place[near[hit]] = at[hit]
    where = np.nonzero(known)[0]
    begin = np.arange(0, n, STRIDE)
    # windows start at multiples of the stride or at the start of a text, and end with it
    begin = np.unique(np.concatenate([begin, words.first[:-1][words.first[:-1] < n]]))
    end = np.minimum(begin + PASSAGE_WORDS, words.first[words.text[begin] + 1])
    whole, part = window_sums(weight**2, begin, end), window_sums(np.where(known, weight**2, 0), begin, end)
    # no passage has more of a word than the one that has most of it
    most = np.zeros(n)
    most[where] = weight[where] * block.most[place[where]]
    most = window_sums(most, begin, end)
    alive = np.nonzero((part >= CANDIDATE**2 * whole) & (part > 0) & (whole > 0) & (most * 1.001 >= CANDIDATE * np.sqrt(whole)))[0]
    pairs: dict[tuple[int, int], list[int]] = {}
    for low in range(0, len(alive), 2048):
        some = alive[low : low + 2048]
        first, last = np.searchsorted(where, begin[some]), np.searchsorted(where, end[some])
        count = last - first  # known words of each window, one at least
        use = where[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        latent = np.add.reduceat(block.rows[place[use]] * weight[use, None].astype(np.float32), np.cumsum(count) - count, axis=0)
        cosine = latent @ block.passages.T / np.sqrt(whole[some])[:, None]
        w, p = np.nonzero(cosine >= CANDIDATE)
        for i, j in zip(some[w].tolist(), block.owner[p].tolist(), strict=True):
            pairs.setdefault((int(words.text[begin[i]]), j), []).append(int(begin[i]))
    runs = runs_of(words.hash, SHINGLE_WORDS)
    maybe[:] = False
    maybe[buckets(block.shingles)] = True
    for i in np.nonzero(maybe[buckets(runs)])[0].tolist():
        if words.text[i] == words.text[i + SHINGLE_WORDS - 1]:
            for k in range(np.searchsorted(block.shingles, runs[i]), np.searchsorted(block.shingles, runs[i], "right")):
                pairs.setdefault((int(words.text[i]), int(block.holder[k])), []).append(i)
    for (text, j), starts in pairs.items():
        item = block.items[j].words
        own = idf[buckets(item)].astype(np.float64)
        tail = max(1, len(item) // 4)
        best = (0.0, 0.0)
        low, high = int(words.first[text]), int(words.first[text + 1])
        reach = len(item) + len(item) // 2
        starts = sorted(set(starts))
        region = [starts[0], starts[0]]
        regions = []
        for s in starts[1:]:
            if s - region[1] > reach:
                regions.append(region)
                region = [s, s]
            region[1] = s
        for a, z in [*regions, region]:
            doc = words.hash[max(low, a - reach) : min(high, z + PASSAGE_WORDS + reach)]
            if own[np.isin(item, doc)].sum() < WEAK * own.sum():
                continue
            share = common_weight(item, own, doc) / own.sum()
            if share >= WEAK:
                best = max(best, (share, common_weight(item[-tail:], own[-tail:], doc) / own[-tail:].sum()))
        if best[0] >= STRONG or (best[0] >= WEAK and best[1] >= ANSWER):
            out[text].append((block.items[j].item_id, best[0], best[1]))
    return [sorted(x) for x in out]


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark as blocks of about BLOCK_PASSAGES passages, by hash of the item."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([passage_count(len(Words([cleaned(x)]).hash)) for x in batch.column(0).to_pylist()], pa.int64())], ["n"])

    clean = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = clean.select("text").mapInArrow(passages, "n long").agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // BLOCK_PASSAGES))
    return [clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else clean for i in range(n)]


def searcher(shared: Broadcast):
    """A function of texts that returns the hits of a broadcast block."""

    @F.arrow_udf(HITS)
    def held(texts: pa.Array) -> pa.Array:
        block, idf = shared.value
        return pa.array([x for words in chunked(unpacked(texts)) for x in search(block, idf, words)], _HITS)

    return held


def leaks(docs: DataFrame, benchmark: DataFrame) -> Column:
    """A column for docs: array<struct<item_id, share, answer>> of the items in a text."""
    spark = docs.sparkSession
    ship(spark)
    idf = inverse_frequencies(docs)
    columns = []
    for items in item_blocks(benchmark):
        block = load_block(items, idf)
        if block is None:
            continue
        columns.append(searcher(spark.sparkContext.broadcast((block, idf)))(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    empty = F.array().cast(HITS)
    return F.concat(*columns) if columns else empty


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share and answer: one row for each document and item found in it."""
    rows = docs.select("doc_id", F.explode(leaks(docs, benchmark)).alias("hit"))
    return rows.select("doc_id", "hit.item_id", "hit.share", "hit.answer")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Repeated rows fare alike; a null text holds none."""
    found = docs.select(whole_row(docs).alias("row"), leaks(docs, benchmark).alias("leaks"))
    return found.where(F.size("leaks") == 0).select("row.*")
