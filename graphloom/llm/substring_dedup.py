"""Substring dedup by seed and extend on winnowed anchors.

Words are hashed; in each window of ``length`` words the smallest hash of the
``seed_words``-grams in it is its anchor (winnowing), so equal windows have the same
anchor at the same place, and one anchor stands for a run of windows.

Seed: anchors that occur more than once, by a counting aggregate. Extend: a run is
stretched both ways to all words of its windows (up to 2 * length - seed_words), and
runs with the same anchor and the same stretch are one class. A class of two or more
occurrences repeats as a whole. Classes that share only the anchor are extended window
by window: one witness of each is read again and its windows are compared by hash, so
a match's left and right ends are found wherever they fall. Windows that overlap or
touch merge into maximal repeats, and the words they cover go.

Nothing pairs up: a passage in a third of all documents is one row per class after
partial aggregation, its occurrences come back through skew-splitting joins, and the
window comparison sees each distinct stretch once. Hashes are compared with the
anchor's own, 128 bits together.

Defined results: a null or empty text has no words. Rows are occurrences of their own
even if they share a doc_id or a text; rows that share both get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import saved, ship

SEED_WORDS = 8
#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 20
#: Odd multipliers of the two polynomial hashes (of bytes in a word, of words in a run).
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 2**64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _powers[base] = (tables[0], tables[1])
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: hashes, the text each is in, and hashes of runs."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        space = _SPACE[data]
        starts = np.nonzero(space[:-1] & ~space[1:])[0] + 1
        ends = np.nonzero(~space[:-1] & space[1:])[0] + 1
        up, down = powers(_BYTE_BASE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        self.hash = mixed((sums[ends] - sums[starts]) * down[starts])
        edges = np.cumsum([1, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(starts, edges)  # of each text, and the end
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = powers(_WORD_BASE, len(starts))
        self.down = down
        self.sums = np.zeros(len(starts) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(starts)], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from start to before end."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest value of each window of ``width`` values."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = place[:-step], place[step:]
        place = np.where(values[a] <= values[b], a, b)
        span += step
    return place


def anchored_runs(words: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: anchor and stretch hashes, the text, the
    first window's word in the text, and the number of windows less one."""
    n = len(words.hash)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(n - seed + 1)
    grams = words.runs(at, at + seed)
    place = smallest(grams, length - seed + 1)
    window = np.arange(len(place))
    inside = words.text[window] == words.text[window + length - 1]
    window, place = window[inside], place[inside]
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (words.text[window[1:]] != words.text[window[:-1]])
    lead = np.nonzero(new)[0]
    low, high = window[lead], window[np.append(lead[1:], len(window)) - 1]
    anchor = place[lead]
    stretch = words.runs(low, high + length) + (anchor - low).astype(np.uint64) * np.uint64(_BYTE_BASE)
    text = words.text[low]
    return grams[anchor].view(np.int64), stretch.view(np.int64), text, low - words.first[text], high - low


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, some megabytes at a time, each with the first one's number."""
    first, chunk, size = 0, [], 0
    for i, x in enumerate(texts):
        chunk.append((x or "").encode())
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            yield first, chunk
            first, chunk, size = i + 1, [], 0
    if chunk:
        yield first, chunk


def find_runs(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, chunk in _chunks(batch.column(2).to_pylist()):
                anchor, stretch, text, low, more = anchored_runs(Words(chunk), length, seed)
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(stretch), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(low.astype(np.int32)), pa.array(more.astype(np.int32))],
                    ["anchor", "stretch", "doc", "t", "low", "more"],
                )

    return run


def find_windows(length: int):
    """Windows of the witnesses, with the hash of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for first, chunk in _chunks(batch.column(2).to_pylist()):
                words = Words(chunk)
                rows, at, anchor, alone = [], [], [], []
                for i in range(len(chunk)):
                    for w in wanted[first + i]:
                        n = w["more"] + 1
                        rows.append(np.full(n, first + i))
                        at.append(np.arange(w["low"], w["low"] + n))
                        anchor.append(np.full(n, w["anchor"]))
                        alone.append(np.full(n, w["n"] == 1))
                if not rows:
                    continue
                rows, at = np.concatenate(rows), np.concatenate(at)
                start = words.first[rows - first] + at
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(anchor)), pa.array(words.runs(start, start + length).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(np.concatenate(alone))],
                    ["anchor", "window", "doc", "t", "at", "alone"],
                )

    return run


def removal(length: int):
    """Apply the runs of repeated windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = (text or "").encode().split()
                words.append(len(parts))
                if runs:
                    change = np.zeros(len(parts) + 1, np.int64)
                    low, more = np.array([(r["low"], r["more"]) for r in runs]).T
                    np.add.at(change, low, 1)
                    np.add.at(change, low + more + length, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    parts = [parts[i] for i in np.nonzero(stays)[0].tolist()]
                removed.append(words[-1] - len(parts))
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 35, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left, joined by one space, after
    every word covered by a window of ``length`` words that also starts elsewhere went."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    runs = rows.mapInArrow(find_runs(length, seed_words), "anchor long, stretch long, doc long, t long, low int, more int")
    # written tables, so that both sides of the joins are plain exchanges and hot keys can be split
    seeds = saved(runs.groupBy("anchor").agg(F.count("anchor").alias("_n")).where(F.col("_n") > 1).select("anchor"), "seeds")
    seeded = saved(runs.join(seeds, "anchor"), "seeded-runs")
    firsts = [F.first(c).alias(c) for c in ("doc", "t", "low", "more")]
    classes = saved(seeded.groupBy("anchor", "stretch").agg(F.count("low").alias("n"), *firsts), "stretches")
    whole = seeded.join(classes.where(F.col("n") > 1).select("anchor", "stretch"), ["anchor", "stretch"]).select("doc", "t", "low", "more")
    several = saved(classes.groupBy("anchor").agg(F.count("n").alias("_k")).where(F.col("_k") > 1).select("anchor"), "several")
    witnesses = classes.join(several, "anchor").groupBy("doc", "t").agg(F.collect_list(F.struct("anchor", "n", "low", "more")).alias("wanted"))
    right = witnesses.select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), "wanted").hint("shuffle_hash")
    same_row = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t"))
    read_again = rows.join(right, same_row).select("doc", "t", "text", "wanted")
    windows = saved(read_again.mapInArrow(find_windows(length), "anchor long, window long, doc long, t long, at int, alone boolean"), "windows")
    shared = saved(windows.groupBy("anchor", "window").agg(F.count("at").alias("_n")).where(F.col("_n") > 1).select("anchor", "window"), "shared")
    single = windows.where("alone").join(shared, ["anchor", "window"]).select("doc", "t", F.col("at").alias("low"), F.lit(0).alias("more"))
    repeats = whole.unionByName(single).groupBy(F.col("doc").alias("_doc"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("low", "more")).alias("runs"))
    return (
        rows.join(repeats.hint("shuffle_hash"), same_row, "left")
        .select(F.col("doc").alias("doc_id"), "text", "runs")
        .mapInArrow(removal(length), "doc_id long, n_words long, n_removed long, kept string")
    )
