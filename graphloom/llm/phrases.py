"""Phrases whose words come together more often than their parts suggest, by suffix-sigma.

Each word's occurrence starts a suffix: the words from it to the end of its piece, at most
``longest`` of them. Tasks sort the suffixes of some texts, count equal ones (a map-side
combine) and send them on by ranges of (language, first word, following words). The ranges
come from a sample of suffixes, as those of any range partitioning do, so that a first word
that holds a third of all rows is dealt over many tasks by the words after it. A task sorts its range in reverse order and
counts the prefixes of all lengths in one pass. The stack of that pass holds the prefixes of the
current suffix, and a prefix is counted when it leaves the stack. numpy works out all pops at
once: row i pops what is longer than its common prefix with row i - 1. A prefix lies in one range
unless it is that of a range's first or last suffix; those counts are kept whatever they are and
summed up afterwards, as are all counts, by phrase. Counts of parts are joined to the
phrases that reach the threshold; parts are as frequent as the whole, so none is missing.

Words are compared as they are, never by hash, and numbers are whole: scores are worked out with
38 decimal digits. Ranges grow in number with the text and stay at ``range_bytes`` of it.

Defined results: a null text is empty, a null language ``und`` (and one with it). Repeated rows count
as often as they are there. A piece never reaches over texts. Equal scores of a phrase's cuts go to the shortest
first part. Ranks are by score, then a, both descending, then phrase in byte order, so there are no
ties. An empty table gives no rows. Columns other than text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import saved, ship
from graphloom.llm.words import binary_array, lengths_and_bytes, marks, portions, split_words

SEPARATORS = marks(b".,;:!?\n\x0b\x0c\r")
BLANKS = marks(b" \t")
#: Suffixes that a task sorts together, and text behind one range.
CHUNK = 1 << 20
RANGE_BYTES = 12 << 20
#: Text looked at for the borders of a range, and every how many-th of its suffixes is taken.
SAMPLE_BYTES = 200_000
SAMPLE_STEP = 50
_BLOCKS = "range int, langs array<string>, rows int, names int, size int, lengths binary, words binary, width int, codes binary, counts binary"
_COUNTS = "lang string, phrase string, words int, n long"

#: A suffix: its language and its words.
Suffix = tuple[str, tuple[bytes, ...]]


class Chunk(NamedTuple):
    """Suffixes of consecutive words: column 0 numbers the language, the others the words (from 1, in
    byte order; 0 where the piece has ended)."""

    langs: list[str]
    words: pa.Array
    columns: list[np.ndarray]


def in_order(columns: Sequence[np.ndarray]) -> np.ndarray:
    """The order that sorts rows by the columns; columns share 64-bit keys where they fit."""
    keys: list[np.ndarray] = []
    room = 0
    for column in columns:
        bits = max(1, int(column.max()).bit_length()) if len(column) else 1
        if bits > room:
            keys.append(column.astype(np.uint64))
            room = 64 - bits
        else:
            keys[-1] = (keys[-1] << np.uint64(bits)) | column.astype(np.uint64)
            room -= bits
    return np.lexsort(keys[::-1])


def changes(columns: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each column, where it or one before it differs from the row before."""
    out, so_far = [], np.zeros(len(columns[0]), dtype=bool)
    so_far[:1] = True
    for column in columns:
        so_far = so_far.copy()
        so_far[1:] |= column[1:] != column[:-1]
        out.append(so_far)
    return out


def in_byte_order(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and for each word its place there, from 1."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def chunks(batch: pa.RecordBatch, longest: int, extra: Sequence[Suffix] = ()) -> Iterator[Chunk]:
    """The suffixes of a batch (text, lang); those of ``extra`` come last in each chunk."""
    langs = batch.column(1).dictionary_encode()
    named = sorted({*langs.dictionary.to_pylist(), *(lang for lang, _ in extra)}, key=str.encode)
    number = {lang: i for i, lang in enumerate(named)}
    of_row = np.array([number[x] for x in langs.dictionary.to_pylist()], dtype=np.int32)[langs.indices.to_numpy()]
    more = pa.array([w for _, ws in extra for w in ws], pa.binary())
    for portion in portions(batch.column(0), SEPARATORS):
        found = split_words(portion, BLANKS, SEPARATORS, lower=True)
        piece, lang = np.cumsum(found.first), of_row[portion.rows[found.part]]
        for a in range(0, len(piece), CHUNK):
            b = min(len(piece), a + CHUNK)
            end = min(len(piece), b + longest - 1)  # words that only follow
            words, code = in_byte_order(pa.concat_arrays([found.words.slice(a, end - a), more]))
            own = np.concatenate((code[: end - a], np.zeros(longest, dtype=np.int32)))
            home = np.concatenate((piece[a:end], np.zeros(longest, dtype=np.int64)))
            columns = [lang[a:b]] + [np.where(home[k : k + b - a] == home[: b - a], own[k : k + b - a], 0) for k in range(longest)]
            if extra:
                at, tail = end - a, np.zeros((len(extra), longest + 1), dtype=np.int32)
                for i, (name, ws) in enumerate(extra):
                    tail[i, 0] = number[name]
                    tail[i, 1 : len(ws) + 1] = code[at : at + len(ws)]
                    at += len(ws)
                columns = [np.concatenate((c, t)) for c, t in zip(columns, tail.T, strict=True)]
            yield Chunk(named, words, columns)


def sampled(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch, longest):
            names = chunk.words.to_pylist()
            rows = [(chunk.langs[row[0]], [names[i - 1] for i in row[1:] if i]) for row in np.stack([c[::SAMPLE_STEP] for c in chunk.columns], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.list_(pa.binary()))], ["lang", "words"])


def borders(docs: DataFrame, longest: int, range_bytes: int) -> list[Suffix]:
    """Where one range ends and the next begins: as many as there are ranges, less one."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = -(-size // range_bytes)
    if ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLE_BYTES / size)
    some = docs.sample(False, share, seed=5) if share < 1 else docs
    rows = some.mapInArrow(lambda batches: sampled(batches, longest), "lang string, words array<binary>").collect()
    keys = sorted(((r["lang"], tuple(map(bytes, r["words"]))) for r in rows), key=lambda x: (x[0].encode(), x[1]))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}, key=lambda x: (x[0].encode(), x[1])) if keys else []


def blocks(batches: Iterator[pa.RecordBatch], longest: int, cuts: list[Suffix]) -> Iterator[pa.RecordBatch]:
    """Counted suffixes, a row for each chunk and range: the words used, and columns of their numbers."""
    schema = pa.schema([("range", pa.int32()), ("langs", pa.list_(pa.string())), ("rows", pa.int32()), ("names", pa.int32()), ("size", pa.int32()), ("lengths", pa.binary()), ("words", pa.binary()), ("width", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        for chunk in chunks(batch, longest, cuts):
            rows = len(chunk.columns[0])
            order = in_order(chunk.columns)
            columns = [c[order] for c in chunk.columns]
            heads = np.flatnonzero(changes(columns)[-1])
            # a border is the last row of its equals: the sort is stable and borders come last
            ends = np.append(heads[1:], rows)
            border = order >= rows - len(cuts)
            counts = (ends - heads) - np.add.reduceat(border, heads, dtype=np.int64)
            here = border[ends - 1]
            of_range = np.cumsum(here)  # a border itself begins a range
            columns = [c[heads] for c in columns]
            kept = np.flatnonzero(counts > 0)
            edges = np.append(np.flatnonzero(np.diff(of_range[kept], prepend=-1)), len(kept))
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                pick = kept[a:b]
                own = np.stack([c[pick] for c in columns])
                used = np.zeros(len(chunk.words) + 1, dtype=bool)
                used[own[1:]] = True
                used[0] = True
                own[1:] = (np.cumsum(used) - 1)[own[1:]]
                lengths, data = lengths_and_bytes(chunk.words.take(pa.array(np.flatnonzero(used)[1:] - 1)))
                width = 2 if used.sum() <= 1 << 16 and len(chunk.langs) <= 1 << 16 else 4
                packed = {k: pa.compress(v, "zstd", asbytes=True) for k, v in {"lengths": lengths, "words": data, "codes": own.astype(f"<u{width}").tobytes(), "counts": counts[pick].astype("<u4").tobytes()}.items()}
                out.append({"range": int(of_range[pick[0]]), "langs": chunk.langs, "rows": len(pick), "names": len(lengths) // 4, "size": len(data), "width": width, **packed})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def count_range(table: pa.Table, longest: int, least: int) -> pa.Table:
    """The counts of the prefixes of a range's suffixes: those of ``least`` and more, and any that other
    ranges may have too. A row of no words has the occurrences of all words of a language."""
    rows, sizes, langs, words = [], [], [], []
    for block in table.to_pylist():

        def unpacked(name: str, size: int, block: dict = block) -> bytes:
            return pa.decompress(block[name], size, "zstd", asbytes=True) if size else b""

        columns = np.frombuffer(unpacked("codes", (longest + 1) * block["rows"] * block["width"]), dtype=f"<u{block['width']}").reshape(longest + 1, -1).astype(np.int32)
        names = binary_array(np.frombuffer(unpacked("lengths", 4 * block["names"]), dtype=np.uint32), unpacked("words", block["size"]))
        rows.append((columns, sum(map(len, words))))
        words.append(names)
        langs.append(block["langs"])
        sizes.append(np.frombuffer(unpacked("counts", 4 * block["rows"]), dtype="<u4").astype(np.int64))
    named = sorted({x for some in langs for x in some}, key=str.encode)
    number = {x: i for i, x in enumerate(named)}
    distinct, place = in_byte_order(pa.concat_arrays(words))
    place = np.append(place, np.int32(0))  # the last stands for no word
    columns = [np.concatenate([np.array([number[x] for x in some], dtype=np.int32)[c[0]] for (c, _), some in zip(rows, langs, strict=True)])]
    columns += [np.concatenate([place[np.where(c[k] > 0, at + c[k] - 1, -1)] for c, at in rows]) for k in range(1, longest + 1)]
    size = np.concatenate(sizes)
    del rows, sizes
    order = in_order(columns)[::-1]
    columns, size = [c[order] for c in columns], size[order]
    pops = changes(columns)
    out: dict[str, list] = {"lang": [], "phrase": [], "words": [], "n": []}
    for k, popped in enumerate(pops):
        heads = np.flatnonzero(popped)
        n = np.add.reduceat(size, heads)
        shared = np.zeros(len(heads), dtype=bool)
        shared[[0, -1]] = True
        kept = np.flatnonzero((n >= least) | shared | (k == 0))
        kept = kept[columns[k][heads[kept]] > 0] if k else kept
        at = heads[kept]
        out["lang"] += [named[i] for i in columns[0][at]]
        parts = [distinct.take(pa.array(c[at] - 1)).to_pylist() for c in columns[1 : k + 1]]
        out["phrase"] += [b" ".join(p).decode() for p in zip(*parts, strict=True)] if k else [""] * len(at)
        out["words"] += [k] * len(at)
        out["n"] += n[kept].tolist()
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())]))


def count_phrases(docs: DataFrame, longest: int = 5, least: int = 100, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, phrase, words, n: all phrases of up to ``longest`` words that occur ``least`` times in a
    language, and a row of 0 words with the occurrences of all its words."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    cuts = docs.sparkSession.sparkContext.broadcast(borders(texts, longest, range_bytes))
    dealt = texts.mapInArrow(lambda batches: blocks(batches, longest, cuts.value), _BLOCKS)
    # a group is a range: as much of the sorted suffixes as the borders let in
    counted = dealt.groupBy("range").applyInArrow(lambda table: count_range(table, longest, least), _COUNTS)
    whole = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return saved(whole.where((F.col("n") >= least) | (F.col("words") == 0)), "phrase-counts")


def exact(*factors: Column) -> Column:
    """The product as a decimal without fraction, of up to 38 digits."""
    out = factors[0].cast("decimal(19,0)")
    for x in factors[1:]:
        out = (out * x.cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def phrase_scores(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of two words and more, at their weakest cut."""
    words = F.split("phrase", " ")
    cut = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), words.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.array_join(F.slice("_w", 1, F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("_w", F.col("k") + 1, F.col("words") - F.col("k")), " ")).drop("_w")
    parts = counts.where("words >= 1")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    totals = counts.where("words = 0").select("lang", F.col("n"))
    cut = cut.join(totals, "lang")
    cut = cut.withColumn("_up", exact(F.col("a"), F.col("n"), F.lit(1000))).withColumn("_down", exact(F.col("l"), F.col("r"))).withColumn("score", F.expr("_up div _down"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("_m")
    return cut.groupBy("lang", "phrase", "words", "a", "n").agg(weakest).select("lang", "phrase", "words", "a", "_m.l", "_m.r", "n", "_m.score")


def without_parts(scored: DataFrame, share: int = 100) -> DataFrame:
    """Phrases go if a longer one holds their words together and has ``share`` percent of their occurrences."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("_w", i, m), " "))))
    longer = scored.where("words > 2").withColumn("_w", F.split("phrase", " ")).select("lang", "a", F.explode(inner).alias("phrase"))
    best = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_a"))
    joined = scored.join(best, ["lang", "phrase"], "left")
    return joined.where(F.col("_a").isNull() | (100 * F.col("_a") < share * F.col("a"))).drop("_a")


def mine_phrases(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language. The window keeps at most
    ``top`` rows of a language in each task before it shuffles."""
    kept = without_parts(phrase_scores(count_phrases(docs, longest, least, range_bytes)), share)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
