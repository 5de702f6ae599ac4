"""SimHash near-dedup with pivot distance tables.

A fingerprint is the majority vote, bit by bit, over the hashes of a text's shingles.
Texts that can't be told apart are one class, found by a plain aggregate, so copies
never pair up. A class is listed under some keys, and classes that share a key meet in
cells of bounded size. A cell holds the distance table of its fingerprints to fixed
reference fingerprints (pivots): by the triangle inequality, a pair whose distances to
any pivot differ by more than the radius is discarded, and the survivors are verified.
A cell returns a spanning star of each of its linked groups, not its pairs.

Distances to pivots discard pairs but don't say who meets: those of unrelated texts lie
within a few bits of half the length. Who meets is said by

* blocks, for ``near_duplicates`` (links by differing bits): two fingerprints within
  ``max_bits`` agree in ``shared`` whole blocks of max_bits + shared; a key for each
  such choice of blocks loses no link. ``shared`` grows with the number of classes.
* smallest shingle hashes, for ``near_dedup`` (links by similarity of shingle sets, at
  which a quarter of the bits may differ and no block is whole). ``TREES`` keys of two
  smallest hashes each, from ``MINIMA`` fixed orders of the hashes; a list of over
  ``CELL_ROWS`` classes is dealt again by more of them. Survivors of the fingerprints
  are compared by their whole shingle sets, so every link is exact.

A list that stays long is cut into cells by hash; then what is not in the list's main
component so far is compared with all cells. So each pair that shares a key is compared
or already linked, and a large group of near copies costs in proportion to its size.
Components are joined by repeated label minimum and pointer jumping over tables in the
shared folder.

Defined results: case of A-Z and kinds of white space make no difference. A text with
fewer words than a shingle is one shingle; texts without words (null, empty, blank)
have fingerprint zero and no shingles, and are copies of each other. A null doc_id comes
after all others: it names a component only if all rows of it are so (then null). An
empty table gives an empty table. ``near_duplicates`` returns a row for each input row.
Other columns, whatever their names, pass ``near_dedup`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import saved, ship
from graphloom.llm.substring_dedup import CHUNK_BYTES, Words, mixed

#: Classes of a cell, and shingles of all of them.
CELL_ROWS, CELL_SHINGLES = 1024, 1 << 20
PIVOTS = 16
#: Unrelated classes that may share a block key on average.
KEY_ROWS = 64
#: Orders of the shingle hashes, keys of each class, and smallest hashes in a key, level by level.
MINIMA, TREES, LEVELS = 24, 16, (2, 3, 4, 6)
#: Bits of near_dedup's fingerprints; its radius leaves so many standard deviations for chance.
SIMILARITY_BITS, DEVIATIONS = 256, 5.0
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]


def votes_print(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half of the hashes; big-endian. Bits beyond 64
    are those of further hashes made from the first."""
    out = b""
    for word in range(bits // 64):
        more = mixed(hashes + np.arange(word, word + 1, dtype=np.uint64) * _STEP) if word else hashes
        votes = np.zeros(64, np.int64)
        for at in range(0, len(more), 1 << 16):
            votes += np.unpackbits(more[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out += np.packbits(votes * 2 > max(1, len(more)), bitorder="little").tobytes()[::-1]
    return out


def fingerprint(text: str, words: int) -> bytes:
    return votes_print(np.array(shingle_hashes(text, words), np.uint64))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x or "", words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


def as_words(fps: list[bytes]) -> np.ndarray:
    """Fingerprints x 64-bit words, the last word first."""
    return np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), -1)[:, ::-1].astype(np.uint64)


def shared_blocks(classes: int, max_bits: int, bits: int = 64) -> int:
    """How many whole blocks a key has: so many that unrelated classes seldom share it."""
    shared = 2
    while classes > KEY_ROWS << (bits * shared // (max_bits + shared)) and comb(max_bits + shared + 1, max_bits) <= 128:
        shared += 1
    return shared


def block_masks(max_bits: int, shared: int, bits: int = 64) -> np.ndarray:
    """The bits of each choice of ``shared`` blocks out of max_bits + shared."""
    n = max_bits + shared
    edges = [bits * i // n for i in range(n + 1)]
    return np.array([sum(1 << b for k in some for b in range(edges[k], edges[k + 1])) for some in combinations(range(n), shared)], np.uint64)


def pivots(words: int, n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([[xxhash.xxh64_intdigest(f"pivot {i} {w}", 42) for w in range(words)] for i in range(n)], np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def cell_links(fps: np.ndarray, max_bits: int, references: np.ndarray) -> np.ndarray:
    """For each fingerprint of a cell, the index of the smallest of its linked group."""
    n = len(fps)
    table = distances(fps[:, None, :], references[None, :, :])
    near = np.ones((n, n), bool)
    for column in range(min(4, table.shape[1])):  # whole rows at once, while most pairs are still there
        d = table[:, column]
        near &= np.abs(d[:, None] - d[None, :]) <= max_bits
    rows, cols = np.nonzero(np.triu(near, 1))
    label = np.arange(n)
    linked = []
    for at in range(0, len(rows), 1 << 18):
        r, c = rows[at : at + (1 << 18)], cols[at : at + (1 << 18)]
        use = np.abs(table[r] - table[c]).max(axis=1) <= max_bits
        r, c = r[use], c[use]
        use = distances(fps[r], fps[c]) <= max_bits
        linked.append((r[use], c[use]))
    rows, cols = (np.concatenate(x) for x in zip(*linked, strict=True)) if linked else (rows, cols)
    while len(rows):
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of a cell, the index of the first of those it is linked to, where
    sets link if their Jaccard similarity is ``similarity`` or more. Sets that already
    have a group are not compared again."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, own = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(own.max() + 1, bool)
    label = np.full(n, -1)
    rest, flat = np.arange(n), own  # the sets to compare with, and their members
    starts, free = ends - sizes, n
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first], free, queue = first, free - 1, [first]
        while queue and free:
            at = queue.pop()
            if 2 * free < len(rest):
                rest = rest[label[rest] < 0]
                flat = np.concatenate([own[ends[i] - sizes[i] : ends[i]] for i in rest.tolist()])
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            members = own[ends[at] - sizes[at] : ends[at]]
            mark[members] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[members] = False
            new = rest[(common >= similarity * (sizes[at] + sizes[rest] - common)) & (label[rest] < 0)]
            label[new] = first
            free -= len(new)
            queue.extend(new.tolist())
    return label


def in_cells(rows: DataFrame, keys: list[str], run: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``run`` on the rows of each cell, as tuples without the keys; ``run`` gives tuples.
    Cells come one after the other, whatever batches they are in."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    names = rows.columns
    key_at, value_at = [names.index(k) for k in keys], [i for i, c in enumerate(names) if c not in keys]
    target = StructType.fromDDL(schema).names

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, out = None, [], []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], target)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*(columns[i] for i in key_at), strict=True), zip(*(columns[i] for i in value_at), strict=True), strict=True):
                if key != cell:
                    if len(held) > 1:
                        out.extend((*cell, *x)[-len(target) :] for x in run(held))
                    cell, held = key, []
                held.append(row)
            if out:
                yield packed()
                out = []
        if len(held) > 1:
            out.extend((*cell, *x)[-len(target) :] for x in run(held))
        if out:
            yield packed()

    return rows.mapInArrow(compare, schema)


def listed(members: DataFrame) -> DataFrame:
    """key, n and s (the cells it needs) of each key that several of the members share.
    A written table, so that both sides of joins with it are plain exchanges and hot
    keys can be split."""
    lists = members.groupBy("key").agg(F.count("node").alias("n"), F.sum("size").alias("total")).where("n > 1")
    cells = F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.ceil(F.col("total") / CELL_SHINGLES))
    return saved(lists.select("key", "n", cells.cast("long").alias("s")), "lists")


def connect(members: DataFrame, lists: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, label: the components of what ``compare`` links among members (key, node)
    that share a key. It gets cells (key, a, b, node) and gives links (u, v)."""
    cell = F.pmod(F.xxhash64("key", "node"), F.col("s"))
    at = members.join(lists, "key")
    links = saved(compare(at.select("key", cell.alias("a"), F.lit(0).alias("b"), "node")), "links")
    labels = components(links)
    many = lists.where("s > 1")
    if many.isEmpty():
        return labels
    inside = saved(members.join(many, "key").select("key", "s", "node"), "long-lists")
    named = inside.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = named.groupBy("key", "label").agg(F.count("node").alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("main"))
    apart = saved(named.join(saved(main, "main"), "key").where("label <> main").select("key", "s", "node"), "apart")
    blocks = saved(apart.groupBy("key").agg(F.ceil(F.count("node") / CELL_ROWS).cast("long").alias("blocks")), "apart-blocks")
    if blocks.isEmpty():
        return labels
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    here = inside.join(blocks, "key").select("key", cell.alias("a"), upto("blocks").alias("b"), "node")
    there = apart.join(blocks, "key").select("key", upto("s").alias("a"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b"), "node")
    return components(links.unionByName(saved(compare(here.unionByName(there).distinct()), "links")))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of the component, for every node with an edge."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    both = saved(both, "links")
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_m")).select("node", F.least("node", "_m").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("_heard"))
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "_heard").alias("_l"))
        top = labels.select(F.col("node").alias("_l"), F.col("label").alias("_ll"))
        new = saved(lower.join(top, "_l").select("node", F.least("_l", "_ll").alias("label"), (F.least("_l", "_ll") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (hexadecimal digits) and component_id, the smallest doc_id
    reachable over links of at most ``max_bits`` differing bits."""
    fps = saved(fingerprints(docs, words), "fingerprints")
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    masks = block_masks(max_bits, shared_blocks(classes.count(), max_bits))

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, tables = batch.num_rows, len(masks)
                found = as_words(batch.column(0).to_pylist()) & masks
                keys = mixed(found + _STEP * np.arange(tables, dtype=np.uint64))  # for each choice, other keys
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(n), tables)))], ["key", "node"])

    def compare(cells: DataFrame) -> DataFrame:
        references = pivots(1)

        def run(rows: list[tuple]) -> Iterator[tuple]:
            label = cell_links(as_words([x for (x,) in rows]), max_bits, references)
            return ((rows[label[i]][0], rows[i][0]) for i in np.nonzero(label != np.arange(len(rows)))[0].tolist())

        return in_cells(cells, ["key", "a", "b"], run, "u binary, v binary")

    members = classes.select("fp").mapInArrow(list_keys, "key long, node binary").withColumn("size", F.lit(0))
    groups = connect(members, listed(members), compare)
    named = groups.join(classes.withColumnRenamed("fp", "node"), "node").groupBy("label").agg(F.min("first").alias("least"))
    named = groups.join(named, "label").select(F.col("node").alias("fp"), "least")
    owner = saved(classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "owners")
    return fps.join(owner, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""

    def chunk(some: list[bytes]) -> Iterator[np.ndarray]:
        w = Words(some)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            start = np.arange(a, max(a + 1, b - words + 1)) if b > a else np.zeros(0, np.int64)
            yield np.unique(w.runs(start, np.minimum(start + words, b)))

    held, size = [], 0
    for text in texts:
        held.append((text or "").encode().translate(_LOWER))
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield from chunk(held)
            held, size = [], 0
    if held:
        yield from chunk(held)


def radius(similarity: float, bits: int = SIMILARITY_BITS) -> int:
    """Differing bits of the fingerprints of two sets whose Jaccard similarity is
    ``similarity``: what is expected for sets of one size, the farthest, and room for chance."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + DEVIATIONS * sqrt(bits * p * (1 - p)))


def tree_orders() -> np.ndarray:
    """For each tree, the orders whose smallest hashes make its keys."""
    draw = np.random.default_rng(5)
    return np.stack([draw.permutation(MINIMA)[: LEVELS[-1]] for _ in range(TREES)])


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """For each row of docs (at, text): its class (a digest of its shingles), their
    number, the fingerprint, the smallest hashes and the lower halves of all hashes."""
    factors = np.random.default_rng(3).integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, fp, least, low = [], [], [], [], []
            for x in shingle_sets(batch.column(1).to_pylist(), words):
                node.append(xxhash.xxh3_128_digest(x.tobytes()))
                size.append(len(x))
                fp.append(votes_print(x, SIMILARITY_BITS))
                least.append(b"".join((x * f).min().tobytes() for f in factors) if len(x) else None)
                low.append(np.unique(x.astype(np.uint32)).tobytes())
            values = [pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(fp, pa.binary()), pa.array(least, pa.binary()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["at", "node", "size", "fp", "least", "low"])

    return docs.mapInArrow(run, "at struct<n:boolean,d:long,h:long>, node binary, size int, fp binary, least binary, low binary")


def tree_keys(nodes: DataFrame, level: int, tree: bool) -> DataFrame:
    """key, tree, node and size: the keys of nodes (node, size, least and, if they are
    in some trees only, tree) from the first ``level`` orders of each tree."""
    orders = tree_orders()[:, :level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            least = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(n, MINIMA)
            row, at = (np.arange(n), batch.column(3).to_numpy()) if tree else (np.repeat(np.arange(n), TREES), np.tile(np.arange(TREES), n))
            key = mixed(at.astype(np.uint64) + _STEP)
            for k in range(level):
                key = mixed(key * _STEP + least[row, orders[at, k]])
            own = batch.take(pa.array(row)) if not tree else batch
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), own.column(0), own.column(1)], ["key", "tree", "node", "size"])

    return nodes.select("node", "size", "least", *(["tree"] if tree else [])).mapInArrow(run, "key long, tree int, node binary, size int")


def dealt(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (key, node, size) of the lists that classes meet in, and the lists."""
    members = saved(tree_keys(classes, LEVELS[0], False), "tree-keys")
    met = []
    for level in [*LEVELS[1:], None]:
        lists = listed(members)
        if level is None or (crowded := lists.where("s > 1")).isEmpty():
            met.append((members, lists))
            break
        met.append((members, lists.where("s = 1")))
        again = members.join(crowded, "key", "left_semi").join(classes.select("node", "least"), "node")
        members = saved(tree_keys(again, level, True), "tree-keys")
    both = [m.join(x.select("key"), "key", "left_semi").select("key", "node", "size") for m, x in met]
    return saved(reduce(DataFrame.unionByName, both), "met"), saved(reduce(DataFrame.unionByName, [x for _, x in met]), "all-lists")


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies: that with the smallest doc_id (ties:
    the smallest hash of the text; rows that agree in both are one, any of them stays).
    Texts are linked if the Jaccard similarity of their sets of shingles of ``words``
    words is ``similarity`` or more, and groups are what links connect."""
    ship(docs.sparkSession)
    named = docs.select(
        F.struct("*").alias("row"),
        F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h")).alias("at"),
        F.col("text").cast("string").alias("text"),
    )
    data = [F.any_value(c).alias(c) for c in ("size", "fp", "least", "low")]
    classes = saved(shingled(named.select("at", "text"), words).groupBy("node").agg(F.min("at").alias("first"), *data), "near-classes")
    bits, references = radius(similarity), pivots(SIMILARITY_BITS // 64)

    def by_fingerprint(rows: list[tuple]) -> Iterator[tuple]:
        label = cell_links(as_words([x[1] for x in rows]), bits, references)
        several = np.bincount(label, minlength=len(rows)) > 1
        return ((int(label[i]), rows[i][0]) for i in np.nonzero(several[label])[0].tolist())

    def by_shingles(rows: list[tuple]) -> Iterator[tuple]:
        label = similar_groups([np.frombuffer(x[1], np.uint32) for x in rows], similarity)
        return ((rows[label[i]][0], rows[i][0]) for i in np.nonzero(label != np.arange(len(rows)))[0].tolist())

    def compare(cells: DataFrame) -> DataFrame:
        near = in_cells(cells.join(classes.select("node", "fp"), "node").select("key", "a", "b", "node", "fp"), ["key", "a", "b"], by_fingerprint, "key long, a long, b long, c long, node binary")
        near = saved(near, "survivors")
        return in_cells(near.join(classes.select("node", "low"), "node").select("key", "a", "b", "c", "node", "low"), ["key", "a", "b", "c"], by_shingles, "u binary, v binary")

    members, lists = dealt(classes.where("least IS NOT NULL"))
    labels = connect(members, lists, compare)
    keep = classes.select("node", "first").join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("group")).agg(F.min("first").alias("at")).select("at")
    return named.select("at", "row").join(saved(keep, "kept").hint("merge"), "at", "left_semi").dropDuplicates(["at"]).select("row.*")
