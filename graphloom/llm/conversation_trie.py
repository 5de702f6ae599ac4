"""The prefix trie of conversations.

A node is a distinct sequence of first d turns (role, text); its members are the conversations
that begin with it, and the one with the smallest id owns it. If a conversation owns a
prefix it owns all its longer ones, for their members are fewer and it is among them. So the
first depth that a conversation owns is found by binary search: in each round all open conversations
are joined at once with the digest of their middle prefix and with the table of minima, the smallest
member by prefix digest. From that depth on a conversation's prefixes are a chain of nodes. A
chain hangs on the node before its first one, which a smaller id owns; chains and what they hang on
form a tree that is added up from below by pointer doubling, in rounds that grow with the logarithm
of its height. Inside a chain sums run from its end upwards.

A prefix digest is 128 bits: the exclusive or of hashes of (position, SHA-256 of the turn). So a
long conversation is dealt by ranges of its turns like any table, and prefixes are put together
from sums of stretches (``STRETCH`` turns); no conversation has to fit into a task. The ids
that end at a node are written down in sorted pieces, and one pass over the pieces hashes them.

Defined results: rows without conv_id are no turns; a null role or text is empty; turns with equal numbers
are ordered by role, then by SHA-256 of the turn; repeated rows are turns of their own; conversations
without turns of their own do not appear, those that lose all turns when rebuilt end at the root. No
conversations, no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import count_words, saved, ship
from graphloom.llm.mixing import running

#: Turns whose prefixes one task puts together.
STRETCH = 4096
_NODE = ["depth", "a", "b"]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (turns of the conversation), key, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), count_words(text).alias("words"))
    rows = running(rows, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()], [], "trie-turns")
    firsts = rows.groupBy("conv_id").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"))
    return rows.join(firsts, "conv_id").select("conv_id", (F.col("_row") - F.col("_first") + 1).alias("pos"), "n", "key", "words")


def rebuilt(turns: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of their family's head (conv_id - conv_id % family; h is
    crc32 of the id modulo ``shared``) and go on with their own turns after the first h:
    (conv_id, pos, key, words) and (conv_id, length)."""
    head = F.col("conv_id") - F.col("conv_id") % family
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("head", head).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % shared)
    counts = convs.select(F.col("conv_id").alias("head"), F.col("n").alias("_m"))
    taken = F.least("h", F.coalesce("_m", F.lit(0)))
    length = taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = saved(convs.join(counts, "head", "left").select("conv_id", "head", "h", taken.alias("taken"), length.alias("length")), "trie-convs")
    opening = turns.where(F.col("pos") < shared).select(F.col("conv_id").alias("head"), "pos", "key", "words")
    opening = opening.join(convs.where("taken > 0").select("conv_id", "head", "h"), "head").where("pos <= h").select("conv_id", "pos", "key", "words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words")
    return opening.unionByName(own), convs.select("conv_id", "length")


def along(rows: DataFrame, key: str, place: str, columns: Sequence[str], agg) -> DataFrame:
    """rows with each of ``columns`` replaced by its aggregate over the rows of its key up to its place (from 1). What lies
    before a stretch is worked out from one row for each stretch."""
    rows = rows.withColumn("_s", F.floor((F.col(place) - 1) / STRETCH))
    before = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(key, "_s").agg(*[agg(c).alias(f"_w{c}") for c in columns])
    long = rows.where("_s > 0").select(key).distinct()
    carried = whole.join(long, key, "left_semi").select(key, "_s", *[agg(f"_w{c}").over(before).alias(f"_c{c}") for c in columns])
    inside = Window.partitionBy(key, "_s").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*[c for c in rows.columns if c not in columns], *[agg(c).over(inside).alias(c) for c in columns])
    rows = rows.join(carried, [key, "_s"], "left")
    zero = F.lit(0).cast("long")
    both = {c: agg_pair(agg, F.col(c), F.coalesce(f"_c{c}", zero)) for c in columns}
    return rows.withColumns(both).drop("_s", *[f"_c{c}" for c in columns])


def agg_pair(agg, x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y) if agg is F.bit_xor else x + y


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the digest of the first depth turns) and the words of the last one."""
    hashed = turns.select("conv_id", F.col("pos").alias("depth"), *[F.xxhash64(F.lit(i), "pos", "key").alias(c) for i, c in enumerate("ab", 1)], "words")
    return saved(along(hashed, "conv_id", "depth", ["a", "b"], F.bit_xor), "trie-prefixes")


def first_owned(paths: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, length, first: the first depth that the conversation owns, length + 1 if it owns none."""
    state = convs.where("length > 0").select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high"))
    owners = minima.select(*_NODE, "owner")
    settled = []
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        probes = state.withColumn("depth", middle).join(paths.drop("words"), ["conv_id", "depth"]).join(owners, _NODE)
        owned = F.col("owner") == F.col("conv_id")
        low, high = F.when(owned, F.col("low")).otherwise(F.col("depth") + 1), F.when(owned, F.col("depth")).otherwise(F.col("high"))
        state = saved(probes.select("conv_id", "length", low.alias("low"), high.alias("high")), "trie-search")
        settled.append(state.where("low = high"))
        state = state.where("low < high")
        if state.isEmpty():
            found = reduce(DataFrame.unionByName, settled)
            return found.select("conv_id", "length", F.col("low").alias("first"))


def summed_up(chains: DataFrame, sums: Sequence[str]) -> DataFrame:
    """conv_id and ``sums`` added up over the chain and all that hang on it, at any distance; ``up`` is the owner of what a
    chain hangs on, null at the top. After k rounds a chain has the sums of all within 2^k steps below it."""
    state = chains.select("conv_id", "up", *sums)
    while not state.where("up is not null").isEmpty():
        gained = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"_g{c}") for c in sums])
        jumps = state.select(F.col("conv_id").alias("up"), F.col("up").alias("_next"))
        state = state.join(gained, "conv_id", "left").join(jumps, "up", "left")
        state = saved(state.select("conv_id", F.col("_next").alias("up"), *[(F.col(c) + F.coalesce(f"_g{c}", F.lit(0).cast("long"))).alias(c) for c in sums]), "trie-sums")
    return state.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(3)]
        ids = batch.column(3).to_pylist()
        new = np.ones(len(ids), dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        heads = np.flatnonzero(new)
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(heads, [*heads[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[heads]) for k in keys], pa.array([ids[i] for i in heads], pa.int64()), pa.array(texts, pa.string())], [*_NODE, "lowest", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a node stand together, in order; only the hash so far is kept between them."""
    now, sha = None, None
    for batch in batches:
        done = []
        for key, ids in zip(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True), batch.column(4).to_pylist(), strict=True):
            if key != now:
                if sha:
                    done.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _hash_rows(done)
    if sha:
        yield _hash_rows([(*now, sha.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*_NODE, "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id) to (depth, a, b, ends_sha256): of the ids in ascending order, comma-joined."""
    ship(ends.sparkSession)
    node = "depth long, a long, b long"
    pieces = ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(_pieces, f"{node}, lowest long, ids string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "lowest").mapInArrow(_hashes, f"{node}, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as (conv_id, pos, key, words) and (conv_id, length): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    zero = F.lit(0).cast("long")
    paths = prefixes(turns)
    minima = saved(paths.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "trie-minima")
    own = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))

    firsts = first_owned(paths, minima, convs).where("first <= length")
    hung = firsts.withColumn("depth", F.col("first") - 1).join(paths.drop("words"), ["conv_id", "depth"]).join(minima.select(*_NODE, F.col("owner").alias("up")), _NODE)
    chains = firsts.join(hung.select("conv_id", "up"), "conv_id", "left")
    weights = own.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    chains = saved(chains.join(weights, "conv_id"), "trie-chains")
    below = chains.where("up is not null").select(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("length")).distinct()
    ends_in_leaf = below.withColumn("_open", F.lit(True))
    chains = saved(chains.join(ends_in_leaf, ["conv_id", "length"], "left").withColumn("leaves", F.when(F.col("_open"), zero).otherwise(F.lit(1).cast("long"))).drop("_open"), "trie-leaves")

    totals = summed_up(chains, ["leaves", "saved"])
    hanging = chains.where("up is not null").select("conv_id", "up", (F.col("first") - 1).alias("depth")).join(totals, "conv_id")
    hanging = hanging.groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    nodes = own.join(chains.select("conv_id", "first", "length", "up"), "conv_id").join(hanging, ["conv_id", "depth"], "left")
    last = F.col("depth") == F.col("length")
    nodes = nodes.select(
        "conv_id", "depth", "n_convs", (F.col("length") - F.col("depth") + 1).alias("_place"), F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"),
        (F.coalesce("_n", zero) + F.when(last, zero).otherwise(1)).alias("n_children"),
        (F.coalesce("_leaves", zero) + F.when(last & F.col("_n").isNull(), F.lit(1).cast("long")).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_saved", zero)).alias("saved_tokens"),
    )
    nodes = along(nodes, "conv_id", "_place", ["n_leaves", "saved_tokens"], F.sum).drop("_place")

    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    tops = chains.agg(F.sum(F.col("up").isNull().cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = root.join(F.broadcast(tops)).select(  # one row beside one row
        "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(None).cast("long").alias("parent_conv_id"),
        F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
    )
    top = root.first()
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(top["conv_id"] if top else None).cast("long")))

    ends = convs.where("length > 0").withColumnRenamed("length", "depth").join(paths.drop("words"), ["conv_id", "depth"])
    ends = ends.unionByName(convs.where("length = 0").select("conv_id", *[zero.alias(c) for c in _NODE]))
    owners = minima.select(*_NODE, "owner").unionByName(root.select("depth", zero.alias("a"), zero.alias("b"), F.col("conv_id").alias("owner")))
    hashes = end_hashes(ends).join(owners, _NODE).select(F.col("owner").alias("conv_id"), "depth", "ends_sha256")
    out = nodes.unionByName(root).join(hashes, ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """The trie of rebuilt conversations (see ``rebuilt``)."""
    turns, convs = rebuilt(saved(placed_turns(conversations), "trie-placed"), family, shared)
    return prefix_trie(turns, convs)
