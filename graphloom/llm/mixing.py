"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its share of the whole by weight, at most
``cap`` times its size, the excess shared again by weight. Within a source a document's
expected copies are in proportion to its measure, the bit length of its size (so longer
documents are likelier, by their logarithm), ``cap`` at most, and such that the expected
words are the target. The whole part of the expected copies is certain; one more copy is
drawn with the rest as inclusion probability. For the draw, documents are ranked by
random odds over inclusion odds, and the lowest ranks are taken until the source's
remaining words are used up, so the sample's size is fixed, in words.

The rate of a source comes from its words per measure (64 rows at most). The cut on its
ranks is found without sorting it: word sums over 4,096 rank bins, then over 4,096 bins
inside the one bin that holds the cut, then the few rows of that last bin. A source has
one row; applying it is a comparison. Sources themselves are ranked and summed over range
partitions, so there may be many.

Defined results: a null text has size 0; documents of size 0 are not drawn and get the
copies that are certain for the smallest measure. A null source is a source of its own, the last.
Rows that agree in doc_id and size get the same decision. Draws depend on doc_id
and the seed only, so reruns agree. An empty table gives an empty table. Other columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import count_words, saved

_BITS = 52
#: Sources up to this many are broadcast to the documents; more are joined by shuffle.
MAX_BROADCAST_SOURCES = 20_000
_SIZES = ("_doc", "_source", "_size", "_u")


def _hash52(*cols: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("long")


def draw(seed: str, doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the document alone."""
    return (_hash52(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))) + F.lit(0.5)) / F.lit(float(2**_BITS))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """_doc, _source, _size, the draw _u, and row, the columns of docs."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_doc"),
        F.col("source").cast("string").alias("_source"),
        count_words(F.col("text")).alias("_size"),
        draw(seed, F.col("doc_id")).alias("_u"),
        F.struct("*").alias("row"),
    )


def measure(size: Column) -> Column:
    return F.length(F.bin(size))


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str], name: str) -> DataFrame:
    """df with _row, the place of each row in the order, and for each of ``sums`` (columns)
    the sum over the rows before it, as before_<column>. Range partitions are written, their sums
    (a row each) are added up, and rows are added up within their partitions."""
    parts = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    counted = ["_one", *sums]
    totals = parts.withColumn("_one", F.lit(1).cast("long")).groupBy("_part").agg(*[F.sum(c).alias(f"_t{c}") for c in counted])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t{c}").over(before), zero).alias(f"_s{c}") for c in counted])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_one", F.lit(1).cast("long")).join(F.broadcast(starts), "_part")
    found = [(F.col(f"_s{c}") + F.coalesce(F.sum(c).over(inside), zero)).alias("_row" if c == "_one" else f"before_{c}") for c in counted]
    return rows.select(*df.columns, *found)


def source_targets(sizes: DataFrame, weights: Sequence[int], ratio: float, cap: int) -> DataFrame:
    """_source, source_size, target: water filling in closed form. Sources fill up in
    the order of cap * size / weight; a level is the words per weight that a source
    and those after it get if those before it are full. It rises up to the first source
    that does not fill up and falls after it, so the level of the mix is the largest."""
    per = running(sizes.groupBy("_source").agg(F.sum("_size").alias("source_size")), [F.col("_source").asc_nulls_last()], [], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_row") % len(weights)).cast("int") + 1).cast("long")
    per = per.withColumn("_w", weight).withColumn("_full", F.col("source_size") * cap).withColumn("_fill", F.col("_full") / F.col("_w"))
    per = per.withColumnRenamed("_row", "_rank")
    filled = saved(running(per, [F.col("_fill"), F.col("_rank")], ["_full", "_w"], "mix-fill"), "mix-levels")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    level = (F.lit((whole["size"] or 0) * float(ratio)) - F.col("before__full")) / (F.lit(whole["w"] or 0) - F.col("before__w"))
    top = filled.agg(F.max(level)).first()[0] or 0.0
    return filled.select("_source", "source_size", F.least(F.col("_full").cast("double"), F.col("_w") * F.lit(float(top))).alias("target"))


def expected(cap: int) -> Column:
    """Expected copies of a document of a source with its rate."""
    return F.least(F.lit(float(cap)), F.col("_rate") * measure(F.col("_size")))


def source_rates(sizes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """targets with _rate, the copies per unit of measure, and _rest, the words left to draw
    when certain copies are taken. Water filling again: the largest measures reach the cap first."""
    per = sizes.where("_size > 0").groupBy("_source", measure(F.col("_size")).alias("_m")).agg(F.sum("_size").alias("_words"))
    per = per.join(targets.select(F.col("_s").alias("_s"), "target"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    own = Window.partitionBy("_source")
    larger = own.orderBy(F.col("_m").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = own.orderBy(F.col("_m").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = (F.col("target") - cap * F.coalesce(F.sum("_words").over(larger), F.lit(0).cast("long"))) / F.sum(F.col("_m") * F.col("_words")).over(smaller)
    per = per.withColumn("_r", rate).withColumn("_rate", F.max("_r").over(own))
    certain = F.floor(F.least(F.lit(float(cap)), F.col("_rate") * F.col("_m"))) * F.col("_words")
    rates = per.groupBy(F.col("_source").alias("_s4")).agg(F.max("_rate").alias("_rate"), F.sum(certain).alias("_certain"))
    return (
        targets.join(rates, F.col("_s").eqNullSafe(F.col("_s4")), "left")
        .select("_s", "source_size", "target", F.coalesce("_rate", F.lit(0.0)).alias("_rate"), F.greatest(F.col("target") - F.coalesce("_certain", F.lit(0)), F.lit(0.0)).alias("_rest"))
    )


def _ranked(df: DataFrame, cap: int) -> DataFrame:
    """_copies (certain) and _q, the rank in [0, 2**52), of documents joined to their source."""
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_pi") / (1 - F.col("_pi")))
    return (
        df.withColumn("_e", expected(cap))
        .withColumn("_copies", F.floor("_e").cast("long"))
        .withColumn("_pi", F.col("_e") - F.col("_copies"))
        .withColumn("_odds", F.when((F.col("_pi") > 0) & (F.col("_size") > 0), odds))
        .withColumn("_q", F.floor(F.col("_odds") / (1 + F.col("_odds")) * F.lit(float(2**_BITS))).cast("long"))
    )


def _attach(df: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    side = F.broadcast(sources) if small else sources
    return df.join(side, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")


def mix_cuts(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), ratio: float = 1.0, cap: int = 3) -> tuple[DataFrame, bool]:
    """One row per source with its target, rate and the cut on the ranks; whether it is small.
    ``sizes`` has _doc, _source, _size, _u and is read several times."""
    targets = source_targets(sizes, weights, ratio, cap).withColumnRenamed("_source", "_s")
    sources = saved(source_rates(sizes, targets, cap), "mix-rates")
    small = sources.count() <= MAX_BROADCAST_SOURCES
    ranked = _ranked(_attach(sizes, sources, small), cap).where(F.col("_q").isNotNull())

    def crossing(df: DataFrame, start: Column, out: str) -> DataFrame:
        """Per source, the bin in which the running sum of words passes _rest."""
        bins = df.groupBy("_source", "_bin").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"), F.first(start).alias("_from"))
        w = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_start", F.col("_from") + F.coalesce(F.sum("_words").over(w), F.lit(0).cast("long")))
        hit = bins.where((F.col("_start") <= F.col("_rest")) & (F.col("_start") + F.col("_words") > F.col("_rest")))
        return hit.groupBy(F.col("_source").alias("_s")).agg(F.min_by(F.struct(F.col("_bin").alias("bin"), F.col("_start").alias("start")), "_bin").alias(out))

    first = saved(crossing(ranked.withColumn("_bin", F.shiftright("_q", 40)), F.lit(0).cast("long"), "_c1"), "mix-cut1")
    inside = _attach(ranked, first, small).where(F.shiftright("_q", 40) == F.col("_c1.bin"))
    second = saved(crossing(inside.withColumn("_bin", F.shiftright("_q", 28)), F.col("_c1.start"), "_c2"), "mix-cut2")
    edge = _attach(ranked, second, small).where(F.shiftright("_q", 28) == F.col("_c2.bin"))
    key = F.struct(F.col("_q").alias("q"), F.col("_doc").alias("doc"), F.col("_size").alias("size"))
    before = Window.partitionBy("_source").orderBy("_q", "_doc", "_size")
    taken = (
        edge.withColumn("_cum", F.sum("_size").over(before.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_same", F.sum("_size").over(Window.partitionBy("_source", "_q", "_doc", "_size")))
        .withColumn("_before", F.col("_c2.start") + F.col("_cum") - F.col("_same"))
        .where(2 * F.col("_before") + F.col("_size") <= 2 * F.col("_rest"))
        .groupBy(F.col("_source").alias("_s3"))
        .agg(F.max(key).alias("_last"))
    )
    none = F.struct((F.shiftleft(F.col("_c2.bin"), 28) - 1).alias("q"), F.lit(2**63 - 1).alias("doc"), F.lit(2**63 - 1).alias("size"))
    cuts = (
        sources.join(second.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left")
        .join(taken, F.col("_s").eqNullSafe(F.col("_s3")), "left")
        # without a crossing, what can be drawn has no more words than are to be drawn
        .select("_s", "source_size", "target", "_rate", F.col("_c2").isNull().alias("_all"), F.coalesce("_last", none).alias("_cut"))
    )
    return saved(cuts, "mix-cuts"), small


def apply_cuts(rows: DataFrame, cuts: DataFrame, small: bool, cap: int = 3) -> DataFrame:
    """Adds source_size, target, copies and taken to ``sized`` rows."""
    df = _ranked(_attach(rows, cuts, small), cap)
    key = F.struct(F.col("_q").alias("q"), F.col("_doc").alias("doc"), F.col("_size").alias("size"))
    drawn = F.col("_q").isNotNull() & (F.col("_all") | (key <= F.col("_cut")))
    df = df.withColumn("copies", F.col("_copies") + drawn.cast("long"))
    return df.withColumn("taken", F.col("copies") * F.col("_size"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), ratio: float = 1.0, cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    sizes = saved(sized(docs.select("doc_id", "source", "text"), seed).select(*_SIZES, F.col("row.doc_id").alias("doc_id")), "mix-sizes")
    cuts, small = mix_cuts(sizes, weights, ratio, cap)
    found = apply_cuts(sizes, cuts, small, cap)
    return found.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies", "taken")


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), ratio: float = 1.0, cap: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, with copy (from 1), words and
    source_target; columns of docs of these names give way."""
    rows = sized(docs, seed)
    cuts, small = mix_cuts(saved(rows.select(*_SIZES), "mix-sizes"), weights, ratio, cap)
    taken = apply_cuts(rows, cuts, small, cap).where(F.col("copies") > 0)
    new = {"copy": F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "words": F.col("_size"), "source_target": F.col("target")}
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in new], *[c.alias(k) for k, c in new.items()])
