"""Line dedup: drop lines that other documents hold too. DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits. A partial aggregate finds,
for each hash, the smallest and largest document (or the number of documents), so a
line that a third of all documents share is one row per task before the shuffle.
Only hashes over the threshold are joined back, as (document, position) rows without
text; Spark's skew-join handling splits hot hashes. The text itself is shuffled once,
to be reassembled by position.

Defined results: a null or empty text is one empty line and is never dropped. Rows
with the same doc_id are one document; rows with a null doc_id are together one
document that comes after all others. Repeated rows get the same result each. Other
columns of the input do not matter, whatever their names, and come back as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, saved, whole_row

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = 2**63 - 1


def line_key(line):
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _UPPER.lower())


def _reassembled(docs: DataFrame, min_chars: int, min_docs: int, short: bool = False) -> DataFrame:
    """The rows of docs with _n (lines), _dropped and _kept (the text without them).
    With ``short``, also _own: the lines that no earlier document holds, whatever their
    length, blank lines aside."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    rows = docs.withColumns({"_d": doc, "_text": text})
    # the text's hash keeps rows apart that share a doc_id but not a text
    rows = rows.withColumn("_t", F.xxhash64("_text"))
    lines = (
        rows.select("_d", "_t", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
        .select("_d", "_t", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= (1 if short else min_chars))
        .select("_d", "_t", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), *([(F.length("_key") >= min_chars).alias("_judged")] if short else []))
    )
    if min_docs == 2:
        seen = lines.groupBy("_h1", "_h2").agg(F.min("_d").alias("_first"), F.max("_d").alias("_other"))
        repeated = seen.where(F.col("_first") < F.col("_other"))
    else:
        once = lines.groupBy("_h1", "_h2", "_d").agg(F.lit(1).alias("_one"))
        repeated = once.groupBy("_h1", "_h2").agg(F.min("_d").alias("_first"), F.count("_one").alias("_k")).where(F.col("_k") >= min_docs)
    # a written table, so that both sides of the join are plain exchanges and hot hashes can be split
    repeated = saved(repeated.select("_h1", "_h2", "_first"), "repeated-lines")
    dropped = (
        lines.join(repeated, ["_h1", "_h2"])
        .where(F.col("_d") > F.col("_first"))
        .groupBy("_d", "_t")
        .agg(*([F.collect_set(F.when(F.col("_judged"), F.col("_pos"))).alias("_gone"), F.collect_set("_pos").alias("_held")] if short else [F.collect_set("_pos").alias("_gone")]))
    )
    joined = rows.join(dropped.hint("shuffle_hash"), ["_d", "_t"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_parts"), i)), "\n"))
    joined = joined.withColumn("_parts", F.split("_text", "\n", -1)).withColumn("_n", F.size("_parts"))
    filled = F.filter("_parts", lambda x: F.length(line_key(x)) > 0)
    own = F.size(filled) - F.coalesce(F.size("_held"), F.lit(0)) if short else None
    return joined.select(*[F.col(c) for c in docs.columns], "_n", F.coalesce(F.size("_gone"), F.lit(0)).alias("_dropped"), kept.alias("_kept"), *([own.alias("_own")] if short else []))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text without the
    dropped lines). A line is dropped if its key has at least ``min_chars`` code
    points and occurs in at least ``min_docs`` documents, except in the smallest
    doc_id that holds it."""
    found = _reassembled(docs.select("doc_id", "text"), min_chars, min_docs)
    return found.select("doc_id", F.col("_n").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), F.col("_kept").alias("kept"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with text (and n_chars, if there) as the lines left make it.
    Rows that lost lines go if nothing of their own is left: every line, those too short
    to be judged too, is blank or stands in an earlier document."""
    found = _reassembled(docs.select(whole_row(docs).alias("row"), "doc_id", "text"), 10, 2, short=True)
    stays = (F.col("_dropped") == 0) | (F.col("_own") > 0)
    row = F.col("row").withField("text", F.when(F.col("_dropped") > 0, F.col("_kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("_dropped") > 0, F.length("_kept").cast("long")).otherwise(F.col("row.n_chars")))
    return found.where(stays).select(row.alias("row")).select("row.*")
