"""Secret scan: fixed patterns, and Markov models of characters. DataFrame functions only.

Two first-order models, of random strings and of ordinary identifiers, are trained on
labelled samples by counting character pairs; their log-likelihood ratio, one table
over the pairs, scores the long tokens of a text. Tokens over the threshold that touch
no pattern match are added.

Spans come from what lies between matches: splitting at a pattern gives the gaps,
extracting gives the matches, and running sums of both lengths give code point
positions. The sums run over (document, kind) windows of matches only; the text is read
once and never shuffled.

Defined results: a null text counts as empty. Rows that share doc_id and text get the
same result, one row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed patterns. A match counts if its measured part is long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words of ordinary identifiers in the labelled samples.
IDENTIFIER_WORDS = (
    "get set user name list index count value data file path node edge graph token type class method function param "
    "result error message request response handler service client server config option default update create delete "
    "insert select query table column record field string number integer boolean object array buffer stream reader "
    "writer parser format encode decode hash cache store session context manager factory builder provider listener "
    "event action state status code version module package import export source target parent child first last next "
    "previous start stop begin end open close read write load save send receive connect check validate verify test "
    "example sample simple common general special internal external public private static dynamic global local "
    "temporary permanent language translation communication development information international responsibility "
    "transformation representation implementation understanding consideration "
    "black white green yellow night morning winter summer weather travel airport hotel station bridge village castle garden "
    "forest island beach ocean coffee breakfast dinner bread butter cheese apple orange lemon sugar knowledge question answer "
    "school teacher student history science physics chemistry biology music guitar piano theatre museum picture camera video "
    "journey adventure business company market product price money account credit payment contract lawyer judge doctor nurse "
    "hospital medicine health hockey football cricket tennis swimming jazz zebra quiz exact equal quality quantity unique technique"
).split()
SAMPLES = 6000
#: Natural logarithm units per character and in all that a token must reach.
MIN_RATE, MIN_TOTAL = 0.35, 9.0


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """value, random: n random strings in the usual encodings and n harmless ones, made by rule. Harmless are identifiers,
    and what looks random to a model of identifiers alone: UUIDs, dates, long numbers, stretches of the alphabet, ruled lines. Hexadecimal
    strings are no random samples: the base pattern finds those, and what is left of them in texts is UUIDs and digests."""
    rows = spark.range(n)
    raw = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    code = F.base64(F.unhex(raw))
    plain = F.translate(code, "+/=", "")
    strings = F.array(code, F.substring(plain, 1, 24), plain, F.translate(code, "+/", "-_"), F.upper(F.substring(plain, 1, 32)))
    random = rows.select(F.get(strings, (F.col("id") % 5).cast("int")).alias("value"), F.lit(True).alias("random"))
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    drawn = lambda i, below: F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(below))
    picked = [F.get(words, drawn(i, len(IDENTIFIER_WORDS)).cast("int")) for i in range(4)]
    capital = [F.initcap(x) for x in picked]
    number = F.pmod(F.xxhash64("id"), F.lit(2000)).cast("string")
    uuid = F.concat_ws("-", *[F.substring(raw, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    padded = lambda i, low, count: F.lpad((drawn(i, count) + low).cast("string"), 2, "0")
    date = F.concat((drawn(4, 60) + 1980).cast("string"), F.lit("-"), padded(5, 1, 12), F.lit("-"), padded(6, 1, 28), F.lit("T"), padded(7, 0, 24), F.lit("-"), padded(8, 0, 60), F.lit("-"), padded(9, 0, 60), F.lit("Z"))
    digits = F.concat(*[F.lpad(drawn(i, 10**8).cast("string"), 8, "0") for i in (10, 11, 12)])
    stretch = F.substr(F.lit(ALPHABET), (drawn(13, 30) + 1).cast("int"), F.lit(32))
    line = F.repeat(F.substr(F.lit(ALPHABET), (drawn(14, len(ALPHABET)) + 1).cast("int"), F.lit(1)), 32)
    names = F.array(
        F.concat_ws("_", *picked), F.concat(picked[0], *capital[1:]), F.concat(*capital), F.concat(*picked), F.concat_ws("-", *picked),
        F.upper(F.concat_ws("_", *picked[:3])), F.concat_ws("/", *picked), F.concat(*picked[:3], F.lit("_"), number), F.concat(*picked),
        uuid, F.upper(uuid), date, digits, stretch, line,
    )
    names = rows.select(F.get(names, (F.col("id") % 15).cast("int")).alias("value"), F.lit(False).alias("random"))
    return random.union(names)


def _codes(value: Column) -> Column:
    """Places of the characters in the alphabet, from 0."""
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), value.substr(i, F.lit(1))) - 1)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each pair of characters, the first one's row by row.
    Counts come to the driver, at most two for each pair of the alphabet."""
    n = len(ALPHABET)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, 2)))
    rows = samples.where(F.length("value") > 1).select("random", pair.alias("pair")).groupBy("random", "pair").count().collect()
    counts = {kind: [[smoothing] * n for _ in range(n)] for kind in (True, False)}
    for r in rows:
        a, b = (ALPHABET.find(c) for c in r["pair"])
        if a >= 0 and b >= 0:
            counts[r["random"]][a][b] += r["count"]
    return [math.log(x / sum(one)) - math.log(y / sum(two)) for one, two in zip(counts[True], counts[False], strict=True) for x, y in zip(one, two, strict=True)]


def likelihood_ratio(value: Column, table: list[float]) -> Column:
    """Sum of the table over a token's pairs of characters."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    n = len(ALPHABET)
    codes = _codes(value)
    step = F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
        lambda acc, c: F.struct(
            (acc["sum"] + F.when(acc["last"] >= 0, F.get(ratios, acc["last"] * n + c)).otherwise(0.0)).alias("sum"), c.alias("last")
        ),
    )
    return step["sum"]


def _hits(text: Column, pattern: str, kind: str, keep) -> Column:
    """kind, number, gap before the match and its length, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), keep(found).alias("keep"))
    rows = F.transform(
        F.slice(parts, F.lit(1), F.size(found)),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), x["keep"].alias("keep")),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,keep:boolean>>"))


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base (pattern spans) and spans (all),
    as kind:start:end by start, then kind, joined by commas."""
    table = table or train(labelled_samples(docs.sparkSession))
    text = F.col("_text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_t", F.xxhash64("_text"))

    def long_value(found: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)

    def random_token(found: Column) -> Column:
        def judged(v: Column) -> Column:
            score = likelihood_ratio(v, table)
            return (score >= MIN_TOTAL) & (score >= MIN_RATE * (F.length(v) - 1))

        return F.transform(found, judged)

    hits = F.concat(
        _hits(text, ASSIGN, "assign", long_value),
        _hits(text, ACCESS, "access", lambda found: F.transform(found, lambda v: F.length(v) >= 20)),
        _hits(text, HEX, "hex", lambda found: F.transform(found, lambda v: F.lit(True))),
        _hits(text, TOKEN, "markov", random_token),
    )
    # repeated rows give the same hits, which count once
    each = rows.select("doc_id", "_t", F.explode(hits).alias("h")).select("doc_id", "_t", "h.*")
    each = each.groupBy("doc_id", "_t", "kind", "i").agg(*[F.first(c).alias(c) for c in ("gap", "len", "keep")])
    upto = Window.partitionBy("doc_id", "_t", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len")).where("keep")
    order = Window.partitionBy("doc_id", "_t").orderBy("start", "kind")
    base = F.col("kind") < KINDS.index("markov")
    reached = F.coalesce(F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumn("_reached", reached).withColumn("_ahead", ahead).where(base | ((F.col("_reached") <= F.col("start")) & (F.col("_ahead").isNull() | (F.col("_ahead") >= F.col("end")))))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    label = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("label"))
    per = spans.groupBy("doc_id", "_t").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"_n{i}") for i in range(len(KINDS))],
        F.array_sort(F.collect_list(F.when(base, label))).alias("_base"),
        F.array_sort(F.collect_list(label)).alias("_all"),
    )
    ids = rows.select("doc_id", "_t")
    per = per.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_h"), *[c for c in per.columns if c not in ("doc_id", "_t")])
    joined = ids.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left")
    text_of = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["label"]), ","), F.lit(""))
    return joined.select("doc_id", *[F.coalesce(f"_n{i}", F.lit(0)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)], text_of("_base").alias("base"), text_of("_all").alias("spans"))
