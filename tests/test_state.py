import os
import random

from graphloom.streaming import state


def _stream(spark, rows, schema, folder, batches):
    """A stream of the batches that the rows are dealt into, a file each, the oldest first."""
    for n, batch in enumerate(batches):
        spark.createDataFrame([rows[i] for i in batch], schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if os.path.getmtime(f"{folder}/{name}") > 10_000:  # just written
                os.utime(f"{folder}/{name}", (n + 1, n + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_upserts_do_not_depend_on_batches(spark, tmp_path):
    schema = "id string, name string, seq long"
    rows = [("a", "x", 1), ("a", "y", 3), ("b", "x", 2), ("a", "z", 2), ("b", "w", 2), (None, "n", 1), ("c", None, None), ("a", "y", 3), ("c", None, None), (None, "m", 0)]
    want = {("a", 3, "y"), ("b", 2, "x"), (None, 1, "n"), ("c", None, None)}
    dealings = [[range(10)], [[9, 8, 7, 6, 5], [4, 3, 2, 1, 0]], [[1], [0, 2, 3], [4, 5, 6, 7, 8, 9]]]
    for n, batches in enumerate(dealings):
        log = str(tmp_path / f"log{n}")
        state.upserts(_stream(spark, rows, schema, str(tmp_path / f"in{n}"), batches), log, str(tmp_path / f"c{n}")).awaitTermination()
        got = state.read_log(spark, log, "id string, seq long, name string")
        assert {tuple(r) for r in state.latest(got, "id").collect()} == want
        assert got.select("_batch").distinct().count() == len(batches)


def test_calls_wait_for_their_symbols(spark, tmp_path):
    """Against brute force; calls before and after symbols, a smaller symbol that comes later, a name that most calls have,
    repeated rows, nulls, and a query that goes on from its checkpoint."""
    draw = random.Random(5)
    schema = "kind string, id string, name string"
    rows = [("call", f"c{i}", "hot" if i % 3 else f"n{draw.randrange(6)}") for i in range(60)]
    rows += [("symbol", f"s{draw.randrange(50):02}", draw.choice(["hot", "n0", "n1", "n2", "n3", "quiet"])) for _ in range(20)]
    rows += [("call", "c1", "hot"), ("call", None, "hot"), ("symbol", "s", None), ("other", "a", "hot")]
    best: dict = {}
    for kind, i, name in rows:
        if kind == "symbol" and name is not None:
            best[name] = min(i, best.get(name, i))
    want = {(i, name, best[name]) for kind, i, name in rows if kind == "call" and i is not None and name in best}
    every = list(range(len(rows)))
    mixed = draw.sample(every, len(every))
    half = len(rows) // 2
    for n, (batches, salts) in enumerate([([every[:60], every[60:70], every[70:]], 3), ([mixed[:half], mixed[half:]], 1)]):
        log, source, checkpoint = (str(tmp_path / f"{x}{n}") for x in ("log", "in", "c"))
        for upto in (1, len(batches)):
            stream = _stream(spark, rows, schema, source, batches[:1] if upto == 1 else batches[1:])
            state.resolve_early_calls(stream, log, checkpoint, salts).awaitTermination()
        got = state.latest(state.read_log(spark, log, "call_id string, name string, symbol_id string"), "call_id", "name").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
