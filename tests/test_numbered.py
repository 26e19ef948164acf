"""Records numbered over micro-batches and restarts as in one reading."""

from pyspark.sql import functions as F

from biblioflow.streaming import numbered

SCHEMA = "source string, at long, text string, _error string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, sticky):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    numbered.drain(stream, f"{tmp_path}/out", f"{tmp_path}/check", "source", ["at"], sticky)
    return {(r["source"], r["text"]): (r["index"], r["_error"]) for r in numbered.read(spark, f"{tmp_path}/out").collect()}


def test_places_do_not_depend_on_batches(spark, tmp_path):
    batches = [[(s, 100 * b + k, f"{s}{b}-{k}", None) for k in range(n) for s in ("a", "b")[: 1 + b % 2]] for b, n in enumerate((5, 40, 1, 7))]
    want = {}
    for upto in (2, 2, 4):
        for rows in batches[len(want.get("done", [])) : upto]:
            put(spark, f"{tmp_path}/in", rows)
            want.setdefault("done", []).append(rows)
        got = run(spark, tmp_path, False)
        all_rows = sorted((r for rows in want["done"] for r in rows), key=lambda r: (r[0], r[1]))
        place = {}
        assert got == {(s, t): (place.setdefault(s, []).append(t) or len(place[s]) - 1, None) for s, _, t, _ in all_rows}


def test_errors_last(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("a", 1, "a1", None), ("a", 2, "a2", "bad"), ("a", 3, "a3", None), ("b", 1, "b1", None)])
    first = run(spark, tmp_path, True)
    assert first == {("a", "a1"): (0, None), ("a", "a2"): (1, "bad"), ("a", "a3"): (2, "bad"), ("b", "b1"): (0, None)}
    put(spark, f"{tmp_path}/in", [("a", 4, "a4", None), ("b", 2, "b2", None), ("a", 5, "a5", "worse"), (None, 1, "n", None)])
    got = run(spark, tmp_path, True)
    assert got == first | {("a", "a4"): (3, "bad"), ("a", "a5"): (4, "bad"), ("b", "b2"): (1, None), (None, "n"): (0, None)}


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("a", k, f"t{k}", None) for k in range(300)])
    rows = spark.read.parquet(f"{tmp_path}/in").repartition(7)
    before = spark.createDataFrame([("a", 10, None), ("z", 3, "e")], "source string, next long, error string")
    for _ in range(2):
        out, state = numbered.number(rows, "source", ["at"], before)
        assert [r["index"] for r in out.orderBy("at").collect()] == list(range(10, 310))
        assert {tuple(r) for r in state.collect()} == {("a", 310, None), ("z", 3, "e")}
    assert numbered.number(rows.where(F.lit(False)), "source", ["at"], before)[1].count() == 2
