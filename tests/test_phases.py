"""Jobs that are stopped and go on."""

import pytest
from pyspark.sql import functions as F

from corpusmith.operators import phases


def flaky(rows, attempt):
    """Every third item passes at its third attempt, id 7 never, ids divisible by 5 fail for good."""
    again = F.when((F.col("id") % 3 == 0) & (F.lit(attempt) < 2) | (F.col("id") == 7), "Connection reset")
    return rows.withColumn("error", F.coalesce(again, F.when(F.col("id") % 5 == 0, "malformed")))


def outcomes(rows):
    return sorted((-1 if r.id is None else r.id, r.attempt, r.error) for r in rows.collect())


def expected(ids):
    out = []
    for k in ids:
        again = k == 7 or k % 3 == 0
        out.append((k, 2 if again else 0, "Connection reset" if k == 7 else "malformed" if k % 5 == 0 else None))
    return sorted(out)


def test_job(spark, tmp_path):
    rows = phases.run(spark.range(100), phases.Job(str(tmp_path), "id", flaky))
    assert outcomes(rows) == expected(range(100))


def test_stopped_job_goes_on(spark, tmp_path):
    begun = []

    def dies(rows, attempt):
        begun.append(attempt)
        if len(begun) == 6:
            raise KeyboardInterrupt
        return flaky(rows, attempt)

    job = phases.Job(str(tmp_path), "id", dies)
    with pytest.raises(KeyboardInterrupt):
        phases.run(spark.range(100), job)
    # A unit that was being written when the job died does not count.
    half = tmp_path / "outcomes/attempt=0/slice=5"
    spark.range(3).withColumn("error", F.lit("half")).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    # What is given now does not matter: the items were written down.
    rows = phases.run(spark.range(5), job)
    assert outcomes(rows) == expected(range(100)) and len(begun) == 6 + 3 + 16
    assert outcomes(phases.run(spark.range(5), job)) == expected(range(100)) and len(begun) == 25


def test_trial(spark, tmp_path):
    def fails(rows, attempt):
        return rows.withColumn("error", F.when(F.col("id") % 3 != 0, "malformed"))

    with pytest.raises(phases.Refused):
        phases.run(spark.range(400), phases.Job(str(tmp_path / "a"), "id", fails))
    assert [p.name for p in (tmp_path / "a/outcomes/attempt=0").iterdir()] == ["slice=0"]
    assert phases.run(spark.range(400), phases.Job(str(tmp_path / "b"), "id", fails, share=0.2)).count() == 400


def test_null_repeated_and_no_items(spark, tmp_path):
    frame = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, 3)], "id long, slice int")
    rows = phases.run(frame, phases.Job(str(tmp_path / "a"), "id", lambda r, a: r.withColumn("error", F.lit(None).cast("string")), trial=0))
    assert sorted((r.id or 0, r.slice) for r in rows.collect()) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert phases.run(spark.range(0), phases.Job(str(tmp_path / "b"), "id", flaky)).count() == 0


def test_may_pass(spark):
    rows = spark.createDataFrame([("HTTP 429",), ("Timeout",), ("malformed",), (None,), ("Server Error 500",)], "e string")
    assert [r[0] for r in rows.select(phases.may_pass(F.col("e"))).collect()] == [True, True, False, False, True]
