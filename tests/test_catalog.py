"""Every query with SQL against DuckDB; the others give rows, and those with another form are held against it."""

import pytest

from tests.compare import assert_same, connection
from veridica.plans import library, reports  # noqa: F401
from veridica.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    assert_same(spark, sf, con, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_bootstrap_takes_all_rows_and_replicates(spark, sf):
    import hashlib

    import numpy as np

    from veridica.operators.stats import POISSON
    from veridica.sources import views

    rows = views.beliefs(spark, sf).select("vec_id", "truth", "predicted").collect()
    d = np.array([float(r.truth == r.predicted) - float(r.vec_id % 3 != 0) for r in rows])
    assert len(d) > 300
    draws = np.array([[int(hashlib.md5(f"42-{k}-{r.vec_id}".encode()).hexdigest()[:8], 16) for r in rows] for k in range(1000)])
    w = np.searchsorted(POISSON, draws, side="right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    means = ((w * d).sum(axis=1) / w.sum(axis=1)).round(9)
    want = (d.mean(), *np.quantile(means, [0.025, 0.975]), min(1, 2 * min((means <= 0).mean(), (means >= 0).mean())))
    assert tuple(QUERIES["bootstrap_ci"](spark, sf).first()) == pytest.approx(want, abs=2e-6)


def test_stream_in_event_time(spark, tmp_path):
    """Batches out of order within the delay give the fold in order; a row from before the delay is told and changes nothing."""
    from pyspark.sql import functions as F

    from veridica.functions.vec import transition_matrix
    from veridica.operators.temporal import Fold
    from veridica.streaming.tracking import closing, track

    schema = "user_id long, at long, event_id long, belief array<double>"
    belief = lambda k: [0.5 if j == k % 6 else 0.1 for j in range(6)]
    second = 1_000_000
    batches = [[2, 0, 1], [5, 3, 4], [9, 8], [1], [7, 30]]  # the second 1 is 8 seconds old when it comes
    for n, b in enumerate(batches):
        rows = [(u, t * second, 100 * n + t, belief(t + u)) for t in b for u in (1, 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = track(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), delay=4)
        run.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        told = {(r.event_id, r.late) for r in spark.read.parquet(str(tmp_path / "out")).where("user_id = 1").collect()}
        if n == 0:
            assert told == set()  # all wait
    assert (301, True) in told and (430, False) not in told
    closing(spark.createDataFrame([(1,), (2,)], "user_id long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), delay=4)
    run.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    step, last = Fold(transition_matrix(6)), None
    got = {r.event_id: r.confidence for r in spark.read.parquet(str(tmp_path / "out")).where("user_id = 2 and not late").orderBy("event_id").collect()}
    times = sorted((t, 100 * n + t) for n, b in enumerate(batches) for t in b if n != 3)
    assert set(got) == {i for _, i in times}
    for t, i in times:
        last = step(last, belief(t + 2))
        assert got[i] == pytest.approx(max(last), abs=1e-12)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("late")).count() == 2
