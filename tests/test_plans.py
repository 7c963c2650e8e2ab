"""Plans stay small enough for the driver: shared views are read, not repeated at every use."""

import pytest

from cellmill import queries as own


MOST = {"p5_paired_batch": 100, "p5b_batch_checks": 100, "d12_missing_token_policy": 20, "prj12_valid_mask": 20, "d9_process_batch": 20, "join10_tokens": 20, "p7_masked_values": 20, "p6_prepend_cls": 20}


@pytest.mark.parametrize("name", MOST)
def test_exchanges(spark, sf, name):
    plan = own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange ") <= MOST[name]


def test_batch_checks_find_each_fault(spark):
    from cellmill.operators import pairs as pa

    paired = spark.createDataFrame([(1, 5), (2, 6)], "source_row long, target_row long")
    cols = "source_row long, target_row long, seq int, source_size_factor double, target_size_factor double"
    good = [(1, 5, 0, 1.0, 1.0), (1, 5, 1, 1.0, 1.0), (2, 6, 0, 1.0, 1.0), (2, 6, 1, 1.0, 1.0)]
    bad = lambda rows: {r["check"] for r in pa.check_batch(paired, spark.createDataFrame(rows, cols), 2).collect() if not r["ok"]}
    assert bad(good) == set()
    assert bad(good[:3]) == {"shape"}
    assert bad(good[:2]) == {"sources"}
    assert bad([*good[:2], (2, 7, 0, 1.0, 1.0), (2, 7, 1, 1.0, 1.0)]) == {"pairs"}
    assert bad([*good[:2], (2, None, 0, 1.0, 1.0), (2, None, 1, 1.0, 1.0)]) == {"pairs"}
    assert bad([*good, (3, 5, 0, 1.0, 1.0), (3, 5, 1, 1.0, 1.0)]) == {"pairs"}
    assert bad([*good[:3], (2, 6, 1, 0.0, 1.0)]) == {"size_factors"}


def test_exported_source_is_read_without_joins(spark, sf):
    from cellmill.plans.views import Corpus
    from cellmill.queries.storage import _source

    c = Corpus(spark, sf)
    source = _source(c, c.ledger.first()["dataset_id"])
    for df in (source.obs, source.var, source.values):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def _jobs(spark, group, f):
    """How many jobs f starts, in threads of its own too."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_inspection_takes_few_jobs(spark, sf):
    from cellmill.plans.views import Corpus
    from cellmill.queries.storage import _source
    from cellmill.sources import build as bu

    c = Corpus(spark, sf)
    source = _source(c, c.ledger.first()["dataset_id"])
    assert 0 < _jobs(spark, "inspection", lambda: bu.inspect(source, "d")) <= 40


def test_together_ends_all_and_raises_the_first():
    from cellmill.plans.together import together

    done = []
    assert together(lambda: 1, lambda: 2, lambda: 3, lambda: 4) == [1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1 // 0, lambda: done.append(1), lambda: done.append(2), lambda: done.append(3), lambda: [][0])
    assert sorted(done) == [1, 2, 3]
