from tidemark.ml import evaluate
from tidemark.plans import reference

DIR = "/root/testdata/sf0.001"


def test_the_query_runs_a_thousand_trials(spark):
    got = reference.QUERIES["ev_random_baseline"](spark, DIR).first()
    p = reference._preds(spark, DIR)
    assert got == evaluate.random_baseline(p, trials=1000).first() != evaluate.random_baseline(p, trials=200).first()
