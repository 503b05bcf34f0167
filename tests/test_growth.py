"""What keeps queries from growing faster than their input."""

from __future__ import annotations

import math
import pickle

import numpy as np

import pandas as pd
from pyspark.sql import functions as F

from driftlex.operators import rates, scoring, sensemodel
from driftlex.operators.kwic import count_targets
from driftlex.operators.matcher import Matcher
from driftlex.plans import source_queries


def test_stream_files_grow_in_number(spark, data, monkeypatch, tmp_path):
    made = []

    def folder(spark, name):
        made.append(str(tmp_path / name))
        return made[-1]

    monkeypatch.setattr(source_queries, "new_folder", folder)
    monkeypatch.setattr(source_queries, "FILE_ROWS", 20)
    got = {(r.dump, r.target): r.hits for r in source_queries.stream_counts(spark, data).collect()}
    assert len(spark.read.parquet(made[0]).inputFiles()) >= 10
    assert len(list((tmp_path / "state/commits").glob("[0-9]"))) == 3
    want = count_targets(source_queries.corpus(spark, data), ["the", "la"], ("dump",)).where("target is not null")
    assert got == {(r.dump, r.target): r.n for r in want.collect()}


def test_texts_reach_python_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    count_targets(spark.createDataFrame([("a b", 1)], "text string, y int"), ["a"], ("y",))
    assert int(spark.conf.get(name)) == 4 << 20


def test_poisson_bounds_take_few_sums(monkeypatch):
    calls, plain = [], rates._gamma_q
    monkeypatch.setattr(rates, "_gamma_q", lambda a, x: calls.append(1) or plain(a, x))
    low, high = rates.poisson_interval(np.array([0.0, 1.0, 9.0, 2500.0]))
    assert len(calls) <= 40
    below = lambda n, m: math.fsum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(n + 1))
    assert low[0] == 0
    for k, a, b in [(0, low[0], high[0]), (1, low[1], high[1]), (9, low[2], high[2]), (2500, low[3], high[3])]:
        assert math.isclose(below(k, b), 0.025, rel_tol=1e-8) and (k == 0 or math.isclose(1 - below(k - 1, a), 0.025, rel_tol=1e-8))


def test_matcher_remembers_no_spellings():
    for targets in (["a", "b"], ["a", "a b"]):
        m = Matcher(targets)
        size = len(pickle.dumps(m.__dict__))
        assert m.matches([f"x{i}" for i in range(5000)] + ["(A)", "-", "B!"])[0] == (5000, 1, "a")
        assert len(pickle.dumps(m.__dict__)) == size


def test_sense_scores_read_rows_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(batches):  # all scores at the end, in one batch
        seen = [b for b in batches]
        asked.add(sum(map(len, seen)))
        yield pd.concat(seen).str.len() / 100.0

    rows = [(i, ["haha", "rare", "the"][i % 3] if i < 6 else "the", "w" * (40 + i)) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, target string, target_context string").coalesce(1)
    scored = scoring.sense_scored(df, model, F.col("target_context"), ("haha",), least=3)
    out = scoring.sense_filter(scored, -1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r.i: (r.rare, r.sense_score) for r in out.collect()}
    assert asked.value == 46
    for i, target, context in rows:
        assert got[i] == {"haha": (False, 1.0), "rare": (True, None), "the": (False, round(2 * len(context) / 100 - 1, 4))}[target]


def test_sense_gradient_works_buckets_out_once(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 40, 9)), int(i % 3 == 0)) for i in range(300)], "context string, label int")
    model = sensemodel.train(df)
    g = sensemodel.gradient(df, model)
    assert g._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 0  # stored: an explosion's own filter would work them out again
    assert all(abs(r.slope) < 1e-8 for r in g.collect())
    # one step's sums against dense ones in double precision
    rows = sensemodel.learnable(df).withColumn("weight", F.lit(0.002))
    beta = rng.normal(size=sensemodel.BUCKETS + 1)
    grad, hess, total = sensemodel.sums(rows, beta)
    held = rows.collect()
    x = np.zeros((len(held), len(beta)))
    for i, r in enumerate(held):
        x[i, r.buckets] = 1
    x[:, -1] = 1
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.allclose(grad, x.T @ (0.002 * (np.array([r.label for r in held]) - p)), rtol=1e-12, atol=1e-14) and math.isclose(total, 0.6)
    assert np.allclose(hess, (x * (0.002 * p * (1 - p))[:, None]).T @ x, rtol=1e-4, atol=1e-9)
