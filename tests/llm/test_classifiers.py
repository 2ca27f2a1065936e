"""Toxicity machine and quality ranking."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from landshift.llm import quality, toxicity
from landshift.llm.labelled import held_out, labelled_texts
from tests.llm import cases


def labelled(spark, rows):
    frame = cases.docs(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return frame, labels


def insults(n, seed):
    """Neither word alone is toxic: only the pair is."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        text = cases.prose(seed * 1000 + k, 40, 20)
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        text += ["awful"] * insult + ["people"] * group
        draw.shuffle(text)
        rows.append((" ".join(text), int(insult and group)))
    return rows


def accuracy(frame, labels, column, at):
    rows = frame.join(labels, "doc_id").where(F.col(column).isNotNull()).collect()
    return sum((r.score >= at) == (r[column] == 1) for r in rows) / len(rows)


def test_toxicity_learns_a_pair_of_terms(spark):
    frame, labels = labelled(spark, insults(600, 1))
    machine = toxicity.train(frame, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.with_score(frame, machine)
    assert accuracy(scored.where(held_out(F.col("doc_id"))), labels, "toxic", 0.5) > 0.95
    again = toxicity.train(frame, labels.where(~held_out(F.col("doc_id"))))
    assert np.array_equal(again.weight, machine.weight)


def test_machine_value_is_the_sum_over_pairs():
    draw = np.random.default_rng(0)
    machine = toxicity.Machine(np.arange(3), draw.normal(size=5), draw.normal(size=(5, 4)))
    rows, index = np.array([0, 0, 0, 1]), np.array([0, 2, 4, 1])
    value, _ = toxicity.raw_scores(rows, index, machine)
    pairs = sum(machine.vector[a] @ machine.vector[b] for a, b in ((0, 2), (0, 4), (2, 4)))
    assert np.allclose(value, [machine.weight[[0, 2, 4]].sum() + pairs, machine.weight[1]])


def noisy(n, seed):
    rows = []
    for k in range(n):
        text = cases.prose(seed * 1000 + k, 60)
        rows.append((" ".join(w + "$$$" for w in text), 0) if k % 4 == 0 else (" ".join(text).capitalize() + ".", 1))
    return rows


def test_quality_ranks_clean_text_higher(spark):
    frame, labels = labelled(spark, noisy(300, 2))
    model = quality.train(frame, labels.where(~held_out(F.col("doc_id"))))
    scored = quality.with_score(frame, model)
    assert accuracy(scored.where(held_out(F.col("doc_id"))), labels, "quality", quality.AT_CUT) > 0.95


def test_cut_is_the_quantile_of_the_worse():
    draw = np.random.default_rng(1)
    features = draw.normal(size=(1000, quality.FEATURES)).astype(np.float32)
    labels = (features[:, 0] + 0.3 * draw.normal(size=1000) > -0.8).astype(int)
    model = quality.fit(features, labels, pairs=20_000)
    below = (quality.rank(features, model) < quality.AT_CUT).mean()
    assert abs(below - (labels == 0).mean()) < 0.01


def test_odd_rows_and_missing_labels(spark):
    frame = cases.clashing(cases.docs(spark, cases.odd_rows()))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for module, score in ((toxicity, 0.25), (quality, 0.5)):
        model = module.train(frame, labels)
        rows = module.with_score(frame, model)
        assert rows.columns.count("score") == 1
        values = [r.score for r in rows.select("score").collect()]
        assert len(values) == frame.count() and np.allclose(values, score)
        assert module.with_score(cases.empty(frame), model).count() == 0
    one_class = spark.createDataFrame([(1, 1, 1), (8, 1, 1)], labels.schema)
    assert 0 <= quality.with_score(frame, quality.train(frame, one_class)).agg(F.max("score")).first()[0] <= 1
    assert 0 <= toxicity.with_score(frame, toxicity.train(frame, one_class)).agg(F.max("score")).first()[0] <= 1


def test_description_of_empty_columns():
    assert quality.describe(pa.array([], pa.string())).shape == (0, quality.FEATURES)
    assert np.isfinite(quality.describe(pa.array(["", None, "a"], pa.string()))).all()


def test_quality_learns_from_every_labelled_document(spark):
    rows = [("Plain words of a clean text.", 1)] * 20_500 + [("## %% $$", 0)] * 500
    frame, labels = labelled(spark, rows)
    model = quality.train(frame, labels)
    looks = quality.describe(pa.array([rows[0][0], rows[-1][0]])).astype(float)
    assert np.allclose(model.mean, (looks[0] * 20_500 + looks[1] * 500) / 21_000, rtol=0, atol=1e-9)
    assert accuracy(quality.with_score(frame, model), labels, "quality", quality.AT_CUT) == 1


def test_few_labels_meet_texts_by_the_plan_of_many(spark):
    frame, labels = labelled(spark, [("Plain words of a clean text.", 1), ("## %% $$", 0)] * 50)
    joined = labelled_texts(frame, labels, "quality")
    assert sorted(joined.collect()) == sorted([("Plain words of a clean text.", 1), ("## %% $$", 0)] * 50)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "Sort" not in plan.replace("SortAggregate", "")
