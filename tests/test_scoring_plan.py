"""Samples scored from their texts: odd samples and problems, and the shares that follow."""

import pytest

from reasonset.plans import scoring

PROBLEMS = [("gpq", 1, "B", "letter"), ("gpq", 2, "C", "letter"), ("sum", 1, "1,234", "answer"), ("sum", 2, "", "answer"), ("sum", 3, None, "answer"), ("code", 1, None, "verdict"), ("code", 2, None, "other")]
SAMPLES = [
    # run, step, eval, problem, content, is_correct, and whether it is graded as correct
    ("r", 0, "gpq", 1, r"a \boxed{A}, then \boxed{B}", True, False),
    ("r", 0, "gpq", 1, r"\boxed{B}", False, True),
    ("r", 0, "gpq", 2, "C", True, False),
    ("r", 0, "gpq", 2, None, True, False),
    ("r", 0, "gpq", 9, r"\boxed{B}", True, False),
    ("r", 0, "sum", 1, "x\nANSWER: $1234", None, True),
    ("r", 0, "sum", 1, "x\nANSWER: $1234", None, True),
    ("r", 0, "sum", 2, "no answer", None, False),
    ("r", 0, "sum", 3, "ANSWER: 3", None, False),
    ("r", 0, "code", 1, None, True, True),
    ("r", 0, "code", 2, None, True, False),
    ("r", 5, "code", 1, "", None, False),
    ("s", 0, "gone", 1, r"\boxed{B}", True, False),
]


@pytest.fixture(scope="module")
def tables(spark):
    samples = spark.createDataFrame([r[:6] for r in SAMPLES], "run string, step long, eval string, problem long, content string, is_correct boolean")
    return samples, spark.createDataFrame(PROBLEMS, "eval string, problem long, target string, kind string")


def test_graded(tables):
    found = scoring.graded(*tables).select("run", "step", "eval", "problem", "content", "is_correct").collect()
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r) for r in found) == order((*r[:5], r[6]) for r in SAMPLES)


def test_shares(tables):
    """Unanswered problems count, unknown ones do not; an eval without problems gives 0."""
    found = {tuple(r)[:3]: r["value"] for r in scoring.score_samples(*tables, k=2).collect()}
    assert found == {("r", 0, "gpq_pass@2"): 0.5, ("r", 0, "sum_pass@2"): pytest.approx(1 / 3), ("r", 0, "code_pass@2"): 0.5, ("r", 5, "code_pass@2"): 0.0, ("s", 0, "gone_pass@2"): 0.0}


def test_no_rows(tables):
    samples, problems = tables
    assert scoring.score_samples(samples.limit(0), problems).collect() == []
    assert {r["value"] for r in scoring.score_samples(samples, problems.limit(0)).collect()} == {0.0}
