"""End-to-end metrics: known cases, and plain Python on random examples."""

import random
import re
import string
from collections import Counter

import pytest

from tablewright.operators import endtoend

CANDIDATES = "example_id string, candidate_id string, place int, is_gold_table boolean, answers array<array<string>>"
PREDICTIONS = "candidate_id string, answer string, score double"
ZERO = dict.fromkeys(("table_accuracy", "table_recall", "answer_accuracy", "answer_token_recall", "answer_token_f1", "oracle_answer_token_f1", "oracle_answer_accuracy"), 0.0)
ONE = dict.fromkeys(("table_precision", "answer_precision", "answer_token_precision"), 1.0)
SPLIT = dict.fromkeys(("answer_accuracy_table", "answer_accuracy_passage", "answer_token_f1_table", "answer_token_f1_passage"))


def report(spark, candidates, predictions, splits=None):
    c, p = spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(predictions, PREDICTIONS)
    s = None if splits is None else spark.createDataFrame(splits, "example_id string, split string")
    return endtoend.report(endtoend.examples(c, p), s).first().asDict()


def test_nothing_and_no_predictions(spark):
    assert report(spark, [], []) == {**dict.fromkeys([*ZERO, *ONE], 1.0), **SPLIT}
    two = [("e", f"e-{i}_0", i, True, [["ANSWER"]]) for i in range(2)]
    assert report(spark, two, []) == {**ZERO, **ONE, **SPLIT}


@pytest.mark.parametrize("answer, want", [
    ("answer", dict.fromkeys(["answer_accuracy", "answer_token_recall", "answer_precision", "answer_token_f1", "answer_token_precision", "oracle_answer_token_f1", "oracle_answer_accuracy"], 1.0)),
    ("answer other", {"answer_accuracy": 0.0, "answer_token_recall": 1.0, "answer_precision": 0.0, "answer_token_f1": 2 / 3, "answer_token_precision": 0.5, "oracle_answer_token_f1": 2 / 3, "oracle_answer_accuracy": 0.0}),
])
def test_the_best_candidate_and_its_best_reference(spark, answer, want):
    candidates = [("e", "e-0_0", 0, True, [["OTHER"], ["ANSWER"]]), ("e", "e-1_0", 1, True, [["ANSWER"]])]
    got = report(spark, candidates, [("e-0_0", "nothing", 2.0), ("e-1_0", answer, 11.0)])
    assert {k: got[k] for k in want} == want and (got["table_accuracy"], got["table_precision"], got["table_recall"]) == (1.0, 1.0, 1.0)


def words(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return re.sub(r"\b(a|an|the)\b", " ", s).split()


def scores(gold, pred):
    g, p = words(gold), words(pred)
    n = sum((Counter(g) & Counter(p)).values())
    pr, rc = n / len(p) if p else 1.0, n / len(g) if g else 1.0
    return (0.0, float(g == p), 0.0, 0.0) if pr + rc < 1e-5 else (2 * pr * rc / (pr + rc), float(g == p), pr, rc)


def plain(candidates, predictions, splits):
    said, out, total = {c: (a, s or 0.0) for c, a, s in predictions if a is not None}, Counter(), Counter()
    sums, counts = Counter(), Counter()

    def note(name, x):
        sums[name] += x
        counts[name] += 1

    for e in sorted({c[0] for c in candidates}):
        total["all"] += 1
        mine = [c for c in candidates if c[0] == e]
        refs = {" ".join(sorted(t for t in a if t)) for c in mine for a in c[4] or []} - {""}
        if not refs:
            for n in ("f1", "exact", "precision", "recall"):
                note(n, 0.0)
            continue
        total["gold"] += any(c[3] for c in mine)
        read = [(said[c[1]][1], -c[2], c, max(scores(r, said[c[1]][0]) for r in refs)) for c in mine if c[1] in said]
        best = max(read, key=lambda x: x[:2]) if read else None
        m = best[3] if best else max(scores(r, "") for r in refs)
        total["predicted"] += best is not None
        total["answered"] += best is not None and said[best[2][1]][0] != ""
        total["right"] += best is not None and bool(best[2][3])
        for n, x in zip(("f1", "exact", "precision", "recall"), m):
            note(n, x)
        for split in ("table", "passage"):
            if best and (e, split) in splits:
                note(f"f1_{split}", m[0])
                note(f"exact_{split}", m[1])
        note("oracle_f1", max((x[3][0] for x in read), default=0.0))
        note("oracle_exact", max((x[3][1] for x in read), default=0.0))
    mean = lambda n: sums[n] / counts[n] if counts[n] else 1.0
    share = lambda a, b: a / b if b else 1.0
    return {
        "table_accuracy": share(total["right"], total["all"]), "table_precision": share(total["right"], total["predicted"]), "table_recall": share(total["right"], total["gold"]),
        "answer_accuracy": mean("exact"), "answer_accuracy_table": mean("exact_table"), "answer_accuracy_passage": mean("exact_passage"), "answer_precision": share(sums["exact"], total["answered"]),
        "answer_token_precision": mean("precision"), "answer_token_recall": mean("recall"), "answer_token_f1": mean("f1"), "answer_token_f1_passage": mean("f1_passage"), "answer_token_f1_table": mean("f1_table"),
        "oracle_answer_token_f1": mean("oracle_f1"), "oracle_answer_accuracy": mean("oracle_exact"),
    }


def test_random_examples_equal_plain_python(spark):
    rng = random.Random(6)
    phrase = lambda: " ".join(rng.choice(["The", "a", "red", "Red!", "fox", "old", "2"]) for _ in range(rng.randint(0, 3)))
    candidates, predictions = [], []
    for e in range(60):
        for k in range(rng.randint(1, 4)):
            answers = rng.choice([None, [], [[phrase(), phrase()]], [[phrase()], ["", None]]])
            candidates.append((f"e{e}", f"e{e}-{k}_0", k, rng.choice([True, False, None]), answers))
            if rng.random() < 0.7:
                predictions.append((f"e{e}-{k}_0", rng.choice([None, phrase(), phrase(), ""]), rng.choice([None, 1.0, 2.0, -1.0])))
    splits = [(f"e{e}", rng.choice(["table", "passage"])) for e in range(0, 60, 2)]
    got = report(spark, candidates, predictions, splits)
    want = plain(candidates, predictions, set(splits))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_equal_answers_meet_references_once(spark):
    cands = [(1, i, i, i == 3, [[f"a {i % 2}"]] if i < 4 else []) for i in range(300)]
    preds = [(i, f"The a {i % 3}!", float(i % 7)) for i in range(300)]
    c = spark.createDataFrame(cands, "example_id long, candidate_id long, place long, is_gold_table boolean, answers array<array<string>>")
    p = spark.createDataFrame(preds, "candidate_id long, answer string, score double")
    read = endtoend.examples(c, p)
    assert read.first()["best_id"] == 6 and read.first()["f1"] == 1.0
    # references met candidates before: an aggregate by candidate brought them together again
    assert not re.search(r"Aggregate \[example_id#\w+, candidate_id#", read._jdf.queryExecution().optimizedPlan().toString())
