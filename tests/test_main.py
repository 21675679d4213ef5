import json

import pytest

from tablewright.__main__ import main
from tablewright.sources import records


def _interaction(i):
    cell = lambda x: {"text": x}
    rows = [{"cells": [cell(f"town{i}x{j}"), cell(str(i * 3 + j * j))]} for j in range(5)]
    table = {"columns": [cell("Town"), cell("Size")], "rows": rows, "table_id": f"t{i}", "document_title": f"places{i}"}
    answer = {"answer_coordinates": [{"row_index": 1, "column_index": 0}], "aggregation_function": "NONE" if i else "COUNT"}
    return {"id": f"i{i}", "table": table, "questions": [{"id": f"i{i}_0", "text": f"size of town{i}x1 in places{i}", "answer": answer}]}


def test_tasks(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "in.tfrecord").write_bytes(records._framed_records([records._encoded(_interaction(i), records.INTERACTION) for i in range(4)]))
    main(["interactions", at("in.tfrecord"), at("all")], spark)
    assert spark.read.parquet(at("all")).count() == 4
    main(["pretrain", at("all"), at("pre"), "--copies", "2", "--rows", "5"], spark)
    assert spark.read.parquet(at("pre")).count() == 8
    main(["statements", at("all"), at("said")], spark)
    assert {r["label"] for r in spark.read.parquet(at("said")).collect()} == {0, 1}
    main(["retrieve", at("all"), at("hits"), "--k", "2"], spark)
    rates = {r["k"]: r["rate"] for r in main(["hit-rate", at("hits"), at("all")], spark)}
    assert rates == {1: 1.0, 5: 1.0, 10: 1.0, 50: 1.0}
    (tmp_path / "p.tsv").write_text("question_id\taggregation\tanswer_coordinates\ni0_0\tcount\t['(1, 0)']\ni1_0\tsum\t['(1, 0)']\ni2_0\tnone\t[]\n")
    capsys.readouterr()
    (row,) = main(["metrics", at("all"), at("p.tsv")], spark)
    assert row == {"aggregation_acc": 0.75, "cell_acc": 0.5, "joint_acc": 0.25, "n": 4} == json.loads(capsys.readouterr().out)
    with pytest.raises(SystemExit):
        main(["unknown"], spark)
