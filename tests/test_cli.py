"""The command line's way from instances or features to the plane."""

import json
import random

import numpy as np
import pytest

from satchel import __main__ as cli
from satchel.operators import solve
from satchel.plans import projection
from satchel.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("cli"), random.Random(3)
    lines, perf, good, origins = [], ["instance_id," + ",".join(solve.FORMULATIONS)], ["instance_id," + ",".join(solve.FORMULATIONS)], ["instance_id,origin"]
    for k in range(40):
        w = [rng.randrange(1, 60) for _ in range(3 + k % 7)]
        p = [rng.randrange(1, 90) + (x if k % 2 else 0) for x in w]
        lines.append(json.dumps({"instance_id": f"i{k}", "origin": "sage", "variant": "domain", "parameters": {"weights": w, "profit": p, "capacity": max(max(w), sum(w) // 2)}}))
        seconds = [0.01 + sum(w) * (j + 1) / 100 + rng.random() / 50 for j in range(len(solve.FORMULATIONS))]
        perf.append(f"i{k}," + ",".join(map(str, seconds)))
        good.append(f"i{k}," + ",".join(str(int(s < 1.5 * (j + 1))) for j, s in enumerate(seconds)))
        origins.append(f"i{k},{'synthetic' if k % 2 else 'sage'}")
    for name, rows in (("instances.jsonl", lines), ("performance.csv", perf), ("good.csv", good), ("origins.csv", origins), ("bad.jsonl", [lines[0].replace('"sage"', '"elsewhere"')])):
        (top / name).write_text("\n".join(rows) + "\n")
    return top


def run(capsys, *args):
    code = cli.main(["project", *map(str, args)])
    out = capsys.readouterr().out
    return code, json.loads(out[out.index("{") :])


def test_fit_apply_and_redraw(spark, folder, capsys):
    code, said = run(capsys, "--instances", folder / "instances.jsonl", "--performance", folder / "performance.csv", "--good", folder / "good.csv", "--output-dir", folder / "fit")
    assert code == 0 and said["status"] == "projection_complete_partitions_deferred" and said["points"] == {"sage_original": 40}
    z = {r.instance_id: (float(r.z1), float(r.z2)) for r in spark.read.csv(f"{folder}/fit/coordinates", header=True).collect()}
    code, said = run(capsys, "--features", f"{folder}/fit/features", "--origins", folder / "origins.csv", "--fitted-projection", folder / "fit", "--output-dir", folder / "frozen")
    assert code == 0 and said["points"] == {"sage_original": 20, "synthetic": 20}
    again = {r.instance_id: (float(r.z1), float(r.z2)) for r in spark.read.csv(f"{folder}/frozen/coordinates", header=True).collect()}
    assert again.keys() == z.keys() and all(np.allclose(again[k], z[k]) for k in z)
    code, said = run(capsys, "--coordinates", f"{folder}/fit/coordinates", "--origins", folder / "origins.csv", "--output-dir", folder / "points")
    assert said == {"status": "coordinates_supplied", "points": {"sage_original": 20, "synthetic": 20}}


def test_what_a_fit_leaves(spark, folder):
    said = tables.read_json(spark, f"{folder}/fit/diagnostics")
    assert said["shape"]["available"] and said["shape"]["n"] == 40 and said["loss"] > 0 and said["boundary"]["available"]
    corners = spark.read.csv(f"{folder}/fit/boundary", header=True)
    targets = [(float(r.z1), float(r.z2), float(r.distance)) for r in spark.read.csv(f"{folder}/fit/coverage_targets", header=True).collect()]
    assert corners.count() == said["boundary"]["corners"] >= 3 and len(targets) == said["boundary"]["coverage_targets"] > 0
    z = np.array([(float(r.z1), float(r.z2)) for r in spark.read.csv(f"{folder}/fit/coordinates", header=True).collect()])
    assert all(d == pytest.approx(np.hypot(*(z - [x, y]).T).min()) for x, y, d in targets)
    applied = tables.read_json(spark, f"{folder}/frozen/application")
    assert applied["fitted_artefacts"] == tables.read_json(spark, f"{folder}/fit/manifest") and applied["refitted"] is False
    kept = [json.loads(r.value)["instance_id"] for r in spark.read.text(f"{folder}/fit/inputs").collect()]
    assert sorted(kept) == sorted(f"i{k}" for k in range(40))


def test_what_is_refused(spark, folder, capsys):
    assert run(capsys, "--instances", folder / "bad.jsonl", "--output-dir", folder / "bad") == (2, {"status": "needs_parameter_review", "bad_rows": 1})
    audit = spark.read.csv(f"{folder}/bad/audit", header=True).collect()
    assert [(r.instance_id, r.status, r.reason) for r in audit] == [("i0", "needs_parameter_review", "origin")]
    for args in (["--features", "f"], ["--instances", "i", "--origins", "o"], ["--instances", "i", "--performance", "p"], [], ["--coordinates", "c", "--origins", "o", "--fitted-projection", "f"]):
        with pytest.raises(ValueError):
            cli.main(["project", *args, "--output-dir", str(folder / "none")])


def test_responses_share_one_minimum(spark):
    rows = [(f"i{k}", 1.0 + k, 0.5 + 2 * k, 3.0) for k in range(30)]
    scales = projection.fit_responses(spark.createDataFrame(rows, "instance_id string, a double, b double, c double"))
    assert [*scales] == ["a", "b"] and {p["minimum"] for p in scales.values()} == {0.5}
    y = projection.apply_normalization(spark.createDataFrame(rows, "instance_id string, a double, b double, c double"), scales).toPandas()
    assert np.allclose(y[["a", "b"]].mean(), 0, atol=1e-9) and np.allclose(y[["a", "b"]].std(ddof=1), 1)
    for bad in (0.0, float("nan"), None):
        with pytest.raises(ValueError):
            projection.fit_responses(spark.createDataFrame([("i", 1.0), ("j", bad)], "instance_id string, a double"))


def test_time_limit(spark, folder):
    rows = tables.read_instances(spark, f"{folder}/instances.jsonl").limit(3)
    free, none = (solve.run_formulations(rows, limit).select("good", "objective").collect() for limit in (60.0, 0.0))
    assert all(r.good for r in free) and not any(r.good for r in none) and sorted(r.objective for r in free) == sorted(r.objective for r in none)


def test_extract_augment_and_solve(spark, folder, capsys):
    """The other commands, end to end, on small files."""
    question = "There are 3 items.\n- Item 0: Value = {}, Weight = 2\n- Item 1: Value = 5, Weight = 3\n- Item 2: Value = 6, Weight = 4\nThe capacity is 6."
    lines = ["id,b,question,d,e,source,g,problem"] + [f'q{k},,"{question.format(4 + k)}",,,OptMATH,,{"KP" if k < 3 else "TSP"}' for k in range(4)]
    (folder / "corpus.csv").write_text("\n".join(lines) + "\n")
    code, out = cli.main(["extract", str(folder / "corpus.csv"), str(folder / "extracted")]), capsys.readouterr().out
    assert code == 0 and json.loads(out[out.index("{") :])
    code, out = cli.main(["augment", "--parents", str(folder / "instances.jsonl"), "--output-dir", str(folder / "more"), "--max-rounds", "1", "--candidates-per-round", "20"]), capsys.readouterr().out
    said = json.loads(out[out.index("{") :])
    assert code == 0 and said["generated"] == 20 == tables.read_instances(spark, f"{folder}/more/instances").count()
    code, out = cli.main(["solve", "--instances", str(folder / "instances.jsonl"), "--output-dir", str(folder / "solved"), "--time-limit", "60"]), capsys.readouterr().out
    assert code == 0 and json.loads(out[out.index("{") :])["compact"] == 40
    good = spark.read.csv(f"{folder}/solved/good", header=True)
    assert good.count() == 40 and {r.compact for r in good.collect()} == {"1"}
