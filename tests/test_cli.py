import json

from tracewright import __main__ as cli
from tracewright.operators import reports


def run(spark, *args):
    return cli.run(spark, cli.parser().parse_args(list(args)))


def test_demo_gate_query_export(spark, tmp_path, capsys):
    out = str(tmp_path / "o")
    assert run(spark, "demo", "--out", out, "--episodes", "3") == 0
    a = f"{out}/annotations"
    assert run(spark, "gate", "--annotations", a) == 1 and "uniform_split: 3" in capsys.readouterr().out
    assert run(spark, "query", "--annotations", a, "--phase", "grasp", "--needs-review") == 0 and "synthetic_00" in capsys.readouterr().out
    assert run(spark, "export", "--annotations", a, "--out", f"{out}/j") == 0
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{out}/j").collect()]
    assert [x["episode_id"] for x in sorted(lines, key=lambda x: x["episode_id"])] == ["synthetic_00", "synthetic_01", "synthetic_02"] and len(lines[0]["subtasks"]) == 4
    assert run(spark, "export", "--annotations", a, "--out", f"{out}/s", "--format", "subtasks") == 0
    assert spark.read.parquet(f"{out}/s/meta/subtasks").count() == 4
    assert run(spark, "cost", "--annotations", a) == 0 and '"cost_per_episode": null' in capsys.readouterr().out


def test_trial_report(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"a": {"marks": {"b0": False, "p0": True}, "verdict": "usable"}, "b": {"marks": {}, "verdict": "garbage"}, "x": {"marks": {}}}))
    (tmp_path / "u.json").write_text(json.dumps({"__dataset__": "stacking", "a": {"strategy": "S2", "bands": [], "denom": {"b": 4, "p": 2, "e": 0}}, "b": {"strategy": "S2", "bands": ["x"], "denom": {"b": 4, "p": 2, "e": 0}}}))
    text = reports.trial_report(spark, str(tmp_path / "g.json"), str(tmp_path / "u.json"))
    assert "**stacking**" in text and "| S2 | 2 | 0.88 (n=8) | 1.00 (n=4) | n/a (n=0) | 0.50 | 1 / 0 / 1 |" in text
