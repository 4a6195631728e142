"""Questions state what answers are held to and why the last one was rejected; temperature and times follow the strategy."""

import json

from tracewright import config
from tracewright.plans import pipeline, providers
from tracewright.sources import episodes as src


class Fussy(providers.MockProvider):
    """Answers with one segment until it is told what was wrong."""

    name = "fussy"

    def answer(self, stage, question, labels):
        if stage.startswith("grounded") and "rejected" not in question:
            return json.dumps({"segments": [{"phase": "grasp", "target": "cup", "end_frame": max(labels), "evidence": str(self.temperature)}]}), 0.0
        return super().answer(stage, question, labels)


def asked(spark, tmp_path, strategy):
    episodes, _ = src.synthetic(spark, 2)
    out = pipeline.label_segments(episodes, Fussy(), strategy, config.Rubric(), str(tmp_path)).collect()
    return out, {(r["stage"], r["episode_id"]): r for r in providers.stored(spark, str(tmp_path)).collect()}


def test_a_rejected_answer_is_asked_for_in_other_words(spark, tmp_path):
    from dataclasses import replace

    out, receipts = asked(spark, tmp_path, replace(config.load_strategy("S2"), min_granularity_policy="reject"))
    assert all(r["error"] is None and len(r["segments"]) == 4 for r in out)
    first = [r["question"] for (s, _), r in receipts.items() if s.endswith("a0") and s.startswith("grounded")]
    second = [r["question"] for (s, _), r in receipts.items() if s.endswith("a1")]
    assert len(first) == len(second) == 2
    for q in first:
        assert "Give 3 to 6 segments." in q and "release-place" in q and "target names" in q and "rejected" not in q and "s)" in q
    assert all("The last answer was rejected: below min granularity: 1 < 3 segments." in q for q in second)
    assert {r["answer"] for (s, _), r in receipts.items() if s.endswith("a0") and "grasp" in r["answer"] and '"0.0"' not in r["answer"]} == set()


def test_open_words_samples_and_times(spark, tmp_path):
    from dataclasses import replace

    strategy = replace(config.load_strategy("S2-open"), self_consistency_k=2, caption_timestamps=False, enforce_min_segments=False, max_label_attempts=1)
    _, receipts = asked(spark, tmp_path, strategy)
    q = [r for (s, _), r in receipts.items() if s.startswith("grounded")]
    assert len(q) == 4 and all("of your own" in r["question"] and "Give 1 to 6" in r["question"] and "s)" not in r["question"] and f'"{strategy.temperature}"' in r["answer"] for r in q)
