"""Registered queries do the whole job: nothing cut, left out or out of reach."""

import json
from collections import Counter

from tracewright.operators import corpus
from tracewright.plans import catalog

D = "/root/testdata/sf0.001"


def test_export_json_lines_carries_whole_texts(spark):
    got = {r["episode_id"]: json.loads(r["json"])["reason"] for r in catalog.QUERIES["export_json_lines"](spark, D).collect()}
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    assert any(len(t or "") > 40 for e, t in texts.items() if e in got)
    assert got == {e: texts.get(e) for e in got}


def test_every_candidate_can_be_retrieved(spark):
    segs = spark.range(600).selectExpr("id div 3 as episode_id", "cast(id % 3 as int) as segment_idx", "' Grasp' as phase", "cast(id as int) as end_frame")
    goals = segs.selectExpr("episode_id", "segment_idx", "end_frame as frame_idx")
    got = corpus.retrieve_seeded(goals, segs, 1, segs.where("episode_id >= 100")).collect()
    assert len(got) == 600 and all(r["retrieved_subgoal_episode_id"] not in (None, r["episode_id"]) for r in got)
    assert all(r["retrieved_subgoal_frame_idx"] // 3 == r["retrieved_subgoal_episode_id"] >= 100 for r in got)
    assert len({r["retrieved_subgoal_frame_idx"] for r in got}) > 200  # of 300
    alone = corpus.retrieve_seeded(goals, segs, 1, segs.where("episode_id = 100")).collect()
    assert {(r["episode_id"] == 100, r["retrieved_subgoal_episode_id"]) for r in alone} == {(True, None), (False, 100)}


def test_gate_and_gold_take_whole_tables(spark):
    rows = lambda name: catalog.QUERIES[name](spark, D).collect()
    flags, grounding = rows("gate_all"), rows("gate_grounding")
    key = lambda r: (r["episode_id"], r["check"], r["detail"])
    assert grounding and sorted(key(r) for r in flags if r["check"] == "object_grounding") == sorted(map(key, grounding))
    talks = spark.read.parquet(f"{D}/conversations.parquet").collect()
    ids = {r["conv_id"] for r in talks}
    n = Counter(r["episode_id"] for r in flags)
    assert {r["episode_id"]: r["n_flags"] for r in rows("episode_payloads_all")} == {str(e): n[str(e)] for e in ids}
    first = {r["conv_id"]: len(r["text"]) - 1 for r in sorted(talks, key=lambda r: -r["turn"])}
    assert {r["episode_id"]: r["thumb_frame"] for r in rows("thumb_frames_all")} == first
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    want = {e: None if labels.get(e) is None else 1 + 4 * labels[e] for e in ids}
    assert {r["episode_id"]: r["quality"] for r in rows("gold_sync_all")} == {r["episode_id"]: r["quality"] for r in rows("gold_update_all")} == want
