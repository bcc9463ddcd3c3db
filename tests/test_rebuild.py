"""Stages rebuilt in order against a plain fold, and published cases of scores and advantages."""

import random

from pyspark.sql import functions as F

from quernel.functions import counting
from quernel.operators import alignment, judging, rebuild, rewards

STAGES = "q string, n int, kind string, updates array<struct<item_id:string,status:string,evidence_ids:array<string>>>, chosen string, candidates array<string>, cited array<string>, prompt_tokens int, target_tokens int, eligible boolean"
EVIDENCE = "q string, n int, place int, source_id string, text string, question string"
ITEMS = "q string, items array<struct<item_id:string,description:string>>"


def audits(spark, stages, evidence, items, **more):
    opened = rebuild.scored_evidence(spark.createDataFrame(evidence, EVIDENCE), ["q", "n"], lambda c: F.split(F.lower(c), " "))
    frame = spark.createDataFrame(stages, STAGES).repartition(3).join(opened, ["q", "n"], "left")
    return rebuild.rebuilt(frame, spark.createDataFrame(items, ITEMS), "q", "n", **more)


def test_states_are_carried_like_a_plain_fold(spark):
    rng = random.Random(5)
    stages, evidence, want = [], [], {}
    for q in ("a", "b", "c", None):
        states = {"R1": ("unknown", []), "R2": ("unknown", [])}
        for n in range(40):
            kind = rng.choice(["state_update", "state_update", "decision", "final"])
            opened = rng.sample(["e1", "e2", "e3"], rng.randint(0, 3))
            evidence += [(q, n, k, s, f"text {s}", "x") for k, s in enumerate(opened)] + [(q, n, 9, s, "again", "x") for s in opened[:1]]
            updates = [(i, s := rng.choice(["unknown", "missing", "partial", "direct"]), rng.sample(["e1", "e2", "e3"], rng.randint(1, 3)) if s in ("partial", "direct") else []) for i in rng.sample(["R1", "R2"], rng.randint(0, 2))] if kind == "state_update" else None
            stages.append((q, n, kind, updates, None, None, None, 10, 5, True))
            for i, status, ids in updates or []:
                kept = [x for x in ids if x in opened]
                if status in ("partial", "direct") and not kept:
                    status = "unknown"
                elif len(kept) < len(ids):
                    status = "partial"
                states[i] = (status, kept)
            want[q, n] = dict(states)
    items = [(q, [("R1", "one"), ("R2", "two")]) for q in ("a", "b", "c")]
    done = audits(spark, stages, evidence, items).collect()
    assert len(done) == len(stages)
    before = {}
    for r in sorted(done, key=lambda r: (r["q"] or "", r["n"])):
        after = {i["item_id"]: (i["status"], i["evidence_ids"]) for i in r["after"]}
        assert after == ({} if r["q"] is None else want[r["q"], r["n"]])
        assert {i["item_id"]: (i["status"], i["evidence_ids"]) for i in r["before"]} == before.get(r["q"], {k: ("unknown", []) for k in after})
        assert r["eligible"] == (not r["pending"])
        before[r["q"]] = after


def test_budgets_cards_and_what_keeps_a_stage_out(spark):
    long = "Alpha beta gamma. " * 110 + "The wanted sentence is here. " + "Delta epsilon zeta. " * 110
    stages = [
        ("q", 1, "decision", None, "z", ["y", "z"], None, 10, 5, True), ("q", 2, "decision", None, "z", list("abcdefghz"), None, 10, 5, True), ("q", 3, "state_update", [("R1", "direct", ["s"])], None, None, None, 6000, 5, True),
        ("q", 4, "final", None, None, None, ["s"], 3000, 2401, True), ("q", 5, "decision_stop", None, None, None, None, 8000, 5, False), ("q", 6, "checklist_init", None, None, None, None, 9000, 5, True),
    ]
    evidence = [("q", n, 0, "s", long, "the wanted sentence") for n in (3, 4)]
    got = {r["n"]: r for r in audits(spark, stages, evidence, [("q", [("R1", "d")])]).collect()}
    assert got[1]["pending"] == [] and got[2]["pending"] == ["browse_target_outside_current_window"]
    assert got[3]["cards"] and "wanted" in got[3]["shown"][0]["text"] and got[3]["tokens"] < got[3]["tokens_before"] and "target_support_not_verified_after_card" in got[3]["pending"]
    assert got[4]["cards"] and got[4]["tokens"] + 2400 <= rebuild.CONTEXT and got[4]["pending"] == ["target_support_not_verified_after_card", "target_exceeds_generation_cap"]
    assert got[5]["pending"] == ["input_reserve_overflow"] and not got[5]["eligible"]
    assert got[6]["pending"] == ["input_reserve_overflow", "total_overflow"]
    cards = spark.createDataFrame([("s", "s", s["text"], s["parent_sha256"], [x.asDict() for x in s["spans"]]) for n in (3, 4) for s in got[n]["shown"]], "stage_id string, source_id string, text string, parent_sha256 string, spans array<struct<start:int,end:int>>")
    assert {r["proof"] for r in alignment.evidence_proofs(spark.createDataFrame([("s", "s", long)], "stage_id string, source_id string, text string"), cards).collect()} == {"exact_spans"}
    words = {r["n"]: r for r in audits(spark, stages, evidence, [("q", [("R1", "d")])], by=counting.WORDS, context=6100).collect()}
    assert words[3]["tokens_before"] == 6000 + len(long.split())
    counts = {(r["kind"], r["name"]): r["n"] for r in rebuild.outcome(audits(spark, stages, evidence, [("q", [("R1", "d")])])).collect()}
    assert counts["decision", "stages"] == 2 and counts["decision", "eligible"] == 1 and counts["final", "carded"] == 1


def test_published_advantages(spark):
    rollouts = [(k, k, v) for k, v in enumerate([1.0, 0.7, 0.3, 0.0])]
    got = rewards.leave_one_out(spark.createDataFrame([("q", m, v) for _, m, v in rollouts], "q string, m int, v double"), ["q"], "m", "v").collect()
    assert [r["advantage"] for r in sorted(got, key=lambda r: r["m"])] == [0.666667, 0.266667, -0.266667, -0.666667]


def test_nine_equal_units_and_one_other(spark):
    rows = [("q", f"Same  ﬁne {'UNIT' if k % 2 else 'unit'}", "supported") for k in range(9)] + [("q", "other", "unsupported"), ("q", "no need", "exempt"), ("r", "a", "unknown"), ("r", "b", "supported")]
    got = judging.dimension_scores(spark.createDataFrame(rows, "q string, t string, v string"), "q", "t", "v", {"supported": 1.0, "unsupported": 0.0}, "exempt").collect()
    assert {r["q"]: r["score"] for r in got} == {"q": 0.5, "r": None}


def test_all_atom_combinations(spark):
    bits = [(a, b, c, False) for a in (True, False) for b in (True, False) for c in (True, False)]
    frame = spark.createDataFrame([*bits, (True, True, True, True)], "a boolean, b boolean, c boolean, d boolean")
    got = {tuple(r)[:4]: r["s"] for r in frame.select("*", judging.atomic_support(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).collect()}
    assert got == {x: "direct" if x[3] else "partial" if x[1] and (x[0] or x[2]) else "none" for x in got}
