"""Training stages of a question rebuilt in order: state carried from stage to stage, budgets, and an audit of each.

One pass over the sorted rows of each question gives all outputs. It holds one stage and the items' states, never a
question's stages together; stages of one question are one chain and so lie in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting
from ..functions import places as P
from . import browsing

#: The context, what each kind of stage keeps for its answer, the share of the rest that evidence may take
#: in turn, and what a card needs at least and besides its text.
CONTEXT, OTHER_RESERVE = 8192, 600
RESERVES = {"checklist_init": 1200, "decision": 240, "decision_stop": 240, "state_update": 1200, "evidence_card": 600, "final": 2400}
FACTORS, LEAST_EVIDENCE, LEAST_CARD, CARD_MARGIN, FRAME = (0.75, 0.55, 0.4), 300, 48, 45, 1100
WINDOW = 8
RANK = {"unknown": 0, "missing": 0, "partial": 1, "direct": 2}

_ITEM = "struct<item_id:string,description:string,status:string,evidence_ids:array<string>>"
_UPDATE = "struct<item_id:string,status:string,evidence_ids:array<string>,revised:boolean>"
_SHOWN = "struct<source_id:string,text:string,parent_sha256:string,spans:array<struct<start:int,end:int>>>"
_AUDIT = f"before array<{_ITEM}>, after array<{_ITEM}>, updates array<{_UPDATE}>, shown array<{_SHOWN}>, cards boolean, tokens_before int, tokens int, pending array<string>, eligible boolean"


def scored_evidence(evidence: DataFrame, key: list[str], terms: Callable[[Column], Column]) -> DataFrame:
    """key, opened: a stage's texts with their sentences scored by the question's terms, for cards that show the best of them.

    evidence: key, place, source_id, text, question; a source that stands twice in a stage counts at its first place.
    """
    found = evidence.groupBy(*key, "source_id").agg(F.min("place").alias("place"), *[F.min_by(F.coalesce(c, F.lit("")), "place").alias(c) for c in ("text", "question")])
    rows = found.withColumnRenamed("question", "__q")
    spans = rows.withColumn("s", P.spans_by(F.col("text"), browsing.PREVIEW_END))
    own = F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.size(F.array_intersect(terms(s["text"]), terms(F.col("__q")))).cast("double").alias("score")))
    one = F.struct("place", "source_id", "text", F.sha2("text", 256).alias("sha"), own.alias("spans"))
    return spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "source_id", one.alias("x")))).alias("o")).select(*key, F.transform("o", lambda x: x["x"]).alias("opened"))


def _visible(update: dict, opened: set[str]) -> dict:
    """An update without the citations that its stage doesn't show; support that loses them all is unknown again."""
    kept = [x for x in update["evidence_ids"] if x in opened]
    status = update["status"]
    if status in ("partial", "direct") and not kept:
        status, kept = "unknown", []
    elif len(kept) < len(update["evidence_ids"]):
        status = "partial"
    return update | {"status": status, "evidence_ids": kept, "revised": (status, kept) != (update["status"], update["evidence_ids"])}


def _carded(opened: list, budget: int, count: browsing.Counter) -> list[dict]:
    """Each text's best sentences within an even part of the budget; a text of which nothing fits is left out."""
    share = max(LEAST_CARD, budget // len(opened) - CARD_MARGIN)
    out = []
    for x in opened:
        cap = min(count(x["text"]), share)
        best = browsing.previewed(x["text"], x["spans"], cap, cap, count)
        if best["shown"]:
            out.append({"source_id": x["source_id"], "text": joined(x["text"], best["spans"]), "parent_sha256": x["sha"], "spans": best["spans"]})
    return out


def joined(text: str, spans: list[dict]) -> str:
    """The stretches of a card, joined as `alignment.extract_of` proves them."""
    return " … ".join(text[s["start"] : s["end"]].strip() for s in spans)


def _plain(value: Any) -> Any:
    """Arrow's arrays and rows as lists and dicts."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        return [_plain(v) for v in value]
    return value


def stage(row: dict, items: list[dict], count: browsing.Counter, context: int = CONTEXT) -> tuple[dict, list[dict]]:
    """The audit of one stage whose items stand as `items` before it, and how they stand after it."""
    kind, opened, pending = row["kind"], row["opened"] or [], []
    before, updates, after = items, [], items
    if kind == "state_update":
        seen = {x["source_id"] for x in opened}
        asked = {u["item_id"]: u | {"evidence_ids": list(u["evidence_ids"] or [])} for u in row["updates"] or []}
        for i in items:
            u = _visible(asked[i["item_id"]], seen) if i["item_id"] in asked else None
            if u is None:
                pending.append("item_without_update")
                continue
            fell = RANK.get(u["status"], 0) < RANK[i["status"]] or (i["evidence_ids"] and u["evidence_ids"] != i["evidence_ids"])
            updates.append(u | {"revised": bool(u["revised"] or fell)})
        new = {u["item_id"]: u for u in updates}
        after = [i | {k: new[i["item_id"]][k] for k in ("status", "evidence_ids")} if i["item_id"] in new else i for i in items]
    if kind == "decision" and row["chosen"] and row["chosen"] not in (row["candidates"] or [])[:WINDOW]:
        pending.append("browse_target_outside_current_window")
    reserve = RESERVES.get(kind, OTHER_RESERVE)
    shown = [{"source_id": x["source_id"], "text": x["text"], "parent_sha256": x["sha"], "spans": None} for x in opened]
    size = lambda some: row["prompt_tokens"] + sum(count(x["text"]) for x in some)
    first, cards = size(shown), False
    tokens = first
    if first + reserve > context and opened and kind in ("decision", "decision_stop", "state_update", "final"):
        cards = True
        for factor in FACTORS:
            shown = _carded(opened, max(LEAST_EVIDENCE, int((context - reserve - FRAME) * factor)), count)
            tokens = size(shown)
            if tokens + reserve <= context:
                break
        cited = row["cited"] or [] if kind == "final" else [x for u in updates for x in u["evidence_ids"]]
        kept, whole = {x["source_id"]: x["text"] for x in shown}, {x["source_id"]: x["text"] for x in opened}
        if any(whole.get(c, "").strip() != kept.get(c, "").strip() for c in cited):
            pending.append("target_support_not_verified_after_card")
    if tokens + reserve > context:
        pending.append("input_reserve_overflow")
    if tokens + row["target_tokens"] > context:
        pending.append("total_overflow")
    if row["target_tokens"] > reserve:
        pending.append("target_exceeds_generation_cap")
    pending = list(dict.fromkeys(pending))
    audit = {"before": before, "after": after, "updates": updates, "shown": shown, "cards": cards, "tokens_before": first, "tokens": tokens, "pending": pending, "eligible": bool(row["eligible"]) and not pending}
    return audit, after


def rebuilt(stages: DataFrame, items: DataFrame, key: str, order: str, by: str = counting.CHARACTERS, context: int = CONTEXT) -> DataFrame:
    """key, order, kind and the audit of every stage of every question, in one pass.

    stages: key, order (distinct in a key), kind, opened (see scored_evidence), updates, chosen, candidates, cited,
    prompt_tokens, target_tokens, eligible; items: key, items (array<struct<item_id, description>>), a row a question.

    An item is unknown before its first update; each state update's items stand as the one before left them. Updates lose
    citations that their stage doesn't show, and say if they were revised or fall back. Evidence is shown whole if the
    context has room for it beside the answer's reserve, else as cards. pending names what keeps a stage from training:
    item_without_update, browse_target_outside_current_window, target_support_not_verified_after_card,
    input_reserve_overflow, total_overflow, target_exceeds_generation_cap. A question without items has no states.
    """
    columns = ["kind", "opened", "updates", "chosen", "candidates", "cited", "prompt_tokens", "target_tokens", "eligible"]
    kinds = f"{key} {stages.schema[key].dataType.simpleString()}, {order} {stages.schema[order].dataType.simpleString()}, kind string, {_AUDIT}"
    names = [key, order, "kind", *[c.split()[0] for c in _AUDIT.replace(f"array<{_ITEM}>", "x").replace(f"array<{_UPDATE}>", "x").replace(f"array<{_SHOWN}>", "x").split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counting.counter(by)
        rows = (r for b in batches for r in zip(b[key], b[order], *(b[c] for c in columns), b["__items"], strict=True))
        out = []
        for _, own in itertools.groupby(rows, itemgetter(0)):
            states = None
            for r in own:
                row = {c: _plain(v) for c, v in zip(columns, r[2:-1], strict=True)}
                if states is None:
                    given = _plain(r[-1])
                    states = [{"item_id": i["item_id"], "description": i["description"], "status": "unknown", "evidence_ids": []} for i in (given if isinstance(given, list) else [])]
                audit, states = stage(row, states, count, context)
                out.append((r[0], r[1], row["kind"], *audit.values()))
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    given = stages.select(key, order, *columns).join(items.select(key, F.col("items").alias("__items")), key, "left")
    return given.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, kinds)


def outcome(audits: DataFrame) -> DataFrame:
    """kind, name, n: how many stages of a kind are eligible, carded, revised, or pending for which reason."""
    told = F.array_compact(F.array(F.lit("stages"), F.when(F.col("eligible"), "eligible"), F.when(F.col("cards"), "carded"), F.when(F.exists("updates", lambda u: u["revised"]), "revised")))
    return audits.select("kind", F.explode(F.concat(told, "pending")).alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
