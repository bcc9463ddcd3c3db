"""Channels of an agent's actions: which characters are the query, the focus, the answer, and which only call a tool.

The channels of a decision part its action: the tool's channel is what the others leave of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from . import spans as S

#: The shape of a call, its focus, the marks of an answer and of a stop, and the tools of each kind.
ACTION = r"<call_tool\s+name=\"(?:[^\"]+)\"(?:[^>]*)>(?:.*?)</call_tool>"
FOCUS = r"\bquery=\"(?:[^\"]*)\""
ANSWER, ANSWER_END = "<answer>", "</answer>"
READY = "FINAL_READY"
TOOLS = {"search": ["pubmed_search", "medical_web_search"], "browse": ["browse_document", "browse_webpage"]}
CHANNELS = {"search": "search_query", "browse": "browse_source_focus"}
_CLOSING = len("</call_tool>")

_SCOPES = "array<struct<channel:string,start:int,end:int>>"


def _scope(channel: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(channel).alias("channel"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _times(text: Column, mark: str) -> Column:
    return F.regexp_count(text, F.lit(rf"\Q{mark}\E"))


def channel_spans(rows: DataFrame, kind: str = "kind", raw: str = "raw") -> DataFrame:
    """rows with `scopes`, array<struct<channel, start, end>> by start, and `fault`, null or why there are none.

    checklist and state: all of it. final: from its only <answer> to the last </answer>. stop: its only FINAL_READY. search
    and browse: their only call, parted into the query (search_query; browse_source_focus with the focus in its attributes)
    and the tool's channel. Faults: not_unique, tool_action_count, wrong_tool, focus_count, unsupported_kind. Null text is empty.
    """
    text, of = F.coalesce(F.col(raw), F.lit("")), F.col(kind)
    found = rows.withColumn("__raw", text).withColumn("__calls", P.matches(F.col("__raw"), ACTION))
    call = F.get("__calls", F.lit(0))
    action = F.substr(F.col("__raw"), call["start"] + 1, call["end"] - call["start"])
    parts = [F.regexp_extract(action, r"(?sU)\A(<call_tool\s+name=\")([^\"]+)(\"[^>]*>)(.*?)</call_tool>\z", k) for k in (1, 2, 3, 4)]
    opening, name, attributes, body = parts
    found = found.select(*rows.columns, "__raw", "__calls", call["start"].alias("__start"), call["end"].alias("__end"), name.alias("__name"), F.length(body).alias("__body"), F.length(F.concat(opening, name)).alias("__before"), attributes.alias("__attributes"))
    # the attributes begin after the name's closing quote; the pattern sees that quote too, as a word boundary needs it
    found = found.withColumn("__focus", P.matches(F.col("__attributes"), FOCUS))
    body_end = F.col("__end") - _CLOSING
    query = F.struct((body_end - F.col("__body")).alias("start"), body_end.alias("end"))
    focus = F.get("__focus", F.lit(0))
    at = F.col("__start") + F.col("__before")
    inside = F.struct((at + focus["start"] + len('query="')).alias("start"), (at + focus["end"] - 1).alias("end"))
    semantic = F.when(of == "browse", F.array_sort(F.array(inside, query))).otherwise(F.array(query))
    found = found.withColumn("__semantic", semantic)
    found = found.withColumn("__reach", P.running_max(F.transform("__semantic", lambda s: s["end"])))
    holes = F.transform(S.gaps(F.col("__semantic"), F.col("__reach"), F.col("__end")), lambda g: F.struct(F.greatest(g["start"], F.col("__start")).alias("start"), g["end"].alias("end")))
    tool = F.transform(F.filter(holes, lambda g: g["end"] > g["start"]), lambda g: _scope("tool", g["start"], g["end"]))
    said = F.transform("__semantic", lambda s: F.struct(F.when(of == "browse", CHANNELS["browse"]).otherwise(CHANNELS["search"]).alias("channel"), s["start"].alias("start"), s["end"].alias("end")))
    by_place = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0)
    decision = F.array_sort(F.concat(tool, said), by_place)
    first, last = F.instr("__raw", ANSWER) - 1, F.length("__raw") - F.instr(F.reverse("__raw"), ANSWER_END[::-1]) + 1
    no_answer = (_times(F.col("__raw"), ANSWER) != 1) | (F.instr("__raw", ANSWER_END) == 0) | (last - len(ANSWER_END) < first)
    ready = F.instr("__raw", READY) - 1
    right_tool = F.when(of == "search", F.col("__name").isin(TOOLS["search"])).otherwise(F.col("__name").isin(TOOLS["browse"]))
    fault = (
        F.when(of.isin("checklist", "state"), F.lit(None).cast("string"))
        .when(of == "final", F.when(no_answer, "not_unique"))
        .when(of == "stop", F.when(_times(F.col("__raw"), READY) != 1, "not_unique"))
        .when(of.isin("search", "browse"), F.when(F.size("__calls") != 1, "tool_action_count").when(~right_tool, "wrong_tool").when((of == "browse") & (F.size("__focus") != 1), "focus_count"))
        .otherwise("unsupported_kind")
    )
    scopes = (
        F.when(of == "checklist", F.array(_scope("checklist", F.lit(0), F.length("__raw"))))
        .when(of == "state", F.array(_scope("state", F.lit(0), F.length("__raw"))))
        .when(of == "final", F.array(_scope("final", first, last)))
        .when(of == "stop", F.array(_scope("stop", ready, ready + len(READY))))
        .otherwise(decision.cast(_SCOPES))
    )
    done = found.withColumn("fault", fault)
    return done.select(*rows.columns, F.when(F.col("fault").isNull(), scopes).alias("scopes"), "fault")
