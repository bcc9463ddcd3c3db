"""Checklists of a question: items located word by word in it, with the proof that they leave no word of it out.

An item is given by fragments of the question, in order. All of it is column work on one row: locating folds over an item's
fragments, and coverage is the union of all items' stretches, by the interval functions of `spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from . import spans as S

MOST_ITEMS = 8

#: Words, the connectors that may stay uncovered, and the cues that make a connector part two requests.
WORD = r"\w+(?:[-‐-‑]\w+)*"
CONNECTORS = ["and", "or"]
CLAUSE = r"(?:what|how|which|when|why|who|does|do)\b"
CUE = (
    r"\b(?:compare\s+for|improv\w*|reduc\w*|affect\w*|effect\w*\s+on|impact\w*\s+on|risk\w*\s+of|outcome\w*|benefit\w*|prevent\w*|preserv\w*|evaluat\w*|assess\w*|predict\w*|measure\w*"
    r"|achiev\w*|effective|safe|mortality|survival|efficacy|safety|diagnos\w*|sensitivity|specificity|recommend\w*|guidance|regulat\w*)\b"
)
LATER_CUE = r"\b(?:compar\w*\b.*?\b(?:for|in)|effect\b.*?\bon|enhanc\w*|caus\w*|lead\w*\s+to|associated\s+with|increas\w*|managed\s+in|evidence\s+supports|approval|authorization|indications|detect\w*)\b"
FRONT = r"\A(?:What|Which)\b"
FRONT_NOUN, FRONT_ADJECTIVE = r"\b(?:risks|outcomes|safety)\b", r"\b(?:maternal|fetal|neonatal)\b"
TOGETHER = r"\b(?:together|coadministered|combined together)\b"

_LETTER = r"[\p{L}\p{N}]"
_SPANS = "array<struct<start:int,end:int>>"


def located(question: Column, fragments: Column) -> Column:
    """struct<spans, fault>: where fragments stand in the question, each at its first place after the one before at which it
    splits no word; fault names the first that has no such place, or is empty."""

    def next_one(state: Column, f: Column) -> Column:
        at = state["at"]
        letter = lambda c: c.rlike(_LETTER)
        left = F.when(letter(F.left(f, F.lit(1))), rf"(?<!{_LETTER})").otherwise("")
        right = F.when(letter(F.right(f, F.lit(1))), rf"(?!{_LETTER})").otherwise("")
        literal = F.concat(F.lit(r"\Q"), F.replace(f, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        # the rest is searched with one character before it, so that the pattern sees whether a word is split
        rest = F.substr(question, F.greatest(at, F.lit(1)), F.length(question))
        place = F.regexp_instr(rest, F.concat(F.when(at > 0, F.lit("(?s)(?<=.)")).otherwise(F.lit("")), left, literal, right))
        start = F.greatest(at, F.lit(1)) + place - 2
        fault = F.when(F.coalesce(f, F.lit("")) == "", F.lit("empty_anchor")).when(place == 0, F.concat(F.lit("anchor_missing_or_inside_word:"), f))
        found = F.struct((start + F.length(f)).alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), (start + F.length(f)).alias("end")))).alias("spans"), F.lit(None).cast("string").alias("fault"))
        return F.when(state["fault"].isNotNull(), state).when(fault.isNotNull(), F.struct(at.alias("at"), state["spans"].alias("spans"), fault.alias("fault"))).otherwise(found)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"), F.lit(None).cast("string").alias("fault"))
    return F.aggregate(fragments, begin, next_one, lambda s: F.struct(s["spans"].alias("spans"), s["fault"].alias("fault")))


def described(fragments: Column) -> Column:
    """An item's wording: its fragments with a space between, none before a mark."""
    return F.regexp_replace(F.array_join(fragments, " "), r"\s+([,.;:?!])", "$1")


def _holders(items: Column, at: Column) -> Column:
    """Numbers of the items that hold the character at a place."""
    held = F.transform(items, lambda i, k: F.when(F.exists(i["spans"], lambda s: (s["start"] <= at) & (at < s["end"])), k))
    return F.filter(held, lambda k: k.isNotNull())


def _separator(question: Column, items: Column, word: Column) -> Column:
    """Whether a connector provably parts two requests: a question word follows, or different items lie on its sides after a
    cue that something is asked of both."""
    before, after = F.left(question, word["start"]), F.substr(question, word["end"] + 1, F.length(question))
    tail = F.regexp_replace(after, rf"(?s)\A[^\p{{L}}\p{{N}}]+", "")
    left_at = F.length(F.regexp_replace(before, r"(?s)[^\p{L}\p{N}]+\z", "")) - 1
    left, right = _holders(items, left_at), _holders(items, F.length(question) - F.length(tail))
    clause = tail.rlike(rf"(?iU)\A{CLAUSE}")
    apart = (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)
    front = question.rlike(f"(?iU){FRONT}") & tail.rlike(f"(?iU){FRONT_NOUN}") & before.rlike(f"(?iU){FRONT_ADJECTIVE}")
    cue = before.rlike(f"(?iU){CUE}") | before.rlike(f"(?iU){LATER_CUE}") | front
    return clause | (apart & cue & ~F.left(tail, F.lit(100)).rlike(f"(?iU){TOGETHER}"))


def checklist(rows: DataFrame, question: str = "question", anchors: str = "anchors", parting: bool = True) -> DataFrame:
    """rows with `items`, array<struct<id, description, spans>>, `separators`, the connectors between items, and `fault`.

    anchors: array<array<string>>, an array of fragments an item, 1 to MOST_ITEMS of them. Every word of the question lies
    in some item, but for connectors that provably part two (with parting off none does). fault is null, or the first of item_count, empty_anchor,
    anchor_missing_or_inside_word:..., uncovered_meaningful_word:..., connector_not_a_proven_task_delimiter:word:place,
    duplicate_items; with a fault there are no items. A null question is empty; null anchors are none.
    """
    asked = F.coalesce(F.col(question), F.lit(""))
    n = F.size(F.coalesce(F.col(anchors), F.array()))
    found = rows.withColumn("__asked", asked).withColumn("__items", F.when(n.between(1, MOST_ITEMS), F.transform(anchors, lambda a: located(F.col("__asked"), a))))
    found = found.withColumn("__words", P.matches(F.col("__asked"), WORD))
    spans = F.array_sort(F.flatten(F.coalesce(F.transform("__items", lambda i: i["spans"]), F.array().cast(f"array<{_SPANS}>"))))
    found = found.withColumn("__ordered", spans).withColumn("__reach", P.running_max(F.transform(spans, lambda s: s["end"])))
    holes = S.gaps(F.col("__ordered"), F.col("__reach"), F.length("__asked"))
    bare = F.filter("__words", lambda w: F.exists(holes, lambda g: (g["start"] < w["end"]) & (w["start"] < g["end"])))
    texts = F.transform(bare, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.substr(F.col("__asked"), w["start"] + 1, w["end"] - w["start"]).alias("text")))
    judged = F.transform(texts, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text"), F.when(F.lower(w["text"]).isin(CONNECTORS), _separator(F.col("__asked"), F.col("__items"), w) if parting else F.lit(False)).alias("parts")))
    found = found.withColumn("__bare", judged)
    lost = F.get(F.filter("__bare", lambda w: ~F.coalesce(w["parts"], F.lit(False))), F.lit(0))
    uncovered = F.when(lost["parts"].isNull(), F.concat(F.lit("uncovered_meaningful_word:"), lost["text"]))
    uncovered = uncovered.otherwise(F.concat_ws(":", F.lit("connector_not_a_proven_task_delimiter"), lost["text"], lost["start"].cast("string")))
    wording = F.transform(anchors, described)
    misplaced = F.get(F.filter(F.transform("__items", lambda i: i["fault"]), lambda f: f.isNotNull()), F.lit(0))
    fault = (
        F.when(~n.between(1, MOST_ITEMS), F.lit("item_count"))
        .when(misplaced.isNotNull(), misplaced)
        .when(lost.isNotNull(), uncovered)
        .when(F.size(F.array_distinct(wording)) < n, F.lit("duplicate_items"))
    )
    items = F.transform(F.arrays_zip(wording.alias("d"), F.col("__items").alias("i")), lambda x, k: F.struct(F.concat(F.lit("R"), (k + 1).cast("string")).alias("id"), x["d"].alias("description"), x["i"]["spans"].alias("spans")))
    separators = F.transform("__bare", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text")))
    done = found.withColumn("fault", fault)
    return done.select(*rows.columns, F.when(F.col("fault").isNull(), items).alias("items"), F.when(F.col("fault").isNull(), separators).alias("separators"), "fault")
