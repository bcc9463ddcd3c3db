"""A rebuilt data set against the one that it was made of: nothing invented, nothing lost, every state in its order.

Rows pair by keys, and a shown text meets the one source that it names: no row is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what joins the stretches of an extract.
ELLIPSIS = " … "

_KNOWN = ["unknown", "missing", "partial", "direct"]


def extract_of(text: Column, spans: Column) -> Column:
    """The stretches of a text between the starts and ends of spans, trimmed and joined by an ellipsis."""
    return F.array_join(F.transform(spans, lambda s: F.trim(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), ELLIPSIS)


def evidence_proofs(old: DataFrame, new: DataFrame, stage: str = "stage_id") -> DataFrame:
    """new with `proof`: copy, exact_spans, or a fault: future_or_invented_source, card_text_not_exact_spans,
    card_parent_hash, untraced_evidence_change.

    old: stage, source_id, text; new: the same and spans (array<struct<start, end>> into the old text, null if it isn't an
    extract) and parent_sha256. A source that old has twice for a stage counts with its last text in order, as the reader of
    a page sees the latest one; repeated rows of new are judged one by one. Digests meet first: equal texts are never
    shipped, and old texts go only to the rows that name them and differ.
    """
    last = old.groupBy(stage, "source_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("__old"))
    keys = last.select(stage, "source_id", F.sha2("__old", 256).alias("__sha"))
    marked = new.withColumn("__row", F.monotonically_increasing_id()).join(keys, [stage, "source_id"], "left")
    same = F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("__sha")
    marked = marked.withColumn("__way", F.when(F.col("__sha").isNull(), "future_or_invented_source").when(same, "copy").when(F.col("spans").isNull(), "untraced_evidence_change").when(~F.coalesce(F.col("parent_sha256") == F.col("__sha"), F.lit(False)), "card_parent_hash"))
    settled = marked.filter(F.col("__way").isNotNull()).withColumn("proof", F.col("__way"))
    cards = marked.filter(F.col("__way").isNull()).join(last, [stage, "source_id"])
    inside = F.forall("spans", lambda s: (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length("__old")))
    exact = F.coalesce(inside & (extract_of(F.col("__old"), F.col("spans")) == F.col("text")), F.lit(False))
    judged = cards.withColumn("proof", F.when(exact, "exact_spans").otherwise("card_text_not_exact_spans"))
    return settled.select(*new.columns, "proof").unionByName(judged.select(*new.columns, "proof"))


def chain_faults(updates: DataFrame, key: list[str], order: str, item: str = "item_id") -> DataFrame:
    """Updates of items' states that break the chain or cite badly: key, order, item, fault.

    updates: key, order, item, prior_status, prior_ids, status, evidence_ids, opened_ids. An item's prior state is the one
    that the update before left, and unknown without evidence at first; faults, the first that holds: invalid_status,
    state_prior_mismatch, state_unopened_citation, unknown_with_citation, support_without_citation. Null ids are none.
    """
    none = F.array().cast("array<string>")
    given = updates.withColumns({c: F.coalesce(F.col(c), none) for c in ("prior_ids", "evidence_ids", "opened_ids")})
    by_item = Window.partitionBy(*key, item).orderBy(order)
    before = F.coalesce(F.lag("status").over(by_item), F.lit("unknown")), F.coalesce(F.lag("evidence_ids").over(by_item), none)
    seen = given.withColumns({"__status": before[0], "__ids": before[1]})
    supports = F.col("status").isin("partial", "direct")
    fault = (
        F.when(~F.coalesce(F.col("status").isin(_KNOWN), F.lit(False)), "invalid_status")
        .when(~F.coalesce((F.col("prior_status") == F.col("__status")) & (F.col("prior_ids") == F.col("__ids")), F.lit(False)), "state_prior_mismatch")
        .when(F.size(F.array_except("evidence_ids", "opened_ids")) > 0, "state_unopened_citation")
        .when(~supports & (F.size("evidence_ids") > 0), "unknown_with_citation")
        .when(supports & (F.size("evidence_ids") == 0), "support_without_citation")
    )
    return seen.select(*key, order, item, fault.alias("fault")).filter("fault is not null")


def row_faults(old: DataFrame, new: DataFrame, key: str, same: list[str]) -> DataFrame:
    """key, fault: rows of the rebuilt set that are missing, added, repeated, or differ in a column that must stay.

    Faults: missing, added, repeated, and <column>_changed for the first of `same` that changed; a key's first that holds.
    Texts are compared by digest; null equals null.
    """
    digest = lambda c: F.sha2(F.to_json(F.struct(F.col(c).alias("v"))), 256)
    one = old.groupBy(key).agg(*[F.min(digest(c)).alias(f"__o{k}") for k, c in enumerate(same)], F.lit(1).alias("__old"))
    two = new.groupBy(key).agg(*[F.min(digest(c)).alias(f"__n{k}") for k, c in enumerate(same)], F.count("*").alias("__n"))
    both = one.join(two, key, "full")
    fault = F.when(F.col("__n").isNull(), "missing").when(F.col("__old").isNull(), "added").when(F.col("__n") > 1, "repeated")
    for k, c in enumerate(same):
        fault = fault.when(F.col(f"__o{k}") != F.col(f"__n{k}"), f"{c}_changed")
    return both.select(key, fault.alias("fault")).filter("fault is not null")


def leaked(rows: DataFrame, key: str, split: str, apart: tuple[str, str] = ("train", "dev")) -> DataFrame:
    """The keys that stand in both splits."""
    found = rows.filter(F.col(split).isin(*apart)).groupBy(key).agg(F.min(split).alias("__a"), F.max(split).alias("__b"))
    return found.filter("__a <> __b").select(key)


def summary(**tables: DataFrame) -> DataFrame:
    """table, name, n: rows of each table by its fault or proof, all counted by their tasks first."""
    parts = [df.groupBy(F.lit(name).alias("table"), F.col("proof" if "proof" in df.columns else "fault").alias("name")).agg(F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
