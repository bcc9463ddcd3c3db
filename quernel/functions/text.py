"""Column functions over text: tokens, overlap measures, hosts, numbers, scripts, estimates and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+|[\\u4e00-\\u9fff]"
NUMBER = "[0-9]+(?:[.][0-9]+)?"


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs and single CJK characters, in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(left: Column, right: Column) -> Column:
    """Of two token sets: both empty 1, one empty 0."""
    shared, every = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / F.greatest(every, F.lit(1)))


def set_f1(truth: Column, predicted: Column) -> Column:
    """F1 of two token sets; 0 if they share nothing."""
    shared = F.size(F.array_intersect(truth, predicted))
    return F.when(shared == 0, F.lit(0.0)).otherwise(2.0 * shared / (F.size(truth) + F.size(predicted)))


def overlap_share(query: Column, text: Column) -> Column:
    """The part of the query's token set that the text has."""
    return F.size(F.array_intersect(query, text)) / F.greatest(F.size(query), F.lit(1))


def shared_bigrams(left: Column, right: Column) -> Column:
    """Distinct pairs of neighbouring tokens that both token lists have."""

    def pairs(x: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    return F.size(F.array_intersect(pairs(left), pairs(right)))


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1))


def host_suffixes(name: Column) -> Column:
    """a.b.c, b.c and c of the host a.b.c."""
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def base_id(identifier: Column) -> Column:
    return F.substring_index(identifier, "#", 1)


def web_id(url: Column) -> Column:
    return F.concat(F.lit("WEB:"), F.substring(F.sha2(url, 256), 1, 16))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))


def language_match(question: Column, answer: Column, cjk: int = 12, latin: int = 4) -> Column:
    """Whether question and answer use the same script, by counts of CJK and Latin characters."""

    def script(x: Column) -> Column:
        bare = F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", "")
        return F.when(F.regexp_count(bare, F.lit("[\\u4e00-\\u9fff]")) >= cjk, "cjk").when(F.regexp_count(bare, F.lit("[A-Za-z]")) >= latin, "latin").otherwise("none")

    return script(question) == script(answer)


def token_estimate(text: Column) -> Column:
    """The greater of bytes / 3.15 and words * 1.1, rounded up."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]"))
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 3.15), F.ceil(words * 1.1)).cast("long")


def is_public_url(url: Column) -> Column:
    """http(s), no credentials, a dotted name that isn't local, no literal address of a private range."""
    name = host(url)
    private = name.rlike("^(10|127|0)[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^169[.]254[.]")
    return F.coalesce(F.lower(url).rlike("^https?://") & ~url.contains("@") & name.contains(".") & ~name.rlike("(^|[.])localhost$|[.]local$") & ~private, F.lit(False))


def is_readable(text: Column, min_chars: int = 120, cues: str = "access denied|captcha|enable javascript") -> Column:
    """Enough characters once white space is compacted, and no block cue in the first 4000."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " "))
    return (F.length(flat) >= min_chars) & ~F.lower(F.substring(flat, 1, 4000)).rlike(cues)


def first_case(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern the lower-cased text has."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out.otherwise(default)


def first_given(*columns: Column) -> Column:
    """The first column that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


#: Words that say nothing about a question's topic.
TOPIC_STOP = "the a an of for in on and or to with by is are do does how what which when compared from at as that this these patients adults current evidence study research".split()


def topic_terms(text: Column) -> Column:
    """Distinct lower-case words of over two characters that start with a letter, without TOPIC_STOP."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9-]+"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(TOPIC_STOP)))


def gate(text: Column, groups: list[tuple[list[str], bool]], default: bool = True) -> Column:
    """The verdict of the first group of patterns of which the compacted lower-case text has one."""
    flat, out = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " "))), F.lit(default)
    for patterns, verdict in reversed(groups):
        out = F.when(flat.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(verdict)).otherwise(out)
    return out


def passage_quality(heading: Column, text: Column, signal: str, boilerplate: str, foreign: str, weak: str, short: int = 320) -> Column:
    """A struct (quality, eligible, penalty, reason) of a passage by patterns for its text and heading.

    Boilerplate without a signal of evidence is left out; a signal clears a foreign heading; foreign or weak headings and
    short passages without a signal rank lower.
    """
    told, bad = F.coalesce(text.rlike(signal), F.lit(False)), F.coalesce(text.rlike(boilerplate), F.lit(False))
    apart, thin = F.coalesce(heading.rlike(foreign), F.lit(False)), F.coalesce(heading.rlike(weak), F.lit(False))
    reason = (
        F.when(bad & ~told, "boilerplate").when(apart & told, "signal_over_heading").when(apart, "foreign_heading").when(thin, "weak_heading")
        .when((F.length(text) < short) & ~told, "short").when(told, "signal").otherwise("general")
    )
    low = reason.isin("foreign_heading", "weak_heading", "short")
    quality = F.when(reason == "boilerplate", "excluded").when(low, "context").otherwise("evidence")
    return F.struct(quality.alias("quality"), (reason != "boilerplate").alias("eligible"), F.when(reason == "boilerplate", 100.0).when(low, 2.0).otherwise(0.0).alias("penalty"), reason.alias("reason"))


def candidate_score(focus: Column, question: Column, found: Column, authority: Column, bonuses: list[tuple[Column, float]], penalties: list[tuple[Column, float]], access: Column, worst: float = 180.0) -> Column:
    """Authority, 70 parts for shared tokens (.6 with the focus, .4 with the question; all with the focus if there is no
    question), bonuses and penalties where they hold, and a measured access penalty within [0, worst]."""
    near = overlap_share(focus, found)
    shared = 0.6 * near + 0.4 * F.when(F.size(question) > 0, overlap_share(question, found)).otherwise(near)
    out = authority + 70.0 * shared
    for holds, worth in bonuses:
        out = out + F.when(F.coalesce(holds, F.lit(False)), worth).otherwise(0.0)
    for holds, worth in penalties:
        out = out - F.when(F.coalesce(holds, F.lit(False)), worth).otherwise(0.0)
    return out - F.greatest(F.lit(0.0), F.least(F.coalesce(access, F.lit(0.0)), F.lit(worst)))


def answer_parts(text: Column) -> Column:
    """A struct (status, body) of a final answer: strict with exactly one block, recovered from an open one, else missing."""
    opened, closed = F.regexp_count(text, F.lit("<answer>")), F.regexp_count(text, F.lit("</answer>"))
    status = F.when((opened == 1) & (closed == 1) & (F.instr(text, "<answer>") < F.instr(text, "</answer>")), "strict").when((opened == 1) & (closed == 0), "recovered").when(opened + closed == 0, "missing").otherwise("invalid")
    body = F.when(status == "strict", F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1)).when(status == "recovered", F.regexp_extract(text, "(?s)<answer>(.*)$", 1))
    return F.struct(status.alias("status"), F.trim(body).alias("body"))


def without_orphans(text: Column, close: str = "</think>", action: str = "<call_tool") -> Column:
    """A leading run of closing tags is dropped if an action follows it at once; all else stays."""
    rest = F.regexp_replace(text, f"^(?:\\s*{close})+\\s*", "")
    return F.when(rest.startswith(action), rest).otherwise(text)


def folded_quote(text: Column) -> Column:
    """Quotes and dashes as ASCII, white space compacted, lower case: what quotes are compared by."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—−", "''\"\"---")
    return F.lower(F.trim(F.regexp_replace(plain, "[ \\t\\n\\r ]+", " ")))
