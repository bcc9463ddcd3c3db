"""Main text of web pages, with boilerplate found by a suffix array per host.

A page is cut into blocks. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are dropped, by element, or by class, id and role: a word for such a part alone, or with words of form, not with
others ("sidebar-left", but not "related-work"). That is a prior, which needs no other page.
What every other block keeps, inside an article (or main) element or not, is decided by its host: the token streams of
the host's pages are joined and their suffixes sorted to the depth of RUN tokens by prefix doubling. Boilerplate is a
run of at least RUN tokens, or a whole shorter block, that stands on at least LEAST pages and on one page in SHARE of the
host. It is removed, everything else stays. Pages of a host with the same kept text count as one page, so copies of a
page are no boilerplate.

1. Every page is parsed once; what it keeps is written, compressed page by page.
2. The kept texts go to their hosts' suffix arrays. A large host is dealt to shards by text: a run on one page in SHARE
   of the host is on one in SHARE of some shard, so the shards' own such runs are all the candidates; the host's pages
   that have them are then counted over all shards. The result doesn't depend on the shards, and no stage deals the
   rows of a large host by host alone.
3. A host's boilerplate (at most SHARE times a mean page's tokens, whatever the host's size) is taken out of its pages
   where they were written.

Candidates and boilerplate of all hosts are broadcast if they are measured to have at most SENT_CHARS characters, else
they are joined to the shards.

Defined cases: null or empty html gives an empty text; truncated mark-up ends where the text ends; a null url is a
host of its own, and each such page too; repeated rows count as one page; all text of a page is read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN = 20
LEAST = 3
SHARE = 5
#: A shard has at most SHARD_CHARS characters, and fewer as long as it has SHARD_PAGES pages or more.
SHARD_CHARS = 8 << 20
SHARD_PAGES = 128
EVEN_CHARS = 1 << 20
#: Boilerplate of all hosts together, and large hosts, that a broadcast may hold.
SENT_CHARS = 16 << 20
SENT_HOSTS = 100_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^<>]*\Z", re.S)
#: One attribute after the other, each with its value, so that nothing inside a value is read as a name.
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'=]""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
DROPPED = {"nav", "footer", "aside", "form", "dialog", "menu"}
#: Dropped without ending the block around them.
INLINE = {"button", "select", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video"}
SCOPES = {"article", "main", "section", "div", "header", "ul", "ol", "table", "body", "figure", "dl", "fieldset", "details", "blockquote", "p", "span", "li", *DROPPED, *INLINE}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "article", "section", "main", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "address", "fieldset", "details", "summary", "body", "html", "hr", "dialog", "menu", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that need no end tag; they hold no state here unless they are named as chrome.
OPEN_ENDED = {"p", "li", "span"}
CHROME = set("ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner sidebar comment comments disqus cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations breadcrumb breadcrumbs menu navbar nav navigation footer masthead pagination pager toolbar widget login search copyright disclaimer gdpr".split())
#: Words that say where or in what form chrome stands. A class with any other word beside one of CHROME names a subject
#: ("related-work", "copyright-law"), and one with a word of AROUND what stands around chrome ("content-with-sidebar").
FORM = set("box bar block section list item items wrapper wrap container content inner outer left right top bottom site page global post posts article articles link links button buttons icon icons panel row col column area region group set slot unit text title heading head body primary secondary tertiary user reader header widget widgets large small mobile desktop fixed sticky main home web app js media story blog news entry recent popular trending tags tag tool tools policy bottom footer".split())
AROUND = {"with", "has", "no", "layout", "without"}


def _names_chrome(word: str) -> bool:
    """Whether a class, id or role names chrome: a word of CHROME alone, or with words of form, short prefixes and numbers."""
    parts = [p for p in re.split(r"[-_:]+", word) if p]
    if AROUND.intersection(parts) or parts in (["main"], ["content"]):
        return False
    found = [p in CHROME for p in parts]
    return any(found) and all(c or p in FORM or len(p) <= 2 or not p.isalpha() for p, c in zip(parts, found, strict=True))


def _chrome(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and any(_names_chrome(w) or w in ("complementary", "contentinfo") for w in value.split()):
            return True
    return False


def _is_comment(attributes: str) -> bool:
    """Whether an article is a reader's comment."""
    return any(name.lower() in ("class", "id", "role") and re.search(r"(?<![a-z])comments?(?![a-z])", value, re.I) for name, value in ATTRIBUTE.findall(attributes))


class _Stack:
    """The open elements and what each makes of its text: every question is answered without a walk through them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.owns: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.of: dict[str, list[int]] = {"a": [], "d": [], "x": []}

    def kind(self) -> str:
        """What becomes of text here: dropped within anything dropped, else what the innermost element says."""
        if self.of["d"]:
            return "d"
        return max((places[-1], own) for own, places in self.of.items() if places)[1] if self.of["a"] or self.of["x"] else "u"

    def push(self, name: str, own: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if own:
            self.of[own].append(len(self.names))
        self.names.append(name)
        self.owns.append(own)

    def place(self, name: str) -> int | None:
        """Where the innermost element of the name is open; one that needs no end tag isn't closed through an article."""
        places = self.at.get(name)
        if not places or name in OPEN_ENDED and any(self.at.get(n) and self.at[n][-1] > places[-1] for n in ("article", "main")):
            return None
        return places[-1]

    def close(self, k: int) -> None:
        """Closes the element at k, and those within it."""
        while len(self.names) > k:
            self.at[self.names.pop()].pop()
            if own := self.owns.pop():
                self.of[own].pop()


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each block: kind a for article, d for dropped, u for undecided."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack = _Stack()

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((stack.kind(), text))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not stack.of["x"]:
            parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name in BLOCKS or name in DROPPED:
            flush()
        elif name in ("br", "td", "th", "img"):
            parts.append(" ")
        if closing:
            k = stack.place(name) if name in SCOPES else None
            if k is not None:
                if any(own != "x" for own in stack.owns[k:]):
                    flush()
                stack.close(k)
            continue
        if name in VOID or m[3].rstrip().endswith("/") and name == "svg":
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in SCOPES:
            in_article = bool(stack.of["a"])
            chrome = name not in ("body", "article", "main") and m[3].strip() and _chrome(m[3]) or name == "article" and m[3].strip() and _is_comment(m[3])
            if name in INLINE or chrome and name == "span":
                own = "x"
            elif name in DROPPED or chrome or name == "header" and not in_article:
                own = "d"
            else:
                own = "a" if name in ("article", "main") else ""
            if own in ("d", "x") or name not in OPEN_ENDED:
                if own == "d":
                    flush()
                stack.push(name, own)
    flush()
    return out


def _ranks(flat: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix of flat among all, sorted to the depth of `run` tokens."""
    n = len(flat)
    rank, depth = np.unique(flat, return_inverse=True)[1].astype(np.int64), 1
    while depth < run and n:
        step = min(depth, run - depth)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    return rank


def _flat(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbered tokens of all streams, a separator of its own after each, and the stream of every place."""
    names: dict[str, int] = {}
    flat = np.concatenate([np.array([names.setdefault(t, len(names)) for t in s] + [-1], np.int64) for s in streams]) if streams else np.zeros(0, np.int64)
    stream = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    flat[flat < 0] = len(names) + stream[flat < 0]
    return flat, stream


def _windows(streams: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, stream and class of every run of `run` tokens within a stream; equal runs have one class."""
    flat, stream = _flat(streams)
    ends = np.cumsum([len(s) + 1 for s in streams]) - 1 if streams else np.zeros(0, np.int64)
    at = np.arange(len(flat))
    at = at[at + run <= ends[stream]] if len(flat) else at
    return at, stream[at], _ranks(flat, run)[at]


def _pages_of(owner: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """For each class below n the number of distinct owners that have it."""
    owners = int(owner.max(initial=0)) + 1
    return np.bincount(np.unique(classes * owners + owner) // owners, minlength=n)


def _cover(at: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    hit = np.zeros(total + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + sizes, -1)
    return np.cumsum(hit)[:-1] > 0


def covered(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each page's tokens whether they lie in a run of at least `run` tokens that another page has too."""
    at, page, classes = _windows(streams, run)
    many = _pages_of(page, classes, int(classes.max(initial=-1)) + 1) > 1
    at = at[many[classes]]
    cover = _cover(at, np.full(len(at), run), sum(len(s) + 1 for s in streams))
    begin = np.cumsum([0] + [len(s) + 1 for s in streams])
    return [cover[b : b + len(s)] for b, s in zip(begin, streams, strict=False)]


def _zip(text: str) -> bytes:
    return pa.compress(text.encode("utf-8", "surrogatepass"), "zstd", asbytes=True)


def _unzip(zipped: bytes, size: int) -> str:
    return pa.decompress(zipped, size, "zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else ""


class Units:
    """The runs of RUN tokens and the shorter whole blocks of distinct pages (lines are blocks), with given ones beside.

    Equal units have one class; the given ones stand on no page.
    """

    def __init__(self, pages: list[str], given: list[str]) -> None:
        self.streams = [page.split() for page in pages]
        place, small, names = 0, [], {}
        for number, page in enumerate(pages):
            for block in page.split("\n") if page else ():
                tokens = block.count(" ") + 1
                if tokens < RUN:
                    small.append((names.setdefault(block, len(names)), number, place, tokens))
                place += tokens
            place += 1  # the separator
        asked = [u[1:].split() for u in given if u[0] == "r"]
        at, stream, rank = _windows(self.streams + asked, RUN)
        own = stream < len(pages)
        classes, rank = np.unique(rank, return_inverse=True)
        self.runs = len(classes)
        of_given = iter(rank[~own].tolist())  # one window each, in order
        self.given = [next(of_given) if u[0] == "r" else self.runs + names.setdefault(u[1:], len(names)) for u in given]
        self.blocks = list(names)
        self.at, self.rank = at[own], rank[own]
        small = np.array(small, np.int64).reshape(-1, 4)
        owner = np.concatenate((stream[own], small[:, 1]))
        self.pages = _pages_of(owner, np.concatenate((self.rank, self.runs + small[:, 0])), self.runs + len(names))

    def named(self, good: np.ndarray, whole: bool) -> list[str]:
        """The classes of good by name: b and a block's text, or r and the tokens of a run.

        whole: neighbouring runs are joined, and a run is named once at least; else every run is named by itself.
        """
        out = ["b" + self.blocks[c] for c in np.flatnonzero(good[self.runs :]).tolist()]
        flat = [t for s in self.streams for t in (*s, "")]
        hit = good[self.rank]
        at, rank = self.at[hit], self.rank[hit]
        if not whole:
            rank, first = np.unique(rank, return_index=True)
            return out + ["r" + " ".join(flat[x : x + RUN]) for x in at[first].tolist()]
        met: set[int] = set()
        ends = np.flatnonzero(np.diff(at, append=-1) != 1) + 1
        for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            own = set(rank[a:b].tolist())
            if not own <= met:
                met |= own
                out.append("r" + " ".join(flat[at[a] : at[b - 1] + RUN]))
        return out


class Boilerplate:
    """Units of one host, looked for in its pages."""

    def __init__(self, units: list[str]) -> None:
        self.blocks = {u[1:]: k for k, u in enumerate(units) if u[0] == "b"}
        self.runs: dict[tuple, int] = {}
        for k, u in enumerate(units):
            if u[0] == "r":
                tokens = u[1:].split()
                self.runs |= {tuple(tokens[x : x + RUN]): k for x in range(len(tokens) - RUN + 1)}
        self.leads = {run[0] for run in self.runs}

    def _places(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Where a run starts, and the unit's number."""
        found = []
        for k in range(len(tokens) - RUN + 1) if self.runs else ():
            if tokens[k] in self.leads:
                own = self.runs.get(tuple(tokens[k : k + RUN]))
                if own is not None:
                    found.append((k, own))
        return found

    def within(self, page: str) -> list[int]:
        """The numbers of the units that a page has."""
        own = {self.blocks[b] for b in page.split("\n") if b in self.blocks and b.count(" ") + 1 < RUN}
        return sorted(own | {k for _, k in self._places(page.split())})

    def out_of(self, page: str) -> str:
        """The page without them; its blocks stay blocks."""
        tokens = page.split()
        gone = np.zeros(len(tokens) + 1, np.int64)
        for k, _ in self._places(tokens):
            gone[k] += 1
            gone[k + RUN] -= 1
        covered = np.cumsum(gone) > 0
        at, lines = 0, []
        for block in page.split("\n") if page else ():
            n = block.count(" ") + 1
            if n >= RUN or block not in self.blocks:
                if covered[at : at + n].any():
                    block = " ".join(t for t, c in zip(tokens[at : at + n], covered[at : at + n].tolist(), strict=True) if not c)
                if block:
                    lines.append(block)
            at += n
        return "\n".join(lines)


def _distinct(zipped, sizes) -> list[str]:
    return [_unzip(z, n) for z, n in dict(zip(zipped, sizes, strict=True)).items()]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and shard. The boilerplate of a host of one shard; else the units on one page in SHARE."""

    def told(key: tuple, rows: dict) -> pa.RecordBatch:
        pages = [_unzip(z, n) for z, n in rows.items()]
        names: list[str] = []
        if len(pages) >= LEAST or key[2] > 1:
            units = Units(pages, [])
            names = units.named(units.pages * SHARE >= len(pages), False) if key[2] > 1 else units.named(units.pages >= max(LEAST, -(-len(pages) // SHARE)), True)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(names), pa.string()), pa.array([key[2]] * len(names), pa.int32()), pa.array(names, pa.string())], ["host", "shards", "unit"])

    now, rows = None, {}
    for batch in batches:
        for host, shard, shards, size, zipped in zip(*(batch.column(c).to_pylist() for c in ("host", "shard", "shards", "size", "zipped")), strict=True):
            if (host, shard, shards) != now:
                if now:
                    yield told(now, rows)
                now, rows = (host, shard, shards), {}
            rows[zipped] = size
    if now:
        yield told(now, rows)


def _count(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """How many pages of a shard have each candidate; the empty unit counts the pages."""
    if group.empty:
        return pd.DataFrame(columns=["host", "unit", "n"], dtype=object)
    given, pages = list(asked["unit"]), _distinct(group["zipped"], group["size"])
    units = Units(pages, given)
    return pd.DataFrame({"host": group["host"].iloc[0], "unit": ["", *given], "n": [len(pages), *units.pages[units.given]]})


def _removed(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The main texts of a shard's pages."""
    out = Boilerplate(list(asked["unit"]))
    return group[["page_id", "url"]].assign(text=[out.out_of(_unzip(z, n)) for z, n in zip(group["zipped"], group["size"], strict=True)])


def kept_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, chars, size (bytes) and zipped: what the tag rules keep of every page, blocks as lines."""
    alone = F.concat(F.lit("?"), F.xxhash64("page_id", "html").cast("string"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), alone)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "html"):
            texts = ["\n".join(text for kind, text in blocks(page) if kind != "d") if page else "" for page in batch.column("html").to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            own = [pa.array([len(t) for t in texts], pa.int32()), pa.array(sizes, pa.int32()), pa.array([_zip(t) if t else b"" for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *own], ["page_id", "url", "host", "chars", "size", "zipped"])

    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(cut, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, chars int, size int, zipped binary")


def _sent(units: DataFrame) -> dict[str, list[str]] | None:
    """host to units, if they are few enough to be broadcast."""
    if (units.agg(F.sum(F.length("unit") + F.length("host"))).first()[0] or 0) > SENT_CHARS:
        return None
    told: dict[str, list[str]] = {}
    for r in units.orderBy("host", "unit").collect():  # at most SENT_CHARS characters
        told.setdefault(r["host"], []).append(r["unit"])
    return told


def _on_pages(texts: DataFrame, told: dict[str, list[str]]) -> DataFrame:
    """host, unit and the number of distinct pages that have it; the empty unit counts the host's pages."""
    sent = texts.sparkSession.sparkContext.broadcast(told)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Boilerplate] = {}
        for batch in batches:
            units = []
            for host, size, zipped in zip(*(batch.column(c).to_pylist() for c in ("host", "size", "zipped")), strict=True):
                if host not in known:
                    known[host] = Boilerplate(sent.value.get(host, []))
                units.append(known[host].within(_unzip(zipped, size)))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(units, pa.list_(pa.int32()))], ["host", "page", "units"])

    found = texts.select("host", "size", "zipped", F.xxhash64("zipped").alias("page")).mapInArrow(within, "host string, page long, units array<int>")
    once = found.groupBy("host", "page").agg(F.first("units").alias("units"))
    counted = once.select("host", F.explode(F.concat(F.array(F.lit(-1)), "units")).alias("k")).groupBy("host", "k").agg(F.count("*").alias("n"))
    names = texts.sparkSession.createDataFrame([(h, k, u) for h, own in told.items() for k, u in enumerate(["", *own], -1)], "h string, i int, unit string")
    return counted.join(names, (F.col("host") == F.col("h")) & (F.col("k") == F.col("i"))).select("host", "unit", "n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    spark, out = pages.sparkSession, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    kept = C.written(kept_texts(pages))
    chars = F.sum("chars")
    many = F.greatest(F.ceil(chars / SHARD_CHARS), F.least(F.ceil(chars / EVEN_CHARS), F.floor(F.count("*") / SHARD_PAGES)))
    sizes = C.cut(kept.groupBy(F.col("host").alias("h")).agg(many.cast("int").alias("many")).filter("many > 1"))
    large = sizes.count()
    if large <= SENT_HOSTS:
        sizes = F.broadcast(sizes)
    shards = F.coalesce("many", F.lit(1))
    dealt = kept.join(sizes, F.col("host") == F.col("h"), "left").withColumns({"shards": shards, "shard": F.pmod(F.xxhash64("zipped"), shards).cast("int")})
    texts = dealt.filter("size > 0").select("host", "shard", "shards", "size", "zipped")
    found = C.cut(texts.repartition("host", "shard").sortWithinPartitions("host", "shard").mapInArrow(_found, "host string, shards int, unit string"))
    bad = found.filter("shards = 1").select("host", "unit")
    key = ["host", "shard"]

    def of_shards(units: DataFrame) -> DataFrame:
        several = units.join(sizes, F.col("host") == F.col("h"), "left").withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
        return several.select("host", "shard", "unit")

    asked = found.filter("shards > 1").select("host", "unit").distinct()
    if large and not asked.isEmpty():
        told, own = _sent(asked), texts.filter("shards > 1")
        if told is None:
            counted = own.groupBy(*key).cogroup(of_shards(asked).groupBy(*key)).applyInPandas(_count, "host string, unit string, n long")
            counted = counted.groupBy("host", "unit").agg(F.sum("n").alias("n"))
        else:
            counted = _on_pages(own.filter(F.col("host").isin(list(told))) if len(told) < 100 else own, told)
        counted = C.cut(counted)
        need = counted.filter("unit = ''").select(F.col("host").alias("g"), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / SHARE)).alias("need"))
        bad = bad.union(counted.filter("unit <> ''").join(need, (F.col("host") == F.col("g")) & (F.col("n") >= F.col("need"))).select("host", "unit"))
    bad = C.cut(bad)
    told = _sent(bad)
    if told is None:
        return dealt.groupBy(*key).cogroup(of_shards(bad).groupBy(*key)).applyInPandas(_removed, out)
    sent = spark.sparkContext.broadcast(told)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Boilerplate] = {}
        for batch in batches:
            texts = []
            for host, size, zipped in zip(*(batch.column(c).to_pylist() for c in ("host", "size", "zipped")), strict=True):
                text = _unzip(zipped, size)
                if host in sent.value:
                    if host not in known:
                        known[host] = Boilerplate(sent.value[host])
                    text = known[host].out_of(text)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return kept.select("page_id", "url", "host", "size", "zipped").mapInArrow(clean, out)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
