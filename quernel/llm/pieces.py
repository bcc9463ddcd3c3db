"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The public model at hand is of the BPE kind, whose segmentation isn't the path of the greatest sum of scores. Its
segmentation is the one path on which every two neighbouring pieces are what the merge rule makes of their joined
text (merges inside a piece never look past its edges), so the dynamic programme takes this as its step condition:
position i keeps a backpointer to the start of the only piece that can end there. A window of positions no further
back than the longest piece can still be the start of a later piece; once the backpointer paths of all of them meet
in one boundary, the ids up to it are committed and the positions before it forgotten. Before a space that follows
another character, and around characters that no longer piece contains, paths always meet; texts are cut there into
runs, and runs met again come from a cache that is bounded in bytes.

`Lanes` does this for many runs at once, one position of all of them at a time, and `Stream` for one run that is fed in
portions: the same window, step condition and commits. Runs of any length go through Lanes; when fewer than LANES of
them are still going, each carries on from its last commit as a Stream.

Defined cases: a null or empty text has no ids and decodes to an empty text; a text may be of any length; U+2581 in
a text is read as a space, as the format itself does; characters outside the model become byte pieces, so every
other text decodes to itself; other columns and repeated rows are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes that the cache of runs may hold, and what an entry takes besides its text and ids.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 160
CACHED_PAIRS = 500_000
LANES = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Slots of the piece table and of the memory of pairs, as powers of two.
SLOT_BITS, PAIR_BITS = 18, 20

_SPACE = "▁"
#: Numbers from here on stand for single characters outside the model.
OUTSIDE = 1 << 20


def _proto(model: bytes):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
    return proto


class Decoder:
    """What decoding needs of a model."""

    def __init__(self, model: bytes) -> None:
        self._read(_proto(model))

    def _read(self, proto) -> None:
        self.prefix = _SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.out = [p.piece.replace(_SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in proto.pieces]

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()])
        return (text[1:] if self.prefix and text[:1] == b" " else text).decode("utf-8", "replace")


class Pieces(Decoder):
    """A model's pieces with the merge rule, the step condition and both directions."""

    def __init__(self, model: bytes) -> None:
        proto = _proto(model)
        self._read(proto)
        self.rank = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.longest = max(map(len, self.id))
        if any(_SPACE in p.lstrip(_SPACE) for p in self.id):
            raise ValueError("a piece has a space inside")
        joined = {c for p in self.id if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        self.runs = re.compile(f"{_SPACE}*[^{_SPACE}{alone}]+|{_SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.alone = re.compile(f"[{alone}]") if alone else None
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.old: dict[str, bytes] = {}  # the cache before this one: what is met again moves over
        self.pairs: dict[int, bool] = {}
        self.longest = max(map(len, self.id))
        # only pieces that the merge rule makes of their own text can stand on the path; a character always can
        self.sound = {p: i for p, i in self.id.items() if self.merge(p) == [p]}
        self.tails = {p[k:] for p in self.sound for k in range(len(p))}
        self._lookup()

    def merge(self, text: str) -> list[str]:
        """The merge rule on a short text: always the best-scored neighbouring pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str, key: int) -> bool:
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        ok = self.pairs[key] = self.merge(left + right) == [left, right]
        return ok

    def ids(self, piece: str) -> list[int]:
        own = self.id.get(piece)
        return [own] if own is not None else [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]

    def _lookup(self) -> None:
        """Sorted hashes of the sound pieces with a slot table, and an empty memory of pairs."""
        names = list(self.sound)
        wide = np.zeros((len(names), self.longest), np.uint64)
        for i, name in enumerate(names):
            wide[i, : len(name)] = [ord(c) for c in name]
        sizes = np.array([len(x) for x in names])
        h = np.zeros(len(names), np.uint64)
        for k in range(self.longest):
            h = np.where(k < sizes, h * _BASE + wide[:, k] + np.uint64(1), h)
        h = h * _SPREAD  # odd, so no two of them meet; the leading bits tell the slot
        order = np.argsort(h)
        self.hashes, self.numbers = h[order], np.array([self.sound[names[i]] for i in order], np.int64)
        slots = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot = np.searchsorted(slots, np.arange(1 << SLOT_BITS)).astype(np.int32)
        self.deep = int(np.bincount(slots).max())
        self.text_of = {i: p for p, i in self.sound.items()}
        self.met = np.zeros(1 << PAIR_BITS, np.int64)  # twice the last key met in each slot, plus its answer

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of sound pieces, and where these stand."""
        h = h * _SPREAD
        last = len(self.hashes) - 1
        at = np.minimum(self.slot[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], last)
        hit = self.hashes[at] == h
        for k in range(1, self.deep):
            after = np.minimum(at + k, last)
            more = self.hashes[after] == h
            at, hit = np.where(more, after, at), hit | more
        return hit, at

    def _fit(self, keys: np.ndarray) -> np.ndarray:
        """The step condition for an array of pairs."""
        at = (keys.astype(np.uint64) * _SPREAD >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        got = self.met[at]
        ok = (got & 1).astype(bool)
        miss = np.flatnonzero(got >> 1 != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            told = np.array([self._told(key) for key in new.tolist()], bool)
            ok[miss] = told[back]
            self.met[at[miss]] = keys[miss] << 1 | ok[miss]
        return ok

    def _told(self, key: int) -> bool:
        ok = self.pairs.get(key)
        return self.follows(self.text_of[key >> 24], self.text_of[key & 0xFFFFFF], key) if ok is None else ok

    def _streamed(self, run: str) -> bytes:
        return Stream(self).rest(run)

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of space-led words into the cache."""
        kept = self.old
        fresh = []
        for w in words:
            own = kept.get(w)
            if own is None:
                fresh.append(w)
            else:
                self.cache[w] = own
                self.held += len(w) + len(own) + ENTRY_BYTES
        apart = [w for w in fresh if self.alone.search(w)] if self.alone else []
        split = {w: self.runs.findall(_SPACE + w) for w in apart}
        whole = [w for w in fresh if w not in split] if split else fresh
        runs = [_SPACE + w for w in whole]
        runs += {r for parts in split.values() for r in parts}
        done: list[bytes] = []
        for a in range(0, len(runs), 1 << 15):
            done += Lanes(self, runs[a : a + (1 << 15)]).ids()
        self.held += sum(map(len, fresh)) + sum(map(len, done)) + ENTRY_BYTES * len(fresh)
        self.cache.update(zip(whole, done, strict=False))
        of_run = dict(zip(runs[len(whole) :], done[len(whole) :], strict=True))
        for w, parts in split.items():
            self.cache[w] = b"".join([of_run[r] for r in parts])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        split = [t.split(" ") if t else [] for t in texts]
        if self.held > CACHE_BYTES // 2:
            self.old, self.cache, self.held = self.cache, {}, 0
        # a word of no characters joins the spaces around it: such texts are cut by the pattern instead
        plain = [bool(w) and "" not in w and _SPACE not in t and bool(self.prefix) for w, t in zip(split, texts, strict=True)]
        new = {w for words, ok in zip(split, plain, strict=True) if ok for w in words if w not in self.cache}
        odd = [None if ok or not t else self.runs.findall(self.prefix + t.replace(" ", _SPACE)) for t, ok in zip(texts, plain, strict=True)]
        new |= {r[1:] for runs in odd if runs for r in runs if r[0] == _SPACE and r[1:2] not in ("", _SPACE) and r[1:] not in self.cache}
        if new:
            self._learn(new)
        get, out = self.cache.__getitem__, []
        other: dict[str, bytes] = {}
        for words, ok, runs in zip(split, plain, odd, strict=True):
            if ok:
                out.append(b"".join(map(get, words)))
                continue
            ids = []
            for r in runs or ():
                own = self.cache.get(r[1:]) if r[0] == _SPACE and r[1:] else other.get(r)
                if own is None:
                    own = other[r] = self._streamed(r)
                ids.append(own)
            out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Lanes:
    """Many runs side by side. Columns stand for positions from `base` on; what every run has committed is dropped."""

    def __init__(self, pieces: Pieces, runs: list[str]) -> None:
        self.p = pieces
        sizes = np.array([len(r) for r in runs], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes, self.runs = sizes[self.order], [runs[i] for i in self.order]
        n = len(runs)
        self.parts: list[list[bytes]] = [[] for _ in runs]
        self.base, self.done = 0, np.zeros(n, np.int64)
        self.prefix = np.zeros((n, 1), np.uint64)  # hashes of what stands before each position
        self.back = np.zeros((n, 1), np.int32)  # where the piece that ends at a position starts
        self.ends = np.zeros((n, 1), np.int64)  # its number; -1: none can end there, 0: the start
        self.lost = np.zeros(n, bool)  # has a character that the model lacks

    def ids(self) -> list[bytes]:
        n, step = len(self.runs), 2 * self.p.longest
        at = 0
        live = n
        while live >= LANES:
            to = min(at + step, int(self.sizes[0]))
            self._widen(live, at, to)
            for i in range(at + 1, to + 1):
                self._position(i, int(np.searchsorted(-self.sizes[:live], -i, side="right")))
            still = int(np.searchsorted(-self.sizes[:live], -to, side="left"))  # longer than to
            self._finish(np.arange(still, live))
            live, at = still, to
            if live >= LANES:
                self._commit(live, at)
        for r in range(live):
            if not self.lost[r]:
                self._commit_one(r)
        out: list[bytes] = [b""] * n
        for place, r in zip(self.order.tolist(), range(n), strict=True):
            out[place] = self.p._streamed(self.runs[r]) if self.lost[r] else b"".join(self.parts[r])
        return out

    def _widen(self, live: int, at: int, to: int) -> None:
        """Columns for the positions after `at` up to `to`; runs that are over are dropped."""
        text = "".join(r[at:to].ljust(to - at, "\0") for r in self.runs[:live])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(live, to - at).astype(np.uint64)
        wide = (live, to - at)
        self.prefix = np.concatenate((self.prefix[:live], np.zeros(wide, np.uint64)), axis=1)
        self.back = np.concatenate((self.back[:live], np.full(wide, -1, np.int32)), axis=1)
        self.ends = np.concatenate((self.ends[:live], np.full(wide, -1, np.int64)), axis=1)
        for k in range(to - at):
            c = at + k - self.base
            self.prefix[:, c + 1] = self.prefix[:, c] * _BASE + points[:, k] + np.uint64(1)

    def _position(self, i: int, live: int) -> None:
        p, prefix, ends, c = self.p, self.prefix, self.ends, i - self.base
        todo = np.arange(live)
        power = np.ones(1, np.uint64)  # an array wraps round in silence
        for size in range(1, min(c, p.longest) + 1):
            power = power * _BASE
            j = c - size
            hit, at = p._find(prefix[todo, c] - prefix[todo, j] * power)
            if i > size:
                hit &= (ends[todo, j] >= 0) & (i - size >= self.done[todo])
            rows, own = todo[hit], p.numbers[at[hit]]
            if i > size and len(rows):
                ok = p._fit(ends[rows, j] << 24 | own)
                rows, own = rows[ok], own[ok]
            if len(rows):
                self.back[rows, c], ends[rows, c] = i - size, own
                todo = todo[ends[todo, c] < 0]
            if not len(todo):
                break

    def _commit(self, live: int, at: int) -> None:
        """Commits each run up to the boundary in which the paths of all positions that can still matter meet."""
        rows = np.flatnonzero(~self.lost[:live])
        first = np.maximum(at - self.p.longest + 1, self.done[rows])
        places = first[:, None] + np.arange(self.p.longest)
        places = np.minimum(places, at)
        open_ = (self.ends[rows[:, None], places - self.base] >= 0) | (places == self.done[rows][:, None])
        some = open_.any(axis=1)
        self.lost[rows[~some]] = True
        rows, places, open_ = rows[some], places[some], open_[some]
        paths = np.where(open_, places, np.where(open_, places, -1).max(axis=1)[:, None])
        going = np.arange(len(rows))
        while len(going):
            far = paths[going].max(axis=1)
            apart = far > paths[going].min(axis=1)
            going, far = going[apart], far[apart]
            if len(going):
                before = self.back[rows[going], far - self.base]
                paths[going] = np.where(paths[going] == far[:, None], before[:, None], paths[going])
        self._emit(rows, paths[:, 0].astype(np.int64) if len(rows) else np.zeros(0, np.int64))
        kept = int(self.done[rows].min()) if len(rows) else at
        cut = kept - self.base
        self.prefix, self.back, self.ends, self.base = self.prefix[:, cut:], self.back[:, cut:], self.ends[:, cut:], kept

    def _emit(self, rows: np.ndarray, to: np.ndarray) -> None:
        """Ids of the paths from what is committed up to `to`, which is committed then."""
        at, rank, steps = to.copy(), np.arange(len(rows)), []
        while len(rank := rank[at[rank] > self.done[rows[rank]]]):
            c = at[rank] - self.base
            steps.append((rank, self.ends[rows[rank], c]))
            at[rank] = self.back[rows[rank], c]
        count = np.zeros(len(rows), np.int64)
        path = np.zeros((len(rows), len(steps)), np.int32)
        for k, (rank, own) in enumerate(steps):
            path[rank, len(steps) - 1 - k] = own
            count[rank] += 1
        flat = path[np.arange(len(steps)) >= (len(steps) - count)[:, None]].tobytes()
        stops = (4 * np.cumsum(count)).tolist()
        for r, a, b in zip(rows.tolist(), [0, *stops], stops, strict=False):
            if b > a:
                self.parts[r].append(flat[a:b])
        self.done[rows] = to

    def _finish(self, rows: np.ndarray) -> None:
        rows = rows[~self.lost[rows]]
        whole = self.ends[rows, self.sizes[rows] - self.base] >= 0
        self.lost[rows[~whole]] = True
        self._emit(rows[whole], self.sizes[rows[whole]])

    def _commit_one(self, r: int) -> None:
        """The rest of a run as a Stream."""
        at = int(self.done[r])
        stream = Stream(self.p)
        if at:
            number = int(self.ends[r, at - self.base])
            stream.head, stream.ends = self.p.text_of[number], [number]
        self.parts[r].append(stream.rest(self.runs[r][at:]))


class Stream:
    """Feeds text in any portions; ids come out as soon as they are certain."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.text = ""  # what isn't committed, after `head`
        self.head = ""  # the last committed piece
        self.back = [0]  # back[i]: where the piece that ends at i starts; -1: no piece can end there
        self.ends = [0]  # ends[i]: a number for that piece; 0: none
        self.tried = 0

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        step = 8 * self.p.longest
        for a in range(0, len(text), step):
            self._extend(text[a : a + step])
            if len(self.text) - self.tried > 4 * self.p.longest:
                out += self._commit()
        return out

    def rest(self, run: str) -> bytes:
        return np.array(self.feed(run) + self.finish(), np.int32).tobytes()

    def _extend(self, more: str) -> None:
        p, back, ends = self.p, self.back, self.ends
        sound, tails, pairs = p.sound, p.tails, p.pairs
        done, self.text = len(self.text), self.text + more
        text = self.text
        for i in range(done + 1, len(text) + 1):
            found, number = -1, 0
            for j in range(i - 1, max(-1, i - 1 - p.longest), -1):
                piece = text[j:i]
                if piece not in tails and i - j > 1:
                    break
                own = sound.get(piece)
                if own is None:
                    if i - j > 1:
                        continue
                    own = OUTSIDE + ord(piece)
                before = ends[j]
                if before == 0 and j:
                    continue
                if before:
                    key = before << 24 | own
                    ok = pairs.get(key)
                    if ok is None:
                        ok = p.follows(text[back[j] : j] if j else self.head, piece, key)
                    if not ok:
                        continue
                found, number = j, own
                break
            back.append(found)
            ends.append(number)

    def _path(self, i: int) -> list[int]:
        out = [i]
        while i:
            i = self.back[i]
            out.append(i)
        return out

    def _emit(self, to: int) -> list[int]:
        marks = self._path(to)[::-1]
        out: list[int] = []
        for a, b in zip(marks, marks[1:], strict=False):
            out += self.p.ids(self.text[a:b])
        if len(marks) > 1:
            self.head = self.text[marks[-2] : to]
        return out

    def _commit(self) -> list[int]:
        """Commits up to the last boundary that the paths of all live positions share."""
        n = len(self.text)
        live = [i for i in range(max(0, n - self.p.longest + 1), n + 1) if i == 0 or self.back[i] >= 0]
        shared = set(self._path(live[0]))
        for i in live[1:]:
            shared &= set(self._path(i))
        to = max(shared, default=0)
        out = self._emit(to) if to else []
        if to:
            self.text = self.text[to:]
            self.back = [0] + [b - to if b >= 0 else -1 for b in self.back[to + 1 :]]
            self.ends = self.ends[to:]
        self.tried = len(self.text)
        return out

    def finish(self) -> list[int]:
        n = len(self.text)
        out = self._emit(n) if n else []
        self.__init__(self.p)
        return out


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one model file


def _lists(parts: list[bytes]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(parts))]))


def encode(docs: DataFrame, model_path: str = MODEL, text_column: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of every whole text in a new column."""
    model = _model(docs.sparkSession, model_path)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for batch in C.chunks(batches, text_column):
            ids = _lists(pieces.encode_all(batch.column(text_column).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str = MODEL, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text that the ids stand for in a new column."""
    model = _model(encoded.sparkSession, model_path)
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Decoder(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(ids_column)
                at = np.asarray(ids.offsets)
                flat = np.asarray(ids.values)
                texts = [pieces.decode(flat[x:y]) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, into])

    return encoded.mapInArrow(run, schema)


def encoded_and_checked(docs: DataFrame, model_path: str = MODEL, decoded: bool = False) -> DataFrame:
    """docs with ids and round_trip: whether the ids decode to the text (a null one counts as empty).

    decoded: the decoded text is returned too. Names that docs has already get underscores in front.
    """
    model = _model(docs.sparkSession, model_path)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())] + decoded * [T.StructField("decoded", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(C.free_name(f.name, docs), f.dataType) for f in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for batch in C.chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            parts = pieces.encode_all(texts)
            again = [pieces.decode(np.frombuffer(x, np.int32)) for x in parts]
            same = pa.array([x == (t or "") for x, t in zip(again, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(parts), same, *([pa.array(again, pa.string())] if decoded else [])], schema.names)

    return docs.mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text, the text that they decode to, and whether that is the text."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded_and_checked(docs, decoded=True).select("doc_id", "ids", "decoded", F.size("ids").cast("long").alias("n_ids"), "round_trip")
