"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised by the library, and cut before every run of the word mark
(U+2581) and between Latin letters and other characters.  No piece of the vocabulary
spans such a cut (checked when the model is loaded; where one does, or where runs
of unknown characters have one id, the cuts are coarser), so each segment is
encoded on its own.  Within a segment an agenda holds all adjacent symbol pairs that form a
piece, best score first and leftmost first among equals; the best pair is
merged, and its new neighbours enter the agenda.  Stale entries are skipped.
What is no piece in the end falls back to bytes, or to the unknown id.  Short
segments of one length share an agenda held in a matrix: in each round the top
entry of every segment is merged.  Long segments have a heap each.

Segments repeat, so a bounded memo of the recent ones is kept for each task;
each new segment is also encoded by the sentencepiece library in batches, and a
difference raises an error.

Defined edge cases: null texts count as empty; an empty text has the end id
only; other columns are carried along unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.llm.shared import give_back, small_batches

MARK = "▁"
#: Bytes of the segments that a task remembers, about: between this number and twice as many.
MEMO_BYTES, ENTRY_BYTES = 32 << 20, 230
#: Characters beyond which a segment gets a heap of its own.
LONG_SEGMENT = 40
#: Segments that share an agenda, so that its arrays stay in the processor's cache.
SEGMENTS_PER_AGENDA = 2048
#: Segments of a text, the finest first: a mark with the run of Latin letters, or of others, behind it; a mark with
#: all up to the next; the whole text.  The first that parts no piece of a vocabulary holds for it.
#: Text that is encoded at once.
STEP_BYTES = 1 << 20
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af"
CUTS = (f"{MARK}+(?:[{_LATIN}]+|[^{_LATIN}{MARK}]+)?|[{_LATIN}]+|[^{_LATIN}{MARK}]+", f"{MARK}+[^{MARK}]*|[^{MARK}]+", r"(?s:.+)")
_NONE = np.int32(1 << 30)
_ID = np.dtype("<i4")


class Agenda:
    """Encoder and decoder over a merge-type model file."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, n = self.library, self.library.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.end = sp.eos_id()
        self.unknown = sp.unk_id()
        self.bytes = {}
        self.rank: dict[str, tuple[float, int]] = {}
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.rank[piece] = (-sp.get_score(i), i)
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.texts = pieces
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self._cut = next(cut for cut in map(re.compile, CUTS if self.bytes else CUTS[1:]) if all(len(cut.findall(p)) == 1 for p in self.rank))
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0
        self._probes: dict[str, bytes] = {}
        self._tables(n)

    def _tables(self, n: int) -> None:
        """Arrays over all pairs of pieces that form a piece, over the levels of scores, and over single characters."""
        levels = {v: i for i, v in enumerate(sorted({r for r, _ in self.rank.values()}))}
        pairs = sorted({(self.rank[p[:k]][1] * n + self.rank[p[k:]][1], levels[r]) for p, (r, _) in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank})
        self._size = n
        # Where pieces have one score, a level does not tell them apart: segments that hold one get a heap.
        shared = Counter(r for r, _ in self.rank.values())
        tied = [p for p, (r, _) in self.rank.items() if shared[r] > 1 and len(p) > 1]
        self._tied = re.compile("|".join(map(re.escape, tied)) if tied else r"(?!)")
        self._pair, self._level = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(1, np.int64) - 1,) * 2
        self._merged = np.zeros(len(levels) + 1, np.int32)
        self._char = np.full(0x110000, -1, np.int32)
        for piece, (r, i) in self.rank.items():
            self._merged[levels[r]] = i
            if len(piece) == 1:
                self._char[ord(piece)] = i

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Return the levels of symbol pairs, _NONE where they form no piece."""
        key = left.astype(np.int64) * self._size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self._pair, key), len(self._pair) - 1)
        return np.where(self._pair[at] == key, self._level[at], _NONE).astype(np.int32)

    def merge_all(self, segments: list[str]) -> list[bytes]:
        """Return the ids, as 4 bytes each, of segments of one length; see the module's description.

        A round takes one symbol from every row, so the agenda stays a matrix.
        """
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).reshape(len(segments), -1)
        symbol = self._char[codes]
        symbol = np.where(symbol < 0, -1 - codes.astype(np.int32), symbol)  # no piece: the character, negative
        level = self._look_up(symbol[:, :-1], symbol[:, 1:])
        of = np.arange(len(segments))
        out: list[bytes] = [b""] * len(segments)
        while len(of):
            width = symbol.shape[1]
            if width > 1:
                rows, at = np.arange(len(of)), level.argmin(axis=1)
                top = level[rows, at]
                done = top == _NONE
            else:
                done = np.ones(len(of), bool)
            if done.any():
                self._finish(out, of[done].tolist(), symbol[done])
                if done.all():
                    break
                stay = ~done
                symbol, level, of, at, top = symbol[stay], level[stay], of[stay], at[stay], top[stay]
                rows = rows[: len(of)]
            symbol[rows, at] = self._merged[top]
            keep = np.ones(symbol.shape, bool)
            keep[rows, at + 1] = False
            symbol = symbol[keep].reshape(len(of), width - 1)
            keep = np.ones(level.shape, bool)
            keep[rows, at] = False
            level = level[keep].reshape(len(of), width - 2)
            for near in (at - 1, at):  # the new symbol's pairs with its neighbours
                r = np.flatnonzero((near >= 0) & (near < width - 2))
                p = near[r]
                level[r, p] = self._look_up(symbol[r, p], symbol[r, p + 1])
        return out

    def _finish(self, out: list[bytes], of: list[int], symbol: np.ndarray) -> None:
        """Note the ids of the rows ``of``; characters that are no piece are settled."""
        flat, step = symbol.astype(_ID).tobytes(), 4 * symbol.shape[1]
        for i, k in enumerate(of):
            out[k] = flat[i * step : (i + 1) * step]
        for i in np.flatnonzero(symbol.min(axis=1) < 0).tolist():
            out[of[i]] = _packed(self._settle(symbol[i].tolist()))

    def _settle(self, ids: list[int]) -> list[int]:
        """Replace characters that are no piece by their bytes, or by one unknown id a run."""
        settled: list[int] = []
        for i in ids:
            if i >= 0:
                settled.append(i)
            elif self.bytes:
                settled += [self.bytes[b] for b in chr(-1 - i).encode()]
            elif not settled or settled[-1] != self.unknown:
                settled.append(self.unknown)
        return settled

    def merge(self, segment: str) -> list[int]:
        """Return the ids of one segment by the agenda of adjacent pairs."""
        rank = self.rank
        if segment in rank and len(segment) == 1:
            return [rank[segment][1]]
        symbols = list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair][0], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            j = after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heapq.heappush(agenda, (rank[new][0], i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heapq.heappush(agenda, (rank[new][0], h, new))
        ids = []
        for symbol in symbols:
            if not symbol:
                continue
            if symbol in rank:
                ids.append(rank[symbol][1])
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def _learn(self, fresh: list[str]) -> None:
        """Add new segments to the memo, and compare each with the library."""
        memo = self._memo
        by_length: dict[int, list[str]] = {}
        for s in fresh:
            by_length.setdefault(LONG_SEGMENT + 1 if len(s) > LONG_SEGMENT or self._tied.search(s) else len(s), []).append(s)
        for length, own in by_length.items():
            if length > LONG_SEGMENT:
                memo.update((s, _packed(self.merge(s))) for s in own)
            else:
                for i in range(0, len(own), SEGMENTS_PER_AGENDA):
                    part = own[i : i + SEGMENTS_PER_AGENDA]
                    memo.update(zip(part, self.merge_all(part)))
        # The library puts a mark before every text.  A segment without one is shown to it behind a
        # character that the cut rule parts from it; where that changes the characters, it is left out.
        shown, want = [], []
        for s in fresh:
            if s[0] == MARK:
                if len(s) > 1:
                    shown.append(s[1:].replace(MARK, " "))
                    want.append((s, b""))
            elif len(self._cut.findall(MARK + (q := "." if s[0].isalpha() else "a") + s)) == 2:
                shown.append(q + s)
                want.append((s, self._probe(q)))
        for text, (s, before), normal, ids in zip(shown, want, self.library.normalize(shown), self.library.encode(shown, num_threads=1)):
            if normal == MARK + text.replace(" ", MARK) and _packed(ids) != before + memo[s]:
                raise ValueError(f"the library encodes {text!r} as {ids}, the agenda as {np.frombuffer(before + memo[s], _ID).tolist()}")

    def forget(self) -> None:
        """Drop the memo."""
        self._memo, self._older, self._held = {}, {}, 0

    def _probe(self, character: str) -> bytes:
        if character not in self._probes:
            self._probes[character] = _packed(self.merge(MARK + character))
        return self._probes[character]

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Return the ids of texts, each with the end id last."""
        segments = [self._cut.findall(t) for t in self.library.normalize(list(texts))]
        distinct = set().union(*segments)
        if self._held > MEMO_BYTES:
            self._older, self._memo, self._held = self._memo, {}, 0
        memo, older = self._memo, self._older
        missing = distinct - memo.keys()
        fresh = []
        for s in missing:
            ids = older.get(s)
            if ids is None:
                fresh.append(s)
            else:
                memo[s] = ids
        if fresh:
            self._learn(fresh)
        self._held += sum(ENTRY_BYTES + len(s) + len(memo[s]) for s in missing)
        end = _packed([self.end])
        return [np.frombuffer(b"".join([*map(memo.__getitem__, parts), end]), _ID) for parts in segments]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


_encoders: dict[str, Agenda] = {}


def encoder(model: str) -> Agenda:
    """Return the worker's encoder for a model file."""
    if model not in _encoders:
        _encoders[model] = Agenda(model)
    return _encoders[model]


def _others(schema: T.StructType, names: Iterable[str]) -> list[T.StructField]:
    """The columns that do not bear one of the names, in any case."""
    taken = {n.lower() for n in names}
    return [f for f in schema.fields if f.name.lower() not in taken]


def encode_rows(docs: DataFrame, model: str, text_col: str, columns: dict[str, T.DataType], build: Callable[[Agenda, list[np.ndarray]], dict[str, pa.Array]]) -> DataFrame:
    """Add ``columns`` to the rows of ``docs``, built from the ids of ``text_col``; they replace columns of the same name.

    ``model`` is a path that executors can read.  Batches are taken in steps of
    ``STEP_BYTES`` of text, or one longer text, so memory is bounded by these and the memo.
    """
    small_batches(docs.sparkSession)
    kept = _others(docs.schema, columns)
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in columns.items())])
    read = names if text_col in names else [*names, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = encoder(model)
        for batch in batches:
            for at, end in _steps(batch.column(text_col)):
                part = batch.slice(at, end - at)
                got = build(agenda, agenda.encode(t or "" for t in part.column(text_col).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(got[k] for k in columns)], names=[*names, *columns])
        agenda.forget()
        give_back()

    return docs.select(*(_quoted(n) for n in read)).mapInArrow(run, schema)


def _steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Yield row ranges of about STEP_BYTES of text each, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        end = int(np.searchsorted(ends, ends[at] - sizes[at] + STEP_BYTES, side="right"))
        yield at, max(at + 1, end)
        at = max(at + 1, end)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of every whole text, the end id last; a column ``ids_col`` is replaced."""

    def build(_: Agenda, ids: list[np.ndarray]) -> dict[str, pa.Array]:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return {ids_col: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))}

    return encode_rows(docs, model, text_col, {ids_col: T.ArrayType(T.IntegerType())}, build)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded", rows_per_step: int = 200) -> DataFrame:
    """Add the text that ids stand for, in place of a column of that name; a null array gives the empty text."""
    small_batches(rows.sparkSession)
    kept = _others(rows.schema, [text_col])
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(model).library
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_step):
                part = batch.slice(at, rows_per_step)
                texts = library.decode([x or [] for x in part.column(ids_col).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    return rows.select(*(_quoted(n) for n in names)).mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def build(agenda: Agenda, ids: list[np.ndarray]) -> dict[str, pa.Array]:
        names = _names(agenda)
        lists = [x.tolist() for x in ids]
        decoded = agenda.library.decode(lists, num_threads=1)
        return {
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(" ".join(map(names.__getitem__, x)).encode()).hexdigest() for x in lists]),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
        }

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    columns = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return encode_rows(rows, model, "text", columns, build).drop("text")


_decimals: list[str] = []


def _names(agenda: Agenda) -> list[str]:
    if len(_decimals) < len(agenda.texts):
        _decimals[:] = map(str, range(len(agenda.texts)))
    return _decimals
