"""SentencePiece encoding and decoding by a streaming Viterbi search, with the identifiers of the model's own algorithm.

The search keeps one path to each of the last positions, as many as the longest piece has characters, and commits
identifiers as soon as all surviving paths go through one boundary.  What it keeps at a position depends on the model:

* A unigram model: the path of the best sum of scores; ties go to the longer last piece.  A character
  without a piece costs its UTF-8 bytes' pieces.
* A BPE model: the path that merging (best pair first, the leftmost of equals) would leave of the text so far.  A sequence of
  pieces is what merging leaves if and only if each two neighbours are what it leaves of the two alone, for merges
  within pieces do not see what lies beyond, and the first merge across a boundary would happen in the pair
  too.  So each position has exactly one such path: its last piece is the one that may follow the
  path to where that piece begins.  Whether two pieces may be neighbours is found by merging
  their few characters, and memoised.  A path of best score would be another text's: scores of a BPE model are ranks.

Where no piece of the vocabulary crosses a gap, all paths meet there, so texts are searched by the stretches between such gaps (``parts_of``: words, and
in them letters of one script, or other signs) and stretches are memoised; that changes no identifier.

A character without a piece becomes its bytes.  ``U+2581`` in a text is written as
bytes, so that decoding gives back every text exactly (the library reads it as a space).

Null text: null identifiers, 0 pieces.  Empty text: no identifiers.  Repeated rows are encoded each, an empty table gives an empty result,
texts may have any length.  Other columns pass, but for those named like new ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from sys import getsizeof

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.common import with_text_columns

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Sets of characters that are told apart in texts.
_SETS = 8
#: Entries of each half of a process's memo of stretches, and about how many bytes they may have.
WORDS, BYTES = 150_000, 27 << 20
#: Entries of each half of the memo of neighbours.
PAIRS = 200_000
#: Bytes of a place in a dict, about.
_PLACE = 50
#: Identifiers from here on stand for characters without a piece; the start of a text.
_CHAR, _START = 1 << 24, -1
_NONE = (0, -float("inf"))
#: Positions between two looks for a common boundary.
_LOOK = 64


def parts_of(pieces: Iterable[str]) -> re.Pattern | None:
    """What cuts texts where no piece crosses; None: a piece goes on after a space.

    Characters side by side in a piece are of one set.  The largest sets have runs of their own; all others share theirs, which only makes stretches longer."""
    other: dict[str, str] = {}

    def first(c: str) -> str:
        while other.setdefault(c, c) != c:
            c = other[c]
        return c

    for p in pieces:
        own = p.lstrip(" ")
        if " " in own:
            return None
        for a, b in zip(own, own[1:]):
            other[first(a)] = first(b)
    sets: dict[str, str] = {}
    for c in list(other):
        sets[first(c)] = sets.get(first(c), "") + c
    runs = [re.escape(x) for x in sorted(sets.values(), key=len, reverse=True)[:_SETS]]
    return re.compile(f" *(?:{''.join(f'[{r}]+|' for r in runs)}[^ {''.join(runs)}]+)| +")


class Vocabulary:
    """Pieces and scores of a model; the space mark is held as a plain space."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool], merges: bool = False):
        """plain: false for unknown, control and byte pieces; merges: a BPE model."""
        self.merges = merges
        self.text = [p.replace("▁", " ") for p in pieces]
        self.byte_of = {i: int(m[1], 16) for i, p in enumerate(pieces) if not plain[i] and (m := _BYTE.fullmatch(p))}
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        self.piece = {self.text[i]: (i, scores[i]) for i in range(len(pieces)) if plain[i] and self.text[i]}
        self.single = {p for p in self.piece if len(p) == 1}
        self.ends = ahocorasick.Automaton()
        for p, (i, score) in self.piece.items():
            self.ends.add_word(p, (len(p), i, score))
        self.ends.make_automaton()
        self.longest = max(map(len, self.piece), default=1)
        low = min((s for _, s in self.piece.values() if s > -1e8), default=0.0)
        self.byte_score = low - 10.0
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.before: dict[tuple[int, int], bool] = {}
        self.parts = parts_of(self.piece)

    @classmethod
    def load(cls, model: bytes) -> "Vocabulary":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        bpe = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(m.get_piece_size())
        return cls([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], [not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i)) for i in ids], bpe)

    def fallback(self, char: str) -> tuple[tuple[int, ...], float]:
        own = char.encode()
        return tuple(self.of_byte[b] for b in own), self.byte_score * len(own)

    def _string(self, i: int) -> str:
        return chr(i - _CHAR) if i >= _CHAR else self.text[i]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces ``a`` and ``b`` of the two joined."""
        known = self.neighbours.get((a, b))
        if known is None:
            known = self.before.pop((a, b), None)
            if known is None:
                own = [self._string(i) for i in (a, b) if i != _START]
                known = self.merged("".join(own)) == own
            if len(self.neighbours) >= PAIRS:
                self.before = dict(self.neighbours)
                self.neighbours.clear()
            self.neighbours[a, b] = known
        return known

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a text of a few characters."""
        parts, get = list(text), self.piece.get
        values = [get(a + b, _NONE)[1] for a, b in zip(parts, parts[1:])]
        while values and (best := max(values)) > _NONE[1]:
            at = values.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = get(parts[at - 1] + parts[at], _NONE)[1]
            if at < len(values):
                values[at] = get(parts[at] + parts[at + 1], _NONE)[1]
        return parts


def stream(chunks: Iterable[str], v: Vocabulary) -> Iterator[int]:
    """Identifiers of a text given in chunks; memory is bounded by where paths meet.

    Positions count from the last common boundary.  The path to a position is known by its last piece: it goes on where that begins."""
    ids, sizes, values = [_START], [0], [0.0]
    merges, known, longest, single = v.merges, v.neighbours.get, v.longest, v.single
    tail = ""
    for chunk in chunks:
        skip = len(tail)
        ends = v.ends.iter(tail + chunk)
        found = next(ends, None)
        while found is not None and found[0] < skip:
            found = next(ends, None)
        for at, char in enumerate(chunk, skip):
            here = len(ids)
            best, own, value = _CHAR + ord(char), 1, None
            while found is not None and found[0] == at:  # pieces that end here, the longest first
                size, i, score = found[1]
                found = next(ends, None)
                if size > here:
                    continue
                if not merges:
                    total = values[here - size] + score
                    if value is None or total > value:
                        best, own, value = i, size, total
                elif value is None:
                    fits = known((ids[here - size], i))
                    if v.may_follow(ids[here - size], i) if fits is None else fits:
                        best, own, value = i, size, 0.0
            if not merges and char not in single:
                total = values[-1] + v.fallback(char)[1]
                if value is None or total > value:
                    best, own, value = _CHAR + ord(char), 1, total
            ids.append(best)
            sizes.append(own)
            values.append(value or 0.0)
            if here % _LOOK == 0:
                meet = _meeting(sizes, longest)
                yield from _path(ids, sizes, meet, v)
                del ids[:meet], sizes[:meet], values[:meet]
        tail = (tail + chunk)[1 - longest :] if longest > 1 else ""
    yield from _path(ids, sizes, len(ids) - 1, v)


def _meeting(sizes: list[int], longest: int) -> int:
    """The last position that the paths to all of the last ``longest`` positions share."""
    n = len(sizes)
    alive = {*range(max(0, n - longest), n)}
    while len(alive) > 1:
        last = max(alive)
        alive.remove(last)
        alive.add(last - sizes[last])
    return alive.pop()


def _path(ids: list[int], sizes: list[int], end: int, v: Vocabulary) -> list[int]:
    back: list[int] = []
    while end > 0:
        i = ids[end]
        if i >= _CHAR:
            back.extend(reversed(v.fallback(chr(i - _CHAR))[0]))
        else:
            back.append(i)
        end -= sizes[end]
    back.reverse()
    return back


class Encoder(dict):
    """Memo from a stretch of text to its identifiers.

    A worker process holds it for as long as it lives, beside the heap of its executor, so it is kept small: when
    full it becomes the old half, from which the stretches that are met again come back."""

    def __init__(self, v: Vocabulary):
        self.v, self.old, self.held = v, {}, 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = tuple(stream((word,), self.v))
        if len(word) <= 64:
            own = getsizeof(word) + getsizeof(ids) + _PLACE
            if len(self) >= WORDS or self.held + own > BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += own
            self[word] = ids
        return ids

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        parts = self.v.parts.findall(" " + text) if self.v.parts else [" " + text]
        return list(chain.from_iterable(map(self.__getitem__, parts)))


#: What a worker process keeps from task to task: the search of one model, with its memos.
_HELD: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The process's encoder of a model; another model replaces it."""
    key = hashlib.sha256(model).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(Vocabulary.load(model))
    return _HELD[key]


class Decoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.bytes = re.compile("\x00([0-9a-f]{2})")
        self.text = [f"\x00{v.byte_of[i]:02x}" if i in v.byte_of else t for i, t in enumerate(v.text)]

    def __call__(self, ids: list[int]) -> str:
        joined = "".join(map(self.text.__getitem__, ids))
        if "\x00" in joined:
            joined = re.sub("(?:\x00[0-9a-f]{2})+", lambda m: bytes.fromhex(m[0].replace("\x00", "")).decode("utf-8", "replace"), joined)
        return joined[1:]


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a model file: under 1 MB


def encode(df: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """Adds ids array<int>, n_pieces and (``check``) round_trip: whether decoding gives the text."""
    content = _model(df, model)

    def make():
        to = encoder(content.value)
        back = Decoder(to.v)

        def run(texts: list[str | None]):
            ids = [None if t is None else to(t) for t in texts]
            sizes = [len(i or ()) for i in ids]
            told = [[None if t is None else back(i) == t for t, i in zip(texts, ids)]] if check else []
            return pa.array(ids, pa.list_(pa.int32())), sizes, *told

        return run

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())]
    return with_text_columns(df, text_col, make, fields + [T.StructField("round_trip", T.BooleanType())] * check, keep)


def decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text_col`` from the identifiers (null: null)."""
    content = _model(df, model)

    def make():
        back = Decoder(Vocabulary.load(content.value))
        return lambda rows: [[None if ids is None else back(ids) for ids in rows]]

    return with_text_columns(df, ids_col, make, [T.StructField(text_col, T.StringType())], keep)
