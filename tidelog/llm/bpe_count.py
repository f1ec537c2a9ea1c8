"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at special strings and by the vocabulary's splitting pattern.  A part
is a linked list of byte symbols; a heap holds its adjacent pairs by merge rank, the
lowest is popped and merged until none is left.  The count is the initial symbols less
the merges; no identifiers are made.  Parts repeat, so each task keeps a bounded memo of
their counts.

A file that splits or normalises in another way than byte-level vocabularies do is refused.

Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows give repeated rows, an
empty table an empty result, other columns do not matter; texts may have any length.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.common import MEMO, with_text_columns

#: Fixed value: the splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What a file may say, where it says anything.
_KNOWN = {
    "pre_tokenizer": {"add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": 0.0, "continuing_subword_prefix": "", "end_of_word_suffix": "", "ignore_merges": False},
}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merges_after(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the lowest-rank-first rule makes on ``symbols``."""
    n = len(symbols)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    value: list[str | None] = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if value[i] != a or (j := right[i]) >= n or value[j] != b:
            continue  # one of the two has been merged since
        value[i], value[j] = a + b, None
        right[i] = k = right[j]
        merges += 1
        if k < n:
            left[k] = i
            if (r := ranks.get((a + b, value[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, value[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((value[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, value[h], a + b))
    return merges


class PartCounts(dict):
    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, part: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        own = [self.symbols[b] for b in part.encode()]
        count = len(own) - merges_after(own, self.ranks)
        if len(part) <= 64:
            self[part] = count
        return count


class Counter:
    """Counts tokens as the ``tokenizers`` library does for a byte-level BPE file."""

    def __init__(self, vocabulary: dict):
        unlike = [f"{part}.{k}" for part, own in _KNOWN.items() for k, v in own.items() if (vocabulary.get(part) or {}).get(k) not in (v, None)]
        if unlike or vocabulary.get("normalizer") or (vocabulary.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"not a plain byte-level vocabulary: {unlike or 'normalizer or pre_tokenizer'}")
        pairs = (p if isinstance(p, list) else p.split(" ") for p in vocabulary["model"]["merges"])
        self.parts = PartCounts({tuple(p): i for i, p in enumerate(pairs)})
        self.find = regex.compile(SPLIT).findall
        special = sorted((t["content"] for t in vocabulary.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __call__(self, text: str) -> int:
        pieces = self.special.split(text) if self.special else [text]
        return len(pieces) - 1 + sum(sum(map(self.parts.__getitem__, self.find(p))) for p in pieces)


def token_counts(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for each row; ``vocabulary``: path of a tokenizers file."""
    context = df.sparkSession.sparkContext
    with open(vocabulary, encoding="utf-8") as f:
        content = context.broadcast(f.read())  # a vocabulary file: a fixed few MB

    def make():
        count = Counter(json.loads(content.value))

        def run(texts: list[str | None]):
            sizes = [len(t.encode()) if t else 0 for t in texts]
            tokens = [count(t) if t else 0 for t in texts]
            return sizes, tokens, [n > limit for n in tokens]

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return with_text_columns(df, text_col, make, fields, keep=[id_col])
