"""Benchmark decontamination by SimHash of item-sized windows.

Items and documents are lower-cased words (runs of letters, digits and underscores).  An
item is the weighted multiset of its ``k``-word shingles (an item of fewer words is one
shingle); a shingle's weight is ``log(1 + items / items with it)``.  A window is as many words of
a document as an item has.  Its SimHash differs from the item's in at most ``radius`` bits, or
it is no candidate.  The fingerprint is cut into four blocks of 16 bits; by the pigeonhole principle one within
the radius of 15 differs from the item's by at most three bits in some block, so that each block's table is asked
for all values that near (697 of 65536; a fingerprint without relation meets an item in 4 % of cases).  Candidates
are verified by exact weighted Jaccard similarity, ``least`` or more.

Windows whose shingles cannot add up to ``least`` of any item of that size are not
fingerprinted: that bound is exact, and leaves out nearly all clean text.

Items go to the tasks in slices of about ``slice_items``, so what a broadcast holds is bounded.  Beyond one slice, one pass over
the documents with a filter of fixed size of all items' shingles leaves the rows that can match at all (another exact bound), and the
slices are asked for these only, one after the other.  Weights are
counted over the whole benchmark; a slice gets those of its own shingles and of all that two items or more
have (any other shingle weighs as an unseen one), so slices change no result.  Null and empty documents and items match nothing; empty tables
give no rows.  A document that
occurs twice gets its rows twice; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import WordHash, fresh, mixed, name, slices, windows, with_text_columns, written

_WORDS = re.compile(r"\w+").findall
_BITS = np.arange(64, dtype=np.uint64)
#: Bits of a block of the index; slots of the filter of all items' shingles.
BLOCK = 16
FILTER = 1 << 24
_COLUMNS = ["id", "item_id", "similarity", "start_word", "n_words"]


def words_of(text: str | None, hashes: WordHash) -> np.ndarray:
    return hashes.of(_WORDS(text.lower())) if text else np.empty(0, np.uint64)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    return ((mixed(shingles)[:, None] >> _BITS) & np.uint64(1)).astype(np.float64) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """A fingerprint of each row of 64 sums."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(-1, dtype=np.uint64)


def near_values(radius: int) -> np.ndarray:
    """All 16-bit numbers with at most a quarter of ``radius`` bits set."""
    every = np.arange(1 << BLOCK, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius // (64 // BLOCK)].astype(np.int64)


def similarity(a: Counter, b: Counter, weight: dict[int, float], default: float) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both = all_ = 0.0
    for k in a.keys() | b.keys():
        w = weight.get(k, default)
        x, y = a.get(k, 0), b.get(k, 0)
        both += w * min(x, y)
        all_ += w * max(x, y)
    return both / all_ if all_ else 0.0


@dataclass
class Item:
    item_id: int
    shingles: Counter
    fingerprint: int
    total: float


class Items:
    """The items of one slice by size, with block indexes over their fingerprints."""

    def __init__(self, rows: list[tuple[int, str | None]], k: int, least: float, radius: int, hashes: WordHash, counts: dict[int, int], n: int):
        """counts: items with a shingle, n: items, both of the whole benchmark."""
        self.k, self.least, self.radius, self.hashes = k, least, radius, hashes
        own = [(i, w) for i, t in rows if i is not None and len(w := words_of(t, hashes))]
        shingled = [(i, len(w), windows(w, min(k, len(w)))) for i, w in own]
        self.weight = {s: float(np.log(1 + n / c)) for s, c in counts.items()}
        self.default = float(np.log(1 + n))
        self.known = np.sort(np.fromiter(self.weight, np.uint64, len(self.weight)))
        self.known_weight = np.array([self.weight[s] for s in self.known.tolist()])
        # most shingles are no item's: a table of their low bits says so without a search
        self.low = np.uint64((1 << 20) - 1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known & self.low).astype(np.int64)] = True
        self.around = near_values(radius)
        self.close = np.zeros(1 << BLOCK, bool)
        self.close[self.around] = True
        self.by_size: dict[int, list[Item]] = defaultdict(list)
        for i, size, sh in shingled:
            w = np.array([self.weight[s] for s in sh.tolist()])
            self.by_size[size].append(Item(i, Counter(sh.tolist()), int(packed((signs(sh) * w[:, None]).sum(0))), float(w.sum())))
        self.bounds = sorted((size, least * min(i.total for i in items) - 1e-6) for size, items in self.by_size.items())
        self.of_size = {size: np.unique(np.fromiter((x for i in items for x in i.shingles), np.uint64)) for size, items in self.by_size.items()}
        #: size -> for each block, the items in the order of its values and where each value begins
        self.index = {}
        for size, items in self.by_size.items():
            prints = np.array([i.fingerprint for i in items], np.uint64)
            values = [((prints >> np.uint64(at)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64) for at in range(0, 64, BLOCK)]
            orders = [np.argsort(v, kind="stable") for v in values]
            self.index[size] = prints, [(o, v[o]) for o, v in zip(orders, values)]

    def near(self, size: int, fingerprint: int) -> list[Item]:
        """Every item of that size within the radius, by way of the blocks."""
        prints, blocks = self.index[size]
        found: set[int] = set()
        for i, (order, values) in enumerate(blocks):
            own = (fingerprint >> (BLOCK * i)) & ((1 << BLOCK) - 1)
            if len(values) < len(self.around):  # fewer items than values to ask for
                found.update(order[self.close[values ^ own]].tolist())
                continue
            asked = self.around ^ own
            first, last = np.searchsorted(values, asked), np.searchsorted(values, asked, "right")
            for a, b in zip(first[first < last].tolist(), last[first < last].tolist()):
                found.update(order[a:b].tolist())
        items = self.by_size[size]
        return [items[j] for j in sorted(found) if (items[j].fingerprint ^ fingerprint).bit_count() <= self.radius]

    def weights_at(self, shingles: np.ndarray) -> np.ndarray:
        """The weight of each shingle that an item has, else 0."""
        out = np.zeros(len(shingles))
        on = np.flatnonzero(self.maybe[(shingles & self.low).astype(np.int64)])
        if len(on):
            own = shingles[on]
            at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            out[on] = np.where(self.known[at] == own, self.known_weight[at], 0.0)
        return out

    def matches(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """item_id -> (similarity, first word, words) of its best window; ties: the first."""
        words = words_of(text, self.hashes)
        best: dict[int, tuple[float, int, int]] = {}
        by_k: dict[int, tuple] = {}
        for size, bound in self.bounds:
            if size > len(words):
                break
            k = min(self.k, size)
            if k not in by_k:
                sh = windows(words, k)
                hit = self.weights_at(sh)
                on = np.flatnonzero(hit)
                by_k[k] = sh, hit, on, sh[on], hit[on], float(hit.sum())
            sh, hit, on, on_sh, on_hit, total = by_k[k]
            if total < bound:
                continue
            own_hit = np.where(np.isin(on_sh, self.of_size[size]), on_hit, 0.0)  # of items of this size only
            if own_hit.sum() < bound:
                continue
            n = size - k + 1
            placed = np.zeros(len(sh))
            placed[on] = own_hit
            upto = np.concatenate(([0.0], np.cumsum(placed)))
            mass = upto[n:] - upto[:-n]
            for start in np.flatnonzero(mass >= bound).tolist():
                own = sh[start : start + n]
                w = np.where(hit[start : start + n] > 0, hit[start : start + n], self.default)
                near = self.near(size, int(packed((signs(own) * w[:, None]).sum(0))))
                window = Counter(own.tolist()) if near else None
                for item in near:
                    s = similarity(window, item.shingles, self.weight, self.default)
                    if s >= self.least - 1e-12 and s > best.get(item.item_id, (0.0,))[0]:
                        best[item.item_id] = (s, start, size)
        return best


class Benchmark:
    """The items in slices, the counts that their weights need, and a filter of all their shingles."""

    def __init__(self, benchmark: DataFrame, item_col: str, item_text: str, slice_items: int, k: int):
        self.context = benchmark.sparkSession.sparkContext
        items = benchmark.select(name(item_col).cast("long").alias("i"), name(item_text).alias("t"))
        self.n = n = -(-max(items.count(), 1) // slice_items)
        self.items = items.withColumn("s", F.coalesce(F.pmod(F.xxhash64("i"), F.lit(n)), F.lit(0)).cast("int"))
        self.k = k

        def run(batches):
            hashes = WordHash()
            for batch in batches:
                for piece in slices(batch):
                    s, h, z = [], [], []
                    for t, own in zip(*map(pa.Array.to_pylist, piece.columns)):
                        words = words_of(t, hashes)
                        if len(words):
                            found = np.unique(windows(words, min(k, len(words)))).view(np.int64).tolist()
                            h += [None, *found]  # the null counts the item
                            s += [own] * (len(found) + 1)
                            z += [len(words)] * (len(found) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(h, pa.int64()), pa.array(z, pa.int64())], ["s", "h", "size"])

        pairs = self.items.where("i IS NOT NULL").select("t", "s").mapInArrow(run, "s int, h long, size long")
        self.pairs = written(pairs, "items") if n > 1 else pairs
        self.counts = self.pairs.groupBy("h").agg(F.count("*").alias("c"), F.collect_set("s").alias("slices"))
        self.counts = written(self.counts, "shingles") if n > 1 else self.counts

    def slice(self, s: int):
        """A broadcast of one slice: a bounded number of items, and the shingles of theirs and common ones."""
        own = self.counts.where(F.col("h").isNull() | (F.col("c") > 1) | F.array_contains("slices", s)).select("h", "c").toArrow().combine_chunks()
        whole = own.filter(own["h"].is_null())["c"].to_pylist()
        own = own.filter(own["h"].is_valid())
        rows = [(r.i, r.t) for r in self.items.where(F.col("s") == s).orderBy("i", "t").collect()]
        return self.context.broadcast((rows, own["h"].to_numpy().view(np.uint64), own["c"].to_numpy(), max(sum(whole), 1)))

    def reachable(self, docs: DataFrame, text_col: str, least: float) -> DataFrame:
        """The rows with a window of some item's size in which a part of ``least`` of the shingles is in the filter.

        A shingle that no item has weighs most, so a window below that part reaches no item.  The filter has FILTER bits and
        at most as many item sizes as there are; what it lets through by chance is looked at again."""
        k, bit = self.k, F.pmod(F.col("h"), F.lit(FILTER))
        words = self.pairs.where("h IS NOT NULL").select(F.floor(bit / 32).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER}) % 32 as int))").alias("b"))
        filled = np.zeros(FILTER // 32, np.uint32)
        rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # FILTER / 32 words at most
        filled[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
        sizes = sorted(r.size for r in self.pairs.select(F.col("size")).distinct().toPandas().itertuples())
        shared = self.context.broadcast((filled, sizes))
        flag = fresh(docs.columns, "reachable")

        def make():
            bits, hashes = shared.value[0], WordHash()

            def can(text: str | None) -> bool:
                words = words_of(text, hashes)
                sums: dict[int, np.ndarray] = {}
                for size in shared.value[1]:
                    if size > len(words):
                        return False
                    if (kk := min(k, size)) not in sums:
                        at = (windows(words, kk) & np.uint64(FILTER - 1)).astype(np.int64)
                        sums[kk] = np.concatenate(([0], np.cumsum((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1)))
                    upto, n = sums[kk], size - kk + 1
                    if upto[-1] >= least * n - 1e-6 and (upto[n:] - upto[:-n]).max() >= least * n - 1e-6:
                        return True
                return False

            return lambda texts: [[*map(can, texts)]]

        return with_text_columns(docs, text_col, make, [T.StructField(flag, T.BooleanType())]).where(F.col(flag)).drop(flag)


def items_of(shared, k: int, least: float, radius: int) -> Items:
    rows, known, counts, n = shared.value
    return Items(rows, k, least, radius, WordHash(), dict(zip(known.tolist(), counts.tolist())), n)


def _leaks(source: DataFrame, items: Benchmark, k: int, least: float, radius: int) -> DataFrame:
    """id, item_id, ... of every match; ``source`` has id (long) and text."""
    def one(rows) -> DataFrame:
        def run(batches):
            own = items_of(rows, k, least, radius)
            for batch in batches:
                for piece in slices(batch):
                    out = [(d, i, *found) for d, t in zip(*map(pa.Array.to_pylist, piece.columns)) for i, found in sorted(own.matches(t).items())]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], _COLUMNS)

        return source.mapInArrow(run, "id long, item_id long, similarity double, start_word long, n_words long")

    if items.n == 1:
        return one(items.slice(0))
    source = written(items.reachable(source, "text", least), "reachable")
    parts = []
    for s in range(items.n):
        shared = items.slice(s)
        parts.append(written(one(shared), "leaks"))
        shared.destroy()
    return reduce(DataFrame.unionAll, parts)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = 5, least: float = 0.8, radius: int = 15, slice_items: int = 20_000,
) -> DataFrame:
    """One row for each document and item with a window of similarity ``least`` or more."""
    source = docs.select(name(id_col).cast("long").alias("id"), name(text_col).alias("text"))
    found = _leaks(source, Benchmark(benchmark, item_col, item_text, slice_items, k), k, least, radius)
    return found.withColumnRenamed("id", "doc_id")


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = 5, least: float = 0.8, radius: int = 15, slice_items: int = 20_000,
) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    items = Benchmark(benchmark, item_col, item_text, slice_items, k)
    if items.n == 1:
        rows, flag = items.slice(0), fresh(docs.columns, "leak")

        def make():
            own = items_of(rows, k, least, radius)
            return lambda texts: [[bool(own.matches(t)) for t in texts]]

        return with_text_columns(docs, text_col, make, [T.StructField(flag, T.BooleanType())]).where(~F.col(flag)).drop(flag)
    key = fresh(docs.columns, "key")
    source = docs.select(F.xxhash64(name(text_col)).alias("id"), name(text_col).alias("text"))
    found = _leaks(source, items, k, least, radius).select(F.col("id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(name(text_col))).join(found, key, "left_anti").select(*map(name, docs.columns))
