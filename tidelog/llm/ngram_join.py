"""N-gram Jaccard join with set relations: list blocks skipped by position, answers taken from a list's head.

A document is the set of its distinct ``k``-word shingles, as 64-bit digests.  Equal sets are one node, by a
digest of the set, whatever the number of copies.  Sets of similarity ``t`` (in percent) or more are linked.

1. Live sets.  With any global order, the first ``n - ceil(t n) + l`` shingles of two linked sets of ``n`` share
   ``l`` or more.  In the order of digests that leaves out every set whose beginning shares too few with others'.
2. Order.  How many live sets have a shingle is counted exactly.  In the order of these counts, shingles of one
   set alone come first, so a set's prefix reaches into the shared ones only if nearly all of it is shared.
3. Index.  A shared shingle of a prefix is a list entry with its position.  Lists are cut into blocks by size.  An
   entry probes the blocks in which a set is no larger than itself and, by the entry's position, leaves room for
   the shingles that a link takes; all other blocks are skipped whole.
4. Answers from similar sets.  In blocks of more than ``LONG`` entries, the entry of the least position (the set
   with the least of its own) is the head, and every prober is compared with it.  Links to heads make classes.
   Pairs within a class are known to be connected and never formed; a block of one class makes no pairs.  The
   overlaps ``o`` with the head answer for the rest of the block: two sets share ``min(o, o') + min(n - o, n' - o')`` at most.
5. The remaining candidates are verified on the whole sets.  Classes are connected components of the links.

No step needs memory that grows with the input outside of Spark's shuffles; hot lists and hot sets meet in
joins only, which Spark can split.

Null, empty and blank texts have no shingles, no links, and their own id as class.  A text of fewer than ``k`` words
is one shingle.  Each row is a document, also where rows repeat.  Null ids are compared too; their class is the
smallest id linked, null if none.  An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Scratch, WordHash, fresh, lean, mixed, name, slices, windows, with_text_columns

#: Entries of a block above which its sets are first compared with its head.
LONG = 16
#: A live set shares one in so many of its shingles beyond what a prefix needs.
MORE = 10
#: Bits of the filter of live sets, at most.
FILTER = 1 << 27
#: Bits of the filter of rows that may be copies.
SIFT = 1 << 24


def shingles(text: bytes | None, k: int, hashes: WordHash) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, ascending."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(k, len(words))))


def beginning(n: int, percent: int) -> int:
    """How many shingles of a set of ``n`` step 1 looks at."""
    return min(n, n - (percent * n + 99) // 100 + max(1, n // MORE))


def digests(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, row, n, node (a digest of the set), q (the beginning of the set in the order of digests)."""

    def make():
        hashes = WordHash()

        def run(texts: list[bytes | None]):
            own = [shingles(text, k, hashes) for text in texts]
            sizes = [len(x) for x in own]
            nodes = [_digest(x) if len(x) else None for x in own]
            flat = [x[: beginning(len(x), percent)].view(np.int64) for x in own]
            return sizes, nodes, pa.array(flat, pa.list_(pa.int64()))

        return run

    fields = [T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("q", T.ArrayType(T.LongType()))]
    return with_text_columns(docs, "text", make, fields, ["doc_id", "row"], as_bytes=True)


def _digest(own: np.ndarray) -> int:
    return int(mixed(mixed(own).sum(dtype=np.uint64) + np.uint64(len(own))).view(np.int64))


def whole_sets(docs: DataFrame, k: int, live: DataFrame) -> DataFrame:
    """node, own (its whole set) of the nodes in ``live`` (node, row).

    A filter of FILTER bits at most, broadcast, keeps most other texts from being cut up and shuffled; the join decides."""
    spark = docs.sparkSession
    bits = 1 << min(max(live.count() * 16, 1 << 16).bit_length(), FILTER.bit_length() - 1)
    place = F.pmod(F.col("row"), F.lit(bits))
    words = live.select(F.floor(place / 32).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(row, {bits}) % 32 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    filled = np.zeros(bits // 32, np.uint32)
    with lean(spark):
        for batch in words.toArrow().to_batches():  # FILTER / 32 words at most
            filled[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(filled)

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            at = batch.column(0).to_numpy() & (bits - 1)
            batch = batch.filter(pa.array(((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)))
            for part in slices(batch):
                own = [shingles(t, k, hashes) for t in part.column(1).cast(pa.binary()).to_pylist()]
                nodes = pa.array([_digest(x) if len(x) else None for x in own], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), nodes, pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["row", "node", "own"])

    made = docs.select("row", "text").mapInArrow(run, "row long, node long, own array<long>")
    return made.join(live, ["node", "row"], "left_semi").dropDuplicates(["node"]).select("node", "own")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``edges`` (a, b).

    Rounds of large-star and small-star, until each node has one edge, to a node that has none of its
    own; each is two joins on partial aggregates, and a hub's rows can be split."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b"), F.col("a")))
        if not large:
            both = both.where("v <= u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionAll(least.where("u <> m").select("u", "m"))
        return out.where("a <> b")

    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    done, before = False, None
    while not done:
        current = scratch.put(star(star(current, True), False).distinct(), "star")
        if before is not None:
            scratch.drop(before)
        before = current
        ends = current.selectExpr("a AS u", "1 AS below", "0 AS above").unionAll(current.selectExpr("b", "0", "1"))
        ends = ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        done = ends.agg(F.count_if(F.expr("below > 1 OR below * above > 0"))).first()[0] == 0
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(current.select(F.col("b"), F.col("b")).distinct())


def _class(n: str, percent: int) -> str:
    return f"cast(floor(ln({n}) / {math.log(100 / percent)!r}) as int)"


def live_nodes(sets: DataFrame, percent: int) -> DataFrame:
    """node, row of the sets that can have links (step 1)."""
    each = sets.where("n > 0").select("node", F.explode("q").alias("h"))
    shared = each.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("h")
    of_node = sets.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.count("*").alias("rows"))
    # a partner has at least ``percent`` of the size, and so many shingles more than one in common; each row of a set counts its own
    needed = F.expr(f"greatest(1, ({percent} * n + 99) div 100 div {MORE})")
    enough = each.join(shared, "h").groupBy("node").agg(F.count("*").alias("m")).join(of_node, "node")
    return enough.where(F.col("m") >= needed * F.col("rows")).select("node", "row")


def shared_sets(whole: DataFrame, percent: int) -> DataFrame:
    """node, n, own (its shared shingles, by count and digest), first (position of the first of them), prefix."""
    each = whole.select("node", F.size("own").alias("n"), F.explode("own").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    # a set's own shared shingles: no more than the set has
    sets = each.join(counts, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("m", "h"))).alias("s"))
    sets = sets.select("node", "n", F.col("s.h").alias("own"), (F.col("n") - F.size("s")).alias("first"))
    room = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - first").cast("int")
    return sets.where(room > 0).withColumn("prefix", F.slice("own", F.lit(1), room))


def _room(x: str, y: str, percent: int) -> str:
    """SQL: sets with a common shingle at these positions can be linked."""
    return (
        f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) AND "
        f"{100 + percent} * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {percent} * ({x}.n + {y}.n)"
    )


def probes(entries: DataFrame, percent: int) -> DataFrame:
    """Each entry once for each block ``c`` of its list that has sets to be compared with it (step 3)."""
    most = f"least(n, {100 + percent} * (n - pos) div {percent} - n)"
    blocks = f"explode(CASE WHEN {most} * 100 >= {percent} * n THEN sequence({_class(f'({percent} * n + 99) div 100', percent)}, {_class(most, percent)}) END)"
    return entries.select("h", F.expr(blocks).alias("c"), *(c for c in entries.columns if c != "h"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, o (shingles in common), s (sum of the sizes) of pairs of nodes."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.size(F.array_intersect("own_a", "own_b")).alias("o"), (F.col("n_a") + F.col("n_b")).alias("s"))


def _ordered(x: str, y: str) -> list:
    return [F.expr(f"least({x}, {y})").alias("a"), F.expr(f"greatest({x}, {y})").alias("b")]


def _candidates(labelled: DataFrame, heads: DataFrame | None, answers: DataFrame | None, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a < b) of sets of different classes, by what positions and the answers of heads leave possible.

    What is known of each block is written first: a sort or an aggregate has a page of memory at least, and a task those of its whole stage."""
    index, asked = labelled.withColumn("c", F.expr(_class("n", percent))), probes(labelled, percent)
    smaller = "(y.n < x.n OR (y.n = x.n AND y.node < x.node))"
    pairs = lambda x, y, more="": x.alias("x").join(y.alias("y"), ["h", "c"]).where(F.expr(f"x.label <> y.label AND {smaller} AND {_room('x', 'y', percent)} {more}")).select(*_ordered("x.node", "y.node"))
    if heads is None:
        return pairs(asked, index).distinct()
    by_class = index.groupBy("h", "c", "label").agg(F.count("*").alias("m")).groupBy("h", "c").agg(F.max_by("label", F.struct("m", "label")).alias("largest"))
    blocks = scratch.put(heads.select("h", "c", F.col("head.node").alias("head")).join(by_class, ["h", "c"]), "blocks")
    with_answer = lambda e: e.join(blocks, ["h", "c"]).join(answers, ["node", "head"], "left")
    x, y = with_answer(asked), with_answer(index)
    derived = f"AND coalesce({100 + percent} * (least(x.o, y.o) + least(x.n - x.o, y.n - y.o)) >= {percent} * (x.n + y.n), true)"
    other, same = "label <> largest", "label = largest"
    short = pairs(asked.join(heads, ["h", "c"], "left_anti"), index)
    return short.unionAll(pairs(x.where(other), y, derived)).unionAll(pairs(x.where(same), y.where(other), derived)).distinct()


def links(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """node, label for the sets (node, n, own, first, prefix) that have links; None if none has."""
    entries = sets.select("node", "n", "first", F.posexplode("prefix").alias("i", "h"))
    entries = scratch.put(entries.select("h", "node", "n", (F.col("first") + F.col("i")).alias("pos")), "entries")
    linked = F.expr(f"{100 + percent} * o >= {percent} * s")
    blocks = entries.groupBy("h", F.expr(_class("n", percent)).alias("c")).agg(F.count("*").alias("m"), F.expr("min(named_struct('pos', pos, 'node', node, 'n', n))").alias("head"))
    heads = scratch.put(blocks.where(F.col("m") > LONG).select("h", "c", "head"), "heads")
    classes = answers = None
    if not heads.isEmpty():
        asked = probes(entries, percent).alias("x").join(heads, ["h", "c"]).where("x.node <> head.node AND " + _room("x", "head", percent))
        with_heads = scratch.put(verified(asked.select(F.col("x.node").alias("a"), F.col("head.node").alias("b")).distinct(), sets), "answers")
        answers = with_heads.select(F.col("a").alias("node"), F.col("b").alias("head"), "o")
        found = with_heads.where(linked).select("a", "b")
        if not found.isEmpty():
            classes = components(found, scratch)
    labelled = entries.withColumn("label", F.col("node")) if classes is None else entries.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if answers is None:
        pairs = _candidates(labelled, None, None, percent, scratch)
    else:
        # a head has all of itself in common with itself
        own = heads.select(F.col("head.node").alias("node"), F.col("head.node").alias("head"), F.col("head.n").alias("o")).distinct()
        pairs = _candidates(labelled, heads, answers.unionAll(own), percent, scratch).join(with_heads.select(*_ordered("a", "b")), ["a", "b"], "left_anti")
    more = scratch.put(verified(pairs, sets).where(linked).select("a", "b"), "links")
    if more.isEmpty():
        return classes
    return components(more if classes is None else classes.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more), scratch)


def _classes(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """row (a digest of id and text), doc_id, n, label (of the class; null without shingles), component_id for each row."""
    scratch = Scratch(df.sparkSession)
    docs = df.select(name(id_col).cast("long").alias("doc_id"), name(text_col).alias("text")).withColumn("row", row_key("doc_id", "text"))
    all_sets = scratch.put(digests(docs, k, percent), "sets")
    live = scratch.put(live_nodes(all_sets, percent), "live")
    rows = scratch.put(all_sets.select("row", "doc_id", "n", "node"), "rows")
    scratch.drop(all_sets)
    whole = scratch.put(whole_sets(docs, k, live), "whole")
    sets = scratch.put(shared_sets(whole, percent), "shared")
    scratch.drop(whole)
    classes = links(sets, percent, scratch)
    # rows of one set are many where a text has many copies: skewed joins, which Spark can split
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("component"))
    if classes is None:
        least = least.withColumn("label", F.col("node"))
    else:
        together = least.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of_class = together.groupBy("label").agg(F.min("component").alias("component"))
        least = together.select("node", "label").join(of_class, "label")
    out = rows.join(least, "node", "left")
    return out.select("row", "doc_id", "n", "label", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(name(id_col).cast("long"), name(text_col))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    return _classes(df, id_col, text_col, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``df`` with one row of each class: that of the smallest id; a null id comes last.

    Rows of equal id and text are one.  Rows without shingles are a class each, by their id and text."""
    key = fresh(df.columns, "key")
    scratch = Scratch(df.sparkSession)
    by_row = _classes(df, id_col, text_col, k, percent).groupBy("row", "label").agg(F.count("*").alias("m"), F.min("doc_id").alias("doc_id"))
    one = F.expr("min(named_struct('unnamed', doc_id IS NULL, 'doc_id', doc_id, 'row', row, 'm', m))").alias("one")
    of_class = by_row.where("label IS NOT NULL").groupBy("label").agg(one).select("one.row", "one.m")
    chosen = scratch.put(of_class.unionAll(by_row.where("label IS NULL").select("row", "m")).withColumnRenamed("row", key), "chosen")
    # rows that may not be kept singly set a bit of a filter of SIFT bits; the others need no shuffle
    others = by_row.select(F.col("row").alias(key)).join(chosen.where("m = 1"), key, "left_anti")
    bit, word = F.pmod(F.col(key), F.lit(SIFT)), fresh([*df.columns, key], "word")
    words = others.groupBy(F.floor(bit / 64).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")).alias("bits"))
    words = F.broadcast(scratch.put(words, "words").select(word, F.col("bits").alias(f"{word}_bits")))  # SIFT / 64 rows at most
    keyed = df.withColumn(key, row_key(id_col, text_col)).withColumn(word, F.floor(bit / 64)).join(words, word, "left")
    may_go = F.coalesce(F.expr(f"shiftright(`{word}_bits`, cast(pmod(`{key}`, 64) as int)) & 1 = 1"), F.lit(False))
    rest = keyed.where(may_go)
    single = rest.join(chosen.where("m = 1"), key, "left_semi")
    many = rest.join(chosen.where("m > 1"), key, "left_semi").dropDuplicates([key])
    columns = [*map(name, df.columns)]
    return keyed.where(~may_go).select(*columns).unionAll(single.select(*columns)).unionAll(many.select(*columns))
