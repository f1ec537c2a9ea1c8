"""URL filters on a sorted digest array.

Rules (``host/path`` strings) and words of bad hosts are kept as one file: the sorted 64-bit
xxhash of every entry, its offset, its decision, and the entries' full strings.  It lies in the
shared folder, Spark hands it to each executor, and tasks memory-map it.  All keys of a batch of
urls are looked up in one vectorised binary search; a hit counts only if the stored string
equals the key, so digests that collide do no harm.

A rule fits its host and subdomains if the path starts with the rule's path; the longest rule
wins.  Where none fits, a url is blocked if a part of its host (split at dots and hyphens), the host or one of its parent domains is
listed, else allowed.  Null urls and urls without ``://`` have an empty host and path and
are allowed.  Rules: later ones replace equal earlier ones.  Repeated rows are judged each, an empty table gives an empty result, urls may have any
length, other columns do not matter.

A list of hosts and words may also be a table: Spark digests and sorts it, and its rows pass through the driver one by one into the file, so
its size is bounded by an executor's disk alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import shared_dir, with_text_columns, written

#: The rules of the query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Words that mark a host for blocking where no rule fits.
BAD_WORDS = ["adult", "casino", "escort", "gambling", "malware", "phishing", "porn", "sex", "spam", "torrent", "warez", "xxx"]

_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HEAD = np.dtype([("digest", "<u8"), ("offset", "<u8"), ("size", "<u4"), ("block", "<u4")])


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _HOST.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def host_ends(host: str, longest: int) -> list[str]:
    """The host and its parent domains, but for those longer than any key."""
    ends, at = [], len(host)
    while at > 0 and len(host) - at <= longest:
        at = host.rfind(".", 0, at)
        if len(host) - at - 1 <= longest:
            ends.append(host[at + 1 :])
    return ends


def packed(entries: dict[str, bool]) -> bytes:
    """The file: a count, the sorted heads, the strings."""
    keys = sorted((xxhash.xxh64_intdigest(k.encode()), k) for k in entries)
    text = b"".join(k.encode() for _, k in keys)
    heads = np.zeros(len(keys), _HEAD)
    offset = 0
    for i, (digest, k) in enumerate(keys):
        size = len(k.encode())
        heads[i] = digest, offset, size, entries[k]
        offset += size
    return np.uint64(len(keys)).tobytes() + heads.tobytes() + text


def digested(listed: DataFrame, entries: dict[str, bool]) -> DataFrame:
    """digest (as text of fixed width, so that it sorts unsigned), key, block of all keys in order; an entry overrides a listed key."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{xxhash.xxh64_intdigest(k.encode()):016x}" for k in keys]), batch.column(0), batch.column(1)], ["digest", "key", "block"])

    own = listed.sparkSession.createDataFrame([(k, v) for k, v in entries.items()], "key string, block boolean")
    keys = listed.where("key IS NOT NULL").select("key", F.lit(True).alias("block")).join(F.broadcast(own.select("key")), "key", "left_anti").distinct().unionAll(own)
    return keys.mapInArrow(run, "digest string, key string, block boolean").orderBy("digest", "key")


def packed_rows(rows: DataFrame):
    """The parts of the file, from sorted rows read in two passes, a partition at a time."""
    rows = written(rows, "urls").orderBy("digest", "key")
    yield np.uint64(rows.count()).tobytes()
    offset = 0
    for r in rows.select("digest", F.octet_length("key").alias("size"), "block").toLocalIterator():
        yield np.array((int(r["digest"], 16), offset, r["size"], r["block"]), _HEAD).tobytes()
        offset += r["size"]
    for r in rows.select("digest", "key").toLocalIterator():
        yield r["key"].encode()


class DigestArray:
    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view("<u8")[0])
        self.heads = whole[8 : 8 + n * _HEAD.itemsize].view(_HEAD)
        self.text = whole[8 + n * _HEAD.itemsize :]
        self.digests = self.heads["digest"]

    def find(self, keys: list[str]) -> np.ndarray:
        """For each key 1 (block), 0 (allow) or -1 (not there)."""
        own = [k.encode() for k in keys]
        digests = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
        at = np.searchsorted(self.digests, digests)
        found = np.full(len(own), -1)
        n = len(self.digests)
        for j in np.flatnonzero((at < n) & (self.digests[np.minimum(at, max(n - 1, 0))] == digests) if n else np.zeros(len(own), bool)).tolist():
            i = int(at[j])
            while i < n and self.digests[i] == digests[j]:  # equal digests lie side by side
                h = self.heads[i]
                if bytes(self.text[int(h["offset"]) : int(h["offset"]) + int(h["size"])]) == own[j]:
                    found[j] = int(h["block"])
                    break
                i += 1
        return found


def distribute(spark: SparkSession, entries: dict[str, bool], listed: DataFrame | None = None) -> str:
    """Writes the file to the shared folder and has Spark hand it to the executors; its name.

    ``listed``: further keys (column key), all to be blocked."""
    file = f"urls-{uuid.uuid4().hex}.bin"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{file}")
    out = path.getFileSystem(conf).create(path)
    if listed is None:
        out.write(packed(entries))
    else:
        for block in packed_rows(digested(listed, entries)):
            out.write(block)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return file


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, words: Iterable[str] = BAD_WORDS, listed: DataFrame | None = None) -> DataFrame:
    """``id_col``, host, path, rule and verdict for each row.

    Rules and words are given by the caller; ``listed`` is a table (column entry) of further words of hosts and whole hosts to be blocked."""
    rules, words = dict(rules), list(words)
    entries = {r: v == "block" for r, v in rules.items()} | {f"//{w}": True for w in words}
    keyed = None if listed is None else listed.select(F.concat(F.lit("//"), F.lower("entry")).alias("key"))
    file = distribute(df.sparkSession, entries, keyed)
    longest = max([len(r) for r in rules] + [len(w) for w in words] + ([] if listed is None else [listed.agg(F.max(F.length("entry"))).first()[0] or 0]), default=0)
    lengths = sorted({len(r) - r.index("/") for r in rules})

    def make():
        array = DigestArray(SparkFiles.get(file))

        def run(urls: list[str | None]):
            split = [host_and_path(u) for u in urls]
            keys: list[str] = []
            owner: list[int] = []
            for i, (host, path) in enumerate(split):
                ends = host_ends(host, longest)
                own = [e + path[:n] for e in ends for n in lengths if n <= len(path)]
                own += [f"//{w}" for w in {*re.split(r"[.-]", host), *ends} if 0 < len(w) <= longest]
                keys += own
                owner += [i] * len(own)
            rule: list[str | None] = [None] * len(urls)
            bad = [False] * len(urls)
            found = array.find(keys)
            for j in np.flatnonzero(found >= 0).tolist():
                i, k = owner[j], keys[j]
                if k.startswith("//"):
                    bad[i] = True
                elif rule[i] is None or len(k) > len(rule[i]):
                    rule[i] = k
            verdict = [rules[r] if r is not None else "block" if b else "allow" for r, b in zip(rule, bad)]
            return [h for h, _ in split], [p for _, p in split], rule, verdict

        return run

    return with_text_columns(df, url_col, make, [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")], keep=[id_col])
