"""Jaccard self-join of word n-grams with prefixes under several token orders.

If two sets overlap as much as the threshold asks, their prefixes under any common order of the
tokens share one: of n tokens the first n - ceil(threshold * n) + 1. So a pair must share a
token in its prefixes under each of several orders; one that fails under any is no pair.

The first order makes the buckets in which sets meet, so it puts rare tokens first: tokens
are counted over all texts in a sketch of fixed size, and what stands out of the sketch's
noise goes to the end, by the logarithm of its count. The second order does so with another
permutation of the rest; the third is a permutation without regard to frequency. Texts that
share a passage as many others do then seldom meet, and if they do, seldom in all three.
Sets of like sizes must share more than one: of the prefix that ends first in an order, all
tokens but those that the other set may lack are in the other prefix too.

Before prefixes move, sets are told apart by parity sketches of a bit or less a token: a bit is
set where an odd number of tokens falls. Two sketches differ in no more bits than their sets in
tokens, so that pairs whose sketches differ in more than near sets may are none.

Texts of equal sets are one class. A bucket's members are compared with its first class, the
hub: those that pass all filters are verified on full sets, and pairs of them by
their exact differences to it. Members that fail a filter with the hub are compared with all
others of the bucket, block against block and once for all buckets that have the same members:
first by sketches, then those that may be near to another, and don't share a hub with it
already, by the second and the third order. Links, hubs' blocks and components are those of `neardup`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import BATCH_BYTES, BATCH_ROWS, BROADCAST_IDS, col, filter_ids, python_map, stash
from quaylark.llm.neardup import _digest, _mix, exact_components, named_rows

#: The sketch: rows, bits of a counter's number, bits of the pieces in which rows are added up.
SKETCH_ROWS, SKETCH_BITS, PIECE_BITS = 2, 22, 16
#: Members of a bucket that a task gets at a time, twice.
DEALT = 1024
#: Seeds of the permutations, and whether an order puts frequent tokens last.
ORDERS = ((0x51ED270B, True), (0x2545F491, True), (0x9E3779B9, False))


class _Words(dict):
    """Lower-case word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word)
        return n


class Tokens:
    """Hashes of the k-word shingles of many texts at a time, the same as `neardup.Shingler`'s."""

    def __init__(self, k: int):
        self.k, self.hashes = k, _Words()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """In the order of each text; repeated ones repeat."""
        # Of bytes, lower() and split() know A-Z and the six ASCII spaces only.
        words = [t.encode("utf-8").lower().split() for t in texts]
        ends = np.cumsum([len(w) for w in words])
        h = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1]) if len(ends) else 0)
        whole = self._mixed(h, self.k) if len(h) >= self.k else h[:0]
        out = []
        for w, end in zip(words, ends):
            n = len(w)
            out.append(whole[end - n : end - self.k + 1] if n >= self.k else self._mixed(h[end - n : end], n) if n else h[:0])
        return out

    @staticmethod
    def _mixed(h: np.ndarray, size: int) -> np.ndarray:
        n = len(h) - size + 1
        s = np.full(n, size, np.uint64)
        for i in range(size):
            s = _mix(s + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        return _mix(s)


def _places(tokens: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((tokens >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a piece, most of them small: the width of each, then all of them, compressed."""
    kind = "<u1" if counts.max() < 256 else "<u4" if counts.max() < 1 << 32 else "<u8"
    return kind.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts[3:]), counts[:3].decode())


def _counts(k: int, bits: int):
    """Sketches of the texts of a task, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Tokens(k), np.zeros((SKETCH_ROWS, 1 << bits), np.uint32)
        for b in batches:
            tokens = np.concatenate([np.zeros(0, np.uint64), *shingles(b.column(0).to_pylist())])
            for row in range(SKETCH_ROWS):
                total[row] += np.bincount(_places(tokens, row, bits), minlength=1 << bits).astype(np.uint32)
        parts = total.reshape(-1, 1 << min(bits, PIECE_BITS))
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_packed(parts[i]) for i in some], pa.binary())], names=["piece", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal pieces; a task holds one sum for each piece that it was dealt."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = _unpacked(counts).astype(np.uint64)
            total[piece] = total[piece] + own if piece in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(x) for x in total.values()], pa.binary())], names=["piece", "counts"])


def token_levels(rows: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """[row, counter] of the sketch over all rows(text): the logarithm of what a count has
    beyond the middle one, in its noise; 0 for most. 2^bits counters a row reach the driver."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    parts = rows.select("text").mapInArrow(_counts(k, bits), "piece int, counts binary")
    total = np.zeros((SKETCH_ROWS << bits >> min(bits, PIECE_BITS), 1 << min(bits, PIECE_BITS)), np.float32)
    for r in parts.repartition("piece").mapInArrow(_added, "piece int, counts binary").collect():
        total[r["piece"]] = _unpacked(r["counts"])
    total = total.reshape(SKETCH_ROWS, 1 << bits)
    # A row at a time, so that the driver holds little beside the counts.
    levels = np.zeros(total.shape, np.uint8)
    for row, out in zip(total, levels):
        middle = np.median(row)
        out[:] = np.log2(1 + np.maximum(0, row - middle) / (1 + np.sqrt(middle)))
    return levels


def prefix_size(n: int, percent: int) -> int:
    """Tokens of which one must be shared by any set that is near to one of n tokens."""
    return n - -(-percent * n // 100) + 1 if n else 0


class Prefixes:
    """A set's prefix under each order."""

    def __init__(self, levels: np.ndarray, percent: int):
        self.levels, self.percent = levels, percent
        self.bits = int(levels.shape[1]).bit_length() - 1

    def __call__(self, tokens: np.ndarray) -> list[np.ndarray]:
        size = prefix_size(len(tokens), self.percent)
        level = np.min([lv[_places(tokens, i, self.bits)] for i, lv in enumerate(self.levels)], axis=0)
        # The permutation has no ties, so that each order is a total one.
        ranks = [(_mix(tokens ^ np.uint64(seed)), rare) for seed, rare in ORDERS]
        return [tokens[(np.lexsort((r, level)) if rare else np.argsort(r))[:size]] for r, rare in ranks]


def _short(tokens: np.ndarray) -> bytes:
    """Four bytes a token. Tokens that become equal count once or more wherever they are
    shared, so that filters let more pairs pass, never fewer."""
    return (tokens >> np.uint64(32)).astype("<u4").tobytes()


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each of at least half as many places as there are tokens, 64 at least: whether an odd number falls there."""
    places = 1 << max(6, ((len(tokens) - 1) // 2).bit_length())
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Parity sketches with as many places as the shortest has, in words of 64."""
    words = min(map(len, sketches)) // 8
    return np.array([np.bitwise_xor.reduce(np.frombuffer(s, "<u8").reshape(-1, words), axis=0) for s in sketches])


def _distinct(tokens: np.ndarray) -> np.ndarray:
    s = np.sort(tokens)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def signatures(rows: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(id, n, digest, sketch, p1, p2, p3) of rows(id, text): set size, digest, parity sketch, and the
    prefixes under the three orders, the second and the third with four bytes a token."""
    sent = rows.sparkSession.sparkContext.broadcast(levels)

    def make():
        shingles, prefixes = Tokens(k), Prefixes(sent.value, percent)

        def run(b):
            out: dict[str, list] = {"n": [], "digest": [], "sketch": [], "p1": [], "p2": [], "p3": []}
            for s in map(_distinct, shingles(b["text"])):
                first, second, third = prefixes(s)
                out["n"].append(len(s))
                out["digest"].append(_digest(s))
                out["sketch"].append(parity(s))
                out["p1"].append(first.view(np.int64))
                out["p2"].append(_short(second))
                out["p3"].append(_short(third))
            return out

        return run

    return python_map(rows, make, "n long, digest binary, sketch binary, p1 array<long>, p2 binary, p3 binary", ["id"])


def least_shared(n, m, percent: int):
    """Tokens that prefixes of near sets of n and m tokens share under any order.

    Near sets have `overlap` tokens in common. Of the prefix whose last token comes first, the
    tokens that are in the other set are in its prefix too; n - overlap of them aren't there.
    """
    overlap = -(-percent * (n + m) // (100 + percent))
    return np.maximum(1, overlap + (-percent * np.maximum(n, m) // 100) + 1)


def most_unequal(n, m, percent: int):
    """Tokens that only one of two near sets of n and m tokens has, at most."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def passes(n: int, m: int, x: list[np.ndarray], y: list[np.ndarray], percent: int) -> bool:
    """Whether sets of n and m tokens with these prefixes may be near."""
    need = least_shared(n, m, percent)
    return 100 * min(n, m) >= percent * max(n, m) and all(len(np.intersect1d(a, b, assume_unique=True)) >= need for a, b in zip(x, y))


def _read(*prefixes: bytes | list[int]) -> list[np.ndarray]:
    return [np.frombuffer(p, "<u4") if isinstance(p, bytes) else np.array(p, np.int64).view(np.uint64) for p in prefixes]


def _sketched(percent: int):
    """Whether the sketches of two sets let them be near."""

    def make():
        def run(b):
            own = zip(*(b[c] for c in ("nx", "nh", "sketch_x", "sketch_h")))
            return {"close": [bool(np.bitwise_count(np.bitwise_xor(*_folded(s))).sum() <= most_unequal(n, m, percent)) for n, m, *s in own]}

        return run

    return make


def _filters(percent: int):
    """Whether two sets pass all filters."""

    def make():
        def run(b):
            own = zip(*(b[c] for c in ("nx", "nh", "p1_x", "p2_x", "p3_x", "p1_h", "p2_h", "p3_h")))
            return {"near": [passes(n, m, _read(*p[:3]), _read(*p[3:]), percent) for n, m, *p in own]}

        return run

    return make


def _shared(prefixes: list[bytes], some: int) -> np.ndarray:
    """[i, j]: how many tokens the first `some` prefixes share with each, or more."""
    own = _read(*prefixes)
    tokens = np.concatenate([np.zeros(0, np.uint32), *own])
    at = np.repeat(np.arange(len(own)), [len(p) for p in own])
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    twice = counts > 1
    keep, place = twice[inverse], (np.cumsum(twice) - 1)[inverse]
    at, place = at[keep], place[keep]
    order = np.argsort(place, kind="stable")
    at, place = at[order], place[order]
    out = np.zeros((some, len(own)), np.float32)
    columns = int(twice.sum())
    for c in range(0, columns, 2048):
        a, b = np.searchsorted(place, (c, c + 2048))
        m = np.zeros((len(own), min(2048, columns - c)), np.float32)
        np.add.at(m, (at[a:b], place[a:b] - c), 1)
        out += m[:some] @ m.T
    return out


def _open(percent: int):
    """Members of pairs of `scan` with all of a block that may be near by their sizes and
    sketches, but for pairs of one home: they share it as their hub."""

    def make():
        def run(b):
            return {"members": [members(s, r) for s, r in zip(b["scan"], b["rest"])]}

        def members(scan: list[dict], rest: list[dict]) -> list[dict]:
            own = {r["x"] for r in scan}
            every = scan + [r for r in rest if r["x"] not in own]
            if not scan:
                return []
            n, home = (np.array([r[k] for r in every], np.int64) for k in ("n", "home"))
            words, found = _folded([r["sketch"] for r in every]), np.zeros(len(every), bool)
            for c in range(len(scan)):
                near = (100 * np.minimum(n, n[c]) >= percent * np.maximum(n, n[c])) & (home != home[c])
                near &= np.bitwise_count(words ^ words[c]).sum(axis=1) <= most_unequal(n, n[c], percent)
                found |= near
                found[c] |= near.any()
            return [{"x": every[i]["x"], "near": every[i]["near"]} for i in np.flatnonzero(found)]

        return run

    return make


def _beside(percent: int):
    """Pairs of `scan` with all of a block that pass the filters, but for those which a member
    before has both passed with: they share it as their hub."""

    def make():
        def run(b):
            return {"pairs": [pairs(s, r) for s, r in zip(b["scan"], b["rest"])]}

        def pairs(scan: list[dict], rest: list[dict]) -> list[dict]:
            scan = sorted(scan, key=lambda r: r["x"])
            own = {r["x"] for r in scan}
            every = scan + [r for r in rest if r["x"] not in own]
            if not scan:
                return []
            n = np.array([r["n"] for r in every], np.int64)
            least, most = np.minimum(n[: len(scan), None], n), np.maximum(n[: len(scan), None], n)
            near, need = 100 * least >= percent * most, least_shared(least, most, percent)
            for p in ("p2", "p3"):
                near &= _shared([r[p] for r in every], len(scan)) >= need
            out, hubs = [], []
            for c in range(len(scan)):
                mine = near[c].copy()
                mine[c] = False
                for h in hubs:
                    if h[c]:
                        mine &= ~h
                if mine.any():
                    out += [{"x": every[i]["x"], "h": every[c]["x"]} for i in np.flatnonzero(mine)]
                    mine[c] = True
                    hubs.append(mine)
            return out

        return run

    return make


def _candidates(classes: DataFrame, signed: DataFrame, percent: int, block: int) -> DataFrame:
    """near(x, h, nx, nh): pairs of classes that pass all filters, such that each two classes
    which do are one of the pairs or both with one h."""
    # Copies are fewer than classes as a rule, so that the rows of those stay where they are.
    full = signed.where("n > 0 and id is not null")
    copies = full.select("row", "digest").join(classes.where("copies > 1").select("digest", "cid"), "digest").where("row <> cid").select("row")
    head = filter_ids(full, "row", stash(copies), keep=False)
    banded = head.select(F.col("row").alias("cid"), F.explode("p1").alias("key"))
    # The class of the smallest number is the hub; a token of one class makes no bucket.
    buckets = stash(banded.groupBy("key").agg(F.min("cid").alias("h"), F.max("cid").alias("m")).where("h < m").select("key", "h"))
    few = F.broadcast(buckets) if buckets.count() <= BROADCAST_IDS else buckets
    star = stash(banded.join(few, "key").where("cid <> h").select("key", F.col("cid").alias("x"), "h"))
    sizes = classes.select("cid", "n")
    pairs = star.select("x", "h").distinct().join(sizes.toDF("x", "nx"), "x").join(sizes.toDF("h", "nh"), "h")
    # Sizes and sketches tell most pairs apart before any prefix moves.
    alike = F.least("nx", "nh") * 100 >= F.greatest("nx", "nh") * percent
    pairs = stash(pairs.withColumn("alike", alike))
    known = head.select(F.col("row").alias("cid"), "n", "sketch", F.transform("p1", lambda t: F.shiftright(t, 32).cast("int")).alias("p1"), "p2", "p3")
    own = ["x", "h", "nx", "nh"]
    tried = stash(python_map(_with(pairs.where("alike").select(*own), known, "sketch"), _sketched(percent), "close boolean", own, ["nx", "nh", "sketch_x", "sketch_h"]))
    near = python_map(_with(tried.where("close").select(*own), known, "p1", "p2", "p3"), _filters(percent), "near boolean", own, ["nx", "nh", *(f"p{i}_{c}" for i in (1, 2, 3) for c in "xh")])
    apart = pairs.where("not alike").select(*own).union(tried.where("not close").select(*own))
    met = stash(near.unionByName(apart.withColumn("near", F.lit(False))))
    more = _pairs_beside_hubs(star, met, known, percent, block)
    more = more.join(sizes.toDF("x", "nx"), "x").join(sizes.toDF("h", "nh"), "h")
    return met.where("near").select(*own).union(more.select(*own))


def _with(pairs: DataFrame, known: DataFrame, *held: str) -> DataFrame:
    """pairs(x, h, ...) with what is `held` of both, as <name>_x and <name>_h."""
    needed = stash(pairs.select("x").union(pairs.select("h")).distinct())
    own = filter_ids(known, "cid", needed, keep=True)
    side = lambda x: own.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in held))
    return pairs.join(side("x"), "x").join(side("h"), "h")


def _members() -> tuple:
    """How many members x a group of one hub h has, and what tells groups of different members apart."""
    return F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), F.bit_xor(F.xxhash64("x")).alias("m1"), F.bit_xor(F.xxhash64("x", F.lit("members"))).alias("m2")


def _pairs_beside_hubs(star: DataFrame, met: DataFrame, known: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (x, h) of bucket members that pass the filters, of which one at least doesn't with
    the bucket's hub. A bucket is cut by set size: members are in the band of their own and in
    the next one, so that those of like sizes meet. Buckets of the same members are one."""
    one = star.groupBy("key").agg(*_members()).where("n > 1").groupBy("h", "n", "m1", "m2").agg(F.min("key").alias("key"))
    star = filter_ids(star, "key", stash(one.select("key")), keep=True)
    band = F.floor(F.log(F.col("nx")) / (-1.000001 * math.log(percent / 100))).cast("int")
    held = star.join(met.select("x", "h", "nx", "near"), ["x", "h"]).select("key", F.explode(F.array(band, band + 1)).alias("band"), "x", "h", "near")
    of_bucket = held.groupBy("key", "band").agg(*_members(), F.count_if(~F.col("near")).alias("n_far"))
    one = of_bucket.where("n > 1 and n_far > 0").groupBy("h", "n", "n_far", "m1", "m2").agg(F.min(F.struct("key", "band")).alias("k")).select("k.key", "k.band", "n", "n_far")
    left = stash(held.join(one, ["key", "band"]).select("key", "band", "x", "near", "n", "n_far"))
    homes = met.where("near").groupBy("x").agg(F.min("h").alias("home"))
    sketched = _of_members(left, known, "n", "sketch").join(homes, "x", "left").withColumn("home", F.coalesce("home", "x"))
    found = python_map(_dealt(left, sketched, block), _open(percent), "members array<struct<x:bigint,near:boolean>>", ["key", "band"], ["scan", "rest"])
    left = stash(found.select("key", "band", F.explode("members").alias("m")).select("key", "band", "m.x", "m.near").distinct())
    sizes = left.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("n_far"))
    left = stash(left.join(sizes, ["key", "band"]))
    found = python_map(_dealt(left, _of_members(left, known, "n", "p2", "p3"), block), _beside(percent), "pairs array<struct<x:bigint,h:bigint>>", [], ["scan", "rest"])
    return found.select(F.explode("pairs").alias("p")).select("p.x", "p.h").distinct()


def _of_members(left: DataFrame, known: DataFrame, *held: str) -> DataFrame:
    """(x, ...) with what is `held` of the members."""
    return filter_ids(known, "cid", stash(left.select("x").distinct()), keep=True).select(F.col("cid").alias("x"), *held)


def _dealt(left: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """Groups (key, band, scan, rest) of left(key, band, x, near, n, n_far): members that are far
    from their hub, and those that they are compared with, with what is held(x, ...) of each. No
    task holds more of a bucket than two blocks at a time; where one is all, none is sent twice."""
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    rows = left.select("key", "band", "x", "near", blocks("n").alias("ms"), blocks("n_far").alias("fs")).join(held, "x")
    member = F.struct("near", *held.columns)
    rows = rows.select("key", "band", "near", "ms", "fs", F.xxhash64("x").alias("hashed"), member.alias("m"))
    none, each = F.lit(None).cast(rows.schema["m"].dataType), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    scan = rows.where(~F.col("near")).select("key", "band", F.pmod("hashed", "fs").cast("int").alias("bf"), each("ms").alias("bm"), F.col("m").alias("s"), none.alias("r"))
    rest = rows.where("near or ms > 1 or fs > 1").select("key", "band", each("fs").alias("bf"), F.pmod("hashed", "ms").cast("int").alias("bm"), none.alias("s"), F.col("m").alias("r"))
    return scan.union(rest).groupBy("key", "band", "bf", "bm").agg(F.collect_list("s").alias("scan"), F.collect_list("r").alias("rest"))


def ngram_join(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS, block: int = DEALT) -> DataFrame:
    """id, n_shingles, component_id for every row of docs.

    Two texts are linked if the Jaccard similarity of their sets of distinct k-word shingles
    is at least `threshold` (to two digits). A text of fewer words is one shingle; a null
    text or one without words is empty and linked with nothing. Ids are integers. Of rows of
    equal id each gets its own text's component; a row without id joins its class's component
    if others have an id, else its component is null. Other columns are ignored, whatever
    their names; an empty table gives none.
    """
    percent = round(100 * threshold)
    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    levels = token_levels(rows, k, sketch_bits)
    signed = stash(signatures(rows, k, percent, levels).withColumn("row", F.monotonically_increasing_id()))
    full = signed.where("n > 0 and id is not null")
    # A class has the number of its first row, which no other class has, and an id, which another may have.
    classes = full.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    classes = stash(classes.select("digest", F.col("first.row").alias("cid"), F.col("first.id").alias("id"), "copies", "n"))
    near = _candidates(classes, signed, percent, block)
    labels = stash(exact_components(rows, classes, near, k, percent))
    return named_rows(signed, classes, labels).withColumnRenamed("id", id_col)


#: DuckDB twin of the join with four words and 0.85; pairs by an inverted index, so only for
#: small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4 + 1, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
