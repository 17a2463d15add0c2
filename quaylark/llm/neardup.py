"""Near-duplicate groups with HyperMinHash registers.

Each text's distinct word shingles are hashed once; the hash chooses one of 256 registers
and each register keeps its smallest hash as a leading-zero count with ten mantissa bits.
Texts with equal shingle sets are one class, named by the smallest number of its rows. Bands
of six registers are the buckets in which classes meet; for the bands alone, an empty
register takes the value of the first full one in its own fixed order, so that short texts
meet as seldom by chance as long ones do.

The work on a bucket is linear in its size where its members are near one hub: the estimate
from the registers, corrected for chance collisions, drops pairs that are far apart, and
the rest are verified on full sets. Members far from their bucket's hub are compared with
the bucket's others and become hubs of those near to them, so that every pair that meets in
a band is estimated or shares a hub.

Members of one hub may be similar to each other without being similar to the hub. With
the exact difference of each member to its hub at hand, the overlap of any two members
follows from the overlap of their differences. It is computed block against block for
the members of a hub that aren't in its main component so far, against all; a block returns
no pairs but a spanning forest of what it links.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import BROADCAST_IDS, col, filter_ids, python_map, stash
from quaylark.llm.decontaminate import lower_ascii
from quaylark.llm.graph import components

#: Registers, registers of a band, mantissa bits. Texts at the threshold of 0.85 miss all 42
#: bands with a probability of 2e-9 (0.8: 3e-6).
REGISTER_BITS, BAND, MANTISSA = 8, 6, 10
REGISTERS, EMPTY = 1 << REGISTER_BITS, 0xFFFF
#: Standard errors below the threshold at which an estimate drops a pair.
SLACK = 5.0
#: Members in one block of a bucket's or a hub's group.
BLOCK = 512
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CACHE = 300_000


class _Hashes(dict):
    """Word as written -> 64-bit hash of its lower-case form; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(lower_ascii(word).encode("utf-8", "surrogatepass"))
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""

    def __init__(self, k: int):
        self.k, self.hashes = k, _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text)
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        size = min(self.k, len(h))
        n = len(h) - size + 1
        s = np.full(n, size, np.uint64)
        for i in range(size):
            s = _mix(s + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(_mix(s))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted hashes: zero count << 10 | mantissa; 0xFFFF is empty."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(hashes):
        place, first = np.unique(hashes >> np.uint64(64 - REGISTER_BITS), return_index=True)
        low = (hashes[first] << np.uint64(REGISTER_BITS)) >> np.uint64(11)  # 53 bits: exact as doubles
        mantissa, exponent = np.frexp(low.astype(np.float64))
        zeros = np.where(low == 0, 53, 53 - exponent)
        bits = np.where(low == 0, 0, (mantissa * 2 - 1) * (1 << MANTISSA))
        out[place.astype(np.int64)] = (zeros.astype(np.uint16) << MANTISSA) | bits.astype(np.uint16)
    return out


#: For each register the order in which it looks for a full one: fixed, by rule.
_STAND_INS = _mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, REGISTERS).argsort(axis=1)


def band_keys(regs: np.ndarray) -> list[int]:
    """One key a band; none where all registers are empty."""
    full = regs != EMPTY
    if not full.any():
        return []
    if not full.all():
        gaps = np.flatnonzero(~full)
        order = _STAND_INS[gaps]
        regs = regs.copy()
        regs[gaps] = regs[order[np.arange(len(gaps)), full[order].argmax(axis=1)]]
    packed = regs[: REGISTERS // BAND * BAND].reshape(-1, BAND).astype(np.uint64)
    key = np.arange(len(packed), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(BAND):
        key = _mix(key + packed[:, i] + np.uint64(1))
    return key.view(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Jaccard similarity from two register rows, less the collisions that chance gives, and
    the number of registers it rests on.

    Two independent minima fall in the same cell (zero count, mantissa) with a probability
    of about 1 / 2^mantissa times the chance of equal zero counts (a third for sets of
    like size), so that this share of the unequal registers is taken off.
    """
    either = int(((a != EMPTY) | (b != EMPTY)).sum())
    if not either:
        return 0.0, 0
    equal = int(((a == b) & (a != EMPTY)).sum())
    chance = (either - equal) / 3 / (1 << MANTISSA)
    return max(0.0, (equal - chance) / either), either


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, digest, regs, keys) of docs(id, text)."""

    def make():
        shingle = Shingler(k)

        def run(b):
            out: dict[str, list] = {"n": [], "digest": [], "regs": [], "keys": []}
            for text in b["text"]:
                s = shingle(text)
                r = registers(s)
                out["n"].append(len(s))
                out["digest"].append(_digest(s))
                out["regs"].append(r.tobytes())
                out["keys"].append(band_keys(r))
            return out

        return run

    return python_map(docs, make, "n long, digest binary, regs binary, keys array<long>", ["id"])


def _unequal_at_most(threshold: float) -> np.ndarray:
    """For each number of registers in use, the most unequal ones that a near pair has."""
    used = np.arange(1, REGISTERS + 1)
    least = threshold - SLACK * (threshold * (1 - threshold) / used) ** 0.5
    # (used - d - d / 3 / 2^mantissa) / used >= least, as in `estimate`, solved for d.
    most = np.floor(used * (1 - least) / (1 + 1 / 3 / (1 << MANTISSA)) + 1e-9)
    return np.concatenate([[-1], np.minimum(most, used)]).astype(np.int64)


def _far(threshold: float):
    """Unequal registers of the pairs (regs_x, regs_h), and whether they are few enough."""

    def make():
        most = _unequal_at_most(threshold)

        def run(b):
            out: dict[str, list] = {"dist": [], "near": []}
            for x, h in zip(b["regs_x"], b["regs_h"]):
                x, h = np.frombuffer(x, np.uint16), np.frombuffer(h, np.uint16)
                d = int((x != h).sum())
                out["dist"].append(d)
                out["near"].append(bool(d <= most[int(((x != EMPTY) | (h != EMPTY)).sum())]))
            return out

        return run

    return make


def _scan(threshold: float):
    """Further hubs of buckets: `scan` are members far from the bucket's hub, `rest` those they
    are compared with. A near pair is given out unless both are with a hub already."""

    def make():
        most = _unequal_at_most(threshold)

        def run(b):
            out: list[list[dict]] = []
            for scan, rest in zip(b["scan"], b["rest"]):
                scan.sort(key=lambda r: (-r["copies"], r["x"]))
                own = {r["x"] for r in scan}
                every = scan + [r for r in rest if r["x"] not in own]
                ids = [r["x"] for r in every]
                regs = np.frombuffer(b"".join(r["regs"] for r in every), np.uint16).reshape(-1, REGISTERS)
                used, groups, pairs = regs != EMPTY, [], []
                for c in range(len(scan)):
                    near = (regs != regs[c]).sum(axis=1) <= most[(used | used[c]).sum(axis=1)]
                    near[c] = False
                    for g in groups:
                        if g[c]:
                            near &= ~g
                    if near.any():
                        pairs += [{"x": ids[i], "h": ids[c]} for i in np.flatnonzero(near)]
                        near[c] = True
                        groups.append(near)
                out.append(pairs)
            return {"pairs": out}

        return run

    return make


def _differences(percent: int):
    def make():
        def run(b):
            out: dict[str, list] = {"linked": [], "diff": [], "removed": []}
            for x, h in zip(b["set_x"], b["set_h"]):
                x, h = np.array(x, np.int64), np.array(h, np.int64)
                same = len(np.intersect1d(x, h, assume_unique=True))
                out["linked"].append(100 * same >= percent * (len(x) + len(h) - same))
                out["diff"].append(np.setxor1d(x, h, assume_unique=True).tolist())
                out["removed"].append(len(h) - same)
            return out

        return run

    return make


def _link_blocks(percent: int):
    """Links between members of one hub, those of `some` with those of `every`: pairs that
    join their components."""

    def make():
        def run(b):
            return {"pairs": [links(s, e, n) for s, e, n in zip(b["some"], b["every"], b["nh"])]}

        def links(some: list[dict], every: list[dict], nh: int) -> list[dict]:
            rows = some + every
            diffs = [np.array(r["diff"], np.int64) for r in rows]
            _, inverse, counts = np.unique(np.concatenate(diffs) if rows else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
            at = np.repeat(np.arange(len(rows)), [len(d) for d in diffs])
            shared = counts > 1
            keep, column = shared[inverse], np.cumsum(shared) - 1
            at, place, cut = at[keep], column[inverse[keep]], len(some)
            overlap = np.zeros((cut, len(every)), np.float32)
            for c in range(0, int(shared.sum()), 2048):
                m = np.zeros((len(rows), 2048), np.float32)
                part = (place >= c) & (place < c + 2048)
                m[at[part], place[part] - c] = 1
                overlap += m[:cut] @ m[cut:].T
            n, removed, comp = (np.array([r[k] for r in rows], np.int64) for k in ("nx", "removed", "comp"))
            same = nh - removed[:cut, None] - removed[None, cut:] + overlap.astype(np.int64)
            linked = (100 * same >= percent * (n[:cut, None] + n[None, cut:] - same)) & (comp[:cut, None] != comp[None, cut:])
            parent: dict = {}

            def root(c):
                while parent.get(c, c) != c:
                    parent[c] = parent.get(parent[c], parent[c])
                    c = parent[c]
                return c

            out = []
            for i, j in zip(*np.nonzero(linked)):
                ca, cb = root(int(comp[i])), root(int(comp[cut + j]))
                if ca != cb:
                    parent[max(ca, cb)] = min(ca, cb)
                    out.append({"a": int(comp[i]), "b": int(comp[cut + j])})
            return out

        return run

    return make


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of docs.

    Two texts are linked if the Jaccard similarity of their sets of distinct k-word
    shingles is at least `threshold` (to two digits); components are those of the links, named by
    their smallest id. A text of fewer words is one shingle; a null text or one without
    words is empty and linked with nothing. Ids are integers. Of rows of equal id each gets
    its own text's component; a row without id joins its class's component if others
    have an id, else its component is null; such rows are never `kept`. Other columns are
    ignored; an empty table gives none.
    """
    percent = round(100 * threshold)
    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    signed = stash(signatures(rows, k).withColumn("row", F.monotonically_increasing_id()))
    full = signed.where("n > 0 and id is not null")
    # A class has the number of its first row, which no other class has, and an id, which another may have.
    classes = full.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    classes = stash(classes.select("digest", F.col("first.row").alias("cid"), F.col("first.id").alias("id"), "copies", "n", "regs", "keys"))
    out = named_rows(signed, classes, stash(_class_components(rows, classes, k, threshold, percent)))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def named_rows(signed: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id) of the rows signed(id, n, digest), by the classes' labels."""
    ids = classes.select("cid", "digest", "id", "copies").join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    names = ids.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    named = ids.where("component is not null or copies > 1").join(names, "component", "left").select("digest", F.coalesce("least", "id").alias("c"))
    # Only classes of several rows or with links have a name to look up.
    out = signed.select("id", "n", "digest").join(named, "digest", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def _class_components(rows: DataFrame, classes: DataFrame, k: int, threshold: float, percent: int) -> DataFrame:
    """(id, component) of the classes that have links, by their numbers."""
    banded = classes.select("cid", "copies", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct((-F.col("copies")).alias("c"), "cid")).alias("hub"), F.count(F.lit(1)).alias("size"))
    hubs = hubs.where("size > 1").select("key", F.col("hub.cid").alias("h"))
    star = stash(banded.join(hubs, "key").where("cid <> h").select("key", F.col("cid").alias("x"), "h"))
    known = classes.select("cid", "n", "regs")
    both = lambda pairs: pairs.join(known.toDF("x", "nx", "regs_x"), "x").join(known.toDF("h", "nh", "regs_h"), "h")
    met = stash(python_map(both(star.select("x", "h").distinct()), _far(threshold), "dist int, near boolean", ["x", "h", "nx", "nh"]))
    more = _pairs_beside_hubs(star, met, classes, threshold)
    size = classes.select("cid", "n")
    near = met.where("near").select("x", "h", "nx", "nh").union(more.join(size.toDF("x", "nx"), "x").join(size.toDF("h", "nh"), "h").select("x", "h", "nx", "nh"))
    return exact_components(rows, classes, near, k, percent)


def exact_components(rows: DataFrame, classes: DataFrame, near: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) of the classes that have links, by their numbers: links are found among the
    pairs near(x, h, nx, nh), and among the members x of one h."""
    near = stash(near.distinct())
    needed = near.select(F.col("x").alias("cid")).union(near.select("h")).distinct()
    needed = stash(needed.join(classes.select("cid", F.col("id").alias("of"), F.col("digest").alias("held")), "cid"))

    def shingled():
        shingle = Shingler(k)

        def run(b):
            sets = [shingle(t) for t in b["text"]]
            return {"set": [s.view(np.int64) for s in sets], "digest": [_digest(s) for s in sets]}

        return run

    sets = python_map(filter_ids(rows, "id", needed.select("of").distinct(), keep=True), shingled, "set array<long>, digest binary", ["id"])
    own = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    # Rows may repeat an id: a class's set is that of a row with its id and its digest.
    sets = stash(sets.join(own, (F.col("id") == F.col("of")) & (F.col("digest") == F.col("held"))).groupBy("cid").agg(F.first("set").alias("set")))
    pairs = near.join(sets.toDF("x", "set_x"), "x").join(sets.toDF("h", "set_h"), "h")
    exact = stash(python_map(pairs, _differences(percent), "linked boolean, diff array<long>, removed long", ["x", "h", "nx", "nh"], ["set_x", "set_h"]))
    links = exact.where("linked").select(F.col("x").alias("a"), F.col("h").alias("b"))
    first = stash(components(links))
    second = components(_links_below_hubs(exact, first, percent)).select(F.col("id").alias("component"), F.col("component").alias("top"))
    alone = second.select(F.col("component").alias("id"), F.col("top").alias("component"))
    merged = first.join(second, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return merged.unionByName(alone).distinct()


def _pairs_beside_hubs(star: DataFrame, met: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Near pairs (x, h) of bucket members of which one at least is far from the bucket's hub.

    Unequal registers are a metric: a member so close to the hub that none of those far from
    it can be near needs no comparison. The others are compared block by block.
    """
    reach = int(_unequal_at_most(threshold).max())
    held = star.join(met.select("x", "h", "dist", "near"), ["x", "h"]).select("key", "x", "dist", "near")
    first = held.groupBy("key").agg(F.min(F.when(~F.col("near"), F.col("dist"))).alias("m"), F.count(F.lit(1)).alias("all")).where("m is not null and all > 1").drop("all")
    left = held.join(first, "key").where(~F.col("near") | (F.col("dist") + reach >= F.col("m"))).select("key", "x", "near")
    size = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("n_far")).where("n > 1")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    left = stash(left.join(size.select("key", blocks("n").alias("ms"), blocks("n_far").alias("fs")), "key"))
    rows = left.join(classes.select(F.col("cid").alias("x"), "copies", "regs"), "x")
    hashed, each = F.xxhash64("x"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = F.struct("x", "copies", "regs")
    scan = rows.where(~F.col("near")).select("key", F.pmod(hashed, F.col("fs")).cast("int").alias("bf"), each("ms").alias("bm"), one.alias("s"), F.lit(None).cast(one_type := "struct<x:bigint,copies:bigint,regs:binary>").alias("r"))
    rest = rows.select("key", each("fs").alias("bf"), F.pmod(hashed, F.col("ms")).cast("int").alias("bm"), F.lit(None).cast(one_type).alias("s"), one.alias("r"))
    dealt = scan.union(rest).groupBy("key", "bf", "bm").agg(F.collect_list("s").alias("scan"), F.collect_list("r").alias("rest"))
    found = python_map(dealt, _scan(threshold), "pairs array<struct<x:bigint,h:bigint>>", [], ["scan", "rest"])
    return found.select(F.explode("pairs").alias("p")).select("p.x", "p.h").distinct()


def _links_below_hubs(exact: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components, between members of one hub: those outside the component
    that most of them are in are compared with all, block by block. Two members in that
    component need no comparison."""
    member = exact.join(first.select(F.col("id").alias("x"), "component"), "x", "left").select("x", "h", "nx", "nh", "diff", "removed", F.coalesce("component", "x").alias("comp"))
    counts = member.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    open_ = counts.groupBy("h").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ = open_.select("h", F.col("most.comp").alias("main"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("most.n")).alias("some_blocks"))
    open_ = stash(open_)
    few = F.broadcast(open_) if open_.count() <= BROADCAST_IDS else open_
    held = member.join(few, "h").withColumn("one", F.struct("x", "nx", "removed", "comp", "diff"))
    none = F.lit(None).cast(held.schema["one"].dataType)
    each, hashed = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)), F.xxhash64("x")
    some = held.where("comp <> main").select("h", "nh", F.pmod(hashed, "some_blocks").cast("int").alias("bs"), each("all_blocks").alias("ba"), F.col("one").alias("s"), none.alias("e"))
    every = held.select("h", "nh", each("some_blocks").alias("bs"), F.pmod(hashed, "all_blocks").cast("int").alias("ba"), none.alias("s"), F.col("one").alias("e"))
    # Grouped by hub and both blocks, so that no task holds more of a hub than two blocks at a time.
    dealt = some.union(every).groupBy("h", "nh", "bs", "ba").agg(F.collect_list("s").alias("some"), F.collect_list("e").alias("every"))
    found = python_map(dealt, _link_blocks(percent), "pairs array<struct<a:bigint,b:bigint>>", [], ["nh", "some", "every"])
    return found.select(F.explode("pairs").alias("p")).select("p.a", "p.b").distinct()


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are the first of their group, in their own columns, whatever
    their names. Rows without id stay, and so do rows of equal id if one of them is a first.
    Null and empty texts are in no group and stay; an empty table stays empty."""
    found = near_duplicates(docs, id_col=id_col, **options).where(col(id_col).isNotNull())
    found = found.groupBy(col(id_col).alias("own")).agg(F.max("kept").alias("kept")).where("not kept").select("own")
    return filter_ids(docs, id_col, stash(found), keep=False)


#: DuckDB twin of the report with three words and 0.85; pairs by an inverted index, so only
#: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3 + 1, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id, doc_id = comp.c AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
