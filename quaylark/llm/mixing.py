"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold their text. A
pattern has a capacity of its words for each pass over it; the first pass is free and each
further one costs more, whichever source asks for it. Words flow from a pattern through the
groups of its documents, one for each set of sources that a document itself names, to
these sources, up to their quotas, at least cost. The flow says how many words of a group
to take: whole passes over all of its documents, and one part of a pass, for which
documents are chosen in an order that a seeded hash gives.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaylark.llm.common import col, cols, fresh, stash

WEIGHTS, REPEATS = (5, 2, 1), 3
#: Rows of a range of hashes, of which the one where a part of a pass ends is ordered.
RANGE_ROWS = 50_000
#: Groups, or texts in several sources, that are broadcast at most; more are joined by shuffles.
BROADCAST_ROWS = 500_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, total: int | None = None) -> dict[str | None, float]:
    """Words wanted of each source: sources by code point, null last, take the weights in
    turn and share `total` (all words). None gets more than `repeats` times its size; what
    is over is shared among the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = Fraction(sum(sizes.values()) if total is None else total)
    out: dict[str | None, Fraction] = {}
    open_ = set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > repeats * sizes[s]}
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
        open_ -= full
    return {s: float(out[s]) for s in order}


class _Network:
    """Maximum flow by shortest augmenting levels (Dinic), to which arcs can be added."""

    def __init__(self):
        self.to: list[int] = []
        self.room: list[int] = []
        self.leaving: dict[int, list[int]] = defaultdict(list)

    def add(self, a: int, b: int, room: int) -> int:
        """An arc's number; the next number is its way back."""
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.leaving[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def fill(self, start: int, end: int) -> None:
        while True:
            level, todo = {start: 0}, deque([start])
            while todo:
                a = todo.popleft()
                for i in self.leaving[a]:
                    if self.room[i] and self.to[i] not in level:
                        level[self.to[i]] = level[a] + 1
                        todo.append(self.to[i])
            if end not in level:
                return
            nexts, path, a = {x: iter(self.leaving[x]) for x in level}, [], start
            while True:
                if a == end:
                    n = min(self.room[i] for i in path)
                    for k in range(len(path) - 1, -1, -1):
                        i = path[k]
                        self.room[i] -= n
                        self.room[i ^ 1] += n
                        if not self.room[i]:
                            a, cut = self.to[i ^ 1], k
                    del path[cut:]
                    continue
                for i in nexts[a]:
                    if self.room[i] and level.get(self.to[i], -1) == level[a] + 1:
                        path.append(i)
                        a = self.to[i]
                        break
                else:
                    if not path:
                        break
                    a = self.to[path.pop() ^ 1]


def route(groups: dict[tuple[tuple, tuple], int], wanted: dict[str | None, int], repeats: int = REPEATS) -> dict[tuple[tuple, tuple], int]:
    """Words to take of each group (pattern, own sources): a flow that fills the sources'
    quotas as far as it can, at least total cost. Pass k over a pattern costs k, and no
    group gives more than `repeats` times its words.

    Only the passes cost anything, so that the cheapest augmenting path costs what the
    pass that it begins with does: the flow is greatest with first passes alone, then
    with second ones added, and so on.
    """
    names: dict = {}
    node = lambda *x: names.setdefault(x, len(names) + 2)
    net, own, mass = _Network(), {}, defaultdict(int)
    for (p, o), n in sorted(groups.items(), key=str):
        mass[p] += n
        own[p, o] = net.add(node("p", p), node("g", p, o), repeats * n)
        for s in o:
            net.add(node("g", p, o), node("s", s), repeats * n)
    for s in sorted({s for _, o in groups for s in o}, key=str):
        net.add(node("s", s), 1, wanted[s])
    for _ in range(repeats):
        for p, n in mass.items():
            net.add(0, node("p", p), n)
        net.fill(0, 1)
    return {g: net.flow(arc) for g, arc in own.items()}


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


_SOURCES = "array<string>"


def _measures(text: Column, source: Column, kind: str, id_: Column, seed: int) -> list[Column]:
    """size, own sources, text and order hash of a row."""
    own = F.array(source.cast("string"))
    if kind.startswith("array"):
        own = F.when(F.size(source) > 0, F.array_sort(F.array_distinct(source.cast(_SOURCES)))).otherwise(F.array(F.lit(None).cast("string")))
    plain = F.coalesce(text, F.lit(""))
    return [word_count(text).alias("size"), own.alias("own"), F.xxhash64(plain).alias("t"), F.xxhash64(F.lit(seed), id_, plain).alias("h")]


def _bounded(df: DataFrame) -> DataFrame:
    """df, a stored table, to be broadcast where its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _overlaps(rows: DataFrame) -> DataFrame:
    """(t, pattern) of the texts whose rows(size, own, t) don't all name the same sources.

    Sources meet by text after a partial aggregate, so that a text with very many copies
    sends one row from each task.
    """
    sets = rows.where("size > 0").groupBy("t").agg(F.collect_set("own").alias("s")).where(F.size("s") > 1)
    return stash(sets.select("t", F.array_sort(F.array_distinct(F.flatten("s"))).alias("pattern")))


def _with_patterns(rows: DataFrame, overlaps: DataFrame) -> DataFrame:
    """rows with `pattern`: all sources of the rows with the same text."""
    return rows.join(_bounded(overlaps), "t", "left").withColumn("pattern", F.coalesce("pattern", "own"))


def plan_mix(rows: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, total: int | None = None) -> tuple[DataFrame, dict, dict]:
    """(plan, sizes, targets) for stored rows(size, own, pattern, h). The plan has a row a
    group (pattern, own): passes over all of its documents; cut, up to which hash one pass
    more; picks, hashes of single documents beyond that, which fill best what the groups of
    the same sources lack together.

    The driver gets one row a group, of which there are as many as different sets of
    sources, however many documents.
    """
    spark, key = rows.sparkSession, ["pattern", "own"]
    stats = rows.groupBy(*key).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    groups = {(tuple(r["pattern"]), tuple(r["own"])): r["n"] for r in stats}
    sizes: dict[str | None, int] = defaultdict(int)
    for (_, own), n in groups.items():
        for s in own:
            sizes[s] += n
    goal = targets(dict(sizes), weights, repeats, total if total is not None else sum(groups.values()))
    flow = route(groups, {s: round(t) for s, t in goal.items()}, repeats)
    docs = {(tuple(r["pattern"]), tuple(r["own"])): r["docs"] for r in stats}
    made = [(list(p), list(o), *(divmod(flow[p, o], n) if n else (0, 0)), max(1, -(-docs[p, o] // RANGE_ROWS))) for (p, o), n in groups.items()]
    schema = StructType.fromDDL(f"pattern {_SOURCES}, own {_SOURCES}, passes long, rest long, ranges long")
    plan = spark.createDataFrame(made, schema)
    plan = F.broadcast(plan) if len(made) <= BROADCAST_ROWS else stash(plan)
    # Ranges of hashes in their order, from 0 in each group; the one where the rest ends is cut.
    at = F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * F.col("ranges")).cast("long")
    placed = rows.where("size > 0").join(plan.where(F.col("passes") < repeats), key).select(*key, "h", "size", "rest", at.alias("at"))
    sums = placed.groupBy(*key, "at").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = stash(sums.withColumn("before", before).where("before <= rest and before + n > rest").select(*key, "at", "before", "rest"))
    # Rows of equal hash are taken or left together.
    order = Window.partitionBy(*key).orderBy("o").rangeBetween(Window.unboundedPreceding, 0)
    cutting = placed.drop("rest").join(_bounded(edge), [*key, "at"]).withColumn("o", _order(F.col("h"))).withColumn("upto", F.col("before") + F.sum("size").over(order))
    cut = cutting.where("upto <= rest").groupBy(*key).agg(F.max("o").alias("cut"), F.max("upto").alias("got"))
    cut = stash(edge.join(cut, key, "left").select(*key, "at", "cut", (F.col("rest") - F.coalesce("got", "before")).alias("gap")))
    # What the groups of the same sources lack is filled together: of each size up to the gap
    # one document that has a pass left; the largest that fits is taken, and again.
    gaps = stash(cut.groupBy("own").agg(F.sum("gap").alias("gap")))
    open_ = placed.withColumnRenamed("at", "own_at").join(_bounded(cut.drop("gap")), key).join(_bounded(gaps), "own")
    after = (F.col("own_at") > F.col("at")) | ((F.col("own_at") == F.col("at")) & F.coalesce(_order(F.col("h")) > F.col("cut"), F.lit(True)))
    one = open_.where(after & (F.col("size") <= F.col("gap"))).groupBy("own", "gap", "size").agg(F.min("h").alias("h"))
    ranked = one.groupBy("own", "gap").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "h")))).alias("c"))
    zero = F.struct(F.col("gap"), F.array().cast("array<bigint>").alias("h"))
    pick = lambda acc, x: F.when(x["size"] <= acc["gap"], F.struct((acc["gap"] - x["size"]).alias("gap"), F.concat(acc["h"], F.array(x["h"])).alias("h"))).otherwise(acc)
    picks = ranked.select("own", F.aggregate("c", zero, pick, lambda acc: acc["h"]).alias("picks"))
    whole = spark.createDataFrame(made, schema).join(cut.drop("gap"), key, "left").join(picks, "own", "left")
    return stash(whole), dict(sizes), goal


def _order(h: Column) -> Column:
    """Hashes in the order of their unsigned values, in which the ranges follow each other."""
    return h.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _copies() -> Column:
    """How often the plan takes a row: a function of its group and hash."""
    at = F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * F.col("ranges")).cast("long")
    first = (at < F.col("at")) | ((at == F.col("at")) & (_order(F.col("h")) <= F.col("cut")))
    extra = F.coalesce(first, F.lit(False)) | F.coalesce(F.array_contains("picks", F.col("h")), F.lit(False))
    return F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(0)


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(..., size, pattern, own, h) with the column copies."""
    return rows.join(_bounded(plan), ["pattern", "own"], "left").withColumn("copies", F.coalesce(_copies(), F.lit(0)))


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, **options) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix
    takes of it, repeats counted.

    `source_col` is a string here. A null text has no words; a text without words is taken
    0 times. Documents are chosen by a hash of seed, id and text, so reruns agree; rows
    that agree in these are taken alike. Ids may be null. Other columns are ignored; an
    empty table gives none.
    """
    rows = docs.select(col(id_col).alias("i"), *_measures(col(text_col), col(source_col), "string", col(id_col), seed))
    rows = stash(rows)
    rows = stash(_with_patterns(rows, _overlaps(rows)))
    plan, sizes, goal = plan_mix(rows, **options)
    known = docs.sparkSession.createDataFrame([(s, int(n), goal[s]) for s, n in sizes.items()], "source string, source_size long, target double")
    known = F.broadcast(known) if len(sizes) <= BROADCAST_ROWS else known
    out = _taken(rows, plan).join(known, F.col("own")[0].eqNullSafe(F.col("source")), "left")
    return out.select(F.col("i").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, copies: str = "copies", **options) -> DataFrame:
    """The documents that the mix takes, in their own columns, with one more that says how
    often; it is named `copies`, or longer where docs has that name.

    `source_col` is a string, or an array of strings for documents in several sources (a
    null array or one without elements is the source null). Nulls, ties, repeated rows and
    empty tables as in the report. Texts stay where they are: the plan, one row a group,
    comes to them.
    """
    kind = docs.schema[source_col].dataType.simpleString()
    name = fresh(docs, copies)[0]
    measured = docs.select(F.struct(*cols(docs)).alias("doc"), *_measures(col(text_col), col(source_col), kind, col(id_col), seed))
    slim = stash(measured.drop("doc"))
    overlaps = _overlaps(slim)
    plan, _, _ = plan_mix(stash(_with_patterns(slim, overlaps)), **options)
    out = _taken(_with_patterns(measured, overlaps), plan).where("copies > 0")
    return out.select("doc.*", F.col("copies").alias(name))
