"""How far the sources of a language differ in what words they use.

A term's level in a group (a language's source) is how often it occurs there. With one
indicator column for every (group, level) and one row for every term, the indicator matrix's
transpose times itself holds all joint tables at once: for any two groups, how many terms have
one level here and another there. As a term's price depends on its level alone, a joint
table and two price lists give the divergence of two groups.

The product is made block by block: terms of like frequency are dealt to blocks, so that most
blocks have few levels, groups to blocks of GROUPS. A task holds one block of terms for
two blocks of groups. Entries of a product are counts of at most SLICE terms, which single
precision holds exactly; prices and sums are integers. What a block's joint tables
cost is added up over the blocks, or the tables themselves are (`joint_tables`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylark.llm.common import BATCH_BYTES, BATCH_ROWS, col, stash

#: Least documents of a term, added to each count, scale of shares, ranks of the part `term`.
MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a block at about the most, terms and columns of one product, groups of a block.
TERMS, SLICE, COLUMNS, GROUPS = 4096, 256, 1024, 64
#: Counts that a task gathers before it gives them out, bytes of a text that are cut at once.
HELD, PIECE = 400_000, 4 << 20
#: A-Z, a-z and all beyond ASCII; in UTF-8 these are the bytes from 0x80 on.
TERM, OTHER = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that cut no term."""
    at = 0
    while at < len(text):
        end = OTHER.search(text, min(len(text), at + PIECE))
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches (lang, source, text): counts of a task, given
    out whenever there are many; a row with the term null for each group."""
    names = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([lang, source, None, 0, 0], kinds)], names=names)
            items = list(total.items())
            for a in range(0, len(items), 50_000):
                part = items[a : a + 50_000]
                own = [[lang] * len(part), [source] * len(part), [t.decode("utf-8") for t, _ in part], [n for _, n in part], [docs[t] for t, _ in part]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds)], names=names)

    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            total, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(total), set()
            for piece in pieces(text.encode("utf-8")):
                words = TERM.findall(piece.lower())  # of bytes: A-Z only
                total.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(total) - before + 1
            if size > HELD:
                yield from give()
                held, size = {}, 0
    yield from give()


def share(count: Column, total: Column, scale: int = SCALE, prior: int = PRIOR) -> Column:
    """1 + floor(scale * (count + prior) / total), exactly."""
    part = (count + F.lit(prior)).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", part, total.cast("decimal(20,0)"))


def _prices(levels: np.ndarray, total: int, scale: int, prior: int) -> np.ndarray:
    # In whole numbers of Python: a count times the scale may be beyond 64 bits.
    return np.array([1 + scale * (int(c) + prior) // total for c in levels], np.int64)


class _Columns:
    """Indicator columns of some groups for a slice of terms: `counts` has a row for each term."""

    def __init__(self, counts: np.ndarray):
        found = [np.unique(counts[:, g], return_inverse=True) for g in range(counts.shape[1])]
        self.levels = [levels for levels, _ in found]
        self.starts = np.cumsum([0, *map(len, self.levels)])
        self.at = np.stack([inverse.reshape(-1) + s for (_, inverse), s in zip(found, self.starts)], axis=1)

    def block(self, start: int, stop: int) -> np.ndarray:
        """The indicator columns from start to stop."""
        x = np.zeros((len(self.at), stop - start), np.float32)
        row, g = np.nonzero((self.at >= start) & (self.at < stop))
        x[row, self.at[row, g] - start] = 1
        return x


def _products(counts_a: np.ndarray, counts_b: np.ndarray) -> Iterator[tuple[_Columns, _Columns, int, int, np.ndarray]]:
    """Blocks of the product of two groups' indicator columns: columns, where the block starts,
    and the exact numbers of terms."""
    order = np.argsort(counts_a.sum(axis=1) + counts_b.sum(axis=1), kind="stable")
    for s in range(0, len(order), SLICE):
        rows = order[s : s + SLICE]
        a, b = _Columns(counts_a[rows]), _Columns(counts_b[rows])
        for i in range(0, a.starts[-1], COLUMNS):
            x = a.block(i, min(i + COLUMNS, a.starts[-1])).T
            for j in range(0, b.starts[-1], COLUMNS):
                yield a, b, i, j, np.rint(x @ b.block(j, min(j + COLUMNS, b.starts[-1]))).astype(np.int64)


def _sides(block: pd.DataFrame, groups: int):
    """Groups and dense counts of both sides of a block; rows without term name the groups."""
    known = block[block["term"].isna()].drop_duplicates("g").sort_values("g")
    held = block[block["term"].notna()]
    term, names = pd.factorize(held["term"])
    out = []
    for side in ("ga", "gb"):
        own = known[known["g"] // groups == block[side].iloc[0]]
        counts = np.zeros((len(names), len(own)), np.int64)
        mine = held["g"].isin(own["g"]).to_numpy()
        counts[term[mine], np.searchsorted(own["g"].to_numpy(), held["g"].to_numpy()[mine])] = held["n"].to_numpy()[mine]
        out.append((own["g"].to_numpy(np.int64), [int(t) for t in own["total"]], counts))
    return out, len(names)


def _priced(scale: int, prior: int, groups: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """(lang, a, b, terms, value): the sum of price differences over a block's terms."""
        ((ga, total_a, ca), (gb, total_b, cb)), n = _sides(block, groups)
        value = np.zeros((len(ga), len(gb)), np.int64)
        last: tuple = (None, None)
        for a, b, i, j, joint in _products(ca, cb):
            if last[0] is not a:
                pa_, pb_ = (np.concatenate([_prices(v, t, scale, prior) for v, t in zip(c.levels, totals)]) for c, totals in ((a, total_a), (b, total_b)))
                own_a, own_b = (np.repeat(np.arange(len(c.levels)), [len(v) for v in c.levels]) for c in (a, b))
                last = (a, b)
            (h, w) = joint.shape
            cost = joint * np.abs(pa_[i : i + h, None] - pb_[None, j : j + w])
            xa, xb = own_a[i : i + h], own_b[j : j + w]
            first_a, first_b = np.unique(xa, return_index=True), np.unique(xb, return_index=True)
            value[np.ix_(first_a[0], first_b[0])] += np.add.reduceat(np.add.reduceat(cost, first_a[1], axis=0), first_b[1], axis=1)
        x, y = np.nonzero(ga[:, None] < gb[None, :])
        return pd.DataFrame({"lang": block["lang"].iloc[0], "a": ga[x], "b": gb[y], "terms": np.int64(n), "value": value[x, y]})

    return run


def _tables(groups: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """(lang, a, level_a, b, level_b, n): the occurring cells of a block's joint tables."""
        ((ga, _, ca), (gb, _, cb)), _ = _sides(block, groups)
        parts = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "level_a", "b", "level_b", "n")})]
        for a, b, i, j, joint in _products(ca, cb):
            own_a, own_b = (np.repeat(np.arange(len(c.levels)), [len(v) for v in c.levels]) for c in (a, b))
            level_a, level_b = np.concatenate(a.levels), np.concatenate(b.levels)
            x, y = np.nonzero(joint)
            cell = pd.DataFrame({"a": ga[own_a[x + i]], "level_a": level_a[x + i], "b": gb[own_b[y + j]], "level_b": level_b[y + j], "n": joint[x, y]})
            parts.append(cell[cell["a"] < cell["b"]])
        out = pd.concat(parts).groupby(["a", "level_a", "b", "level_b"], as_index=False)["n"].sum()
        out.insert(0, "lang", block["lang"].iloc[0])
        return out

    return run


class Audit:
    """Counts of the terms and groups of docs, each stored once."""

    def __init__(self, docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, groups: int = GROUPS):
        self.prior, self.scale, self.size = prior, scale, groups
        spark = docs.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        own = docs.select(*(F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
        raw = stash(own.mapInArrow(_count, "lang string, source string, term string, n long, docs long"))
        # Dealt by term, so that sums by source, then over sources, need no further shuffle.
        sums = raw.where("term is not null").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        w = Window.partitionBy("lang", "term")
        sums = sums.select("lang", "source", "term", "n", F.sum("n").over(w).alias("term_n"), F.sum("docs").over(w).alias("term_docs"), (F.min("source").over(w) == F.col("source")).alias("first"))
        #: (lang, source, term, n, term_n): counts of the kept terms; `first` marks one row a term.
        self.held = stash(sums.where(F.col("term_docs") >= min_docs).drop("term_docs"))
        langs = self.held.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("v"))
        by_group = self.held.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        groups = raw.where("term is null").select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(langs, "lang", "left")
        #: (lang, source, g, v, total, lang_total): groups are numbered inside their language.
        self.groups = stash(groups.select(
            "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("g"), zero("v").alias("v"),
            (zero("group_n") + prior * zero("v")).alias("total"), (zero("lang_n") + prior * zero("v")).alias("lang_total"),
        ))

    def _blocks(self):
        """Counts (lang, level, part, ga, gb, g, total, term, n), grouped by what one task holds."""
        key = ["lang", "level", "part", "ga", "gb"]
        entries = self.held.join(self.groups, ["lang", "source"]).select(
            "lang", F.floor(F.log2("term_n")).cast("int").alias("level"), F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / TERMS)).cast("int").alias("part"), "g", "total", "term", "n")
        most = self.groups.groupBy("lang").agg(F.max("g").alias("last"))
        # A block of groups meets itself and each other block.
        other, own = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / self.size))).alias("other"), F.floor(F.col("g") / self.size)
        meets = entries.join(most, "lang").select("*", other).withColumn("ga", F.least(own, "other")).withColumn("gb", F.greatest(own, "other"))
        keys = meets.select(*key).distinct()
        # Every group of a block, if it has none of the block's terms too.
        every = keys.join(self.groups, "lang").where((own == F.col("ga")) | (own == F.col("gb")))
        every = every.select(*key, "g", "total", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
        return meets.select(*every.columns).unionByName(every).groupBy(*key)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for each two sources of a language, both ways: the sum of
        |p - q| over its kept terms; 0 without any."""
        sums = self._blocks().applyInPandas(_priced(self.scale, self.prior, self.size), "lang string, a long, b long, terms long, value long")
        sums = sums.groupBy("lang", "a", "b").agg(F.sum("terms").alias("terms"), F.sum("value").alias("value"))
        side = lambda x: self.groups.select("lang", F.col("g").alias(x), F.col("source").alias(f"source_{x}"), F.col("total").alias(f"total_{x}"), F.col("v").alias(f"v_{x}"))
        both = side("a").join(side("b"), "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
        p0 = lambda x: share(F.lit(0).cast("long"), F.col(f"total_{x}"), self.scale, self.prior)
        # Terms that no block of the two groups holds occur in neither.
        absent = (F.col("v_a") - F.coalesce("terms", F.lit(0))) * F.abs(p0("a") - p0("b"))
        value = F.when(F.col("v_a") > 0, F.coalesce("value", F.lit(0)) + absent).otherwise(F.lit(0)).cast("long")
        both = both.select("lang", "source_a", "source_b", value.alias("value"))
        return both.select("lang", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): a group's terms that it uses more than its language."""
        n = self.held.join(self.groups, ["lang", "source"])
        value = share(F.col("n"), F.col("total"), self.scale, self.prior) - share(F.col("term_n"), F.col("lang_total"), self.scale, self.prior)
        n = n.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
        w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)

    def joint_tables(self) -> DataFrame:
        """(lang, source_a, level_a, source_b, level_b, n): of how many kept terms each two
        counts in two sources are those of; source_a < source_b. Cells that don't occur are
        left out."""
        cells = self._blocks().applyInPandas(_tables(self.size), "lang string, a long, level_a long, b long, level_b long, n long")
        cells = cells.groupBy("lang", "a", "level_a", "b", "level_b").agg(F.sum("n").alias("n"))
        side = lambda x: self.groups.select("lang", F.col("g").alias(x), F.col("source").alias(f"source_{x}"), F.col("v").alias(f"v_{x}"))
        pairs = side("a").join(side("b").drop("v_b"), "lang").where("a < b")
        absent = pairs.join(cells.groupBy("lang", "a", "b").agg(F.sum("n").alias("seen")), ["lang", "a", "b"], "left")
        absent = absent.select("lang", "source_a", F.lit(0).cast("long").alias("level_a"), "source_b", F.lit(0).cast("long").alias("level_b"), (F.col("v_a") - F.coalesce("seen", F.lit(0))).alias("n")).where("n > 0")
        out = cells.join(pairs.drop("v_a"), ["lang", "a", "b"]).select("lang", "source_a", "level_a", "source_b", "level_b", "n").union(absent)
        return out.groupBy("lang", "source_a", "level_a", "source_b", "level_b").agg(F.sum("n").alias("n"))


def divergence_report(docs: DataFrame, *, top: int = TOP, **options) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of docs its divergence from each
    other source of its language (`pair`) and its first `top` overused terms (`term`).

    Null texts, languages and sources are empty strings; a group whose texts have no term
    is compared all the same; a language without kept terms has pairs of value 0. Ties rank
    by item. Repeated rows count each. Other columns are ignored, whatever their names; an
    empty table gives none.
    """
    audit = Audit(docs, **options)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = audit.pairs().withColumn("rank", F.row_number().over(w))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pair, "pair").unionByName(columns(audit.terms(top), "term"))


#: DuckDB twin of the report with its default settings.
ORACLE = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
n AS (SELECT lang, source, term, count(*) AS c FROM word JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM doc),
v AS (SELECT grp.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM grp) grp LEFT JOIN kept USING (lang) GROUP BY 1),
tot AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS total FROM grp LEFT JOIN n USING (lang, source) GROUP BY 1, 2),
ltot AS (SELECT lang, CAST(sum(total) AS BIGINT) AS total FROM tot GROUP BY 1),
p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(c, 0) AS c,
    1 + ({SCALE}::HUGEINT * (coalesce(c, 0) + {PRIOR})) // (tot.total + {PRIOR} * v.v) AS p
  FROM grp JOIN kept USING (lang) JOIN tot USING (lang, source) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
lp AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(c)::HUGEINT + {PRIOR})) // (any_value(ltot.total) + {PRIOR} * any_value(v.v)) AS p FROM n JOIN ltot USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3),
over AS (SELECT p.lang, p.source, p.term AS item, p.p - lp.p AS value FROM p JOIN lp USING (lang, term) WHERE c > 0 AND p.p > lp.p),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM over) WHERE rank <= {TOP})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
