"""Benchmark decontamination with suffix arrays over the training text.

Each Arrow batch of documents is a shard: its words become numbers (0 between documents,
1 for words that no benchmark item has), and a suffix array sorts their positions by the
words that follow. Every suffix of every benchmark item is looked up in it by binary
search, which gives the places of its first words; places that follow each other in item
and document alike are one longest verbatim match.

The benchmark goes to the tasks in blocks of bounded size, one at a time; with more than one
block, the documents are stored once and searched for each, and only what is found moves.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import col, cols, fresh, python_map, stash

#: Words of a window, and bytes of benchmark text in one block.
WINDOW, BLOCK_BYTES = 10, 16 << 20
#: Fixed: ASCII letters and digits, and all characters beyond ASCII; lower case follows.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_CACHE = 300_000
_MATCH = "array<struct<item_id:string,item_start:int,start:int,words:int>>"


def lower_ascii(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def words_of(text: str) -> list[str]:
    return [lower_ascii(w) for w in WORD.findall(text)]


class _Numbers(dict):
    """Word as written -> number. Emptied when full, so that its memory is bounded."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        n = self[word] = self.known.get(lower_ascii(word), 1)
        return n


def packed(ids: np.ndarray, at: np.ndarray, width: int, bits: int) -> list[np.ndarray]:
    """The `width` words from each position, several to a 64-bit key, most significant first.
    Positions beyond the end read 0."""
    per = max(1, 62 // bits)
    padded = np.concatenate([ids, np.zeros(width, np.int64)])
    out = []
    for a in range(0, width, per):
        key = np.zeros(len(at), np.int64)
        for k in range(a, min(a + per, width)):
            key = (key << bits) | padded[at + k]
        out.append(key)
    return out


def bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted key rows at once in the sorted key rows."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted):
            v = k[mid]
            less |= same & (v < w)
            same &= v == w
        right = less | (same & after)
        lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


class Searcher:
    """The suffixes of one block of benchmark items, ready to be looked up in shards."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.known: dict[str, int] = {}
        self.names: list[str | None] = []
        seqs = []
        for name, text in items:
            if words := words_of(text or ""):
                self.names.append(name)
                seqs.append(np.array([self.known.setdefault(w, len(self.known) + 2) for w in words], np.int64))
        self.numbers = _Numbers(self.known)
        self.bits = max(2, int(len(self.known) + 2).bit_length())
        # A suffix that is shorter than the window is looked up only if it is a whole item.
        rows = [(i, p, min(window, len(s))) for i, s in enumerate(seqs) for p in range(max(1, len(s) - window + 1))]
        self.item, self.pos, self.size = (np.array([r[c] for r in rows], np.int64) for c in range(3))
        top = (1 << self.bits) - 1
        low, high = np.zeros((len(rows), window), np.int64), np.full((len(rows), window), top, np.int64)
        for r, (i, p, n) in enumerate(rows):
            low[r, :n] = high[r, :n] = seqs[i][p : p + n]
        at = np.arange(len(rows)) * window
        self.low, self.high = (packed(x.ravel(), at, window, self.bits) for x in (low, high))
        self.firsts = np.unique(low[:, 0]) if rows else np.zeros(0, np.int64)

    def shard(self, texts: list[str]) -> tuple[list[int], list[list[dict]]]:
        """Word counts and matches of each text."""
        get = self.numbers.__getitem__
        seqs = [list(map(get, WORD.findall(t))) for t in texts]
        counts = [len(s) for s in seqs]
        found: list[list[dict]] = [[] for _ in texts]
        starts = np.cumsum([0] + [n + 1 for n in counts])[:-1]
        ids = np.fromiter((x for s in seqs for x in (*s, 0)), np.int64, sum(counts) + len(counts))
        if not len(self.item):
            return counts, found
        # Only positions whose word begins a wanted suffix belong in the array.
        at = np.flatnonzero(ids > 1)
        at = at[np.isin(ids[at], self.firsts)]
        keys = packed(ids, at, self.window, self.bits)
        order = np.lexsort(keys[::-1])
        keys, at = [k[order] for k in keys], at[order]
        lo, hi = bound(keys, self.low, False), bound(keys, self.high, True)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return counts, found
        n = hi[hit] - lo[hit]
        row = np.repeat(hit, n)
        place = at[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        # Runs on a diagonal: same item, item position and place grow together.
        by = np.lexsort((place, place - self.pos[row], self.item[row]))
        row, place = row[by], place[by]
        item, pos, size = self.item[row], self.pos[row], self.size[row]
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(item) != 0) | (np.diff(place - pos) != 0) | (np.diff(place) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        doc = np.searchsorted(starts, place[first], "right") - 1
        for d, i, p, a, b, w in zip(doc, item[first], pos[first], place[first], place[last], size[last]):
            found[d].append({"item_id": self.names[i], "item_start": int(p), "start": int(a - starts[d]), "words": int(b + w - a)})
        return counts, found


def _items(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(stored items(part, i, t), parts): the different items that have a text, dealt by hash
    over as many parts as keep each at about `block_bytes`."""
    items = benchmark.select(col(item_col).cast("string").alias("i"), col(text_col).alias("t")).where("t is not null").distinct()
    items = stash(items)
    total = items.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n))), n


def find_matches(docs: DataFrame, benchmark: DataFrame, n_words: str = "n_words", matches: str = "matches", *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with two more columns of the names given: the number of words, and the longest
    verbatim matches with benchmark items: (item_id, item_start, start, words), places
    counted in words. docs must have no columns of these names.

    A match has at least `window` words, or is a whole shorter item. Null texts have no
    words; items without words match nothing; equal items count once; an item without id
    is matched under a null id; repeated rows are read one by one. With one block nothing
    is shuffled.

    A benchmark of several blocks is searched block by block: the driver and the executors
    hold one block at a time. Documents are written once, with what the first block gave;
    a further one writes the row numbers and matches of the documents that it is found in,
    and these are joined in the end.
    """
    items, n = _items(benchmark, item_col, item_text_col, block_bytes)
    text, count, found, row = fresh(docs, "match_text", "match_count", "match_found", "match_row")

    def searched(rows: DataFrame, part: int, keep: list[str]) -> tuple[DataFrame, Broadcast]:
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(F.col("part") == part).select("i", "t").collect()])

        def make():
            s = Searcher(sent.value, window)

            def run(b):
                counts, got = s.shard(b[text])
                return {count: counts, found: got}

            return run

        return python_map(rows, make, f"`{count}` long, `{found}` {_MATCH}", keep, [text]), sent

    out, sent = searched(docs.withColumn(text, F.coalesce(col(text_col), F.lit(""))), 0, docs.columns)
    if n > 1:
        held = stash(out.withColumn(row, F.monotonically_increasing_id()))
        sent.unpersist()
        slim = held.select(col(row), F.coalesce(col(text_col), F.lit("")).alias(text))
        more = []
        for k in range(1, n):
            got, sent = searched(slim, k, [row])
            more.append(stash(got.where(F.size(col(found)) > 0).select(col(row).alias("r"), col(found).alias("f"))))
            sent.unpersist()
        # Rows are numbered, so a document has one row here for each block that it holds parts of.
        other = reduce(DataFrame.union, more).groupBy("r").agg(F.flatten(F.collect_list("f")).alias("f"))
        r, f = fresh(held, "match_other_row", "match_other")
        out = held.join(other.toDF(r, f), col(row) == col(r), "left")
        out = out.withColumn(found, F.when(col(f).isNull(), col(found)).otherwise(F.concat(col(found), col(f))))
    return out.select(*cols(docs), col(count).alias(n_words), col(found).alias(matches))


def covered(matches: Column) -> Column:
    """Number of words inside any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["words"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    merge = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end"))
    return F.aggregate(spans, zero, merge, lambda acc: acc["n"].cast("long"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: words, words inside matches, and the items matched.

    Nulls, empty texts, repeated rows and empty tables as in `find_matches`; columns other
    than the two named are ignored.
    """
    slim = docs.select(col(id_col).alias("i"), col(text_col).alias("t"))
    m = find_matches(slim, benchmark, text_col="t", **options)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda x: x["item_id"]), lambda i: i.isNotNull())))
    m = m.select("i", "n_words", covered(F.col("matches")).alias("n_hit"), items.alias("items"))
    return m.select(F.col("i").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any match, in their own columns, whatever their names. Null and
    empty texts match nothing and stay; of repeated rows all stay or go; an empty table
    stays empty."""
    n_words, matches = fresh(docs, "n_words", "matches")
    return find_matches(docs, benchmark, n_words, matches, **options).where(F.size(col(matches)) == 0).select(*cols(docs))


#: DuckDB twin of the report.
ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
place AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS p
        FROM doc CROSS JOIN (SELECT DISTINCT size FROM win))),
hit AS (SELECT place.doc_id, place.p, place.size, win.item_id FROM place JOIN win USING (size, s)),
word AS (
  SELECT doc_id, count(DISTINCT k) AS n
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""
