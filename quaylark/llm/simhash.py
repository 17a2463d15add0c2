"""SimHash fingerprints with DataFrame functions only.

A text's terms are its pairs of neighbouring words. A term has two 64-bit hashes, and each
occurrence votes for or against each of the 128 bits with the term's weight. Votes are counted in packed sums: masking a shifted
hash leaves two bits 32 places apart, so one long sum counts the votes for two bits.

All fingerprints within a Hamming radius are found with permuted block tables: a
fingerprint is cut in blocks, and two within the radius agree on all but `radius` blocks,
so that each table keys on one combination of the remaining blocks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylark.llm.common import col, stash

#: Bits of a fingerprint and the longs that hold them.
BITS, HALVES = 128, 2
#: A term weighs as much as it has letters, up to this: pairs of common short words, which
#: are in every text, count less.
MAX_WEIGHT = 16
_TWO_BITS = (1 << 32) | 1


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fp (array of two longs) of every row of `texts`, whose keys are unique.

    A term is a word (lower case, between white space) with its right neighbour, the last
    word alone; a text without words has the empty term. The votes are summed by `keys`;
    where the rows are already dealt by some of them, nothing is shuffled. Equal texts have
    equal fingerprints; null counts as empty.
    """
    plain = F.translate(F.lower(F.coalesce(col(text_col), F.lit(""))), "\t\n\x0b\x0c\r", " " * 5)
    t = texts.select(*keys, F.filter(F.split(plain, " "), lambda w: w != "").alias("w"))
    t = t.select(*keys, F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.lit(""))).alias("w"))
    following = F.slice("w", F.lit(2), F.size("w"))
    t = t.select(*keys, F.explode(F.zip_with("w", following, _term)).alias("t"))
    t = t.select(*keys, F.col("t.h").alias("h0"), F.xxhash64("t.h").alias("h1"), F.col("t.n").alias("n_"))
    votes = [F.sum(F.shiftrightunsigned(f"h{half}", j).bitwiseAND(F.lit(_TWO_BITS)) * F.col("n_")).alias(f"v{half}_{j}") for half in range(HALVES) for j in range(32)]
    sums = t.groupBy(*keys).agg(*votes, F.sum("n_").alias("votes"))
    return sums.select(*keys, F.array(*[_majority(half) for half in range(HALVES)]).alias("fp"))


def _term(a: Column, b: Column) -> Column:
    weight = F.least(F.length(a) + F.length(F.coalesce(b, F.lit(""))), F.lit(MAX_WEIGHT))
    return F.struct(F.xxhash64(a, b).alias("h"), F.greatest(weight, F.lit(1)).cast("long").alias("n"))


def _majority(half: int) -> Column:
    """The long of the bits which more than half of the votes are for."""
    total = F.lit(0).cast("long")
    for j in range(32):
        v = F.col(f"v{half}_{j}")
        for place, count in ((j, v.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(v, 32))):
            one = (1 << place) - ((1 << 64) if place == 63 else 0)
            total = total.bitwiseOR(F.when(count * 2 > F.col("votes"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    d = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, HALVES):
        d = d + F.bit_count(a[i].bitwiseXOR(b[i]))
    return d


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, counted from chance (half of them): 0 to 1."""
    return F.greatest(F.lit(0.0), 1.0 - distance(a, b) / F.lit(BITS / 2))


def as_hex(fp: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(fp[i]), 16, "0") for i in range(HALVES)]))


def near_pairs(fps: DataFrame, radius: int, *, blocks: int | None = None, id_col: str = "doc_id", fp_col: str = "fp") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(id, class_id) puts equal fingerprints in one class, named
    by its smallest id; pairs(a, b, distance) has all pairs of classes, a < b, within
    `radius` bits.

    Two fingerprints within the radius agree on at least blocks - radius blocks; each
    table keys on one choice of these, so every pair meets in some table and each pair is
    taken in the first table where it meets. More blocks give longer keys and more tables.
    Rows whose id is null are left out; a null fingerprint is in no class.
    """
    blocks = blocks or radius + 2
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below the number of blocks")
    own = fps.select(col(id_col).alias("id"), F.col(fp_col).alias("fp")).where("id is not null and fp is not null")
    classes = own.groupBy("fp").agg(F.min("id").alias("class_id"))
    members = own.join(classes, "fp").select("id", "class_id")
    bits = F.concat(*[F.lpad(F.bin(F.col("fp")[i]), 64, "0") for i in range(HALVES)])
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [F.substring(F.col("bits"), a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    tables = list(combinations(range(blocks), blocks - radius))
    keyed = classes.withColumn("bits", bits).select("class_id", "fp", F.posexplode(F.array(*[F.xxhash64(F.lit(n), *[part[i] for i in t]) for n, t in enumerate(tables)])).alias("table", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.class_id") < F.col("b.class_id")) & (distance(F.col("a.fp"), F.col("b.fp")) <= radius))
    pairs = near.select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"), distance(F.col("a.fp"), F.col("b.fp")).alias("distance")).distinct()
    return members, pairs


def with_next(docs: DataFrame, buckets: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, last, id, tie, text, next_text): every document with the one that
    follows it by id, and the first after the last.

    Ids are cut in ranges at quantiles that are ids of the table, so that a range's first
    row is known: it is given to the range before as well, as its last row (last = 1, to be
    dropped). One shuffle by range then brings neighbours together. Null ids come first;
    rows of equal id follow each other by their text's hash.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("id", lowest))
    found = rows.agg(F.min("k").alias("lo"), F.percentile_approx("k", [i / buckets for i in range(1, buckets)], F.lit(100 * buckets)).alias("q")).first()
    cuts = sorted({found["lo"], *found["q"]}) if found["lo"] is not None else [0]
    n = len(cuts)
    # Cuts, ascending, as a sorted literal array: array_position finds a cut, a binary
    # choice over the same array finds the range.
    own = _range_of(F.col("k"), cuts)
    before = F.when(F.col("k").isin(cuts), F.pmod(own - 1, F.lit(n)))
    places = F.when(before.isNotNull(), F.array(F.struct(own.alias("bucket"), F.lit(0).alias("last")), F.struct(before.alias("bucket"), F.lit(1).alias("last")))).otherwise(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("last"))))
    placed = rows.select("id", "k", "text", F.explode(places).alias("p")).select("p.bucket", "p.last", "id", "k", F.xxhash64("text").alias("tie"), "text")
    # Numbers make rows of equal id and text different.
    w = Window.partitionBy("bucket").orderBy("last", "k", "tie")
    return placed.select("bucket", "last", "id", F.row_number().over(w).alias("n"), "text", F.lead("text").over(w).alias("next_text"))


def _range_of(k: Column, cuts: list[int]) -> Column:
    """Index of the last cut that is not above k: a balanced tree of comparisons."""
    if len(cuts) == 1:
        return F.lit(0)

    def pick(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(k < F.lit(cuts[mid]), pick(lo, mid)).otherwise(pick(mid, hi))

    return pick(0, len(cuts))


def neighbours(fps: DataFrame, radius: int, *, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """(fp, n_near): fingerprints that have others within `radius`, and how many different ones."""
    classes = fps.where(col(id_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("class_id"))
    _, pairs = near_pairs(fps, radius, id_col=id_col, fp_col=fp_col)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_near"))
    return classes.join(ends, "class_id").select("fp", "n_near")


def fingerprint_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, radius: int = 3) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the second half replaced by
    the start of the next document), the likeness of its own to that and to the next
    document's fingerprint, and n_near, how many other fingerprints of documents with an id
    lie within `radius` bits of its own.

    Null texts are empty. A single document is its own next. Rows of equal id or text are
    all returned. The one shuffle is that of `with_next`; votes are summed and neighbours
    compared inside its ranges.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = with_next(docs, buckets, id_col=id_col, text_col=text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    both = near.select("bucket", "last", "id", "n", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("t")), F.struct(F.lit(1).alias("edit"), edited.alias("t")))).alias("x"))
    both = both.select("bucket", "last", "id", "n", "n_chars", "x.edit", F.when(F.col("x.edit") == 1, F.sha2("x.t", 256)).alias("sha"), F.col("x.t").alias("text"))
    fps = fingerprints(both, ["bucket", "last", "id", "n", "n_chars", "edit", "sha"])
    # In a range's order come a text, its edited text, the next text.
    w = Window.partitionBy("bucket").orderBy("n", "edit")
    ahead = fps.select("*", F.lead("sha").over(w).alias("edited_sha256"), F.lead("fp").over(w).alias("edited_fp"), F.lead("fp", 2).over(w).alias("next_fp"))
    out = ahead.where("last = 0 and edit = 0").select("id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
    out = stash(out)
    # Only fingerprints with neighbours come to the join; copies on the other side can be split.
    out = out.join(neighbours(out, radius, id_col="id"), "fp", "left")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
