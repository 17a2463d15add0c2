"""Divergence of sources and clusters of vectors, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.llm import clusters, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_divergence(docs, min_docs, top):
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        words = TERM.findall(lower(text or ""))
        n[lang, source].update(words)
        in_docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in in_docs[lang].items() if k >= min_docs]
        own = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * len(kept)) for t, k in c.items()} for s, c in own.items()}
        for s in sources:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            term = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > p[None][t])[:top]
            out |= {(lang, s, part, item.decode(), -v, i + 1) for part, x in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(x)}
    return out


def corpus(rng, n, sources, vocabulary=60):
    letters = ["Wort", "WORT", "é", "ü", "no", "Straße", "x1y", "don't"] + [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(vocabulary)]
    return [(rng.choice(["en", "de", None]), rng.choice(sources), " ".join(rng.choices(letters, [1 / (i + 1) for i in range(len(letters))], k=rng.randrange(30)))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, g long, term string")


@pytest.mark.parametrize("groups", [2, 64])
def test_divergence_equals_brute_force(spark, groups):
    rng = random.Random(groups)
    rows = corpus(rng, 150, [None, "a", "b", "ä", "B", "c", "d"]) + [("fr", "a", None), ("fr", "b", ""), ("fr", "c", "mot"), ("en", "silent", "12 !"), (None, "alone", None)]
    got = divergence.divergence_report(docs_of(spark, rows), min_docs=4, top=5, groups=groups)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == brute_divergence(rows, 4, 5)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]


def test_joint_tables_hold_every_kept_term_once_a_pair(spark):
    rng = random.Random(5)
    rows = corpus(rng, 80, ["a", "b", "c", "d"]) + [("en", "silent", "")]
    audit = divergence.Audit(docs_of(spark, rows), min_docs=3, groups=2)
    got = {tuple(r) for r in audit.joint_tables().collect()}
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall(lower(text or ""))
        counts[lang or "", source].update(words)
        docs[lang or ""].update(set(words))
    want = Counter()
    for lang in {k for k, _ in counts}:
        own = sorted(s for k, s in counts if k == lang)
        for t in (t for t, k in docs[lang].items() if k >= 3):
            want.update((lang, a, counts[lang, a][t], b, counts[lang, b][t]) for a in own for b in own if a < b)
    assert got == {(*k, n) for k, n in want.items()}


def test_divergence_of_long_texts_and_no_rows(spark):
    # Over a piece and over an Arrow batch, with a term across every place where it could be cut.
    text = "é" * 3_000_000 + " " + "ab " * 2_000_000 + "c" * 5_000_000
    assert Counter(w for p in divergence.pieces(text.encode()) for w in divergence.TERM.findall(p)) == Counter(w.encode() for w in text.split())
    rows = [("en", "a", text), ("en", "b", "ab")]
    got = divergence.divergence_report(docs_of(spark, rows), min_docs=2, top=3)
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows, 2, 3)
    assert divergence.divergence_report(docs_of(spark, rows).limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    c, total = 4_000_000_000_000_000, 9_000_000_000_000_001
    got = spark.range(1).select(divergence.share(F.lit(c).cast("long"), F.lit(total).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (c + 5) // total == divergence._prices([c], total, 10**9, 5)[0]


def brute_clusters(vectors, k, rounds, seed=2):
    """(id, v) -> [(id, cluster, distance)], centroids"""
    first = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    cen = [list(v) for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cen))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in vectors:
            own[near(v)[1]].append(v)
        for i, members in own.items():
            cen[i] = [sum(x) // len(members) for x in zip(*members)]
    return [(i, near(v)[1], near(v)[0]) for i, v in vectors], cen


@pytest.mark.parametrize("bits", [2, 6])
def test_clusters_equal_brute_force(spark, bits):
    rng = random.Random(bits)
    centres = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(6)]
    made = [[x + rng.gauss(0, 0.1) for x in rng.choice(centres)] for _ in range(150)]
    made += [made[0]] * 40 + [[0.0] * 64] * 3  # a common vector
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [nan] * 64, [1.0] * 63 + [inf], [1.0] * 63 + [-inf]]
    rows = [(i, e, "x") for i, e in enumerate(made + odd)] + [(None, made[1], "y"), (5, made[7], "z"), (3, made[3], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(4)
    kept = [(i, tuple(math.floor(256 * x) for x in e)) for i, e, _ in rows if e and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    want, cen = brute_clusters(kept, 10, 3)
    got = clusters.cluster_report(df, k=10, rounds=3, bits=bits).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == sorted((str(i), c, d) for i, c, d in want)
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    assert {(r["cluster"], r["cluster_inertia"]) for r in got} == {(c, sum(d for _, x, d in want if x == c)) for _, c, _ in want}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cen[r["cluster"]])).encode()).hexdigest() for r in got)


def test_intervals_hold_the_distances_and_spare_vectors(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 8]]) for i in range(400)]
    vectors = clusters.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    grid = clusters.fit_grid(vectors, bits=4)
    v = np.array([r["v"] for r in vectors.collect()])
    assert all(len(low) <= 16 and (low <= high).all() for low, high in zip(grid.low, grid.high))
    near = clusters.Nearest(grid, v[:8].astype(np.int64))
    low, high = near.intervals(grid.cells(v))
    exact = ((v[:, None] - v[None, :8]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    best, taken = near(grid.cells(v), v)
    assert (best == exact.argmin(axis=1)).all() and taken < len(v) / 4


def test_clusters_of_few_or_no_or_too_large_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [-0.001] * 64)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in clusters.cluster_report(df).collect()}
    assert [got[i]["distance"] for i in (1, 2)] == [0, 0] and got[1]["cluster"] != got[2]["cluster"]
    assert clusters.cluster_report(df.where("false")).collect() == []
    with pytest.raises(Exception, match="too large"):
        clusters.cluster_report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()
