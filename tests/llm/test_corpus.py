"""Operators over whole corpora, against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from quaylark.llm import decontaminate, graph, linededup, mixing, neardup
from quaylark.llm.common import stash


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, n int, id string, component int")


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def words(rng, n):
    return [rng.choice("ka lo mi ten sho var eth un iz pra gol dun".split()) + str(rng.randrange(40)) for _ in range(n)]


def brute(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "  \n", "One", "one", "two words", "Two WORDS"]
    for _ in range(25):
        base = words(rng, rng.choice([4, 9, 30, 120]))
        for e in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = rng.choice(base) if rng.random() < 0.4 else f"edit{rng.randrange(999)}"
            texts.append(" ".join(w))
    texts += [texts[20]] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = table(spark, [(i, t, "s") for i, t in rows])
    for k, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k=k, threshold=percent / 100).collect()}
        assert got == brute(rows, k, percent)
    kept = neardup.keep_first(df, k=3, threshold=0.85)
    assert kept.columns == df.columns and kept.count() == len({c for _, c in brute(rows, 3, 85).values()})
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_links_below_a_hub(spark, monkeypatch):
    """Chains that only members of one hub form, over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(9)
    base = words(rng, 200)
    rows = []
    for i in range(30):
        w = list(base)
        for j in range(3 * (i // 2)):
            w[(7 * j) % 200] = f"c{i // 2}x{j}"
        if i % 2:
            w[199] = "own"
        rows.append((i, " ".join(w)))
    df = table(spark, [(i, t, "s") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k=3, threshold=0.85).collect()}
    assert got == brute(rows, 3, 85)


def test_links_beside_a_hub(spark, monkeypatch):
    """Texts of passages that many share: in each shared band of a near pair the hub is a third, far text."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng, rows = random.Random(12), []
    for i in range(2):
        own = [" ".join(words(rng, 12)) for _ in range(24)]
        rows += [(5000 + 2 * i, " ".join(own)), (5001 + 2 * i, " ".join([*own[:-1], *words(rng, 12)]))]
        for h in range(120):
            part = list(own)
            for j in rng.sample(range(24), 8):
                part[j] = " ".join(words(rng, 12))
            rows += [(1000 * (i + 10) + 2 * h + c, " ".join(part)) for c in range(2)]
    df = table(spark, [(i, t, "s") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k=3, threshold=0.85).collect()}
    assert got[5001][1] == 5000 and got == brute(rows, 3, 85)


def test_null_and_repeated_ids(spark):
    t = " ".join(words(random.Random(1), 30))
    df = table(spark, [(None, t, "s"), (5, t, "s"), (3, t, None), (3, "else where", "s"), (None, "lonely words here", "s")])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, False), (5, 3, False), (3, 3, True), (3, 3, True), (None, None, False)], key=str)


def test_families_of_shared_paragraphs(spark):
    """300 texts of 10 of 20 shared paragraphs, and a near pair whose hubs are third texts."""
    rng = random.Random(31)
    pool = [" ".join(words(rng, 25)) for _ in range(20)]
    rows = [(i, " ".join(rng.sample(pool, 10))) for i in range(300)]
    own = rng.sample(pool, 10)
    rows += [(1000, " ".join(own)), (1001, " ".join([*own[:-1], own[-1].rpartition(" ")[0] + " other"]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, [(i, t, "s") for i, t in rows]), k=3, threshold=0.85).collect()}
    assert got[1001][1] == got[1000][1] and got == brute(rows, 3, 85)


def test_short_texts_that_share_a_passage(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(32)
    passage = " ".join(words(rng, 40))
    rows = []
    for i in range(150):
        t = passage + " " + " ".join(words(rng, 30))
        rows += [(2 * i, t)] + ([(2 * i + 1, t + " more")] if i % 3 == 0 else [])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, [(i, t, "s") for i, t in rows]), k=3, threshold=0.85).collect()}
    assert got == brute(rows, 3, 85)


def test_texts_of_one_id_stay_apart(spark):
    rng = random.Random(33)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (1, " ".join([*a, "x"])), (2, " ".join([*b, "y"])), (5, " ".join(a))]
    df = table(spark, [(i, t, "s") for i, t in rows])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k=3, threshold=0.85).collect())
    assert sorted((i, c) for i, _, c in got) == [(1, 1), (2, 2), (5, 1), (5, 1), (5, 2)]
    assert sorted(r["doc_id"] for r in neardup.keep_first(df, k=3, threshold=0.85).collect()) == [1, 2]


def clashing(spark, rows):
    """Documents with columns of the names that the operators use themselves."""
    names = ["doc_id long", "text string", "source string", *(f"`{c}` string" for c in (
        "score", "_score", "set_key", "line_set", "line_kept", "line_n", "line_n_dropped", "own_id", "match_text", "match_count", "match_found", "match_so_far", "n_words", "matches",
        "size", "own", "t", "h", "pattern", "copies", "passes", "id", "component_id", "kept", "a.b", "n_lines"))]
    return spark.createDataFrame([(*r, *(f"{c}!" for c in range(len(names) - 3))) for r in rows], ", ".join(names))


def test_columns_of_clashing_names_are_kept(spark):
    rng = random.Random(34)
    rows = [(i, "\n".join([" ".join(words(rng, 12)), "all pages", str(i)]), f"s{i % 2}") for i in range(30)] + [(40, None, None), (41, "", "s1"), (41, "", "s1")]
    df = clashing(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    bench = spark.createDataFrame([("a", rows[3][1].split("\n")[0])], "item_id string, text string")
    from quaylark.llm import toxicity

    for out in (
        toxicity.drop_toxic(df, labels, threshold=1.1), linededup.drop_boilerplate(df), neardup.keep_first(df), decontaminate.remove_contaminated(df, bench),
        decontaminate.remove_contaminated(df, bench, block_bytes=10), mixing.mixed_documents(df),
    ):
        own = [f"`{c}`" for c in df.columns]
        assert out.columns[: len(df.columns)] == df.columns and out.select(*own).count() <= len(rows)
        assert {tuple(r)[3:] for r in out.select(*own).collect()} == {tuple(f"{c}!" for c in range(len(df.columns) - 3))}
        assert out.limit(0).count() == 0
    assert mixing.mixed_documents(df).columns[-1] == "copies_"
    assert linededup.drop_boilerplate(df).where("text like '%all pages%'").count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(df, bench).collect()) == sorted(i for i, _, _ in rows if i != 3)


def test_contamination(spark):
    rng = random.Random(3)
    items = [(f"i{j}", " ".join(words(rng, 25))) for j in range(8)] + [("short", "Rare tiny item"), ("none", "... !"), ("null", None), ("i0", None)]
    item = dict(items[:9])
    clean = " ".join(words(rng, 60))
    part = " ".join(item["i2"].split()[5:17]).upper().replace(" ", "; ")
    df = table(spark, [(1, clean, "s"), (2, f"{clean} {item['i0']} x {item['i1']}", "s"), (3, part, "s"), (4, " ".join(item["i3"].split()[:9]), "s"), (5, "a rare, TINY item!", "s"), (6, None, "s"), (7, "", "s"), (8, (item["i4"] + " ") * 3, "s")])
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (100, 1 << 20):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination_report(df, bench, block_bytes=size).collect()}
        assert got == {1: (60, 0, 0), 2: (111, 50, 2), 3: (12, 12, 1), 4: (9, 0, 0), 5: (4, 3, 1), 6: (0, 0, 0), 7: (0, 0, 0), 8: (75, 75, 1)}
    m = decontaminate.find_matches(df.where("doc_id = 3"), bench).first()["matches"]
    assert [(x["item_id"], x["item_start"], x["start"], x["words"]) for x in m] == [("i2", 5, 0, 12)]
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(df, bench).collect()) == [1, 4, 6, 7]
    assert decontaminate.contamination_report(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_blocks_of_a_benchmark_move_matches_only(spark, monkeypatch):
    """Many blocks: texts are written once, clashing names and repeated rows are kept, matches equal those of one block."""
    rng = random.Random(8)
    items = [(f"i{j}", " ".join(words(rng, 20))) for j in range(6)]
    rows = [(i, " ".join([*words(rng, 15), *(items[j][1] for j in range(6) if i >> j & 1)]), i, "x") for i in range(40)]
    rows += [rows[5], rows[5], (None, rows[3][1], 0, "x"), (99, None, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, match_row long, `match.other` string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    written = []
    monkeypatch.setattr(decontaminate, "stash", lambda d: written.append(d.columns) or stash(d))  # the items are stored first, each time

    def found(size):
        out = decontaminate.find_matches(df, bench, block_bytes=size)
        assert out.columns == [*df.columns, "n_words", "matches"]
        return sorted((repr((*r[:4], r["n_words"], sorted(map(tuple, r["matches"]))))) for r in out.collect())

    want = found(1 << 20)
    assert written == [["i", "t"]] and len(want) == len(rows)
    assert found(60) == want
    assert len(written) > 4 and "text" in written[2] and all(c == ["r", "f"] for c in written[3:])


def test_line_dedup(spark):
    rows = [(i, f"Menu  line\nbody {i} text\n\n(c) us", "a") for i in range(20)] + [(50, rows_text := "Menu  line\nother", "b"), (51, None, "a"), (52, "", "a"), (53, "Menu  line", None)]
    rows += [(60 + i, "copied\ntext", "a") for i in range(30)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.line_report(table(spark, rows), ratio=0.3).collect()}
    assert got[3] == ("body 3 text\n", 2) and got[50] == (rows_text, 0) and got[51] == (None, 0) and got[52] == ("", 0) and got[60] == ("copied\ntext", 0)
    assert len(got) == len(rows) and linededup.line_report(table(spark, rows).limit(0)).count() == 0


def test_pages_that_are_mostly_boilerplate(spark):
    """12 different pages of 20 shared lines and one own line each: the shared ones go."""
    shared = [f"menu entry {i}" for i in range(20)]
    rows = [(i, "\n".join([*shared, f"own line of page {i}"]), "h") for i in range(12)] + [(20 + i, "\n".join([*shared, "copied"]), "few") for i in range(9)]
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in linededup.line_report(table(spark, rows)).collect()}
    assert all(got[i] == (20, f"own line of page {i}") for i in range(12))
    # Nine copies are one page, too few for boilerplate.
    assert all(got[20 + i][0] == 0 for i in range(9))


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100, None: 100}) == pytest.approx({"a": 2000 / 13, "b": 800 / 13, "c": 400 / 13, None: 2000 / 13})
    got = mixing.targets({"a": 10, "b": 90, "c": 100})
    assert got["a"] == 30 and got["b"] == pytest.approx(170 * 2 / 3) and sum(got.values()) == pytest.approx(200)


def cheapest(groups, wanted, repeats):
    """Words served and cost of the best flow, over all ways to give words to sources."""
    arcs = [(p, o, s) for p, o in groups for s in o]
    best = (0, 0)
    for give in product(*(range(repeats * groups[p, o] + 1) for p, o, _ in arcs)):
        to, of, by = defaultdict(int), defaultdict(int), defaultdict(int)
        for (p, o, s), n in zip(arcs, give):
            to[s] += n
            of[p, o] += n
            by[p] += n
        mass = defaultdict(int)
        for (p, _), n in groups.items():
            mass[p] += n
        if any(to[s] > wanted[s] for s in to) or any(of[g] > repeats * n for g, n in groups.items()):
            continue
        cost = sum(k * min(max(0, by[p] - k * mass[p]), mass[p]) for p in by for k in range(repeats))
        best = max(best, (sum(give), -cost))
    return best


def cost_of(flow, groups, repeats):
    mass, by = defaultdict(int), defaultdict(int)
    for (p, o), n in groups.items():
        mass[p] += n
        by[p] += flow[p, o]
    return -sum(k * min(max(0, by[p] - k * mass[p]), mass[p]) for p in by for k in range(repeats))


def test_flow_is_the_cheapest():
    rng = random.Random(5)
    for _ in range(12):
        groups = {}
        for p in (("a",), ("a", "b"), ("b", "c")):
            for o in [(s,) for s in p] if rng.random() < 0.5 else [p]:
                groups[p, o] = rng.randint(0, 2)
        if sum(len(o) for _, o in groups) > 4:
            groups.popitem()
        wanted = {s: rng.randint(0, 6) for s in "abc"}
        flow = mixing.route(groups, wanted, 2)
        assert (sum(flow.values()), cost_of(flow, groups, 2)) == cheapest(groups, wanted, 2)


def test_flow_serves_overlapping_sources():
    ab = ("a", "b")
    flow = mixing.route({(("a",), ("a",)): 10, (ab, ab): 10, (("b",), ("b",)): 10}, {"a": 15, "b": 15}, 3)
    assert sum(flow.values()) == 30 and max(flow.values()) == 10  # no repetition is needed
    # The text that both hold is repeated for neither while either has words of its own.
    flow = mixing.route({(("a",), ("a",)): 10, (ab, ("a",)): 10, (ab, ("b",)): 10, (("b",), ("b",)): 20}, {"a": 20, "b": 30}, 3)
    assert flow[("a",), ("a",)] == 10 and flow[("b",), ("b",)] == 20 and flow[ab, ("a",)] == flow[ab, ("b",)] == 10


def test_mix_of_texts_in_several_sources(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(words(rng, 20)), f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, rows[i % 6][1], f"s{i % 3}") for i in range(60)] + [(None, "no id", "s1"), (None, "no id", "s1")]
    df = table(spark, rows)
    got, by = mixing.mix_report(df).collect(), {}
    for r in got:
        t = by.setdefault("s1" if r["doc_id"] is None else f"s{(r['doc_id'] - (100 if r['doc_id'] >= 100 else 0)) % 3}", [0, r["target"]])
        t[0] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) and all(abs(t - goal) <= 20 for t, goal in by.values())
    arrays = df.select("doc_id", "text", F.when(F.col("doc_id") % 5 > 0, F.array("source", F.lit("s9"))).alias("source"))
    out = mixing.mixed_documents(arrays)
    assert out.columns == ["doc_id", "text", "source", "copies"] and 0 < out.count() <= len(rows) and out.agg(F.max("copies")).first()[0] <= 3


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), f"s{i % 4}" if i % 9 else None) for i in range(800)] + [(900, None, "s1"), (901, "", "s1")]
    df = table(spark, rows)
    got = [tuple(r) for r in mixing.mix_report(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
    again = [tuple(r) for r in mixing.mix_report(df.repartition(3)).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    by = {}
    for (_, _, s), (_, size, own, target, taken) in zip(sorted(rows), sorted(got)):
        t = by.setdefault(s, [0, 0, target, own])
        t[0] += size
        t[1] += taken
        assert taken % max(size, 1) == 0 and taken <= 3 * size
    for size, taken, target, own in by.values():
        assert size == own and abs(taken - target) <= 0.01 * target
    copies = mixing.mixed_documents(df)
    assert copies.columns == [*df.columns, "copies"]
    assert copies.agg(F.sum(F.col("copies") * mixing.word_count(F.col("text")))).first()[0] == sum(x[4] for x in got)
    assert mixing.mix_report(df.limit(0)).count() == 0
