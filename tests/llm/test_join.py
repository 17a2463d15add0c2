"""The join of n-grams, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from test_corpus import brute, table, words

from quaylark.llm import neardup, ngramjoin


def join(spark, rows, k=4, percent=85, **options):
    df = table(spark, [(i, t, "s") for i, t in rows])
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_join(df, k=k, threshold=percent / 100, sketch_bits=12, **options).collect()}


def test_prefixes_of_near_sets_meet_under_every_order():
    rng = np.random.default_rng(2)
    levels = rng.integers(0, 3, (2, 1 << 8)).astype(np.uint8)
    for n in (1, 2, 6, 7, 20, 61, 300):
        prefixes = ngramjoin.Prefixes(levels, 85)
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for lost in range(n):
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 63, lost // 3).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                need = ngramjoin.least_shared(len(a), len(b), 85)
                assert all(len(np.intersect1d(x, y)) >= need for x, y in zip(prefixes(a), prefixes(b)))
                assert ngramjoin.passes(len(a), len(b), prefixes(a), prefixes(b), 85)


def test_sketch_counts_all_texts(spark):
    rng = random.Random(4)
    common = " ".join(words(rng, 6))
    rows = [(i, common + " " + " ".join(words(rng, 30))) for i in range(200)]
    levels = ngramjoin.token_levels(table(spark, [(i, t, "s") for i, t in rows]).repartition(5), 4, 14)
    shingle = neardup.Shingler(4)
    own = [np.min([lv[ngramjoin._places(shingle(t), i, 14)] for i, lv in enumerate(levels)], axis=0) for t in (common, " ".join(words(rng, 400)))]
    assert own[0].min() >= 4 and np.median(own[1]) <= 1


def test_join_equals_brute_force(spark):
    rng = random.Random(16)
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
    for k, percent in ((4, 85), (5, 80)):
        assert join(spark, rows, k, percent) == brute(rows, k, percent)
    assert ngramjoin.ngram_join(table(spark, []), k=4).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_links_beside_hubs(spark, block):
    """Texts of 6 of 12 shared paragraphs, each with a near twin: most are far from their hubs."""
    rng = random.Random(17)
    pool = [" ".join(words(rng, 15)) for _ in range(12)]
    rows = []
    for i in range(60):
        own = rng.sample(pool, 6)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-1], own[-1].rpartition(" ")[0] + f" other{i}"]))]
    rng.shuffle(rows)
    assert join(spark, rows, block=block) == brute(rows, 4, 85)


def test_every_pair_that_passes_is_given_out_or_shares_a_hub():
    rng = np.random.default_rng(18)
    prefixes, rows, near = ngramjoin.Prefixes(np.zeros((2, 1 << 8), np.uint8), 70), [], set()
    base = rng.integers(0, 1 << 63, (3, 60)).astype(np.uint64)
    for i in range(40):
        own = np.unique(np.concatenate([rng.permutation(base[i % 3])[: rng.integers(45, 60)], rng.integers(0, 1 << 63, 6).astype(np.uint64)]))
        p1, p2, p3 = prefixes(own)
        rows.append({"x": i, "n": len(own), "own": own, "p1": p1.view(np.int64).tolist(), "p2": ngramjoin._short(p2), "p3": ngramjoin._short(p3)})
    for a, b in combinations(rows, 2):
        both = len(np.intersect1d(a["own"], b["own"]))
        may = ngramjoin.passes(a["n"], b["n"], ngramjoin._read(*(a[p] for p in ("p1", "p2", "p3"))), ngramjoin._read(*(b[p] for p in ("p1", "p2", "p3"))), 70)
        assert may or 100 * both < 70 * (a["n"] + b["n"] - both)  # no near pair fails
        if may or 100 * min(a["n"], b["n"]) >= 70 * max(a["n"], b["n"]) and all(len(np.intersect1d(*(np.frombuffer(r[p], np.uint32) for r in (a, b)))) >= ngramjoin.least_shared(a["n"], b["n"], 70) for p in ("p2", "p3")):
            near.add((a["x"], b["x"]))
    assert 0 < len(near) < 700
    out = ngramjoin._beside(70)()({"scan": [rows[:25]], "rest": [list(rows)]})["pairs"][0]
    given = {tuple(sorted((p["x"], p["h"]))) for p in out}
    assert given <= near
    hubs: dict = {}
    for p in out:
        hubs.setdefault(p["h"], {p["h"]}).add(p["x"])
    assert all((a, b) in given or any({a, b} <= h for h in hubs.values()) for a, b in near if a < 25 or b < 25)


def test_short_tokens_never_share_less():
    rng = np.random.default_rng(19)
    pool = (rng.integers(0, 4, 40).astype(np.uint64) << np.uint64(32)) | np.arange(40, dtype=np.uint64)  # ten tokens are short for one number
    sets = [rng.permutation(pool)[: rng.integers(0, 40)] for _ in range(30)]
    short = [ngramjoin._short(s) for s in sets]
    table = ngramjoin._shared(short, 12)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert i >= 12 or table[i, j] >= both
            assert len(np.intersect1d(*ngramjoin._read(short[i], short[j]), assume_unique=True)) >= both


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(21)
    apart = 0
    for n in (0, 1, 2, 60, 64, 65, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for lost in {0, n // 12, n // 8, n // 2, n}:
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 63, lost // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            folded = ngramjoin._folded([ngramjoin.parity(a), ngramjoin.parity(b)])
            assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= len(a) + len(b) - 2 * both
            close = ngramjoin._sketched(85)()({"nx": [len(a)], "nh": [len(b)], "sketch_x": [ngramjoin.parity(a)], "sketch_h": [ngramjoin.parity(b)]})["close"][0]
            assert close or 100 * both < 85 * (len(a) + len(b) - both)
            apart += not close
    assert apart >= 8


@pytest.mark.parametrize("block", [4, 512])
def test_no_prefix_moves_for_members_far_from_all_others(spark, monkeypatch, block):
    """Texts of 6 of 12 shared paragraphs, far from each other, but for one pair beside its hubs."""
    rng = random.Random(22)
    pool = [" ".join(words(rng, 15)) for _ in range(12)]
    rows = [(i, " ".join(rng.sample(pool, 6))) for i in range(60)]
    rows.append((60, rows[30][1].rpartition(" ")[0] + " other"))
    moved, dealt = [], ngramjoin._dealt

    def seen(left, held, block):
        moved.append((set(held.columns), left.select("x").distinct().count()))
        return dealt(left, held, block)

    monkeypatch.setattr(ngramjoin, "_dealt", seen)
    assert join(spark, rows, block=block) == brute(rows, 4, 85)
    (first, tried), (second, left) = moved
    assert not {"p1", "p2", "p3"} & first and {"p2", "p3"} <= second
    assert tried > 40 and left <= 2


def test_tokens_are_those_of_the_shingler():
    rng = random.Random(20)
    texts = ["", " ", "One", "one TWO", "A b\xa0c d\x1ce f", "Ünï ÉÉ ßs a b", *(" ".join(words(rng, n)) for n in (3, 4, 5, 300)), "  lead\t\n\x0btail  a b c "]
    for k in (1, 4, 5):
        shingle = neardup.Shingler(k)
        assert [np.unique(x).tolist() for x in ngramjoin.Tokens(k)(texts)] == [shingle(t).tolist() for t in texts]


def test_null_and_repeated_ids_and_long_texts(spark):
    rng = random.Random(19)
    t = " ".join(words(rng, 30))
    long = words(rng, 40_000)
    rows = [(None, t, "s"), (5, t, "s"), (3, t, None), (3, "else where", "s"), (None, "lonely words here", "s"), (8, " ".join(long), "s"), (9, " ".join([*long[:-100], *words(rng, 100)]), "s")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngramjoin.ngram_join(table(spark, rows), sketch_bits=12).collect()), key=str)
    assert got == sorted([(None, 3), (5, 3), (3, 3), (3, 3), (None, None), (8, 8), (9, 8)], key=str)
