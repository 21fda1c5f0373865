"""op11 to op13 against brute force, with lists cut short, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ragloom.llm import jaccard, lexical, queries, whitening

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}
ODD = [(0, "same words here again and again"), (1, None), (2, ""), (3, "x"), (4, "same words here again and again"), (4, "same words here again and again"), (None, "no id at all here"), (5, "wordy " * 30_000), (6, " \n\t "), (7, "ünï 漢字 'S 're"), (8, "X"), (9, "x y z"), (10, "X\ty\nz")]
KIND = "doc_id long, text string, node string, mark int, size string, key string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", 1, "b", "c", "d") for i, t in ODD], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# ---- op11


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute_join(rows, percent=85):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def edited_groups(seed):
    """Groups of edited copies of all lengths; a third of them hold one passage."""
    rnd, rows = random.Random(seed), []
    for g in range(50):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 5, 8, 10, 12, 14, 18, 25, 40, 80, 150]))]
        if g % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = [f"p{k}" for k in range(30)]
        for _ in range(rnd.choice([1, 2, 4, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at, kind = rnd.randrange(len(w)), rnd.randrange(3)
                if kind == 0:
                    w[at] = f"x{rnd.randrange(9999)}"
                elif kind == 1 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, f"y{rnd.randrange(9999)}")
            rows.append((len(rows) * 3 + rnd.randrange(3), " ".join(w)))
    return rows


@pytest.mark.parametrize("knobs", [{}, {"common": 2, "reserve": 0.01, "boundary": 0}, {"boundary": 14, "common": 4, "needed": 0}])
def test_op11_equals_brute_force(spark, knobs):
    rows = edited_groups(7)
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **knobs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows)


def test_op11_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op11_heavy_light_join(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join([(r.doc_id, r.text) for r in docs.collect()])


def test_op11_large_group_of_near_copies_and_templates(spark):
    """One group of near copies, outsiders like it but under the threshold, and texts from one template, with short lists."""
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for at in rnd.sample(range(120), 1 if k < 70 else 9):
            w[at] = f"x{rnd.randrange(99999)}"
        rows.append((k, " ".join(w)))
    slots = [[f"s{i} o{j} t{j} u{i}" for j in range(6)] for i in range(8)]
    rows += [(100 + k, " ".join(f"fixed {i} words between " + rnd.choice(s) for i, s in enumerate(slots))) for k in range(80)]
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), common=8).collect()
    want = brute_join(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert Counter(c for _, c in want.values()).most_common(1)[0][1] >= 70


def test_op11_need_and_subsets():
    for a in range(1, 60):
        for b in range(a, 70):
            least = next((i for i in range(a + 1) if 100 * i >= 85 * (a + b - i)), None)
            assert (jaccard.need(a, b, 85) if jaccard.need(a, b, 85) <= a else None) == least
            if least is not None:
                assert a - least < jaccard.first_places(a, 85)[0] and b - least < jaccard.first_places(b, 85)[1]
                if a < b <= 20:
                    assert least in jaccard.subset_sizes(a, 20, 85) and least in jaccard.subset_sizes(b, 20, 85)
    assert jaccard.chosen_boundary({n: 10 for n in range(1, 33)}, 0.0, 85) < jaccard.chosen_boundary({n: 10 for n in range(1, 33)}, 50.0, 85)


def test_op11_odd_rows(odd, none):
    got = jaccard.linked(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 0 and by[8].component_id == 3 and by[10].component_id == 9
    assert [(by[k].n_shingles, by[k].component_id) for k in (1, 2, 6)] == [(0, 1), (0, 2), (0, 6)]
    assert by[5].n_shingles == 1 and by[None].component_id is None
    assert jaccard.linked(none).count() == 0


# ---- op12


def brute_whitening(rows):
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("fan", [2, 16])
def test_op12_equals_brute_force(spark, fan):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    x, n, s, e, v = brute_whitening([(r.vec_id, r.embedding) for r in frame.collect()])
    got = whitening.whiten(frame.repartition(7), fan=fan).collect()
    assert len(got) == 16 * len(x) and {r.n for r in got} == {n}
    deviation = {i: int(((n * c - s).astype(object) ** 2).sum()) for i, c in x.items()}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert max(abs(r.explained - e[r.component - 1] / e.sum()) for r in got) < 1e-12
    assert max(r.identity_error for r in got) < 1e-10
    white = {(r.vec_id, r.component): r.whitened for r in got}
    for k in range(1, 17):
        own = {i: float((c - s / n) @ v[:, k - 1] / math.sqrt(e[k - 1])) for i, c in x.items()}
        far = max(own, key=lambda i: abs(own[i]))
        sign = math.copysign(1, own[far] * white[far, k])
        assert max(abs(sign * white[i, k] - own[i]) for i in own) < 1e-6


def test_op12_small_deviations_and_odd_numbers_of_dimensions():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(400, 7)) * 10.0 ** -np.arange(7)
    turn = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    norms, v = whitening.jacobi(np.linalg.qr(a @ turn, mode="r"))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(norms, want, rtol=1e-9) and np.allclose(v.T @ v, np.eye(7), atol=1e-12)
    z = a @ turn @ v / norms
    assert np.abs(z.T @ z - np.eye(7)).max() < 1e-9
    norms, _ = whitening.jacobi(np.zeros((3, 4)))
    assert norms.tolist() == [0.0] * 4


def test_op12_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.5, 0.25], [1.0, 0.5, 0.25], [0.0, 0.0, 0.0], [0.2, -0.9, 0.1], [0.3, 0.3, -0.3], None, [1.0, None, 0.0], [nan, 1.0, 1.0], [1.0, inf, 0.0], [1.0, 2.0], [], [3.0, -3.0, 0.5]]
    rows = [(k if k else None, v, "x", 1, 2.0) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int, whitened double").repartition(3)
    got = whitening.whiten(frame).collect()
    assert Counter(r.vec_id for r in got) == {k: 3 for k in (None, 1, 2, 3, 4, 11)} and {r.n for r in got} == {5}
    assert all(r.whitened is not None for r in got) and got[0].identity_error < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in same)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and line[0].identity_error < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 2.0]), (2, [2.0, -1e300]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge)
    assert whitening.whiten(frame.where("false")).count() == 0


# ---- op13


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_search(docs, items, k=50):
    own = [(d, c, sum(c.values())) for d, c in ((d, Counter(terms(t))) for d, t in docs) if c]
    many, length = len(own), sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in own:
            m = 50 + 50 * n * many // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            found += [(-score, d)] if score > 0 else []
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("knobs", [{}, {"block": 20, "pilot": 3, "item_block": 7}, {"k": 3, "block": 64, "pilot": 1}])
def test_op13_equals_brute_force(spark, knobs):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], knobs.get("k", 50))
    assert sorted(tuple(r) for r in lexical.ranked(docs.repartition(5), items, **knobs).collect()) == want


def test_op13_stops_before_the_ends_of_lists(spark):
    """A block of many documents: scores are looked up for a part of them, and ties at the kth score go by id."""
    rng = np.random.default_rng(2)
    texts = [" ".join(["a"] * int(x) + ["b"] * int(y) + [f"z{k}"]) for k, (x, y) in enumerate(rng.integers(1, 40, (3000, 2)))] + ["a b"] * 200
    own = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(1)
    items = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "b z7")], "item_id long, text string")
    want = brute_search(own, [(1, "a b"), (2, "a"), (3, "b z7")])
    assert sorted(tuple(r) for r in lexical.ranked(docs, items).collect()) == want
    index = lexical.forward_index(docs, {b"a": 0, b"b": 1}, "doc_id", "text").toArrow().to_batches()
    lists = lexical.Lists(index, np.array([100, 90]), 3200, 100_000)
    lists.top(0, np.array([0, 1]), 50, 0)
    assert (lists.seen >= 0).sum() < 2600


def test_op13_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "WORDS x", 5), (1, "again", 5), (None, "漢字", 5), (2, None, 5), (3, "", 5), (4, "absent", 5)], "item_id long, text string, rank int")
    got = lexical.ranked(odd, items).collect()
    rows = [(d if d is not None else 1 << 62, t) for d, t in ODD]
    want = [(i, r, None if d == 1 << 62 else d, s) for i, r, d, s in brute_search(rows, [(1, "words x again"), (0, "漢字")])]
    assert sorted((r.item_id or 0, r.rank, r.doc_id, r.score) for r in got) == want
    assert lexical.ranked(none, items).count() == 0 and lexical.ranked(odd, items.where("false")).count() == 0
