"""Ranked search, exact top-k and whitening against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm import brute
from voxelmeter.llm import exact_search, lexical_search, oracles, whitening


def ranked(docs, items, top=50):
    """[(item_id, rank, doc_id, score)] of documents [(id, text)] and items [(id, text)]."""
    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.FOLD))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df, terms, out = Counter(t for _, b in bags for t in b), {}, []
    for i, t in items:
        if i is not None:
            terms.setdefault(i, set()).update(cut(t))
    for item, own in terms.items():
        scores = []
        for doc, bag in bags:
            s = 0
            for t in own & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + 50 * sum(bag.values()) * n_docs // total
                s += w * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=lambda r: r[:2])


@pytest.fixture(scope="module")
def library():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(120)]

    def some(n):
        return " ".join(words[min(int(rng.expovariate(0.05)), 119)] for _ in range(n))
    docs = [(i, some(rng.randint(0, 40))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(150)] + [(500, None), (501, ""), (502, "!? -"), (None, docs[3][1]), (3, docs[3][1]), (503, some(4000)), (504, "Ab,AB;ab É")]
    items = [(i, some(rng.randint(1, 12))) for i in range(20)] + [(20, None), (21, ""), (22, docs[7][1]), (22, "zzz ab"), (None, "ab"), (23, "nowhere-else")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 0.5) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(3)
    return d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("sizes", [{}, {"tree_postings": 300, "leaf_docs": 4, "top": 7}, {"max_item_bytes": 400}])
def test_ranked_search(spark, library, sizes):
    docs, items = library
    got = sorted(tuple(r) for r in lexical_search.search(*frames(spark, docs, items), **sizes).collect())
    assert sorted(got, key=lambda r: r[:2]) == ranked(docs, items, sizes.get("top", 50))


def test_search_without_rows(spark, library):
    docs, items = library
    assert lexical_search.search(*frames(spark, [], items)).collect() == []
    assert lexical_search.search(*frames(spark, docs, [])).collect() == []
    assert lexical_search.search(*frames(spark, docs, [])).columns == ["item_id", "rank", "doc_id", "score"]


def test_tree_lets_subtrees_go(library):
    """Documents of another vocabulary are never scored, and every document lies in one leaf."""
    n = 2000
    rank = np.concatenate([np.arange(5) + (0 if i % 2 else 50) + (i % 7) * 5 for i in range(n)])
    tree = lexical_search.Tree(np.arange(n + 1) * 5, rank, np.ones(5 * n, np.int64), np.full(n, 100), np.arange(n), 16)
    leaves = sorted(tree.nodes[v] for v in range(len(tree.nodes)) if not tree.children[v])
    assert leaves[0][0] == 0 and leaves[-1][1] == n and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:], strict=False))
    search = lexical_search.Search(np.full(100, 10), np.array([0, 1, 2]), np.array([0, 3]), 50)
    search.over(tree)
    assert search.scored < n / 5 and (search.score > 0).all()


def test_sql_of_search_is_the_same(spark, tmp_path):
    docs = [(i, t) for i, t in [(1, "a b c b"), (2, "B c"), (3, None), (4, "zz"), (5, "c c c")]]
    items = [(1, "b c"), (2, "q")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.execute(oracles.RANKED_SEARCH).fetchall()) == ranked(docs, items)


VECTORS = "vec_id long, embedding array<float>, score double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0, 1) for i, v in rows], VECTORS).repartition(3)


def nearest(rows, top=20, every=20):
    known = sorted({(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i in sorted({i for i, _ in known if i % every == 0}):
        scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), j) for k, q in known if k == i for j, v in known if j != i and len(v) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:top])]
    return out


@pytest.fixture(scope="module")
def bank():
    rng = np.random.RandomState(2)
    centres = rng.normal(size=(12, 19))
    rows = [(i, (centres[i % 12] + rng.normal(size=19) * rng.choice([0.05, 0.5])).tolist()) for i in range(700)]
    rows += [(700 + i, rows[40][1]) for i in range(90)] + [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 17), (2020, [float("nan")] * 19), (2040, [float("inf")] + [0.0] * 18), (None, rows[3][1])]
    return rows + [rows[40], rows[41]] + [(3000, [1.0, 2.0]), (3001, [3.0, -1.0]), (3020, [0.0, 0.0])]


@pytest.mark.parametrize("sizes", [{}, {"query_block": 7, "candidate_block": 50}])
def test_exact_top_k(spark, bank, sizes):
    got = sorted(tuple(r) for r in exact_search.top_k(vectors(spark, bank), **sizes).collect())
    assert got == nearest(bank)


def test_top_k_of_large_entries_and_nothing(spark):
    rng = np.random.RandomState(3)
    rows = [(i, (rng.randint(-1 << 20, 1 << 20, 6) / 4).tolist()) for i in range(60)]
    assert sorted(tuple(r) for r in exact_search.top_k(vectors(spark, rows)).collect()) == nearest(rows)
    assert exact_search.top_k(vectors(spark, [])).collect() == []
    assert exact_search.top_k(vectors(spark, [(20, [1.0])])).collect() == []


def test_bounds_hold_and_let_candidates_go():
    rng = np.random.RandomState(4)
    codes = np.floor(64 * rng.normal(size=(400, 64)) * 0.1).astype(np.int64)
    exact = codes @ codes.T
    for edges in exact_search.levels(64):
        f = exact_search.features(codes.astype(float), edges).astype(float)
        assert (f @ f.T >= exact - 0.5).all()
    centres = np.repeat(rng.randint(-60, 60, (40, 64)), 50, axis=0)
    codes = rng.permutation(centres + rng.randint(-3, 4, centres.shape))
    best = exact_search.Best(np.arange(0, 2000, 20), codes[::20], 5)
    for lo in range(0, 2000, 250):
        best.offer(np.arange(lo, lo + 250), codes[lo:lo + 250])
    assert best.exact < best.compared / 4


def test_whitening(spark):
    rng = np.random.RandomState(6)
    data = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(7, data[7].tolist()), (None, data[8].tolist())]
    odd = [(900, None), (901, []), (902, [None] * 5), (903, [float("nan")] * 5), (904, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows + odd), components=3).toPandas()
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, total = len(rows), x.sum(axis=0)
    value, basis = np.linalg.eigh(np.cov(x.astype(float).T, bias=True))
    value, basis = value[::-1], basis[:, ::-1]
    assert len(got) == 3 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    want = {i: int(((n * r - total) ** 2).sum()) for (i, _), r in zip(rows, x, strict=True) if i is not None}
    own = got[got["vec_id"].notna()]
    assert (own["deviation"] == own["vec_id"].map(want)).all()
    for k in range(3):
        mine = own[own["component"] == k + 1].drop_duplicates("vec_id").set_index("vec_id")["whitened"].sort_index()
        true = ((x.astype(float) - x.astype(float).mean(axis=0)) @ basis[:, k] / math.sqrt(value[k]))[:500]
        assert np.allclose(abs(mine.to_numpy() @ true), (true ** 2).sum(), rtol=1e-9) and np.allclose(np.abs(mine), np.abs(true), atol=1e-8)
        assert np.allclose(got[got["component"] == k + 1]["explained"], value[k] / value.sum(), rtol=1e-9)


def test_cross_products_are_exact(spark):
    rng = np.random.RandomState(8)
    x = rng.randint(-(1 << 30), 1 << 30, (150, 3))
    x[:, 1] >>= 25
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(2)
    least = x.min(axis=0).tolist()
    y = (x - np.array(least)).astype(object)
    assert whitening.cross_products(rows, least, x.max(axis=0).tolist()) == {(d, e): int((y[:, d] * y[:, e]).sum()) for d in range(3) for e in range(d, 3)}


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 1.0]) for i in range(9)])).collect()
    assert [r.component for r in flat] == [1] * 9 and math.isclose(flat[0].explained, 1)
