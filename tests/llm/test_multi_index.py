"""Links and components against all pairs; measured recall."""

import numpy as np
import pytest

from commentflow.llm import multi_index


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links = {i: 0 for i, _ in good}
    root = dict(zip(links, links, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, rep long").repartition(3)
    got = multi_index.near_duplicates(df, **options).collect()
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [rng.normal(size=16) for _ in range(500)]
    for base in list(out[:40]):
        out += [base + rng.normal(size=16) * s for s in (0, 0, .1, .2, .3, .4)]
    out += [base * 3 for base in out[:5]]
    hot = rng.normal(size=16)
    out += [hot + rng.normal(size=16) * 0.05 for _ in range(120)]
    out = [np.float32(v).tolist() for v in out]
    out += [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.1]]
    ids = rng.permutation(len(out)).tolist()
    return [*zip(ids, out, strict=True), (None, out[0])]


def test_against_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 50)
    want = brute(rows)
    got = run(spark, rows, recall=0.999)
    found = sum(r.n_links for r in got)
    total = sum(n for n, _ in want.values())
    assert found >= 0.97 * total
    for r in got:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert r.n_links <= n and (r.component_id is None or r.component_id >= c)
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    exact = sum((r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)) for r in got)
    assert exact >= 0.95 * len(got)


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()][:600]
    want = brute(rows)
    got = run(spark, rows)
    assert sum(r.n_links for r in got) >= 0.95 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)


def test_nothing_valid(spark):
    got = run(spark, [(1, None), (2, [0.0]), (None, [1.0])])
    assert sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(0, 1, True), (0, 2, True)]
    assert run(spark, []) == []
