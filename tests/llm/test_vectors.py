import numpy as np
import pytest

from starcell.llm import vectors


def rows_of(seed):
    r = np.random.default_rng(seed)
    out = []
    for c in range(25):
        centre = r.normal(size=16)
        for _ in range(int(r.choice([1, 2, 9]))):
            out.append((centre + r.normal(size=16) * r.choice([0.01, 0.1, 0.3])).astype(np.float32).tolist())
    out += [out[0], out[0], [2 * x for x in out[1]], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15,
            [None] + [1.0] * 15, [1.0, 2.0]]
    return [(i * 3 % 101 if i != 7 else None, v) for i, v in enumerate(out)]


def brute(rows, limit=0.9):
    good = [v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good)]
    links, up = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and good[i] and good[j] and unit[i] @ unit[j] >= limit:
                links[i] += 1
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[up[i]] = min(name, least.get(up[i], name))
    return sorted(((name, n, least.get(u), name == least.get(u)) for (name, _), n, u in zip(rows, links, up)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 40)
    monkeypatch.setattr(vectors, "MOST_SHARD_ROWS", 30)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = vectors.near_duplicates(df, recall=1.0).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, kept string")
    assert vectors.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None, "x"), (2, [1.0, 0.0], "y")], "vec_id bigint, embedding array<float>, kept string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert got[1].n_links == got[2].n_links == 0 and got[1].kept is True and got[2].component_id == 2


def test_graph_is_searchable():
    r = np.random.default_rng(5)
    v = vectors.unit(r.normal(size=(600, 24)))
    heads, tails = (np.concatenate(x) for x in zip(*vectors.robust_graph(v)))
    shard = vectors.Shard(v, heads, tails)
    q, found = shard.search(vectors.unit(v[:200] + r.normal(size=(200, 24)) * 0.02), np.full(200, -1), 0.9, 32)
    true = {(i, int(m)) for i in range(200) for m in [i]}
    assert len(true & set(zip(q.tolist(), found.tolist()))) >= 190


def paired(seed, n, pairs, copies):
    """Far apart vectors, some with one partner just in range, and one large group of near copies."""
    r = np.random.default_rng(seed)
    v = vectors.unit(r.normal(size=(n, 24)))
    aside = vectors.unit(r.normal(size=(pairs, 24)))
    near = vectors.unit(v[:pairs] + 0.4 * aside)
    large = vectors.unit(r.normal(size=(1, 24)) + r.normal(size=(copies, 24)) * 0.02)
    return [(i, x.tolist()) for i, x in enumerate(np.concatenate((v, near, large)).astype(np.float32))]


def links_of(rows):
    v = vectors.unit(np.array([v for _, v in rows], np.float64))
    return ((v @ v.T >= 0.9).sum(1) - 1).tolist()


@pytest.mark.parametrize("missed,copies,sample", [("all", 0, 10_000), ("small", 300, 10_000), ("small", 300, 800)])
def test_audit_sees_what_a_search_misses(spark, monkeypatch, missed, copies, sample):
    """A search without any links, or with those of the large group alone, is never final."""
    monkeypatch.setattr(vectors, "SAMPLE", sample)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 500)
    rows = paired(4, 1200, 20, copies)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    search = vectors._found

    def lossy(nodes, *more):
        found = search(nodes, *more)
        if missed == "all":
            return found.where("false")
        group = nodes.where("least >= 1220").select("node")
        return found.where("node is not null").join(group, "node", "left_semi").union(
            found.where("a is not null").join(group.withColumnRenamed("node", "a"), "a", "left_semi")
            .select("node", "links", "a", "b"))

    monkeypatch.setattr(vectors, "_found", lossy)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(rows))] == links_of(rows)
    want = [i - 1200 if 1200 <= i < 1220 else min(i, 1220) for i in range(len(rows))]
    assert [got[i].component_id for i in range(len(rows))] == want


def test_recall_is_a_mean_over_queries():
    true = {i: 2000 for i in range(40)} | {100 + i: 1 for i in range(40)}
    got = dict.fromkeys(range(40), 2000)
    assert not vectors.reached(true, got, 0.98) and vectors.reached(true, true, 0.98)
