import numpy as np

from textloom.llm import neighbours, queries


def test_search_finds_nine_tenths_of_the_ten_nearest(spark):
    """Of vectors without any clusters: their ten nearest are hardly nearer than others."""
    x = np.random.default_rng(8).normal(size=(4000, 100)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    graph = neighbours.nn_descent(df, "k", "v", k=10, cell_rows=400)
    q = graph.nodes.filter("id % 20 = 0").selectExpr("id as query", "vec")
    rows = neighbours.greedy_search(graph, q, k=11).filter("query <> id").collect()
    assert all(r["rank"] <= 11 for r in rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -2)
    want = {(i, int(j)) for i in range(0, 4000, 20) for j in np.argsort(-g[i])[:10]}
    assert len(want & {(r["query"], r["id"]) for r in rows}) >= 0.9 * len(want)


def test_copies_are_sources_queries_and_results(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(200, 100)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(90)] + [(2000, x[1].tolist())]
    spark.createDataFrame(rows, "voca_idx long, wvec array<float>").write.parquet(f"{tmp_path}/word_vectors.parquet")
    ids, hot = {r[0] for r in rows}, {0, *range(1000, 1090)}
    for name, asked in (("p1_neighbours", ids), ("p1_search", {i for i in ids if i % 20 == 0})):
        got = {}
        for r in queries.QUERIES[name](spark, str(tmp_path)).collect():
            got.setdefault(r.voca_idx, {})[r.similar_voca_idx] = r.cosine
        assert set(got) == asked
        assert all(len(v) <= 10 and i not in v for i, v in got.items())
        assert all(set(got[i]) == set(sorted(hot - {i})[:10]) for i in asked & hot)
        assert got[2000][1] == 1.0 and len(got[2000]) == 10
