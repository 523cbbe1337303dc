"""The inverted-file index: recall against the exact search, all cells, odd vectors."""

from pyspark.sql import functions as F

from tidemill.operators import search, vectors
from tidemill.plans import catalog, stateful

SF = "/root/testdata/sf0.01"


def test_recall_of_the_query(spark):
    exact = search.vector_top_k(*catalog._queries(spark, SF), threshold=None)
    got = stateful.vector_index_topk(spark, SF)
    r = vectors.recall(got, exact).first()
    assert r.recall >= 0.9 and r.pairs == exact.count() == got.count()


def test_all_cells_are_exact(spark):
    v, q = catalog._queries(spark, "/root/testdata/sf0.001")
    centers = vectors.fit(v, 8)
    got = vectors.search_index(vectors.index(v, centers), centers, q, probes=8)
    assert vectors.recall(got, search.vector_top_k(v, q, threshold=None)).first().recall == 1.0


def test_every_vector_is_indexed_whatever_the_sample(spark):
    v, _ = catalog._queries(spark, "/root/testdata/sf0.001")
    centers = vectors.fit(v, 4, sample_rows=10)
    odd = v.unionByName(spark.createDataFrame([(9001, None), (9002, [])], v.schema))
    assert vectors.index(odd, centers).count() == v.count() and len(centers) == 4
    assert vectors.fit(v.limit(0), 4).shape == (0, 0)
    assert vectors.index(v, centers).agg(F.count_distinct("cell")).first()[0] <= 4
