"""Searches that ask for the neighbours of every vector, not of some."""

import pytest

import __spark_entry__

NAMES = ["knn_l2", "knn_l1", "knn_angular", "knn_eligible", "regime_weights"]


@pytest.mark.parametrize("name", NAMES)
def test_every_vector_is_a_query(spark, duck, sf, name):
    got = {r.q for r in __spark_entry__.queries()[name](spark, sf).select("q").distinct().collect()}
    every = {i for (i,) in duck.sql("SELECT vec_id FROM embeddings").fetchall()}
    assert len(every) > len(got & every) if name == "knn_eligible" else got == every  # the first vectors have none that is old enough
    assert len(got) > 0.6 * len(every)


def test_the_sum_of_differences_matches_its_sql(same):
    assert same(__spark_entry__.queries()["knn_l1"], __spark_entry__.oracle_sql()["knn_l1"]) > 0
