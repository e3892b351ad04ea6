"""The sparse matrix: vectors from coordinates, and a fit that reads dense columns, places and tags."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from lendscope.catalog import _sparse_input
from lendscope.plans import sparse_input


def test_vectors_hold_the_coordinates(spark):
    rows = [(1, 0, 2.5), (1, 7, 1.0), (2, 3, -1e-300), (1, 5, 0.1 + 0.2), (3, 9, 1e22)]
    matrix = sparse_input.SparseInput(spark.createDataFrame(rows, "user_id long, position long, value double"), None, 10)
    vectors = sparse_input.vectors(matrix)
    found = {r.user_id: r.features for r in vectors.collect()}
    assert found == {1: SparseVector(10, [0, 5, 7], [2.5, 0.1 + 0.2, 1.0]), 2: SparseVector(10, [3], [-1e-300]), 3: SparseVector(10, [9], [1e22])}
    assert sorted(map(tuple, sparse_input.entries(vectors, "user_id", "features").collect())) == sorted(rows)
    assert tuple(sparse_input.audit(vectors, "user_id", "features").first()) == (3, 3, 10, 10, 5, 0)
    assert "Python" not in vectors._jdf.queryExecution().toString()


def test_audit_finds_faults(spark):
    one = spark.createDataFrame([(1, 4, 1.0), (1, 11, 1.0)], "user_id long, position long, value double")
    broken = sparse_input.vectors(sparse_input.SparseInput(one, None, 5))
    assert broken.select(F.unwrap_udt("features")).count() == 1
    assert sparse_input.audit(broken, "user_id", "features").first().faults == 1


def test_one_fit_reads_numbers_places_and_tags(spark, views):
    matrix = _sparse_input(views)
    users = sparse_input.vectors(matrix).cache()
    (size,) = {r.features.size for r in users.collect()}
    assert size == matrix.size == matrix.columns.count()
    fact = views.train().select(
        "user_id", "listing_id", (F.col("repay_date") == "\\N").cast("double").alias("label"), F.col("due_amt")
    )
    listed = fact.unionByName(spark.createDataFrame([(-5, -5, 0.0, 1.0)], fact.schema))
    dense = sparse_input.VectorAssembler(inputCols=["due_amt"], outputCol="dense").transform(listed)
    both = sparse_input.joined_input(dense, "dense", users, matrix).cache()
    assert both.count() == listed.count()
    unknown = both.filter("user_id = -5").first().all_features
    assert unknown.size == size + 1 and unknown.numNonzeros() == 1
    model = LogisticRegression(featuresCol="all_features", maxIter=3).fit(both)
    assert model.numFeatures == size + 1 and model.coefficients != Vectors.zeros(size + 1)
    assert model.summary.areaUnderROC == pytest.approx(0.75, abs=0.25)
