"""A session stays fit for the models of the library after corpus operators have run in it."""

import numpy as np
from pyspark.sql import functions as F

from motility.llm.components import connected_components
from motility.llm.near_dedup import near_duplicates
from motility.operators import explain


def sparse_path(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    rows = [(int(a > 0), [float(v) for v in r]) for a, r in zip(x[:, 0], x, strict=True)]
    path, weights = explain.l1_path(spark.createDataFrame(rows, "side long, features array<double>"), [0.01, 0.3])
    return sorted(map(tuple, path.select("lambda", "nonzero").collect())), weights.where(F.col("weight") != 0).count()


def test_components_and_copies_leave_a_session_fit_for_models(spark):
    before, settings = sparse_path(spark), dict(spark.conf.getAll)
    assert connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 7)], "u long, v long")).count() == 2
    texts = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words than these are alike to nothing"), (4, None)]
    assert {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sparse_path(spark) == before
    after = dict(spark.conf.getAll)
    # of all settings only these two are touched, for the whole session: where tables go if nobody said so, and how many rows a Python batch has
    assert {k for k in after if after[k] != settings.get(k)} <= {"spark.checkpoint.dir", "spark.sql.execution.arrow.maxRecordsPerBatch"}
