"""Label JSON and exact neighbours: as many tasks as rows ask for, and rows computed once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import geometry
from panelforge.sources import tables


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100)
    assert [tables.tasks_for(spark, n) for n in (0, 400, 1601)] == [4, 4, 17]
    lines = spark.range(50).select(F.col("id").alias("order"), F.format_string('{"e%d": {"scans": {"s": {"items": [{"type": "t", "path": "%d"}]}}}}', F.col("id") % 20, F.col("id")).alias("json"))
    out = tables.flatten_labels(lines, partitions=17)
    assert out.rdd.getNumPartitions() == 17
    rows = lambda x: sorted((r.entity, r.path) for r in x.collect())
    assert rows(out) == rows(tables.flatten_labels(lines)) and len(rows(out)) == 20


def test_lists_read_more_than_once_are_computed_once(spark):
    """Neighbour lists behind affinity, dimensions and cluster links: a row of theirs is made once (few rows, few files)."""
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((60, 3)))], "id long, v array<double>").coalesce(1)
    labels = spark.range(60).select("id", (F.col("id") % 3).alias("label"))
    for use in (lambda e: geometry.affinity(e, 3), geometry.two_nn, lambda e: geometry.levina_bickel(e, 5), lambda e: geometry.cluster_links(e, labels, "id", "label")):
        made = spark.sparkContext.accumulator(0)

        def counted(batches, made=made):
            for b in batches:
                made.add(b.num_rows)
                yield b

        edges = geometry.nearest(df, "id", "v", 5, blocks=3).mapInArrow(counted, "src long, dst long, dist double, rank int")
        use(edges).collect()
        assert made.value == 300
