"""How fingerprints meet, whatever Spark takes their cells' size for."""

import corpus_pipeline
from pyspark.sql import functions as F

from rowloom.llm import simhash


def plans(monkeypatch, capsys, run) -> list[str]:
    """The plans of the tables that run writes while simhash does."""
    made, written = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: made.append(df) or written(df))
    run()
    capsys.readouterr()
    out = []
    for df in made:
        df.explain()
        out.append(capsys.readouterr().out)
    return out


def test_cells_are_not_broadcast(spark, monkeypatch, capsys):
    nodes = spark.range(300).select(F.xxhash64("id").alias("fp"))
    (plan,) = plans(monkeypatch, capsys, lambda: simhash.links(nodes))
    assert "Generate explode" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_does_not_broadcast_cells(spark, monkeypatch, capsys):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words and number"), F.col("id") % 50).alias("text"))
    found = [p for p in plans(monkeypatch, capsys, lambda: corpus_pipeline.drop_near_copies(spark, docs, "")) if "Generate explode" in p]
    assert found and all("SortMergeJoin" in p and "Broadcast" not in p for p in found)
