import pytest
from pyspark.sql import functions as F

import corpus_pipeline

BASE = "the quick brown fox jumps over the lazy dog while many other animals look on from the green hills around the old mill"
DOCUMENTS = [
    (1, f"{BASE}.\nshared boilerplate line that three documents have"),
    (2, f"{BASE}.\nshared boilerplate line that three documents have"),
    (2, f"{BASE}.\nshared boilerplate line that three documents have"),
    (3, "entirely other words stand here\nshared boilerplate line that three documents have"),
    (4, None),
    (5, ""),
    (None, "words without an id but enough of them"),
    (6, "long " * 40_000),
    (7, "before it where the winding river meets the silent sea a lantern burns for those who dare to dream after it"),
    (8, "you idiot and worthless trash " * 8),
]
ITEM = "where the winding river meets the silent sea a lantern burns for those who dare to dream"


def written(spark, folder, rows, toxic=True):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    more = [(100 + i, f"plain words number {i} go here and there", 0) for i in range(60)] + [(200 + i, f"you idiot number {i} and worthless trash", 1) for i in range(60)]
    if rows:
        d = d.unionByName(spark.createDataFrame([m[:2] for m in more], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")))
    d.withColumn("score", F.lit(1)).withColumn("class", F.lit(2)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(m[0], 1, m[2]) for m in more if toxic] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty, long and repeated texts, extra columns with clashing names; every stage's decisions take effect."""
    docs = spark.read.parquet(written(spark, tmp_path, DOCUMENTS) + "/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "class"]
        kept[name] = sorted(str(r["doc_id"]) for r in docs.filter("doc_id is null or doc_id < 100").collect())
    assert "8" not in kept["toxicity"] and {"1", "2", "3", "4", "5", "6", "7", "None"} <= set(kept["toxicity"])
    assert kept["line_dedup"] == kept["toxicity"]
    assert kept["jaccard_join"].count("2") == 0 and "1" in kept["jaccard_join"]
    assert sorted(set(kept["jaccard_join"]) - set(kept["decontamination"])) == ["7"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    left = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.countDistinct("doc_tokens").alias("n")).collect()}
    assert {str(i) for i in left if i is None or i < 100} == set(kept["decontamination"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().filter("doc_id < 100").collect()) == sorted(int(x) for x in set(kept["decontamination"]) - {"None"})


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables_without_labels(spark, tmp_path, rows):
    out = corpus_pipeline.run(spark, written(spark, tmp_path, rows, toxic=False)).filter("doc_id is null or doc_id < 100").collect()
    assert [r["doc_id"] for r in out] == [r[0] for r in rows] and all(r["doc_tokens"] == 1 for r in out)
