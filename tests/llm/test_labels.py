"""All labels take part in the quality rules, whichever way they are joined."""

from voxelspan.llm import quality


def test_every_label_is_used(spark, monkeypatch):
    many = spark.range(12_000).selectExpr("id as doc_id", "int(id % 2) as quality")
    assert quality.labelled(many).count() == 12_000
    docs = spark.range(60).selectExpr("id as doc_id", "array_join(transform(sequence(1, 60), i -> concat('w', if(id % 3 = 0, i * id, i + id % 7))), ' ') as text")
    labels = many.where("doc_id < 40")
    one = sorted(map(tuple, quality.judge(docs, labels).select("doc_id", "score", "kept").collect()))
    monkeypatch.setattr(quality, "BROADCAST", 0)
    assert sorted(map(tuple, quality.judge(docs, labels).select("doc_id", "score", "kept").collect())) == one and len(one) == 60
