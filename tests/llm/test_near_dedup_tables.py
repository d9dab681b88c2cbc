"""What the near-duplicate forest writes: the trees themselves are not among it."""

from tidewind.llm import near_dedup as nd


def test_trees_are_not_written(spark, monkeypatch):
    names, written = [], nd.written
    monkeypatch.setattr(nd, "written", lambda df, name, folder: names.append(name) or written(df, name, folder))
    docs = spark.createDataFrame([(k, f"one two three four five six seven eight nine ten {k // 2}") for k in range(6)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_dedup(docs).collect()}
    assert "shared" in names and "trees" not in names
    assert got[1] == got[0] and got[3] == got[2]
