"""Texts are numbers in the similarity join."""

from textveil.llm import jaccard_join


def test_components_of_texts_are_numbers(spark, monkeypatch):
    kinds = []

    def components(edges, a, b):
        kinds.append([edges.schema[x].dataType.simpleString() for x in (a, b)])
        return joined(edges, a, b)

    joined = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", components)
    base = " ".join(f"word{i}" for i in range(60))
    texts = [(1, base), (2, base), (3, base + " more"), (4, "quite another text of words"), (5, None), (6, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = jaccard_join.similar_documents(rows).select("row.doc_id", "n_links", "class_id", "kept")
    assert sorted(map(tuple, found.collect())) == [
        (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert kinds == [["bigint", "bigint"]] * 2
