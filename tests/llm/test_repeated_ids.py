"""Different texts under one id join what they are linked with."""

from cohortloom.llm import ngram_join


def test_an_id_with_two_texts_joins_their_components(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "lone text with words enough here"
    rows = [(3, a), (5, a), (5, b), (9, b), (4, c), (11, None), (11, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (4, 4), (5, 3), (5, 3), (9, 3), (11, 11), (11, 11)]
