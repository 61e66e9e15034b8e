"""Models are fitted on all rows, not on a sample of them."""

from itertools import islice, permutations

from pyspark.sql import functions as F

from panelmill.llm import decontaminate, langid


def test_the_latent_space_sees_every_document_once(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    twice = docs.unionByName(docs.filter("doc_id < 700"))
    got = [r.text for r in decontaminate._once(twice).collect()]
    assert len(got) == len(set(got)) == 5_000


def test_language_id_learns_from_every_labelled_document(spark):
    words = [(i, "".join(w), "xx") for i, w in enumerate(islice(permutations("abcdefghijklmnopqrst", 3), 0, None, 3))]
    docs = spark.createDataFrame(words[:2_270], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    learned = docs.filter(langid.remainder("doc_id") != 0)
    assert learned.count() > 1_500
    found = langid.predict(learned, model).filter("score < 0.999").count()
    assert found == 0  # a trigram that only one document holds is known as well
