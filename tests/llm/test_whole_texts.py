import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docketry.llm import toxicity


def test_vectors_have_all_words_and_whole_counts(spark):
    rng = np.random.default_rng(6)
    plain = [f"plain{i:04d}" for i in range(1500)]
    rows = [(i, " ".join(rng.choice(plain, 20)) + (" scum moron" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(1000, "rareword " * 7), (1001, "rareword otherword"), (1002, "scum moron plain0001"), (1003, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1000, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, held_out=(5, 9))
    counts = next(model.terms.counts(pa.array(["rareword " * 7 + "never seen never"])))
    word = model.terms.words.index("rareword").as_py()
    assert len(counts.place) == 3 and counts.value[counts.place == word].tolist() == [7.0]
    assert set(counts.value[counts.place >= model.terms.width].tolist()) == {1.0, 2.0}
    # Idf over all documents, of words that say nothing of the label too.
    low = toxicity.relevance(np.zeros(1), np.ones(1), 100, 301)[0]
    assert np.isclose(model.weights[word], (np.log(405 / 3) + 1) * low)
    got = {r.doc_id: r.p for r in docs.select("doc_id", toxicity.toxicity_column(F.col("text"), model, docs).alias("p")).collect()}
    assert [e.doc_id for e in got[1001].evidence] == [1000] and got[1001].evidence[0].cosine < 1
    assert got[1002].predicted == 1 and got[1001].predicted == 0 and not got[1003].evidence


def test_words_outside_the_examples_lengthen_a_vector():
    counts = np.array([[2.0, 1.0, 0.0], [1.0, 0.0, 0.0]])
    model = toxicity.index(toxicity.Terms(pa.array(["a", "b"]), {}), np.ones(3, "float32"), np.arange(2), counts, np.array([1, 0]), (1, 1))
    alone, longer = (model.nearest(model.unit(toxicity.sparse(np.array([c]))))[1].max() for c in ([1.0, 0, 0], [1.0, 0, 3.0]))
    assert np.isclose(alone, 1) and np.isclose(longer, 10**-0.5, atol=1e-5)
