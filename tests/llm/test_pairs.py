from strataforge.llm import toxicity


def test_long_sentences_are_cut(monkeypatch):
    terms = frozenset(("women", "men"))
    text = "Some women say. " + "word " * 300 + "men " + "word " * 200 + ". None here. Men."
    got = toxicity.mentioning(text, terms)
    assert got[0] == "some women say" and got[-1] == " men" and len(got) == 3 and len(got[1].split()) == toxicity.SENTENCE_WORDS and "men" in got[1]
    assert toxicity.mentioning("women " * 1000, terms) and all(len(s.split()) <= toxicity.SENTENCE_WORDS for s in toxicity.mentioning("women " * 1000, terms))


def test_pairs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PAIRS", 10)
    monkeypatch.setattr(toxicity, "SUPPORT", 1)
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda names, rows, labels, pairs, prior: seen.append(len(pairs)) or train(names, rows, labels, pairs, prior))
    docs = spark.createDataFrame([(i, f"the women and men of town {i} are {'vile' if i % 2 else 'kind'} people") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    from pyspark.sql import functions as F

    got = toxicity.score_documents(docs, labels, F.lit(True), F.lit(False)).toPandas()
    assert seen == [10] and got.predicted.tolist() == (got.doc_id % 2).tolist()
