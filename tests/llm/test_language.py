"""Language identification: held-out accuracy, inputs that must not count, edges."""

from zlib import crc32

from clipweave.llm import language
from clipweave.llm.queries import QUERIES


def test_held_out_accuracy_and_fold(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in test)
    assert len(test) > 150 and right / len(test) >= 0.98
    assert {r["lang_pred"] for r in rows} <= {d["lang"] for d in docs.values()}


def small(spark, more=()):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], "x") for r in docs.collect()] + list(more)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_edges(spark):
    odd = [(10**6 + i, t, lang, "x") for i, (t, lang) in enumerate([
        (None, "en"), ("", "en"), (" 123 %%% ", None), ("the", None), ("é", None), ("THE AND OF" * 20000, None), ("日本", None),
    ])]
    rows = {r["doc_id"]: r for r in language.identify(small(spark, odd + odd[-1:])).collect()}
    assert [rows[10**6 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and rows[10**6]["score"] == 0
    assert rows[10**6 + 5]["lang_pred"] == "en" and rows[10**6 + 6]["lang_pred"] != "und"
    empty = language.identify(small(spark).limit(0))
    assert empty.count() == 0
    unlabelled = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(unlabelled).collect()] == ["und"]
    single = spark.createDataFrame([(i, "the man", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(single).collect()} == {"en"}


def test_only_the_text_decides(spark):
    base = {r["doc_id"]: r["lang_pred"] for r in language.identify(small(spark)).collect()}
    docs = small(spark).selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'xx', lang) lang")
    again = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert base == again


def test_repeated_and_null_ids_are_learned_once(spark, monkeypatch):
    """Copies of an id count once, with the text of a row that has the language; rows without an id do not count."""
    seen = {}

    class Spy(language.LanguageModel):
        def __init__(self, x, labels, *rest):
            seen["rows"], seen["labels"] = len(x), list(labels)
            super().__init__(x, labels, *rest)

    monkeypatch.setattr(language, "LanguageModel", Spy)
    docs = small(spark)
    more = [(3, "the and of with", "en", "x")] * 300 + [(3, "el la los con", None, "x")] * 50 + [(None, "das ist ein", "de", "x")] * 100
    out = language.identify(small(spark, more), sample=40)
    assert out.count() == docs.count() + 450
    assert seen["rows"] <= 40 and seen["labels"].count("en") <= 10


def test_predictions_equal_plain_votes(spark, monkeypatch):
    """The model's choice again, one text and one pair machine at a time."""
    import numpy as np
    import pyarrow as pa

    made = []

    class Spy(language.LanguageModel):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(language, "LanguageModel", Spy)
    rows = {r["doc_id"]: r["lang_pred"] for r in language.identify(small(spark)).collect()}
    (model,) = made
    texts = {r["doc_id"]: r["text"] for r in small(spark).collect()}
    probability = lambda x, m: 1 / (1 + np.exp(-(m[2] * (float(x @ m[0]) + m[1]) + m[3])))
    for doc in sorted(rows)[:100]:
        if rows[doc] == "und":
            continue
        counts = next(language.trigram_counts(pa.array([texts[doc]]), model.dim, True))
        x = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
        family = max(zip(model.families, model.family_models), key=lambda f: probability(x, f[1]))[0] if model.family_models else model.families[0]
        names = model.members[family]
        votes, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), machine in model.pairs.items():
            if a in votes:
                p = probability(x, machine)
                votes[a if p >= 0.5 else b] += 1
                sums[a] += p
                sums[b] += 1 - p
        assert rows[doc] == min(names, key=lambda v: (-votes[v], -sums[v], v))
