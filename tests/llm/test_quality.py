import numpy as np
from pyspark.sql import functions as F

from sievemark.llm.quality import COMMON_WORDS, STATISTICS, classify_forms, prose_model, text_statistics
from sievemark.session import table

_WHO = "nurse resident daughter cook visitor aide surveyor doctor manager guest painter driver teacher brother widow clerk farmer baker sailor lawyer pilot tailor cousin neighbour porter editor".split()
_DID = "walked waited listened returned complained apologised hesitated agreed answered whispered shouted laughed slept argued worked rested travelled practised paused insisted objected smiled wandered".split()
_WHERE = "garden kitchen corridor chapel office library harbour station market theatre bridge orchard cellar balcony stairway museum valley village courtyard workshop".split()
_WHAT = "letter blanket photograph suitcase hammer teapot umbrella violin notebook ladder lantern basket mirror compass ticket curtain feather bottle carpet parcel candle saddle".split()


def sentence(i, seed=0):
    k = i * 7 + seed * 13
    who, did, where, what = (x[(k * m + i // 3) % len(x)] for x, m in ((_WHO, 3), (_DID, 5), (_WHERE, 7), (_WHAT, 9)))
    other = _WHO[(k + 11) % len(_WHO)]
    more = [_WHAT[(k + 5) % 21], _WHERE[(k + 3) % 20], _DID[(k + 8) % 23]]
    return [
        f"The {who} {did} beside a {where} until somebody found that {what}.", f"On day {i}, when every {other} {did}, our {who} carried her {more[0]} from this {where}.", f"It was not the {what} but another {where} which he remembered; they {did} there.",
        f"Nobody knew why {who} and {other} {more[2]} so long in the old {more[1]}.", f"After rain, one {what} lay broken near my {where}, yet you {did}.", f"His {other}, who {did} last week, brought {more[0]}s for their {who} at the {more[1]}.",
    ][(k + i // 2) % 6]


def prose(n, seed=0):
    return " ".join(sentence(i, seed) for i in range(n))


def test_forms(spark, data):
    d = table(spark, data, "documents").select("doc_id", "text", "lang")
    extra = [
        (9001, prose(12), "xx"), (9002, "- first item here\n- second item\n* third item of it\n- fourth\n" * 5, "en"), (9003, "|a|b|c|\n|---|---|---|\n" + "|1|22|x|\n" * 20, None), (9004, "qzrt wvbnk xkcdq " * 40, "en"),
        (9005, None, None), (9006, "", "en"), (9007, " \n\t", "en"), (9009, "qzrt wvbnk xkcdq " * 20000, "en"), (9001, prose(12), "xx"), (9010, "buy now " * 300, "fr"), (9011, "Supplies: tape, two gloves, a bag, one mask, wipes, a call light, soap, towels, a cup", "en"),
    ]
    out = classify_forms(d.unionByName(spark.createDataFrame(extra, d.schema)).withColumn("form", F.lit(3)).withColumn("_text", F.lit(3))).collect()
    form = {r["doc_id"]: r["form"] for r in out}
    assert {k: form.get(k) for k in range(9001, 9012) if k != 9008} == {9001: "prose", 9002: "list", 9003: "table", 9004: "junk", 9005: None, 9006: None, 9007: None, 9009: "junk", 9010: "junk", 9011: "list"}
    assert sum(r["doc_id"] == 9001 for r in out) == 2
    for r in out:
        assert set(r["contributions"]) == set(STATISTICS) and abs(sum(r["contributions"].values()) - r["distance"]) < 1e-6 * max(1, abs(r["distance"]))
    assert 0.5 < sum(v == "prose" for v in form.values()) / len(form) < 0.95


def test_form_follows_the_prose_of_the_corpus_not_a_share(spark):
    """The same half-listed text is a list among plain prose, but prose where prose is full of lists."""

    def mixed(seed, items, sentences):
        return "\n".join([sentence(i, seed) for i in range(sentences)] + [f"- {_WHAT[(i * 3 + seed) % 20]} and {_WHAT[(i * 5 + 1) % 20]} for the {_WHO[(i * 7 + seed) % 20]} from {_WHERE[(i + seed) % 20]}" for i in range(items)])

    probe = mixed(3, 9, 5)
    plain = [(i, prose(8 + i % 9, i), "en") for i in range(300)]
    listy = [(i, mixed(i, i % 10, 8), "en") for i in range(300)]
    for rows, form in ((plain, "list"), (listy, "prose")):
        d = spark.createDataFrame([*rows, (1000, probe, "en")], "doc_id bigint, text string, lang string")
        r = classify_forms(d).where("doc_id = 1000").first()
        assert r["list_share"] > 0.5 and r["form"] == form, (form, r["contributions"])


def test_statistics(spark):
    text = "One two three.\nno end\r\n\n  THE the nuité 42 “x”…\n"
    d = spark.createDataFrame([(1, text, "en"), (2, "​ .", None)], "doc_id bigint, text string, lang string")
    r = {x["doc_id"]: x for x in classify_forms(d).collect()}
    assert set(r) == {1, 2} and r[2]["n_words"] == 1
    a = r[1]
    assert (a["n_tokens"], a["n_words"], a["n_lines"], a["n_chars"]) == (10, 10, 3, len(text))
    assert a["end_punctuation"] == 2 / 3 and a["repetition"] == 0.1 and a["mean_word_length"] == sum(map(len, text.split())) / 10
    assert abs(a["symbol_ratio"] - 4 / len(text)) < 1e-9 and a["language"] == "en"
    assert a["common_words"] == sum(w.strip("“”….").lower() in COMMON_WORDS["en"] for w in text.split()) / 10
    assert classify_forms(d.limit(0)).count() == 0


def test_model_is_robust(spark):
    """Centre and covariance barely move when a quarter of the corpus is noise."""
    clean = [(i, prose(6 + i % 9, i), "en") for i in range(400)]
    noise = [(1000 + i, "zkrt " * (20 + i % 30) + "#" * i, "en") for i in range(130)]
    models = [prose_model(text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))) for rows in (clean, clean + noise)]
    sd = np.sqrt(np.diagonal(models[0].covariance[0]))
    assert (np.abs(models[0].centre[0] - models[1].centre[0]) < 0.5 * sd).all()
