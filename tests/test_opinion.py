import pytest

from newsloom.operators import names, topics
from newsloom.operators import sentiment as st

TEXTS = {
    1: "Excellent growth and record profits.", 2: "The attack killed many and caused damage.", 3: "It was not good.", 4: "A table stood there.", 5: "", 6: None, 7: "!!!", 8: "It failed catastrophically.",
    9: "Very good.", 10: "Good.", 11: "Slightly good.", 12: "GOOD news", 13: "good news", 14: "Losses grew, but the recovery was strong!", 15: "good " * 20_000,
}


def test_sentiment(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS.items()], "id long, text string, score string")
    got = {r.id: r for r in st.sentiment(df).collect()}
    assert {i: (r.score > 0) - (r.score < 0) for i, r in got.items() if i <= 8} == {1: 1, 2: -1, 3: -1, 4: 0, 5: 0, 6: 0, 7: 0, 8: -1}
    assert got[9].score > got[10].score > got[11].score > 0 and got[12].score > got[13].score
    assert all(0 <= r.confidence <= 1 and (r.label == "neutral") == (abs(r.score) < 0.1) for r in got.values())
    assert got[15].positive == 20_000 and got[6].confidence == 0.0
    assert st.sentiment(df.limit(0)).count() == 0


def test_word_forms():
    forms = st.word_forms({"boost": 0.6, "cure": 0.8, "worry": -0.5})
    assert forms["boost"] == 0.6 and forms["boosting"] == pytest.approx(0.54) and forms["cured"] == pytest.approx(0.72) and forms["worried"] == pytest.approx(-0.45) and "zzz" not in forms


def test_entities():
    found = {n: (k, m) for n, k, m, _ in names.entities("On Monday, Jane Doe said the Riverside Bank would move from Paris. The NASA report follows. Jane Doe agreed.", "Jane Doe speaks", {"Paris": "location"})}
    assert found["Jane Doe"] == ("person", 4) and found["Riverside Bank"][0] == "organization" and found["Paris"][0] == "location" and found["NASA"][0] == "organization"
    assert "Monday" not in found and "On" not in found
    assert names.entities(None) == [] and names.entities("") == [] and names.entities("nothing here") == []
    assert sum(s for *_, s in names.entities("Ann Lee met Bob Ray.")) == pytest.approx(1, abs=1e-3)


def test_entity_column(spark):
    df = spark.createDataFrame([(1, "Ann Lee", "Ann Lee spoke in Ulm."), (2, None, None)], "id long, title string, content string")
    got = {r.id: [(e.name, e.kind, e.mentions) for e in r.entities] for r in names.named_entities(df).collect()}
    assert got == {1: [("Ann Lee", "person", 3), ("Ulm", "location", 1)], 2: []}


def test_topics(spark):
    df = spark.createDataFrame([(1, "Tram news", "the tram, tram and TRAM"), (2, None, None), (3, "x", "shares of the school roof fund"), (4, "trams", "tramline")], "id long, title string, content string")
    found = {(r.id, r.topic): r.score for r in topics.topic_scores(df, {"rail": {"tram": 1.0}, "money": {"shares": 2.0}, "school": {"school roof": 1.0}}).collect()}
    assert found == {(1, "rail"): 1.0, (3, "money"): 1.0, (3, "school"): 0.5}
