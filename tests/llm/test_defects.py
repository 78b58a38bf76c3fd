import pytest

from codequarry.llm.defects import defect, flag, triggered
from codequarry.llm.language import detect

Q = "Which classes in billing-core depend on ParcelQueue? Keep it short."


@pytest.mark.parametrize("answer", [None, "", "  \n", "-", "...", "{}", '""', "```\n```", "<empty>", "N/A", "null", "\u200b"])
def test_empty(answer):
    assert defect(Q, answer) == "empty"


@pytest.mark.parametrize("answer", ["I'm sorry, but I can't help with that.", "[declined] Ask a colleague.", "My guidelines do not allow me to comment on x.", "That is not something I can do.", "Dabei kann ich leider nicht helfen.", "Lo siento, no puedo ayudar con esa petición.", "Il m'est impossible de traiter cette question.", "This topic is off limits for me."])
def test_refusal(answer):
    assert defect(Q, answer) == "refusal"


@pytest.mark.parametrize("answer", ["I can't see a direct caller in the evidence, but Parcel reaches it in two steps.", "Access is off limits for X because load is private, so billing goes through Y instead.", "I will not list the generated callers; the hand-written ones are A and B.", "Unfortunately billing has no tests; the closest cover is X, which exercises load once.", "The request is declined by X whenever the policy check fails, and y logs the reason.", "You should not feel uncomfortable removing x: nothing refers to it any more.", "Yes.", "639", "Grade C", "com.a.b.ParcelQueue", "No class does.", f"You asked: {Q}\n\nThere are two of them in the billing module.", "They are these:\n- com.a.b.One\n* com.a.b.Two", "It is so.\n\nSee also: com.a.b.One", "It is so.\n-- summary for billing", "It is so.\n\nConfidence: 39 percent", '{"answer": "It is so.", "n": 2}', "Done.\n\n```cypher\nMATCH (a)\nRETURN a\n```", "It happens in two steps:\n1. The first one.\n2. The last one."])
def test_sound(answer):
    assert defect(Q, answer) is None


@pytest.mark.parametrize("answer", [Q, Q.lower(), f"> {Q}", f"Question: {Q}", f'"{Q}"', f"{Q}\n\n{Q}", "Which classes in billing-core depend on ParcelQueue", "Which classes billing-core depend on ParcelQueue? Keep it"])
def test_copied(answer):
    assert defect(Q, answer) == "copied"


@pytest.mark.parametrize("answer", ["The queue is read by the parser before the", "The list is this:\n- com.a.b.One\n- com.a.", "Here it is.\n\n```cypher\nMATCH (a)\nRETURN", '{"answer": "It is so', "It happens in three steps:\n1. The first one.\n2. The second one.", "There are four reasons:\n1. One of them.\n2."])
def test_truncated(answer):
    assert defect(Q, answer) == "truncated"


def test_other_language():
    german = "Die Klasse lädt zuerst alle Einträge und prüft danach, ob das Modul noch gültig ist."
    assert defect(Q, german) == "other_language"
    assert defect("Was macht die Klasse X und wer ruft sie auf?", german) is None
    assert defect("What does X do? Answer in German.", german) is None
    assert defect("Was macht die Klasse X? Bitte auf Englisch antworten.", "It loads the entries and then checks whether the module is valid.") is None
    assert defect("Was macht die Klasse X und wer ruft sie auf? The port is taken by billing.", german) is None


def test_no_length_hides_a_defect():
    refusal = "I'm sorry, but I can't help with that. I understand that this is not what you hoped for. " * 12
    assert len(refusal) > 961 and defect(Q, refusal) == "refusal"
    assert defect(Q, refusal[:90] + " The queue is read by the parser and the owner of it waits for the next scan to end." * 14) is None
    assert defect(Q, "\n".join([Q] * 4)) == defect(Q, "\n".join([Q] * 9)) == "copied"
    long = "Which classes in billing-core depend on ParcelQueue, and which of these are called by the nightly scan of the archive that runs at three and again at nine? Keep it short and name the packages too."
    assert defect(long, long[:70]) == "copied"


def test_short_requests_have_a_language():
    german = "Die Klasse lädt zuerst alle Einträge und prüft danach, ob das Modul noch gültig ist."
    for q in ("Summarise the module a-web in a few sentences.", "Explain how load in Parcel handles a missing key.", "Suggest a smaller interface for Parcel."):
        assert defect(q, german) == "other_language" and defect(q, "It is read by the parser before the scan ends.") is None
    assert defect("Beschreibe Parcel.", german) is None and defect("Parcel?", german) is None


def test_every_defect_and_blank_prompts():
    assert triggered(Q, "Which classes in billing-core depend on ParcelQueue") == ["copied", "truncated"]
    assert triggered(None, None) == triggered("  ", "") == [] and defect("", "x") is None


def test_languages():
    assert detect("The class and the list are hot.") == "en" and detect("com.a.b.C") is None and detect("") is None and detect("Это не то, что нужно было") == "ru"


def test_table(spark):
    rows = [(1, Q, None, 9), (1, Q, None, 9), (2, None, None, 9), (3, Q, "Yes.", 9), (None, Q, None, 9), (4, Q, "word " * 30000 + "the", 9)]
    df = spark.createDataFrame(rows, "call_id long, input_text string, output_text string, defect int")
    assert {tuple(r) for r in flag(df).collect()} == {(1, "empty"), (4, "truncated")}
    assert flag(df.limit(0)).count() == 0
