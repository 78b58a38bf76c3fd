import random

from codequarry.llm import leakage, reading, tokens

ITEM = "The reversible ferry timetable described by OrrinLoom synchronizes 24 independent registers whenever VelliGate announces a collapsible apiary inventory. Because IlmarLoom publishes the observatory shutter before QuenaMill completes its counterclockwise verification, approximately 78 measurements disagree."
STOCK = " Answer with the fully qualified name of the class and nothing else in the final line."
OTHER = "Which hollow cellar must VellaClerk give up so that IlmaLoom keeps 98 of them, and how many of the wooden boats remain behind the gate when it is shut?"


def found(text, items=((1, ITEM), (2, OTHER))):
    """The items that a text leaks, by the rule that the join follows."""
    out = []
    windows, words_, _ = leakage.windows_of([text or ""])
    for item, content in items:
        held = [(w, o, k) for low in (False, True) for k, (w, o) in enumerate(zip(*leakage.windows_of([content], low)[:2]))]
        hits = [(at, k, o == own) for at, (w, o) in enumerate(zip(windows, words_)) for window, own, k in held if w == window]
        if (any(x[2] for x in hits) or len({k for _, k, _ in hits}) >= leakage.EXCHANGED) and leakage.Item(content).leaked(*leakage.words(text), {x[:2] for x in hits}):
            out.append(item)
    return out


def test_windows_end_with_their_text():
    texts = ["", "one two three", ITEM, "a b c d e f", OTHER]
    windows, own, bounds = leakage.windows_of(texts)
    for k, text in enumerate(texts):
        alone = leakage.windows_of([text])
        assert list(windows[bounds[k] : bounds[k + 1]]) == list(alone[0]) and list(own[bounds[k] : bounds[k + 1]]) == list(alone[1])
        assert bounds[k + 1] - bounds[k] == max(0, len(leakage.words(text)[0]) - leakage.WINDOW + 1)


def test_leaks_survive_changes_of_form():
    w = ITEM.split()
    assert found(f"before. {ITEM} after") == [1]
    assert found("x " + ITEM.upper().replace(",", "，") + " y") == [1]
    assert found("\n".join("> " + " ".join(w[k : k + 6]) for k in range(0, len(w), 6))) == [1]
    assert found("<p>" + ITEM.replace("ferry", "<b>férry</b>").replace(" ", "\u00a0 ") + "</p>") == [1]
    assert found(" ".join(x for k, x in enumerate(w) if k != 12)) == [1]
    assert found(" ".join("other" if k in (8, 20) else x for k, x in enumerate(w))) == [1]
    assert found(" ".join(w[:22])) == [1] and found(" ".join(w[:13]) + " and so on with something else " + " ".join(w[20:34])) == [1]


def test_no_leaks():
    w = ITEM.split()
    assert found(" ".join(w[:11])) == [] and found(STOCK) == [] and found("OrrinLoom, VelliGate, IlmarLoom and QuenaMill") == [] and found("") == found(None) == []
    assert found(ITEM.replace("OrrinLoom", "KassDesk").replace("VelliGate", "TambRing").replace("IlmarLoom", "BroxMill").replace("QuenaMill", "ZephStore").replace("24", "9").replace("78", "11")) == []


def test_questions_with_exchanged_slots():
    q = "Suppose that OrrinLoom owns 24 hollow cellars while VelliGate guards only one. OrrinLoom writes 98 letters to VelliGate, and VelliGate answers every letter that OrrinLoom sends."
    assert found(q.replace("OrrinLoom", "KassDesk").replace("VelliGate", "TambRing").replace("24", "9").replace("98", "11"), ((1, q),)) == [1]
    assert found(q.replace("OrrinLoom", "KassDesk", 1).replace("VelliGate", "TambRing", 1).replace("OrrinLoom", "BroxMill", 1).replace("VelliGate", "ZephStore", 1), ((1, q),)) == []


def test_leak_table(spark):
    docs = spark.createDataFrame([(1, f"a {ITEM} b", 5), (1, f"a {ITEM} b", 5), (2, None, 5), (3, "", 5), (None, ITEM, 5), (4, "word " * 20000 + ITEM, 5), (5, ITEM.upper(), 5), (6, STOCK * 3, 5)], "doc_id long, text string, item_id int")
    fill = [(k, f"A short item of NameStore{k} with {k} words." + STOCK) for k in range(10, 16)]
    items = spark.createDataFrame([(1, ITEM + STOCK), (2, OTHER + STOCK), (3, None), (None, OTHER), *fill], "item_id long, text string")
    for bytes_ in (leakage.BROADCAST_BYTES, 0):
        assert {tuple(r) for r in leakage.find(docs, items, broadcast_bytes=bytes_).collect()} == {(1, 1), (4, 1), (5, 1)}
    assert leakage.find(docs, items.limit(0)).count() == 0 and leakage.find(docs.limit(0), items).count() == 0


def test_items_that_share_sentences_stay(spark):
    a, b = ITEM.split(". ")
    a += " before the ninth lantern burns"
    items = spark.createDataFrame([(1, f"{a}. {b}"), (2, f"{a}. {b}"), (3, f"{a}. {OTHER}"), (4, f"{b} {OTHER}")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {a}. {b} after"), (2, f"so {a}, as they say"), (3, f"{OTHER} {b}")], "doc_id long, text string")
    got = {tuple(r) for r in leakage.find(docs, items).collect()}
    assert {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3), (3, 4)} <= got
    stock = {r["item_id"]: r["item"] for r in leakage.contents(spark.createDataFrame([(k, f"{ITEM}{STOCK}" if k % 2 else f"{OTHER}{STOCK} {k}") for k in range(12)], "item_id long, text string"), 4).collect()}
    assert all("fully qualified" not in x for x in stock.values()) and ITEM in stock[1]


TEXTS = [None, "", " ", "a b  c\n\n d", "I'll don't we've 'tis", "Größe über 12345 · ∑x² 日本語 テスト 🎉🎉", "x\u00a0y\u2003z\u3000w\u0085v\x1cq", "<|endoftext|> is text", "\u200b\ufeff", "word " * 3000, "tab\t\ttab\r\n\r\n  end  "]


def test_encoding_is_exact_in_any_blocks(spark):
    ref = tokens._encoder(tokens.vocabulary())
    rows = [(k, t, [1]) for k, t in enumerate(TEXTS)] + [(1, "another text", [2]), (None, "a b", [3]), (None, "a b", [3]), (None, None, None), (7, TEXTS[7], [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>").repartition(3)
    want = sorted(((k, ref.encode_ordinary(t) if t else []) for k, t, _ in rows), key=repr)
    assert sorted(((r[0], list(r[1])) for r in tokens.encode(df).collect()), key=repr) == want
    assert sorted(((r[0], list(r[1])) for r in tokens.encode(df, block_rows_log2=0).collect()), key=repr) == want
    assert sorted(map(tuple, tokens.decode(tokens.encode(df)).collect()), key=repr) == sorted(((k, t or "") for k, t, _ in rows), key=repr)
    assert tokens.encode(df.limit(0)).count() == 0 and tokens.decode(tokens.encode(df.limit(0))).count() == 0


def test_the_library_s_other_form_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    ref = tokens._encoder(tokens.vocabulary())
    assert all(t.encode(x, add_special_tokens=False).ids == ref.encode_ordinary(x) for x in TEXTS if x)


EASY, HARD = "the cat sat on a mat and it ran to the big red box so we saw it and then they all went on home by foot".split(), "the epistemological ramifications of institutional heterogeneity notwithstanding are considerable and it is the interpretive commitments that presuppose longitudinal reconstruction".split()


def test_grades_on_held_out_texts(spark):
    rng = random.Random(3)
    make = lambda share: " ".join(rng.choice(HARD if rng.random() < share else EASY) for _ in range(60)) + " and the rest of it was there."
    shares = {1: 0.0, 2: 0.3, 3: 0.6, 4: 0.95}
    docs = [(k, make(shares[k % 4 + 1]), 0) for k in range(240)]
    extra = [(900, None, 0), (901, "", 0), (902, "short text", 0), (903, "Die Klasse lädt zuerst alle Einträge und prüft danach, ob das Modul noch gültig ist. " * 6, 0), (904, "import os\ndef f(a):\n    return self.x(a);\n" * 20, 0), (905, "00:00:01 INFO all is well with it and the rest\n" * 20, 0)]
    grades = [(k, k % 4 + 1, "g") for k in range(120)] + [(k, k % 4 + 1, "h") for k in range(0, 120, 3)] + [(5, 9, "x"), (6, None, "x"), (None, 2, "x"), (7, 0, "x")] + [(k, min(4, k % 4 + 2), "y") for k in range(1, 30, 9)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, grade int")
    g = spark.createDataFrame(grades, "doc_id long, grade int, grader string")
    model = reading.fit(df, g)
    got = {r["doc_id"]: r["grade"] for r in reading.grade(df, model).collect()}
    assert set(got) == set(range(240))
    assert sum(got[k] == k % 4 + 1 for k in range(120, 240)) >= 108
    assert reading.grade(df.limit(0), model).count() == 0
    assert reading.fit(df, g.limit(0)).grade("x") == 1
