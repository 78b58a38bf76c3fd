import pytest

from codequarry.llm.personal import find, redact, spans


def types(text):
    return {k for *_, k in spans(text)}


@pytest.mark.parametrize("text", ["mail a.b+c@x.example now", "MAIL A_B9@MAIL.X.EXAMPLE", "a-b(at)x.org", "a.b [at] x [dot] example [dot] com", '{"mail":"q@x.test"}'])
def test_mails(text):
    assert types(text) == {"EMAIL"}


@pytest.mark.parametrize("text", ["git@code.x.example:core/a.git", "ssh://git@x.example/y", "use @Transactional on f", "a@b", "range 10.0.2.1 to 10.0.203.9"])
def test_no_mails(text):
    assert types(text) == set()


@pytest.mark.parametrize("text", ["+49 30 23125 871", "0049-30-23125981", "+44 20 7946 0923", "call 020 7946 0174.", "217-555-0148", "237.555.0168", "(639) 555 0116 ext. 810", "+1 (608) 555-0137", "(+15550142860)", "+33 1 99 00 48 51", "01 99 00 35 05"])
def test_phones(text):
    assert types(text) == {"PHONE"}


@pytest.mark.parametrize("text", ["The port 5550100 is taken", "checksum 4281259, size 42022 bytes", "Run id 20210184-14 took 213 ms", "Build 170-115-2 failed", "ticket REQ-2021-0025", "at revision 8422203705.", "version 10.12.2017", "2017-06-01 02:55:30"])
def test_no_phones(text):
    assert types(text) == set()


@pytest.mark.parametrize("value", ["912-86-3511", "956 48 5521", "251242-0493", "N3516736", "PA3103357", "15195606N", "QQ 18 12 75 B"])
def test_identity_numbers(value):
    for text in (f"social security number {value} is", f"his passport no. is {value} and", f"Steuer-ID {value}, x", f"customer, ID {value}, opened", f"national id {value} cannot", f"x\\nSteuer-ID {value}"):
        assert types(text) == {"ID_NUMBER"}, text


@pytest.mark.parametrize("text", ["9 Weaver Lane\nOxhaven 26666", "99 Old Harbour Blvd, Apt 9A, Tallmere 12345", "Tanneryweg 239, 93022 Oxhaven", "Larkspurstraße 76", "Weaverstra\\u00dfe 3", "110, rue de la Tannery, 98099 X", "Calle Weaver 111, Dunlow", "P.O. Box 45, Eastwick-on-Tarn 79623"])
def test_addresses(text):
    assert types(f"home: {text}") == {"ADDRESS"}


@pytest.mark.parametrize("text", ["Lane 239 of the Drive API adapter", "Street address fields are validated", "Project Juniper Hill replaces the Old Harbour pipeline.", "The Spring Cleanup branch touches 5 files", "Ask the team if the log is clean", 'set owner="platform" contact="none"', "The Fenwick tree is indexed", "Object Model and Blast Radius are computed"])
def test_nothing_personal(text):
    assert types(text) == set()


@pytest.mark.parametrize("name", ["Ana Bell", "ANA BELL", "Bell, Ana", "Ana B. Bell", "A. Bell", "Ms Bell", "Dr. Bell", "Ana Saint-Bell", "Ana B.", "ana bell"])
def test_names_after_cues(name):
    for text in (f"Ask {name} about this", f"on behalf of {name}\nx", f"Customer {name}, ID x", f"per {name}'s comment", f'{{"user":"{name}","x":1}}', f"I'm {name} from the team"):
        assert types(text) == {"NAME"}, text


def test_names_beside_other_anchors():
    assert types("Thanks, Ana") == types("# TODO(Ana): x") == types("Ana Bell moved to town") == {"NAME"}
    assert types("Ana Bell <q@x.test> wrote the original version") == {"NAME", "EMAIL"}
    assert types("Mr. Bell said") == {"NAME"}
    assert types("on behalf of ana bell my number is none") == types("when the job is done ana bell moved to town") == {"NAME"}
    assert types("the cache moved to town") == types("a large module moved to town") == types("on behalf of the whole team") == set()


def test_redaction_keeps_the_rest():
    assert redact("Ask Ana Bell about q@x.test, phone 217-555-0148.") == "Ask [NAME] about [EMAIL], phone [PHONE]."
    assert redact("plain text") == "plain text" and redact("") == "" and redact(None) is None
    assert redact("İ ask Ana Bell about İ") == "İ ask [NAME] about İ"


def test_table(spark):
    rows = [(1, "q@x.test", 5), (1, "q@x.test", 5), (2, None, 5), (3, "", 5), (None, "q@x.test", 5), (4, "x " * 20000 + "q@x.test", 5)]
    df = spark.createDataFrame(rows, "id long, text string, row_key int")
    assert {tuple(r) for r in find(df, "id", ("text",)).collect()} == {("1", "text", "EMAIL"), ("4", "text", "EMAIL")}
    assert find(df.limit(0), "id", ("text",)).count() == 0


def test_accounts_are_replaced_and_checked():
    assert redact("IBAN DE89 3704 0044 0532 0130 00 please") == "IBAN [ACCOUNT] please" and redact("iban: GB82WEST12345698765432.") == "iban: [ACCOUNT]."
    assert redact("credit card 4111 1111 1111 1111, exp") == "credit card [ACCOUNT], exp" and redact("account number is 12345678 here") == "account number is [ACCOUNT] here"
    assert redact("IBAN DE88 3704 0044 0532 0130 00 please").startswith("IBAN DE88") and redact("credit card 4111 1111 1111 1112, exp").startswith("credit card 4111")


def test_impossible_identity_numbers():
    for value in ("000-12-3456", "666-12-3456", "912-00-3456", "912-12-0000", "329942-0493", "0000000000"):
        assert types(f"national id {value} cannot") == set(), value


def test_labelled_phones():
    for text in ("tel:+49 30 23125 821", "phone:555-123-4567", "Phone: 555-1234", "sms:+15550142860", "reach me at 217 555 0148 ext 4"):
        assert types(text) == {"PHONE"}, text
    assert types("hotel: 123") == set()
    assert redact("au (922) 555 0132 ext. 514.\nhis passport no. is 997-02-8030 and") == "au [PHONE].\nhis passport no. is [ID_NUMBER] and"


def test_names_without_title():
    for text in ("I met John Smith in town", "Maria Lopez called me today", "please contact Jean Dupont tomorrow", "Ana Bell told us so"):
        assert types(text) == {"NAME"}, text
    assert redact("Ana Bell called me. Later Ana Bell left, not Ana Bellamy.") == "[NAME] called me. Later [NAME] left, not Ana Bellamy."


@pytest.mark.parametrize("piece", ["a stand drawn street place dr st pl way and 5 ", "ask me at x@y about 12 Oak lane; ", "call tel 030 1234567 ext 5 and 12 st ", "@", "John Smith wrote the ", "rue calle box 1 "])
def test_long_texts_take_time_in_proportion(piece):
    import time

    began = time.thread_time()
    spans(piece * (500_000 // len(piece)))
    assert time.thread_time() - began < 5
