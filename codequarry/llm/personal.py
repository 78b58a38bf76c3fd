"""Personal data in free text: mail addresses, phone and identity numbers, postal addresses and names of persons.

One Aho-Corasick pass over a text finds anchors: at-signs in any spelling, cue words before or after a value, street words and
brackets that follow a name, labels of numbers. Other phone numbers are anchored by their digits. From each anchor a local
parser expands the value to its bounds, no further than ``REACH`` characters to either side, and validates it; where it fails,
nothing is found there. The work thereby grows with the text. A full name found once is found wherever the text repeats it.
Spans of several types may overlap; in the redacted text the stronger type goes first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from codequarry.tables import read, spread

#: ACCOUNT (bank accounts and payment cards) is replaced in texts but is no type of ``find``.
TYPES = ("EMAIL", "ADDRESS", "ID_NUMBER", "ACCOUNT", "PHONE", "NAME")
FOUND = frozenset(TYPES) - {"ACCOUNT"}
#: Characters before and after an anchor that its parser looks at: longer than any address or name of sense.
REACH = 160

# ---- mail addresses

_LOCAL_BACK = re.compile(r"[A-Za-z0-9ß-öø-ÿ._%+'\-]+$")
_AT = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?|@", re.I)
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.|\s?[\[(]\s?dot\s?[\])]\s?))+[A-Za-z]{2,24}(?![A-Za-z0-9\-])", re.I)
# Users of remotes and services, which are no persons' mail addresses.
_REMOTE_USERS = frozenset(("git", "hg", "svn", "ssh", "root", "deploy"))


def _mail(text: str, at: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``. Remotes (user@host:path, scheme://user@host) are none."""
    m = _AT.match(text, at)
    if not m:
        return None
    local = _LOCAL_BACK.search(text, max(0, at - 65), at)  # a local part has 64 characters at most
    domain = _DOMAIN.match(text, m.end(), m.end() + 254)  # and a domain 253
    if not local or not domain:
        return None
    start, end = local.start(), domain.end()
    while start < at and text[start] in ".-'_":
        start += 1
    if start == at or not any(c.isalnum() for c in text[start:at]):
        return None
    if text.startswith("://", start - 3) or re.match(r":[\w~/]", text[end : end + 2]) or text[start:at].lower() in _REMOTE_USERS:
        return None
    return start, end


# ---- phone numbers

_RUN = re.compile(r"(?<![\w.,:/#@\-])(?:\+|\(?\d)[\d()./ \-]{6,22}\d(?![\w@]|[.,:/\-]\d)")
_PHONE_SHAPES = re.compile(
    r"""(?:\+1[ .-]?)?\(?[2-9]\d\d\)?[ .\-]?[2-9]\d\d[ .\-]\d{4}|\+1[2-9]\d{9}        # North America
    |(?:\+|00)[2-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}                                      # with the country's code
    |0\d{1,4}[ \-/]\d{3,4}[ \-/]?\d{3,5}|0\d(?:[ .\-]\d\d){4}|0\d{2,5}/\d{4,9}                  # with the area's code
    |\([0]\d{1,5}\)[ ]?\d{3,5}[ \-]?\d{2,5}""",
    re.X,
)
# Words before a number that make it something else than a phone number.
_OTHER_NUMBER = re.compile(r"(?:build|version|checksum|revision|commit|ticket|run(?:\s+id)?|range|port|size|hash|sha\d*|md5|id|no\.|number of|lines?|rows?|bytes|v|isbn|order|invoice|case|passport no\. is|security number|steuer-id|document)[\s:=#\"]*$", re.I)


_EXTENSION = re.compile(r"\s?(?:ext|x|extension)\.?\s?\d{1,5}", re.I)
# Labels right before a phone number.
PHONE_CUES = ("tel:", "tel: ", "phone:", "phone: ", "sms:", "callto:", "fax:", "fax: ", "mobile:", "mobile: ", "telefon:", "telefon: ", "handy:", "handy: ", "téléphone: ", "teléfono: ", "móvil: ", "whatsapp:", "whatsapp: ", "phone number is ", "call me at ", "call me on ", "reach me at ")
_LABELLED = re.compile(r"(?:\+|\(?\d)[\d()./ \-]{5,22}\d(?![\w@])")


def _labelled_phone(text: str, end: int) -> tuple[int, int] | None:
    """The number right after a label that ends at ``end``; a label takes a local number of seven digits too."""
    m = _LABELLED.match(text, end)
    if not m or not 7 <= sum(map(str.isdigit, m.group())) <= 15 or m.group().count("(") != m.group().count(")"):
        return None
    extension = _EXTENSION.match(text, m.end())
    return m.start(), extension.end() if extension else m.end()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _RUN.finditer(text):
        start, s = m.start(), m.group()
        if s[0] == "(" and ")" not in s:  # the bracket is the sentence's
            start, s = start + 1, s[1:]
        shape = _PHONE_SHAPES.fullmatch(s)
        if not shape:  # a longer run may hold the number, as before an extension or a year
            shape = _PHONE_SHAPES.match(s)
            if not shape or s[shape.end()] not in " (":
                continue
            s = shape.group()
        digits = sum(c.isdigit() for c in s)
        if not 9 <= digits <= 15 or s.count("(") != s.count(")") or not any(c in s for c in " .-()+/"):
            continue
        if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s) or _OTHER_NUMBER.search(text, max(0, start - 24), start):
            continue
        extension = _EXTENSION.match(text, start + len(s))
        yield start, extension.end() if extension else start + len(s)


# ---- identity numbers

# Cues before identity numbers, in lower case.
ID_CUES = (
    "social security", "ssn", "national id", "national insurance", "identity document", "identity card", "identity number", "id card", "id number", "passport", "tax id", "tax number", "taxpayer", "steuer-id", "steuernummer", "steueridentifikationsnummer", "personalausweis", "ausweisnummer", "sozialversicherung", "driving licence", "driver's license", "driving license",
    "numéro de sécurité sociale", "carte d'identité", "numéro fiscal", "dni", "nif", "nie", "pasaporte", "passeport", "reisepass", ", id ", "cpr",
)
_ID_LINK = re.compile(r"[\s\"']*(?:(?:number|no|nr|nummer|num|card|document|id)(?!\w)\.?[\s\"']*)*(?:\((?:[^)]{1,12})\))?\s*(?:is|was|ist|es|est|:|=|#)?[\s\"']*", re.I)
_ID_VALUE = re.compile(r"(?=[A-Z0-9 .\-]*\d)(?:\d{3}[ \-]\d{2}[ \-]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{6}[\-+ ]?\d{4}|[A-Z]{0,3}[ \-]?\d{7,11}[ \-]?[A-Z]{0,2}|\d{2} ?\d{3} ?\d{3} ?\d{3}|[A-Z]\d{2}[A-Z0-9]{6,9}|\d(?: \d{2}){3}(?: \d{3}){2}(?: \d{2})?)(?![\w\-])")


def _identity(text: str, end: int) -> tuple[int, int] | None:
    """The number after a cue that ends at ``end``."""
    link = _ID_LINK.match(text, end)
    value = _ID_VALUE.match(text, link.end()) if link else None
    return value.span() if value and _may_identify(value.group()) else None


_SOCIAL = re.compile(r"(\d{3})[ \-](\d\d)[ \-](\d{4})")
_BORN = re.compile(r"(\d\d)(\d\d)\d\d[\-+]\d{4}")


def _may_identify(value: str) -> bool:
    """Whether a number of a known form can have been given out: no part of zeros only, a birthday that exists."""
    if m := _SOCIAL.fullmatch(value):
        return m.group(1) not in ("000", "666") and m.group(2) != "00" and m.group(3) != "0000"
    if m := _BORN.fullmatch(value):
        a, b = int(m.group(1)), int(m.group(2))
        return 1 <= b <= 12 or 1 <= a <= 12 and 1 <= b <= 31  # day, month or year come first
    return len(set(filter(str.isdigit, value))) > 1


# ---- accounts and cards

# Cues before bank accounts and payment cards, in lower case.
ACCOUNT_CUES = ("iban", "bank account", "account number", "account no", "kontonummer", "konto", "número de cuenta", "cuenta", "numéro de compte", "compte", "credit card", "debit card", "card number", "kreditkarte", "carte bancaire", "tarjeta")
_ACCOUNT_LINK = re.compile(r"[\s\"']*(?:(?:number|no|nr|nummer|num|iban)(?!\w)\.?[\s\"']*)*(?:is|was|ist|es|est|:|=|#)?[\s\"']*", re.I)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"\d(?:[ \-]?\d){12,18}(?![\w\-])")
_PLAIN_ACCOUNT = re.compile(r"\d(?:[ \-]?\d){6,11}(?![ \-]?\d|[\w\-])")


def _iban_holds(value: str) -> bool:
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _card_holds(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return len(set(digits)) > 1 and sum(digits[::2] + [d * 2 - 9 * (d > 4) for d in digits[1::2]]) % 10 == 0


def _account(text: str, end: int, plain: bool) -> tuple[int, int] | None:
    """The account or card after a cue that ends at ``end``, its check digits in order. ``plain``: one without any will do."""
    at = _ACCOUNT_LINK.match(text, end).end()
    m = _IBAN.match(text, at)
    while m and not _iban_holds(m.group()):  # the last group may be the next word
        back = m.group().rfind(" ")
        m = _IBAN.fullmatch(text, at, at + back) if back > 0 else None
    if m:
        return m.span()
    m = _CARD.match(text, at)
    if m and _card_holds(m.group()):
        return m.span()
    m = _PLAIN_ACCOUNT.match(text, at) if plain else None
    return m.span() if m else None


# ---- postal addresses

# Words of streets and post boxes.
_STREET = r"(?:Lane|Ln|Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Way|Boulevard|Blvd|Court|Ct|Place|Pl|Square|Sq|Terrace|Close|Crescent|Highway|Hwy|Parkway|Pkwy|Row|Walk|Gardens|Grove|Mews|Circle)"
_CITY = r"[A-ZÀ-Þ][\wÀ-ÿ'’]+(?:[ \-](?:[a-z]{1,3}-)?[A-ZÀ-Þ][\wÀ-ÿ'’]+|-[a-z]+-[A-ZÀ-Þ]\w+){0,3}"
_TAIL = rf"(?:(?:,\s|\s|\\n|\n)(?:Apt|Apartment|Suite|Unit|Flat|#)\.?\s?\w{{1,6}})?(?:(?:,\s?|\s?\\n|\s?\n)(?:\d{{4,5}}\s{_CITY}|{_CITY}(?:,?\s[A-Z]{{2}})?\s\d{{4,5}}(?:-\d{{4}})?))?"
_AFTER_NUMBER = re.compile(rf"(?<![\w\-.,/])(?:No\.? ?)?\d{{1,5}}[A-Za-z]?,? (?:(?:[NSEW]|North|South|East|West)\.? )?(?:[A-ZÀ-Þ][\wÀ-ÿ'’\-]+ ){{1,4}}{_STREET}\b\.?{_TAIL}")
_COMPOUND = re.compile(rf"\b[A-ZÄÖÜ][\wäöüß\-]*?(?:stra(?:ß|ss|\\u00df)e|str\.|weg|platz|gasse|allee|ufer|damm)\s\d{{1,4}}(?:\s?[a-z])?\b{_TAIL}")
_RUE = re.compile(rf"(?<![\w\-.])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route)\b(?: (?:de|du|des|la|le|les|d'|l'))*\s?[A-ZÀ-Þ][\wÀ-ÿ'’\-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'’\-]+)*{_TAIL}", re.U)
_CALLE = re.compile(rf"\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrer|C/) (?:(?:de|del|la|las|los|el) )*[A-ZÀ-Þ][\wÀ-ÿ'’\-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'’\-]+)*,? (?:n[.º°o]* ?)?\d{{1,4}}(?:, ?{_CITY})?{_TAIL}")
_BOX = re.compile(rf"\b(?:P\.? ?O\.? ?Box|PO Box|Post Office Box|Postfach|Apartado(?: de Correos)?|Boîte postale|BP|Casilla)\s(?:No\.? ?)?\d{{1,7}}(?:,\s(?-i:{_CITY})(?:,?\s\d{{4,5}})?)?", re.I)
# Anchors of each parser, in lower case.
_ADDRESS_ANCHORS = {
    " lane": _AFTER_NUMBER, " ln": _AFTER_NUMBER, " street": _AFTER_NUMBER, " st": _AFTER_NUMBER, " road": _AFTER_NUMBER, " rd": _AFTER_NUMBER, " avenue": _AFTER_NUMBER, " ave": _AFTER_NUMBER, " drive": _AFTER_NUMBER, " dr": _AFTER_NUMBER, " way": _AFTER_NUMBER, " boulevard": _AFTER_NUMBER, " blvd": _AFTER_NUMBER,
    " court": _AFTER_NUMBER, " ct": _AFTER_NUMBER, " place": _AFTER_NUMBER, " pl": _AFTER_NUMBER, " square": _AFTER_NUMBER, " terrace": _AFTER_NUMBER, " close": _AFTER_NUMBER, " crescent": _AFTER_NUMBER, " highway": _AFTER_NUMBER, " parkway": _AFTER_NUMBER, " row": _AFTER_NUMBER, " walk": _AFTER_NUMBER, " gardens": _AFTER_NUMBER, " grove": _AFTER_NUMBER, " mews": _AFTER_NUMBER, " circle": _AFTER_NUMBER,
    "straße ": _COMPOUND, "strasse ": _COMPOUND, "stra\\u00dfe ": _COMPOUND, "str. ": _COMPOUND, "weg ": _COMPOUND, "platz ": _COMPOUND, "gasse ": _COMPOUND, "allee ": _COMPOUND, "ufer ": _COMPOUND, "damm ": _COMPOUND,
    " rue ": _RUE, " chemin ": _RUE, " allée ": _RUE, " impasse ": _RUE, " quai ": _RUE, "calle ": _CALLE, "avenida ": _CALLE, "avda": _CALLE, "plaza ": _CALLE, "paseo ": _CALLE, "camino ": _CALLE, "carrer ": _CALLE,
    "box ": _BOX, "postfach ": _BOX, "apartado ": _BOX, "boîte postale": _BOX, "casilla ": _BOX,
}


_DIGIT = re.compile(r"\d")


def _address(text: str, at: int, end: int, parser: re.Pattern) -> tuple[int, int] | None:
    """The address that the street word between ``at`` and ``end`` is part of."""
    first = max(0, at - REACH)
    if parser is _AFTER_NUMBER:
        if end < len(text) and text[end].isalnum() or not _DIGIT.search(text, first, at):
            return None
    elif not _DIGIT.search(text, first, end + REACH):
        return None
    for m in parser.finditer(text, first, end + REACH):
        if m.start() > end:
            return None
        if m.end() >= end - 1:
            return m.span()
    return None


# ---- names

_PART = r"(?:[A-ZÀ-Þ](?:[a-zß-ÿ]+|['’][A-ZÀ-Þ][a-zß-ÿ]+)(?:-[A-ZÀ-Þ][a-zß-ÿ]+)*)"
_UPPER = r"(?:[A-ZÀ-Þ](?:['’]?[A-ZÀ-Þ])+(?:-[A-ZÀ-Þ]+)*)"
_LETTER = r"[A-ZÀ-Þ]\."
_PREFIX = r"(?:(?:van|von|de|der|den|del|della|di|da|al|el|la|le|ter|ten|bin|ibn) ){0,3}"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Sr|Sra|Mme|M|Mlle|Sir|Dame)\.? )"
_FULL = rf"{_TITLE}{{0,2}}(?:{_PART}, {_PREFIX}{_PART}(?: {_LETTER})?|(?:{_PART}|{_LETTER})(?: (?:{_PART}|{_LETTER})){{0,2}} {_PREFIX}{_PART}|{_PART} {_LETTER}|{_UPPER}(?: {_LETTER})? {_UPPER}|{_UPPER}, {_UPPER})"
_WHOLE = rf"(?:{_FULL}|{_TITLE}{_PREFIX}(?:{_PART}|{_UPPER}))(?!\w)"
_ANY_NAME = re.compile(rf"{_WHOLE}|(?:{_PART}|{_UPPER})(?!\w)")
_FULL_NAME = re.compile(_WHOLE)
_FULL_BACK = re.compile(rf"(?:(?<=\\n)|(?<![\w.@\-])){_WHOLE}$")
_TITLED = re.compile(rf"{_TITLE}{_PREFIX}(?:{_PART}|{_UPPER})(?: {_PART})?")

# Cues before a name, in lower case, each with what must stand after the name.
_NO = re.compile("")
NAME_CUES: dict[str, re.Pattern] = {
    "ask ": re.compile(r"(?:,? (?:about|whether|if|to|before|for|why|how)\b)"), "customer ": re.compile(r"(?:,|'s\b| \(| opened| asked| called| wrote| complained| reported|\.$)"), "reviewer was ": _NO, "reviewed by ": _NO, "test user ": re.compile(r"(?: with| cannot| can|,|$|\.)"), "on behalf of ": _NO, "issued to ": _NO, "written by ": _NO, "reported by ": _NO, "assigned to ": _NO, "signed by ": _NO, "approved by ": _NO, "maintained by ": _NO,
    "contacter ": re.compile(r"(?: au\b|,|\.| par\b| pour\b|$| à )"), "bitte an ": re.compile(r" wenden\b"), "wenden sie sich an ": _NO, "contactar a ": _NO, "contactar con ": _NO, "llamar a ": _NO, "preguntar a ": _NO, "row: \"": _NO, "row: \\\"": _NO, "user\":\"": _NO, "user\": \"": _NO, "user\\\":\\\"": _NO, "user\\\": \\\"": _NO, "name\":\"": _NO, "name\": \"": _NO, "name\\\": \\\"": _NO, "owner=\"": _NO, "owner=\\\"": _NO, "owner: ": _NO, "author: ": _NO, "@author ": _NO,
    "i met ": _NO, "met with ": _NO, "spoke with ": _NO, "spoke to ": _NO, "talked to ": _NO, "please contact ": _NO, "e-mail to ": _NO, "a call from ": _NO, "invoice for ": _NO, "appointment with ": _NO, "interview with ": _NO,
    "i'm ": re.compile(r"(?: from| and| at| in| on|,|\.)"), "i am ": re.compile(r"(?: from the|,)"), "my name is ": _NO, "per ": re.compile(r"['’]s\b"), "regards, ": _NO, "regards,\n": _NO, "regards,\\n": _NO, "grüße, ": _NO, "grüßen, ": _NO, "cordialement, ": _NO, "saludos, ": _NO, "sincerely, ": _NO, "cheers, ": _NO, "thanks, ": _NO, "thanks,\n": _NO, "thanks,\\n": _NO, "thank you, ": _NO, "todo(": re.compile(r"\)"), "fixme(": re.compile(r"\)"), "xxx(": re.compile(r"\)"), "dear ": re.compile(r","), "hallo ": re.compile(r","), "bonjour ": re.compile(r","), "hola ": re.compile(r","),
}
# A full name all in lower case counts only after a cue, and only where both of its words can be names.
_LOWER_PART = r"[a-zß-ÿ]{2,}(?:['’-][a-zß-ÿ]{2,})*"
_LOWER = re.compile(rf"(?:(?:mr|mrs|ms|dr|prof)\.? {_LOWER_PART}|{_LOWER_PART}, {_LOWER_PART}|{_LOWER_PART} [a-z]\. {_LOWER_PART}|[a-z]\. {_LOWER_PART}|{_LOWER_PART} [a-z]\.(?!\w)|{_LOWER_PART} {_LOWER_PART})")
_LOWER_BACK = re.compile(rf"(?:^|[.?!:;,\n>\]}})\"']\s?|\\n|\s{{2}})({_LOWER.pattern})$")
_LOWER_AFTER_WORD = re.compile(rf"(\S+)\s({_LOWER_PART} {_LOWER_PART})$")
_LOWER_END = re.compile(r"(?=$|\s*[\n\"'’<(),.;]|\\|\s+[A-ZÀ-Þ¿#{\[])")
# Nouns and adjectives that follow the cues without being names, besides closed-class words.
_COMMON = frozenset("my our your per cache layer whole team user users owner owners platform support service services graph customer client server project module class method package release review reviewer report builder import table folder branch caller change parser digest queue warning code file files system company department people everyone nobody someone data test tests very too slow good bad new old late done sent unknown none null admin root other one two three".split())
# Cues after a name, in lower case.
_AFTER_NAME = (" moved to ", " wrote the ", " lives at ", " lives in ", " was born ", " called me", " called us", " called on ", " phoned ", " emailed ", " told me ", " told us ", " asked me ", " asked us ", " complained that ", " ist umgezogen", " wohnt in ", " hat angerufen", " a déménagé", " habite ", " a appelé", " se mudó", " vive en ", " llamó ")
# Capitalised words that stand where names do and are none.
_NO_NAMES = frozenset("I He She It We You They His Her Its Our Your Their My Do Does Did Look Send Ask Customer Fixture Regards Thanks Owner Bitte Veuillez Escribir Identity Ship Tel Steuer The This That These Those What Which Where When Why How Can Is Are Write List Suggest Summarise Explain Describe Use Context Evidence Answer Please Keep Every Some Most All Any No Yes Not In On At For From If Then Later Under After Before Whenever While Because Although Unless So Was Welche Warum Kann Que Quels Pourquoi Spring Project Object Street Lane Version Build Run Team Platform Support Admin Nobody Everyone Anyone Someone English German French Spanish Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
_TITLE_ANCHORS = ("mr. ", "mrs. ", "ms. ", "ms ", "dr. ", "prof. ", "mr ", "mrs ", "herr ", "frau ", "mme ", "sra. ")


def _name_after(text: str, end: int, after: re.Pattern, single: bool) -> tuple[int, int] | None:
    """The name that begins at ``end``, followed as the cue demands. Only some cues take a single word for a name."""
    full = _FULL_NAME.match(text, end)
    options = [full] if full else []
    if single:
        options.append(_ANY_NAME.match(text, end))
    for m in options:
        if not m:
            continue
        a, b = m.span()
        words = re.findall(r"[^\W\d_]+(?:\.(?= ))?", m.group())
        if words[0] in _NO_NAMES:
            return None
        if words[-1] in _NO_NAMES and len(words) > 1:  # the next sentence's first word
            b = a + m.group().rfind(words[-1])
            b = a + len(text[a:b].rstrip(" ,"))
        if b < len(text) and (text[b].isalnum() or text[b] in "_@"):
            back = text.rfind(" ", a, b)
            if not single or back < 0:
                continue
            b = back
        if after.match(text, b):
            return a, b
    m = _LOWER.match(text, end)
    if m and (after.match(text, m.end()) if after.pattern else _ends_lower(text, m.end())) and _may_name(m.group()):
        return m.span()
    if single and after.pattern and (m := re.compile(_LOWER_PART).match(text, end)) and after.match(text, m.end()) and _may_name(m.group()) and text[end - 1] == "(":
        return m.span()
    return None


@cache
def _closed() -> frozenset[str]:
    from codequarry.llm.language import WORDS

    return _COMMON | frozenset().union(*WORDS.values()) - {"van", "von", "de", "la", "le"}


def _may_name(words: str) -> bool:
    return not any(w in _closed() for w in re.findall(r"[a-zß-ÿ]{2,}", words))


def _ends_lower(text: str, at: int) -> bool:
    """A name in lower case may end here: at a mark, a capital or a closed-class word."""
    following = re.compile(r"\s([a-zß-ÿ]+)\b").match(text, at)
    return _LOWER_END.match(text, at) is not None or following is not None and following.group(1) in _closed()


def _name_before(text: str, start: int) -> tuple[int, int] | None:
    """The full name that ends at ``start``."""
    m = _FULL_BACK.search(text, max(0, start - REACH), start)
    if not m:
        low = _LOWER_BACK.search(text, max(0, start - REACH), start)
        if low:
            return low.span(1) if _may_name(low.group(1)) else None
        low = _LOWER_AFTER_WORD.search(text, max(0, start - REACH), start)
        clear = low and (low.group(1)[-1].isdigit() or low.group(1).lower() in _closed())
        return low.span(2) if clear and _may_name(low.group(2)) else None
    a, b = m.span()
    words = re.findall(r"[^\W\d_]+(?:\.(?= ))?", m.group())
    if words[-1] in _NO_NAMES:
        return None
    while words and words[0] in _NO_NAMES:
        a = text.find(words[1], a) if len(words) > 1 else b
        words = words[1:]
    return (a, b) if words and b > a else None


_SINGLE = ("todo(", "fixme(", "xxx(", "thanks, ", "thanks,\n", "thanks,\\n", "thank you, ", "regards, ", "regards,\n", "regards,\\n", "cheers, ", "dear ", "hallo ", "bonjour ", "hola ", "ask ", "per ", "user\":\"", "user\": \"", "user\\\":\\\"", "user\\\": \\\"", "bitte an ", "contacter ")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, list] = {}
    for w in ("@", "(at)", "[at]", "( at )", "[ at ]"):
        words.setdefault(w, []).append(("mail", None))
    for w in PHONE_CUES:
        words.setdefault(w, []).append(("phone", None))
    for w in ACCOUNT_CUES:
        words.setdefault(w, []).append(("account", "account" in w or w in ("kontonummer", "número de cuenta", "numéro de compte")))
    for w in ID_CUES:
        words.setdefault(w, []).append(("id", None))
    for w, parser in _ADDRESS_ANCHORS.items():
        words.setdefault(w, []).append(("address", parser))
    for w, after in NAME_CUES.items():
        words.setdefault(w, []).append(("name", (after, w in _SINGLE)))
    for w in _AFTER_NAME:
        words.setdefault(w, []).append(("before", None))
    for w in (" <", "\\u003c"):
        words.setdefault(w, []).append(("mailed", None))
    for w in _TITLE_ANCHORS:
        words.setdefault(w, []).append(("title", None))
    for w, kinds in words.items():
        a.add_word(w, (len(w), kinds))
    a.make_automaton()
    return a


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of each piece of personal data, in order, of the stronger type first where they begin together."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few capital letters grow when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found: set[tuple[int, int, str]] = set()
    for last, (n, kinds) in _automaton().iter(low):
        start, end = last + 1 - n, last + 1
        for kind, how in kinds:
            if kind == "mail":
                at = start - 1 if start and text[start - 1] == " " and text[start] in "[(" else start
                span, name = _mail(text, at), "EMAIL"
            elif kind == "id":
                if start and low[start - 1].isalnum() and low[start].isalnum() and not text.startswith("\\n", start - 2):
                    continue
                span, name = _identity(text, end), "ID_NUMBER"
            elif kind == "phone":
                span, name = (None if start and low[start - 1].isalnum() else _labelled_phone(text, end)), "PHONE"
            elif kind == "account":
                span, name = (None if start and low[start - 1].isalnum() or end < len(low) and low[end].isalpha() else _account(text, end, how)), "ACCOUNT"
            elif kind == "address":
                span, name = _address(text, start, end, how), "ADDRESS"
            elif kind == "name":
                if start and low[start - 1].isalnum() and low[start].isalpha() and not text.startswith("\\n", start - 2):
                    continue
                span, name = _name_after(text, end, *how), "NAME"
            elif kind == "before":
                span, name = _name_before(text, start), "NAME"
            elif kind == "mailed":
                span, name = (_name_before(text, start) if _AT.search(text, end, min(len(text), end + 70)) else None), "NAME"
            else:
                if start and low[start - 1].isalnum() and not text.startswith("\\n", start - 2):
                    continue
                m = _TITLED.match(text, start)
                span, name = (m.span() if m and m.group().split()[-1] not in _NO_NAMES else None), "NAME"
            if span:
                found.add((*span, name))
    if sum(map(str.isdigit, text)) >= 9:
        taken = _Cover((a, b) for a, b, kind in found if kind in ("ID_NUMBER", "ADDRESS", "ACCOUNT", "PHONE"))
        found |= {(a, b, "PHONE") for a, b in _phones(text) if not taken.meets(a, b)}
    names = {text[a:b] for a, b, kind in found if kind == "NAME" and " " in text[a:b]}
    if names:
        found |= {(a, b, "NAME") for a, b in _repeats(text, names)}
    mails = _Cover((a, b) for a, b, kind in found if kind == "EMAIL")
    found = {(a, b, kind) for a, b, kind in found if kind != "NAME" or not mails.meets(a, b)}
    return sorted(found, key=lambda x: (x[0], TYPES.index(x[2]), -x[1]))


class _Cover:
    """Spans that may overlap, to be asked whether a span meets one of them."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def _repeats(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Where the text has these names again, as whole words."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for name in names:
        a.add_word(name, len(name))
    a.make_automaton()
    for last, n in a.iter(text):
        start, end = last + 1 - n, last + 1
        if not (start and text[start - 1].isalnum() and not text.startswith("\\n", start - 2)) and not (end < len(text) and text[end].isalnum()):
            yield start, end


def redact(text: str | None) -> str | None:
    """The text with each piece of personal data replaced by its type in brackets; null stays null, other text as it is."""
    if not text:
        return text
    out, done = [], 0
    for a, b, kind in spans(text):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
        elif b > done:  # an overlapping rest goes with the piece before it
            done = b
    return "".join(out) + text[done:]


def _found(batches: Iterator, fields: tuple[str, ...]) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = []
        for field in fields:
            for key, text in zip(pdf["row_key"].tolist(), pdf[field].tolist()):
                if text:
                    rows += [(key, field, kind) for kind in {x[2] for x in spans(text)} & FOUND]
        yield pd.DataFrame(rows, columns=["row_key", "field_name", "pii_type"])


def find(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(row_key, field_name, pii_type): one row per record, field and type found in it.

    Rows with a null key are left out, null and empty texts hold nothing, repeated rows count once. Columns other than the key
    and the fields play no part.
    """
    own = df.select(df[key].cast("string").alias("row_key"), *fields).where("row_key is not null")
    return spread(own).mapInPandas(lambda batches: _found(batches, fields), "row_key string, field_name string, pii_type string").distinct()


def _redacted(batches: Iterator, fields: tuple[str, ...]) -> Iterator:
    for pdf in batches:
        yield pdf.assign(**{field: [redact(x) for x in pdf[field].tolist()] for field in fields})


def redacted(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with placeholders in ``fields``; every row and every other column stays."""
    return spread(df).mapInPandas(lambda batches: _redacted(batches, fields), df.schema)


TURNS, CALLS = ("user_prompt", "insights_raw"), ("input_text",)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of personal data in each field of turns and calls."""
    from pyspark.sql import functions as F

    turns = find(read(spark, sf_dir, "turns", "turn_id", *TURNS), "turn_id", TURNS).withColumn("tbl", F.lit("turns"))
    calls = find(read(spark, sf_dir, "llm_calls", "id", *CALLS), "id", CALLS).withColumn("tbl", F.lit("llm_calls"))
    return turns.unionByName(calls).select("tbl", "row_key", "field_name", "pii_type")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with placeholders in place of personal data."""
    return redacted(read(spark, sf_dir, "turns", "turn_id", *TURNS), TURNS)


def p2_redacted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with placeholders in place of personal data."""
    return redacted(read(spark, sf_dir, "llm_calls", "id", *CALLS), CALLS)


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p2_redacted_calls": p2_redacted_calls}
SQL: dict[str, str] = {}
