"""Defective pairs of prompt and answer: empty, refusing, copied, cut off, or in another language than the one asked in.

The rules are ordered and each looks at the pair alone, whatever its length. ``triggered`` gives every defect that a pair shows;
``defect`` the one that counts, the first of them in the order of ``ORDER``: an empty or refusing answer is just that in any
language, and a copy that breaks off is a copy.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm.language import detect, votes
from codequarry.tables import read, spread

ORDER = ("empty", "refusal", "copied", "truncated", "other_language")

# What stands in for an answer without being one, in lower case and without brackets and quotes.
STAND_INS = frozenset(("null", "none", "nil", "n/a", "na", "nan", "empty", "undefined", "tbd", "todo", "blank", "void", "no answer", "no output", "no response", "no content", "not available", "no answer given", "placeholder"))

# Phrasings of refusals.
_DO = r"(?:help|assist|answer|provide|discuss|respond|reply|comment|go into|go through|review|fulfil|fulfill|comply|do (?:that|this|so)|share|continue|talk|complete|process|handle|engage|give|support|work on|carry out|say)"
_CANNOT = r"(?:can(?:no|')t|can not|cannot|could not|couldn't|won't(?: be able to)?|will not(?: be able to)?|am (?:not |un)(?:able|permitted|allowed|authori[sz]ed|willing|in a position) to|am unable to|must decline to|must refuse to|have to decline to|would rather not|'d rather not|prefer not to|refuse to|decline to|do not wish to)"
REFUSALS = (
    rf"\bi(?:'m afraid (?:that )?i)? {_CANNOT} {_DO}\b", rf"\bi {_CANNOT}[^.;:,]{{0,40}}\b(?:request|question|topic|policy reasons)\b", r"\bi'd rather not\b", r"\bnot something i (?:can|may|will|am able to)\b", r"\bi must (?:decline|refuse)\b", r"\bi have to (?:pass|decline)\b",
    r"\b(?:do|does|would|should) not feel comfortable (?:\w+ing)\b|\bi (?:am|feel|would be) (?:not comfortable|uncomfortable)\b", r"\b(?:outside|beyond) (?:of )?what i (?:am|may|can)\b", r"\boff limits for me\b", r"\bagainst (?:the |my )?(?:rules|guidelines|policy|policies|instructions) i\b|\bagainst my (?:rules|guidelines|policy|policies|programming|instructions)\b",
    r"\btalk about something other than\b|\b(?:change the subject|talk about something else)\b", r"\bno answer (?:can|will|could) be given\b", r"\b(?:judged|deemed|considered|flagged as) (?:to be )?(?:unsafe|inappropriate|harmful)\b", r"^\W*(?:declined|refused|request declined|request refused|blocked|filtered)\W*(?:$|[A-Z\s])",
    r"\binappropriate for me to\b|\bnot appropriate for me to\b", r"\b(?:guidelines|rules|policy|policies|instructions) (?:do|does|did) not (?:allow|permit) me\b|\b(?:guidelines|rules|policy|policies) (?:forbid|prohibit|prevent)s? me\b", r"\brequests? of this (?:kind|sort|type) (?:is|are) (?:blocked|refused|declined|not (?:allowed|permitted|supported))\b",
    r"\b(?:just |only )?an? (?:ai )?(?:language model|assistant)\b[^.]{0,60}\b(?:no opinion|cannot|can't|must|unable|not able|decline|do not|don't)\b", r"\bfind (?:that|this|it) out elsewhere\b", r"\b(?:has to|must|will|shall) (?:remain|go|be left) unanswered\b", r"\bnot (?:able|permitted|allowed|authori[sz]ed) to (?:assist|help|answer|discuss|respond|comment)\b",
    r"\bask someone else\b[^.]*\.?$", r"\b(?:request|question) (?:falls|is) (?:outside|beyond) (?:what|the scope of what|my)\b",
    r"\bkann ich (?:\w+ ){0,3}nicht (?:helfen|beantworten|antworten|weiterhelfen|dienen)\b|\b(?:darf|kann|möchte|werde) ich (?:\w+ ){0,3}nicht (?:beantworten|antworten|bearbeiten|helfen)\b|\bich (?:kann|darf|möchte|werde)\b[^.]{0,60}\bnicht (?:beantworten|antworten|helfen|bearbeiten|weiterhelfen)\b|\bist (?:es )?mir nicht (?:möglich|gestattet|erlaubt)\b|\bmir ist es nicht (?:möglich|gestattet|erlaubt)\b|\bmuss ich (?:\w+ ){0,3}ablehnen\b|\bich muss\b[^.]{0,40}\bablehnen\b",
    r"\bje ne (?:peux|puis|suis|souhaite|saurais|dois)(?: pas)?\b[^.]{0,50}\b(?:répondre|aider|traiter|autorisé|en mesure|fournir|commenter)\b|\bil m'est (?:impossible|interdit)\b|\bje (?:refuse|dois refuser|dois décliner)\b|\bje n'ai pas le droit\b",
    r"\bno (?:puedo|podré|debo|me es posible|me está permitido|estoy autorizad[oa] a)\b[^.]{0,40}\b(?:ayudar|responder|contestar|hablar|atender|comentar|proporcionar)(?:te|le|les)?\b|\bno me (?:está|es) (?:permitido|posible)\b|\bdebo (?:rechazar|negarme|declinar)\b|\bme niego a\b",
)
_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS), re.I | re.M)
# Pieces of which every refusal has one, in lower case; they spare most answers the patterns.
_CUES = (
    "can't", "cannot", "can not", "could not", "couldn't", "won't", "will not", "not able", "unable", "declin", "refus", "not something i", "rather not", "prefer not", "not wish", "have to pass", "comfortable", "what i ", "outside", "beyond", "off limits", "against ", "something other", "something else", "the subject",
    "no answer", "unsafe", "inappropriate", "harmful", "not appropriate", "allow me", "permit me", "forbid", "prohibit", "prevent", "of this kind", "of this sort", "of this type", "language model", "assistant", "elsewhere", "unanswered", "permitted", "authorize", "authorise", "someone else", "blocked", "filtered", "not allowed",
    "nicht", "ablehnen", "je ne ", "impossible", "interdit", "je refuse", "je dois", "je n'ai", "no pue", "no podr", "no debo", "no me ", "no estoy", "debo ", "me niego",
)
#: Words up to which an answer with a refusal counts as one as a whole; of a longer one half of the sentences must refuse,
#: excuse or send elsewhere.
REFUSAL_WORDS = 60
# Pieces of the sentences that go with a refusal, in lower case.
_COURTESIES = ("sorry", "apolog", "regret", "unfortunately", "understand", "appreciate", "thank", "please", "feel free", "happy to", "glad to", "instead", "something else", "anything else", "other question", "polic", "guideline", "rules", "colleague", "elsewhere", "support", "leider", "entschuldig", "bitte", "stattdessen", "désolé", "malheureusement", "veuillez", "plutôt", "lo siento", "lamento", "disculp", "por favor", "en su lugar")

# Requests for a language, and number words in announcements.
_ASKED = (
    ("en", r"\b(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin english\b|\bauf englisch\b|\ben anglais\b|\ben inglés\b|\bin english,? please\b"),
    ("de", r"\b(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin german\b|\bauf deutsch\b|\ben allemand\b|\ben alemán\b|\bin german,? please\b"),
    ("fr", r"\b(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin french\b|\bauf französisch\b|\ben français\b|\ben francés\b|\bin french,? please\b"),
    ("es", r"\b(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin spanish\b|\bauf spanisch\b|\ben espagnol\b|\ben español\b|\bin spanish,? please\b"),
    ("it", r"\b(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin italian\b|\bauf italienisch\b|\ben italien\b|\ben italiano\b"),
    ("pt", r"\b(?:answer|reply|respond|write)\b[^.?!]{0,30}\bin portuguese\b|\bauf portugiesisch\b|\ben portugais\b|\ben portugués\b"),
)
_REQUEST = re.compile("|".join(f"(?P<{lang}>{x})" for lang, x in _ASKED), re.I)
_HINTS = ("english", "german", "french", "spanish", "italian", "portug", "englisch", "deutsch", "französisch", "spanisch", "italien", "anglais", "allemand", "français", "espagnol", "inglés", "alemán", "francés", "español")
_COUNTS = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_PROMISE = re.compile(r"\b(" + "|".join(w for w in _COUNTS if w not in ("zero", "one")) + r"|\d{1,2}) (?:\w+ )?(?:steps|things|reasons|points|ways|parts|changes|items|causes|options|cases|differences|problems)\b", re.I)
_ITEM = re.compile(r"(?m)^\s*(\d{1,3})[.)](?:\s|$)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]*[?]")
_END = re.compile(r"[.!?…:;)\]}\"'»”`|]\s*$")
_DOTS = re.compile(r"(?:[a-z]\w*\.){2,}")
_DOTTED = re.compile(r"(?:[A-Za-z_]\w*\.)+[A-Za-z_]*\w*$")


@cache
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def is_empty(answer: str | None) -> bool:
    """No answer, only blanks, invisible characters or fences, or a stand-in without content."""
    if answer is None:
        return True
    if len(answer) > 60:
        if not answer.isspace() and any(map(str.isalnum, answer[:200])):
            return False
    s = re.sub(r"[\s​‌‍⁠﻿­`\x00-\x1f]+", " ", answer).strip()
    s = re.sub(r"^(?:answer|output|response|result)\s*:\s*$", "", s, flags=re.I)
    bare = s.strip("\"'`<>[](){} ").lower()
    return not bare or bare.rstrip(".!") in STAND_INS or bare in STAND_INS or not any(map(str.isalnum, bare))


_SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")


def is_refusal(answer: str) -> bool:
    """An answer that declines, in any of the languages known here, and doesn't go on to answer."""
    low = answer.lower().replace("’", "'")
    if next(_automaton(_CUES).iter(low), None) is None:
        return False
    m = _REFUSAL.search(low)
    if not m:
        return False
    if answer.count(" ") > REFUSAL_WORDS:
        told = [s for s in _SENTENCES.split(low) if any(map(str.isalnum, s))]
        return 2 * sum(_REFUSAL.search(s) is not None or any(c in s for c in _COURTESIES) for s in told) >= len(told)
    clause = low[m.end() :].split(".")[0]
    return not re.search(r"\bcaller in the evidence\b|, but \w|; the\b", clause)


_LABEL = re.compile(r"^\s*(?:[>\"'«“]+\s*)?(?:(?:prompt|input|question|query|user|q|frage|pregunta|entrada|eingabe)\s*:\s*)?", re.I)


#: Words of a copied beginning that is too short to be most of the prompt.
COPIED_PREFIX = 8


def is_copied(prompt: str, answer: str) -> bool:
    """The answer's words are the prompt's, in its order and with hardly any other, and half of the prompt's at least or its beginning.

    Labels, quotation marks, case and spacing make no difference, nor does saying it several times.
    """
    known = set(prompt.lower().split())
    rough = answer.lower().split()
    if 2 * sum(w in known for w in rough) < len(rough):
        return False
    y = _WORD.findall(_LABEL.sub("", answer).lower())
    x = _WORD.findall(prompt.lower())
    if len(y) < 4 or not x:
        return False
    known = set(x)
    if sum(w in known for w in y) < 0.85 * len(y):
        return False
    times = round(len(y) / len(x))
    half = len(y) // 2
    if times > 1 and len(y) % times == 0 and y == y[: len(y) // times] * times:
        y = y[: len(y) // times]
    elif len(y) % 2 == 0 and y[:half] == y[half:]:
        y = y[:half]
    if len(y) < 0.5 * len(x):
        return len(y) >= COPIED_PREFIX and y[:-1] == x[: len(y) - 1]  # the last word may be cut
    follows = set(zip(x, x[1:]))
    return sum(p in follows for p in zip(y, y[1:])) >= 0.7 * (len(y) - 1)


def is_truncated(answer: str) -> bool:
    """Unclosed fences, objects or brackets; fewer items than announced; or an end amid a sentence, name or list item."""
    s = answer.rstrip()
    if s.count("```") % 2:
        return True
    if s[0] in "{[" and not re.match(r"\[[\w ]+\]", s):
        try:
            json.loads(s)
            return False
        except ValueError:
            return s[-1] not in "}]" or s.count("{") + s.count("[") > s.count("}") + s.count("]")
    lines = s.split("\n")
    last = lines[-1].strip()
    items = _ITEM.findall(s) if len(lines) > 1 else ()
    if items:
        if re.fullmatch(r"\d{1,3}[.)]", last):
            return True
        promised = _PROMISE.search(s[: s.find(items[0] + ".") + 1] or s)
        if promised:
            n = _COUNTS.get(promised.group(1).lower()) or int(promised.group(1))
            if max(map(int, items)) < n:
                return True
    bullet = re.match(r"[-*•+]\s*(.*)$", last)
    if bullet and len(lines) > 1:
        item = bullet.group(1)
        if not item:
            return True
        if _DOTTED.fullmatch(item) or item.endswith("."):
            cut = item.endswith(".") and " " not in item or not item.endswith(".") and item.rsplit(".", 1)[-1][:1].islower()
            others = [m.group(1) for x in lines[:-1] if (m := re.match(r"\s*[-*•+]\s*(.*)$", x))]
            return cut and (not others or any(o.rsplit(".", 1)[-1][:1].isupper() for o in others) or item.endswith("."))
        if " " not in item or not any(re.match(r"\s*[-*•+]\s.*[.!?]$", x) for x in lines[:-1]):
            return False
    if s.endswith("```") or s[-1] in ".!?…":
        tail = s[s.rfind(" ") + 1 :]
        return tail in ("e.g.", "i.e.") or bool(_DOTS.fullmatch(tail[tail.rfind("\n") + 1 :])) and tail not in ("a.m.", "p.m.") or s.count("(") > s.count(")") + 1
    if s[-1] in ",;:-–—(" or s.endswith(" ="):
        return True
    words = last.split()
    if len(lines) > 1 and _END.search(lines[-2] if lines[-2].strip() else next((x for x in reversed(lines[:-1]) if x.strip()), ".")):
        if re.match(r"(?:--|->|=>|#|—|\(|\[|\*|>|[A-Z][\w ]{0,20}:)\s*\S", last) and len(words) <= 12 and not re.search(r"\.$", last):
            return bool(_DOTTED.search(last)) and last.rsplit(".", 1)[-1][:1].islower()
    if s[-1] in ")]}\"'»”":
        return False
    if len(s.split()) <= 3:
        return False
    return not (len(s.split()) <= 6 and "." not in s and len(lines) == 1 and last[:1].isupper() and re.search(r"\d$|\b[A-F]$", last))


# Words with which requests begin, or that questions are full of, beside the closed-class ones.
_OPENERS = {
    "en": "summarise summarize explain describe suggest list show find give name compare write tell rewrite review translate many much few changed since between handles",
    "de": "erkläre beschreibe nenne zeige liste fasse vergleiche schreibe gib schlage übersetze viele wenige geändert seit zwischen man",
    "fr": "explique décris résume liste donne montre compare écris propose traduis combien peu changé depuis entre",
    "es": "explica describe resume lista muestra compara escribe propón traduce cuántos cuántas pocas cambió desde entre",
}
_OPENING: dict[str, list[str]] = {}
for _lang, _list in _OPENERS.items():
    for _w in _list.split():
        _OPENING.setdefault(_w, []).append(_lang)


def _weakly(prompt: str) -> str | None:
    """The language of a prompt too short to be clear, by the words of requests as well."""
    v = votes(prompt)
    for w in re.findall(r"[^\W\d_]+", prompt.lower()):
        for lang in _OPENING.get(w, ()):
            v[lang] = v.get(lang, 0.0) + 1 / len(_OPENING[w])
    ranked = sorted(v.items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < 1 or len(ranked) > 1 and ranked[0][1] < 1.3 * ranked[1][1]:
        return None
    return ranked[0][0]


def asked_language(prompt: str) -> str | None:
    """The language that an answer should have: the one asked for, else that of the question, else that of the prompt."""
    low = prompt.lower()
    if next(_automaton(_HINTS).iter(low), None) is not None:
        for m in _REQUEST.finditer(prompt):
            return m.lastgroup
    if "?" in prompt:
        questions = "".join(_SENTENCE.findall(prompt))
        lang = detect(questions, 1.0)
        if lang:
            return lang
    return detect(prompt) or _weakly(prompt)


def _prose(answer: str) -> str:
    if "```" in answer:
        answer = re.sub(r"```.*?(?:```|\Z)", " ", answer, flags=re.S)
    return answer


def is_other_language(prompt: str, answer: str) -> bool:
    """The answer's own language is clear, so is the one expected, and they differ. Code and lists have none."""
    if answer.startswith("You asked:") or "\n\n" in answer and answer.split("\n\n", 1)[0].rstrip().endswith("?"):
        parts = answer.split("\n\n", 1)
        answer = parts[1] if len(parts) > 1 else answer
    own = detect(_prose(answer))
    if own is None:
        return False
    asked = asked_language(prompt)
    return asked is not None and asked != own


def triggered(prompt: str | None, answer: str | None) -> list[str]:
    """Every defect of the pair, in order. A blank prompt makes no pair and has none; an empty answer shows nothing else."""
    return list(_defects(prompt, answer))


def _defects(prompt: str | None, answer: str | None) -> Iterator[str]:
    if prompt is None or not prompt.strip():
        return
    if is_empty(answer):
        yield "empty"
        return
    for name, rule in (("refusal", lambda: is_refusal(answer)), ("copied", lambda: is_copied(prompt, answer)), ("truncated", lambda: is_truncated(answer)), ("other_language", lambda: is_other_language(prompt, answer))):
        if rule():
            yield name


def defect(prompt: str | None, answer: str | None) -> str | None:
    """The pair's one defect, the first that it triggers, or None."""
    return next(_defects(prompt, answer), None)


def _flagged(batches: Iterator, every: bool) -> Iterator:
    import pandas as pd

    for pdf in batches:
        ids, names = [], []
        for call, prompt, answer in zip(pdf["call_id"].tolist(), pdf["input_text"].tolist(), pdf["output_text"].tolist()):
            for name in triggered(prompt, answer) if every else filter(None, [defect(prompt, answer)]):
                ids.append(call)
                names.append(name)
        yield pd.DataFrame({"call_id": pd.Series(ids, dtype="int64"), "defect": pd.Series(names, dtype="object")})


def flag(calls: DataFrame, every: bool = False) -> DataFrame:
    """(call_id, defect) of each defective pair of ``calls`` (call_id, input_text, output_text).

    One row per call, or with ``every`` one for each defect that it triggers. Pairs with a null or blank prompt, and rows
    without call_id, have none; a null answer is empty. Repeated rows count once. Other columns play no part.
    """
    own = calls.select("call_id", "input_text", "output_text").where("call_id is not null and input_text is not null")
    return spread(own).mapInPandas(lambda batches: _flagged(batches, every), "call_id long, defect string").distinct()


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "llm_calls", "id", "input_text", "output_text").withColumnRenamed("id", "call_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one defect of each defective call."""
    return flag(_calls(spark, sf_dir))


def p7_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect that each call triggers."""
    return flag(_calls(spark, sf_dir), every=True)


def p7_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls without an answer, or with a stand-in for one."""
    return flag(_calls(spark, sf_dir), every=True).where("defect = 'empty'").select("call_id")


_BARE = "lower(trim(trim(regexp_replace(output_text, '[\\s\u200b\u200c\u200d\u2060\ufeff\u00ad`\\x00-\\x1f]+', ' ', 'g')), '\"''`<>[](){} '))"
QUERIES = {"p7_found": p7_found, "p7_triggered": p7_triggered, "p7_empty": p7_empty}
SQL = {
    "p7_empty": f"SELECT DISTINCT id AS call_id FROM (SELECT *, {_BARE} AS b FROM llm_calls) WHERE regexp_matches(input_text, '\\S') AND id IS NOT NULL AND (output_text IS NULL OR NOT regexp_matches(b, '[\\p{{L}}\\p{{N}}]') OR rtrim(b, '.!') IN ({', '.join(repr(x) for x in sorted(STAND_INS))}) OR regexp_matches(b, '^(answer|output|response|result)\\s*:\\s*$'))",
}
