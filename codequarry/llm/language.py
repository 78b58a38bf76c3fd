"""The language of short texts, by script and by closed-class words."""

from __future__ import annotations

import re
from collections import Counter

# Closed-class words by language, none of them common in another one of the list at the same spelling.
WORDS = {
    "en": "the of and to is are was were that which with for from this these they it its be been has have had not when what who how why does do will would can could should must there all by at an as or but if into than then after before because his her their only every most".split(),
    "de": "der die das den dem des ein eine einen einer eines und oder ist sind war wird werden wurde wurden worden nicht mit für von vom zum zur auf aus bei nach nur noch kann darf soll muss sich auch wenn wer wie warum welche welcher welches was keine keinen dass daß weil ihn sie ich wir ihr über zuerst alle ohne später im".split(),
    "fr": "le les des du et est sont était une dans sur pour par pas que qui quoi quel quelle quels quelles avec ne sans au aux ce cette ces il elle nous vous ils mais ou où puis lorsque cela être après avant plus tous toutes peut lors pourquoi comment leur dont".split(),
    "es": "el los las del y es son era una en por para con sin que qué quién cómo cuál cuáles no se lo al esta este estos estas pero porque cuando puede también más ya muy su sus hay está fue como todos todas después antes otra otro".split(),
    "it": "il gli della delle dei nel nella che è sono una per con non si più questo questa anche come quando perché dove ogni tutti".split(),
    "pt": "os as do da dos das um uma em no na nos nas para com não que é são foi por mais como mas ao você isso este esta também quando porque".split(),
    "nl": "het een van en is zijn dat niet met voor op aan ook als maar door bij naar uit worden werd wordt deze die geen kan".split(),
}
_SETS = {lang: frozenset(words) for lang, words in WORDS.items()}
_VOTES: dict[str, list[str]] = {w: [lang for lang, own in _SETS.items() if w in own] for w in set().union(*_SETS.values())}
_EN = _SETS["en"].__contains__
#: Share of English closed-class words beyond which a text is English without a count of the others.
_CLEAR = 0.2
_SCRIPTS = {
    "ru": re.compile("[Ѐ-ӿ]"), "el": re.compile("[Ͱ-Ͽ]"), "he": re.compile("[֐-׿]"), "ar": re.compile("[؀-ۿ]"), "hi": re.compile("[ऀ-ॿ]"),
    "th": re.compile("[฀-๿]"), "ko": re.compile("[가-힯]"), "ja": re.compile("[぀-ヿ]"), "zh": re.compile("[一-鿿]"),
}
_POINTS = ",;:!?¿¡()\"«»"
_MARKS = (("de", "ßÄÖÜäöü"), ("es", "¿¡ñ"), ("fr", "àâçèêëîïôœùû"))


def votes(text: str) -> dict[str, float]:
    """Closed-class words of each language in a text; a word that several languages share counts in parts."""
    out: dict[str, float] = {}
    for w, n in Counter(filter(_VOTES.__contains__, _words(text))).items():
        langs = _VOTES[w]
        for lang in langs:
            out[lang] = out.get(lang, 0.0) + n / len(langs)
    for lang, marks in () if text.isascii() else _MARKS:
        n = sum(text.count(c) for c in marks)
        if n:
            out[lang] = out.get(lang, 0) + min(2, n)
    return out


def _words(text: str) -> list[str]:
    low = f"{text} ".lower().replace(". ", " ").replace(".\n", " ")
    for c in _POINTS:
        if c in low:
            low = low.replace(c, " ")
    return low.split()


def detect(text: str | None, least: float = 2.0) -> str | None:
    """The code of the text's language, or None where too little of it tells one: null, empty, code, names, numbers."""
    if not text:
        return None
    if not text.isascii() and max(text) >= "Ͱ":
        letters = sum(map(str.isalpha, text))
        for lang, script in _SCRIPTS.items():
            if len(script.findall(text)) > 0.3 * letters > 0:
                return lang
    if text.isascii():
        words = text.lower().split()
        if sum(map(_EN, words)) >= max(least, _CLEAR * len(words)):
            return "en"
    v = votes(text)
    if not v:
        return None
    ranked = sorted(v.items(), key=lambda x: -x[1])
    if ranked[0][1] < least or len(ranked) > 1 and ranked[0][1] < 1.3 * ranked[1][1]:
        return None
    return ranked[0][0]
