"""Functions and methods out of source texts, each with its documentation comment.

At every place where a member may begin, the text is cut into tokens as far as needed and the generalised LL recogniser tries
the header grammar of the language. What doesn't parse is skipped up to the next such place, so a broken file loses its broken
parts only: bodies are passed over by their strings, comments and brackets, without tokens, but a header that stands no deeper
than the one whose body is being passed ends that body.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from codequarry.llm.gll import Recogniser, Rules

# Words that may stand before a definition, and words that never name one.
MODIFIERS = frozenset("public private protected static final abstract synchronized native strictfp default async export declare readonly override get set sealed open internal virtual transient volatile".split())
NEVER = frozenset("if for while switch catch return new else do try throw case with using synchronized await yield typeof super this delete void in of instanceof lock foreach elif except assert".split()) - {"synchronized"}
NO_START = NEVER - {"void"}

_TOKEN = re.compile(
    r"""[ \t\f\v﻿]*(?:(?P<id>[^\W\d]\w*|\$[\w$]*)|(?P<nl>\r\n|\n|\r)
    |(?P<doc>/\*\*(?!/)[\s\S]*?(?:\*/|\Z))|(?P<block>/\*[\s\S]*?(?:\*/|\Z))|(?P<line>//[^\r\n]*)
    |(?P<str>"(?:[^"\\\r\n]|\\.)*"?|'(?:[^'\\\r\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)
    |(?P<num>\d[\w.]*)|(?P<op>[^ \t\f\v﻿]))""",
    re.X | re.S,
)
_PY_TOKEN = re.compile(
    r"""(?:[ \t\f\v﻿]|\\(?:\r\n|\n|\r))*(?:(?P<nl>\r\n|\n|\r)|(?P<line>\#[^\r\n]*)
    |(?P<str>[rRuUbBfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|"(?:[^"\\\r\n]|\\.)*"?|'(?:[^'\\\r\n]|\\.)*'?))
    |(?P<id>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<op>[^ \t\f\v﻿]))""",
    re.X | re.S,
)


#: The same patterns for texts of plain letters alone, whose classes are quicker to test.
_PLAIN = {p: re.compile(p.pattern, (p.flags & ~re.UNICODE) | re.ASCII) for p in (_TOKEN, _PY_TOKEN)}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int
    column: int


class Function(NamedTuple):
    name: str
    owner: str
    line: int  # of the definition itself, without its annotations
    name_line: int
    end_line: int
    parameters: list[str]
    return_type: str
    doc: str | None
    start: int
    end: int


def _match(symbol: str, token: Token) -> bool:
    if symbol == "ID":
        return token.kind == "id" and token.text not in NEVER
    if symbol == "MOD":
        return token.kind == "id" and token.text in MODIFIERS
    if symbol == "STR":
        return token.kind == "str"
    if symbol == "NUM":
        return token.kind == "num"
    if symbol == "FREE":  # anything inside brackets that is no bracket
        return token.text not in "()[]{}" or token.kind != "op"
    if symbol == "PIECE":  # of an expression that a comma ends
        return token.kind != "nl" and (token.kind != "op" or token.text not in "()[]{},;=")
    return token.text == symbol and token.kind in ("op", "id")


_SHARED: Rules = {
    "Soup": [(), ("FREE", "Soup"), ("Group", "Soup")],
    "Group": [("(", "Soup", ")"), ("[", "Soup", "]"), ("{", "Soup", "}")],
    "Expr": [("PIECE",), ("Group",), ("PIECE", "Expr"), ("Group", "Expr"), ("=", "=", "Expr"), ("=", ">", "Expr")],
    "QName": [("ID",), ("ID", ".", "QName")],
    "Mods": [(), ("MOD", "Mods"), ("Annotation", "Mods")],
    "Annotation": [("@", "QName"), ("@", "QName", "(", "Soup", ")")],
    "TArgs": [("<", ">"), ("<", "TList", ">")],
    "TList": [("TArg",), ("TArg", ",", "TList")],
}
JAVA: Rules = _SHARED | {
    "TArg": [("Type",), ("?",), ("?", "extends", "Type"), ("?", "super", "Type"), ("ID", "extends", "Bounds"), ("Annotation", "TArg")],
    "Bounds": [("Type",), ("Type", "&", "Bounds")],
    "Dims": [(), ("[", "]", "Dims")],
    "Type": [("QName", "Dims"), ("void",), ("QName", "TArgs", "Dims"), ("QName", "TArgs", ".", "Type")],
    "Head": [("Mods", "Type", "ID"), ("Mods", "TArgs", "Type", "ID"), ("Mods", "ID")],
    "Params": [(), ("PList",)],
    "PList": [("P",), ("P", ",", "PList")],
    "P": [("Mods", "Type", "ID", "Dims"), ("Mods", "Type", ".", ".", ".", "ID")],
    "Tail": [("Dims", "Open"), ("Dims", "throws", "Types", "Open"), ("Dims", "default", "Expr", ";")],
    "Types": [("Type",), ("Type", ",", "Types")],
    "Open": [("{",), (";",)],
}
SCRIPT: Rules = _SHARED | {
    "TArg": [("TType",), ("ID", "extends", "TType"), ("ID", "=", "TType")],
    "TType": [("Prim",), ("Prim", "|", "TType"), ("Prim", "&", "TType"), ("|", "TType")],
    "Prim": [("QName",), ("void",), ("this",), ("QName", "TArgs"), ("Prim", "[", "]"), ("{", "Soup", "}"), ("[", "Soup", "]"), ("(", "Soup", ")"), ("(", "Soup", ")", "=", ">", "TType"), ("STR",), ("NUM",), ("typeof", "QName"), ("keyof", "Prim"), ("ID", "is", "TType")],
    "Head": [("Mods", "Name"), ("Mods", "*", "Name"), ("Mods", "function", "Name"), ("Mods", "function", "*", "Name")],
    "Name": [("ID",), ("ID", "TArgs"), ("#", "ID")],
    "Params": [(), ("PList",), ("PList", ",")],
    "PList": [("P",), ("P", ",", "PList")],
    "P": [("Mods", "Pattern", "Hint", "Default"), ("Mods", "Pattern", "?", "Hint", "Default")],
    "Pattern": [("ID",), ("this",), ("{", "Soup", "}"), ("[", "Soup", "]"), (".", ".", ".", "Pattern")],
    "Hint": [(), (":", "TType")],
    "Default": [(), ("=", "Expr")],
    "Tail": [("Hint", "{"), ("Hint", ";")],
}
PYTHON: Rules = _SHARED | {
    "TArg": [("QName",)],
    "Head": [("def", "ID"), ("async", "def", "ID")],
    "Params": [(), ("PList",), ("PList", ",")],
    "PList": [("P",), ("P", ",", "PList")],
    "P": [("ID", "Hint", "Default"), ("*",), ("/",), ("*", "ID", "Hint"), ("*", "*", "ID", "Hint")],
    "Hint": [(), (":", "Expr")],
    "Default": [(), ("=", "Expr")],
    "Tail": [(":",), ("-", ">", "Returns", ":")],
    "Returns": [("QName",), ("STR",), ("QName", "Group"), ("Returns", "|", "Returns"), ("Expr",)],
}
_STOPS = {"java": "{};", "script": "{};", "python": ":"}
_KEYWORDS = frozenset("extends throws default function is keyof def".split())
_PARSERS = {"java": Recogniser(JAVA, _match), "script": Recogniser(SCRIPT, _match), "python": Recogniser(PYTHON, _match)}
_SUFFIX = {"java": "java", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "tsx": "script", "py": "python", "pyi": "python"}
_LANGUAGE = {"java": "java", "javascript": "script", "typescript": "script", "python": "python"}
_TYPE_WORDS = ("class", "interface", "enum", "record")


_LINE_END = re.compile(r"\r\n|\n|\r")
_COMMENTS, _LONG, _BREAKS = frozenset(("doc", "block", "line")), frozenset(("doc", "block", "str")), frozenset("{};")


class _Stream:
    """Tokens without white space, made as far as they are asked for, and for each index the comment that comes last before it."""

    def __init__(self, text: str, pattern: re.Pattern, pos: int = 0, line: int = 1, bol: int = 0):
        self.text, self.python, self.tokens, self.comments = text, pattern is _PY_TOKEN, [], {}
        self.line, self.bol = line, bol
        self.pattern = _PLAIN[pattern] if text.isascii() else pattern
        self._found = self.pattern.finditer(text, pos)

    def more(self) -> bool:
        """Add tokens up to the next brace or semicolon, in Python up to the next line end; False at the end of the text."""
        add, new, text, python = self.tokens.append, tuple.__new__, self.text, self.python
        before = len(self.tokens)
        line, bol = self.line, self.bol
        for m in self._found:
            kind = m.lastgroup
            start, end = m.span(kind)
            if kind == "nl":
                line, bol = line + 1, end
                if python:
                    add(new(Token, ("nl", "\n", line - 1, start, end, start - bol)))
                    break
                continue
            s = text[start:end]
            if kind == "id":
                add(new(Token, (kind, s, line, start, end, start - bol)))
                continue
            token = new(Token, (kind, s, line, start, end, start - bol))
            if kind == "op":
                add(token)
                if s in _BREAKS and not python:
                    break
                continue
            if kind in _COMMENTS:
                self.comments[len(self.tokens)] = token
            else:
                add(token)
            if kind in _LONG and ("\n" in s or "\r" in s):
                line += len(_LINE_END.findall(s))
                bol = start + max(s.rfind("\n"), s.rfind("\r")) + 1
        self.line, self.bol = line, bol
        return len(self.tokens) > before

    def go(self, keep: int, pos: int) -> None:
        """Forget the tokens from ``keep`` on and go on at ``pos``."""
        del self.tokens[keep:]
        for k in [k for k in self.comments if k >= keep]:
            del self.comments[k]
        from_, line, bol = (self.tokens[-1].end, _last_line(self.tokens[-1]), None) if self.tokens else (0, 1, 0)
        passed = self.text[from_:pos]
        self.line = line + (len(_LINE_END.findall(passed)) if "\r" in passed else passed.count("\n"))
        self.bol = max(self.text.rfind("\n", 0, pos), self.text.rfind("\r", 0, pos)) + 1
        self._found = self.pattern.finditer(self.text, pos)


def _last_token(text: str, pos: int, end: int) -> int:
    """Where the last token between two places ends, comments aside."""
    last = pos
    for m in _TOKEN.finditer(text, pos, end):
        if m.lastgroup not in _COMMENTS and m.lastgroup != "nl":
            last = m.end()
    return last


def _clean_block(s: str) -> str:
    s = s[3:-2] if s.endswith("*/") else s[3:]
    return "\n".join(re.sub(r"^\s*\*(?!/)? ?", "", x) if k else x.strip() for k, x in enumerate(re.split(r"\r\n|\n|\r", s))).strip()


def _last_line(token: Token) -> int:
    return token.line + len(re.findall(r"\r\n|\n|\r", token.text))


def _split(tokens: list[Token], a: int, b: int, text: str) -> list[str]:
    """The parameters between tokens a and b, parted at commas outside brackets."""
    out, depth, first = [], 0, a
    for k in range(a, b):
        c = tokens[k].text if tokens[k].kind == "op" else ""
        depth += (c in "([{<") - (c in ")]}>") if c else 0
        if c == "," and depth <= 0:
            out.append((first, k))
            first = k + 1
    out.append((first, b))
    return [text[tokens[x].start : tokens[y - 1].end] for x, y in out if y > x]


@lru_cache(maxsize=50_000)
def _parsed(lang: str, shape: tuple) -> tuple[int, int, int] | None:
    """As ``_header``, for a run of tokens given by their kinds and telling texts."""
    parser, tokens = _PARSERS[lang], [Token(kind, text, 0, 0, 0, 0) for kind, text in shape]
    for end in sorted(parser.ends("Head", tokens, 0), reverse=True):
        if end < len(tokens) and tokens[end].text == "(":
            for close in sorted(parser.ends("Params", tokens, end + 1)):
                if close < len(tokens) and tokens[close].text == ")":
                    tails = parser.ends("Tail", tokens, close + 1)
                    if tails:
                        return end - 1, close, min(tails)
    return None


def _header(lang: str, stream: _Stream, at: int) -> tuple[int, int, int] | None:
    """(index of the name, of the closing bracket, after the tail) of the header that begins at ``at``.

    The run up to the first ``{``, ``;`` or, in Python, ``:`` outside brackets is parsed by its shape, that is with all plain
    names alike, so that headers of one shape are parsed once. A type that itself has braces takes the run further.
    """
    shape: list[tuple[str, str]] = []
    depth, tokens, k = 0, stream.tokens, at - 1
    while (k := k + 1) < len(tokens) or stream.more():
        kind, text = tokens[k][:2]
        if kind == "id":
            shape.append((kind, text if text in MODIFIERS or text in NEVER or text in _KEYWORDS else "x"))
            continue
        if kind != "op":
            if kind == "nl" and depth <= 0 and k > at:
                return None
            shape.append((kind, ""))
            continue
        shape.append((kind, text))
        if text in "([":
            depth += 1
        elif text in ")]":
            depth -= 1
        elif text in _STOPS[lang]:
            if text == "{" and (depth > 0 or shape[-2:-1] and shape[-2][1] in (":", "|", "&", "<", ",")):
                depth += 1
            elif text == "}" and depth > 0:
                depth -= 1
            elif depth <= 0:
                break
        if depth < 0:
            return None
    else:
        return None
    if shape[-1][1] == "}" or ("op", "(") not in shape:
        return None
    got = _parsed(lang, tuple(shape))
    return got and (at + got[0], at + got[1], at + got[2])


def _after_annotations(tokens: list[Token], at: int) -> int:
    while at + 1 < len(tokens) and tokens[at].text == "@" and tokens[at + 1].text != "interface":
        at += 2
        while at + 1 < len(tokens) and tokens[at].text == ".":
            at += 2
        if at < len(tokens) and tokens[at].text == "(":
            depth = 0
            while at < len(tokens):
                depth += (tokens[at].text == "(") - (tokens[at].text == ")")
                at += 1
                if not depth:
                    break
        while at < len(tokens) and tokens[at].kind == "nl":
            at += 1
    return at


def _braced(text: str, lang: str) -> list[Function]:
    stream = _Stream(text, _TOKEN)
    tokens, comments = stream.tokens, stream.comments
    out: list[Function] = []
    owners: list[tuple[int, str]] = []
    depth, at = 0, 0
    begins = True
    while at < len(tokens) or stream.more():
        t = tokens[at]
        if t.kind == "id" and t.text in _TYPE_WORDS and at + 1 < len(tokens) and tokens[at + 1].kind == "id":
            owners.append((depth, tokens[at + 1].text))
            at += 2
            begins = False
            continue
        if begins and (t.kind == "id" and t.text not in NO_START or t.text in "@<*#"):
            got = _header(lang, stream, at)
            first = _after_annotations(tokens, at) if got else at
            if got and not (got[0] == first and lang == "java" and tokens[got[2] - 1].text == ";") and not (lang == "script" and tokens[got[2] - 1].text == ";" and (not owners or got[0] == first and tokens[got[1] + 1].text == ";")):
                name, close, after = got
                opening = tokens[after - 1]
                end_line, end = opening.line, opening.end
                comment = comments.get(at)
                doc = _clean_block(comment.text) if comment and comment.kind == "doc" and _last_line(comment) >= tokens[at].line - 1 else None
                kept = [t for t in tokens[first:name] if not (t.kind == "id" and t.text in MODIFIERS)]
                hint = tokens[close + 1 : got[2] - 1]
                returns = text[kept[0].start : kept[-1].end] if kept and lang == "java" else text[hint[1].start : hint[-1].end] if lang == "script" and len(hint) > 1 else ""
                opened = next(k for k in range(name + 1, close + 1) if tokens[k].text == "(")
                named = tokens[name] if tokens[name].kind == "id" else tokens[next(k for k in range(name, first - 1, -1) if tokens[k].text == "<") - 1]
                out.append(Function(named.text, owners[-1][1] if owners else "", tokens[first].line, named.line, end_line, _split(tokens, opened + 1, close, text), returns, doc, tokens[first].start, end))
                if opening.text == "{":
                    end = _body(lang, text, opening.end, tokens[first].column)
                    stream.go(after, end)
                    out[-1] = out[-1]._replace(end_line=stream.line, end=end)
                at, begins = after, True
                continue
        if t.text == "{":
            depth += 1
        elif t.text == "}":
            depth = max(0, depth - 1)
            while owners and owners[-1][0] >= depth:
                owners.pop()
        begins = t.kind == "op" and t.text in "{};" or begins and t.text == "@"
        at += 1
    return out


_INSIDE = re.compile(
    r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\r\n]*|"(?:[^"\\\r\n]|\\.)*"?|'(?:[^'\\\r\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?
    |(?P<brace>[{}])|(?:\r\n|\n|\r)(?P<indent>[ \t\f\v]*)(?=[^\W\d]|@)""",
    re.X | re.S,
)


def _body(lang: str, text: str, pos: int, column: int) -> int:
    """Where the body that opens before ``pos`` ends: by its braces, or before a header that stands no deeper than ``column``."""
    depth = 1
    for m in _INSIDE.finditer(text, pos):
        kind = m.lastgroup
        if kind == "brace":
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return m.end()
        elif kind == "indent" and m.end() - m.start("indent") <= column:
            ahead = _Stream(text, _TOKEN, m.end())
            if ahead.more() and ahead.tokens[0].text not in NO_START and _header(lang, ahead, 0):
                return _last_token(text, pos, m.start())
    return _last_token(text, pos, len(text))


_PY_INSIDE = re.compile(
    r"""(?P<comment>\#[^\r\n]*)|(?P<str>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:[^"\\\r\n]|\\.)*"?|'(?:[^'\\\r\n]|\\.)*'?)
    |(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<joined>\\(?:\r\n|\n|\r))|(?P<nl>\r\n|\n|\r)""",
    re.X | re.S,
)
_PY_START = re.compile(r"(?:[ \t\f\v\ufeff]|\\(?:\r\n|\n|\r))*(?:(?P<class>class\b(?:[ \t\f\v]|\\(?:\r\n|\n|\r))+(?P<name>[^\W\d]\w*))|(?P<def>(?:def|async)\b)|(?P<else>[^\s#]))")
_PY_AGAIN = re.compile(r"[ \t\f\v\ufeff]{0,8}(?:def\b|class\b|@)")


def _flat(stream: _Stream) -> None:
    """Fill a stream with a header, its docstring and the token after: line ends inside brackets part nothing and are left out."""
    depth, k, lines, rest = 0, 0, 0, -1
    while k < len(stream.tokens) or stream.more():
        t = stream.tokens[k]
        if t.kind == "nl":
            if depth > 0 and not _PY_AGAIN.match(stream.text, t.end):
                del stream.tokens[k]
                continue
            depth, lines = 0, lines + 1
        elif t.kind == "op":
            depth = max(0, depth + (t.text in "([{") - (t.text in ")]}"))
        if lines and t.kind != "nl":
            rest += 1
            if rest == 0:
                k += 1
                if k >= len(stream.tokens):
                    stream.more()
                return
        k += 1


def _indented(text: str) -> list[Function]:
    out: list[Function] = []
    owners: list[tuple[int, str]] = []
    open_functions: list[tuple[int, int]] = []
    lines = text.count("\n") + text.count("\r") + 1
    line, bol, depth = 1, 0, 0
    last, last_line = 0, 1  # where the last token ends
    cut: int | None = None  # where the line's comment begins

    def start(pos: int) -> None:
        m = _PY_START.match(text, pos)
        if not m:
            return
        kind = m.lastgroup if m.lastgroup != "name" else "class"
        at = m.start(kind)
        column = at - max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) - 1
        while owners and owners[-1][0] >= column:
            owners.pop()
        while open_functions and open_functions[-1][0] >= column:
            f = open_functions.pop()[1]
            out[f] = out[f]._replace(end_line=last_line, end=last)
        if kind == "class":
            owners.append((column, m.group("name")))
        elif kind == "def":
            stream = _Stream(text, _PY_TOKEN, at, line + len(_LINE_END.findall(text[pos:at])), at - column)
            _flat(stream)
            tokens = stream.tokens
            got = _header("python", stream, 0)
            if not got:
                return
            name, close, after = got
            hint = tokens[close + 1 : after]
            if hint and hint[-1].text == ":":
                hint = hint[:-1]
            k = after
            while k < len(tokens) and (tokens[k].kind == "nl" or tokens[k].text == ":" and k == after):
                k += 1
            doc = None
            if k < len(tokens) and tokens[k].kind == "str" and (k + 1 == len(tokens) or tokens[k + 1].kind == "nl"):
                m = re.match(r"[rRuU]?(\"\"\"|\'\'\'|\"|\')([\s\S]*?)(?:\1)?\Z", tokens[k].text)
                doc = m.group(2).strip() if m else None
            t = tokens[0]
            out.append(Function(tokens[name].text, owners[-1][1] if owners else "", t.line, tokens[name].line, lines, _split(tokens, name + 2, close, text), text[hint[2].start : hint[-1].end] if len(hint) > 2 else "", doc, t.start, len(text)))
            open_functions.append((column, len(out) - 1))

    start(0)
    for m in _PY_INSIDE.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif kind == "comment":
            cut = m.start()
        elif kind == "str":
            s = m.group()
            if "\n" in s or "\r" in s:
                line += len(_LINE_END.findall(s))
                bol = m.start() + max(s.rfind("\n"), s.rfind("\r")) + 1
        else:
            stop = cut if cut is not None else m.start()
            content = text[bol:stop].rstrip()
            if content:
                last, last_line = bol + len(content), line
            line, bol, cut = line + 1, m.end(), None
            if kind == "nl" and (depth <= 0 or _PY_AGAIN.match(text, m.end())):
                depth = 0
                start(m.end())
    return out


def extract(text: str | None, path: str = "", language: str | None = None) -> list[Function]:
    """The functions of a text, in order. The suffix of the path tells the language, else ``language``; other kinds give none."""
    lang = _SUFFIX.get(path.rsplit(".", 1)[-1].lower()) or _LANGUAGE.get((language or "").lower())
    if not text or lang is None:
        return []
    return _indented(text) if lang == "python" else _braced(text, lang)
