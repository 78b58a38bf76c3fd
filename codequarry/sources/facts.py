"""Facts out of source files: types, members, imports, calls, endpoints and the like, one row each.

``facts`` sends each file to the reader of its language in Arrow batches. Readers are plain functions from text to rows and
never fail: a file that can't be read gives one row of kind ``error``. Rows of all languages have one schema, so that they are
one table to join and count.
"""

from __future__ import annotations

import ast
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.files import LANGUAGES
from codequarry.tables import spread


class Fact(NamedTuple):
    kind: str
    name: str
    owner: str = ""
    target: str = ""
    detail: str = ""
    line: int = 0


SCHEMA = "repo_id string, path string, kind string, name string, owner string, target string, detail string, line int"

# ---- blanking of comments and strings, so that braces and words inside them count for nothing

_NOISE = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)|//[^\r\n]*|\"(?:[^\"\\\r\n]|\\.)*\"?|'(?:[^'\\\r\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?")


def _bare(text: str) -> str:
    """The text with comments and strings blanked, every line and column kept."""
    return _NOISE.sub(lambda m: re.sub(r"[^\r\n]", " ", m.group()), text)


def _lines(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]


def _line_of(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


def _scopes(bare: str, types: re.Pattern) -> tuple[list[tuple[int, int, str, str]], Callable[[int], str]]:
    """Types with their extents, and the innermost type around a place."""
    found = []
    for m in types.finditer(bare):
        opened = bare.find("{", m.end())
        if opened < 0 or ";" in bare[m.end() : opened]:
            continue
        depth, end = 0, len(bare)
        for b in re.finditer(r"[{}]", bare[opened:]):
            depth += 1 if b.group() == "{" else -1
            if not depth:
                end = opened + b.end()
                break
        found.append((m.start(), end, m.group("name"), m.group("kind"), bare[m.end() : opened], opened))
    around = lambda at: max((x for x in found if x[5] < at < x[1]), key=lambda x: x[0], default=(0, 0, "", ""))[2]
    return found, around


# Words that look like calls or names and are none.
_WORDS = frozenset("if for while switch catch return new else do try throw synchronized super this assert case function await yield typeof with".split())
_ACCESS = ("public", "protected", "private")
_JAVA_TYPE = re.compile(r"\b(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>[A-Za-z_$][\w$]*)")
_JAVA_METHOD = re.compile(r"(?:^|[;{}])\s*(?P<ann>(?:@[\w.]+(?:\s*\([^()]*\))?\s+)*)(?P<mods>(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*)(?:<[^>{}()]*>\s+)?(?P<type>[A-Za-z_$][\w$.]*(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*)\s+(?P<name>[A-Za-z_$][\w$]*)\s*\((?P<params>[^(){};]*)\)\s*(?:throws\s+[\w.,\s]+)?(?=[{;])")
_JAVA_FIELD = re.compile(r"(?:^|[;{}])\s*(?:@[\w.]+(?:\s*\([^()]*\))?\s+)*(?P<mods>(?:(?:public|protected|private|static|final|transient|volatile)\s+)+)(?P<type>[A-Za-z_$][\w$.]*(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:=[^;]*)?(?=;)")
_CALL = re.compile(r"(?:(?P<obj>[A-Za-z_$][\w$]*)\s*\.\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*\(")


def java(text: str) -> Iterator[Fact]:
    bare, starts = _bare(text), _lines(text)
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", bare)
    if package:
        yield Fact("package", package.group(1), line=_line_of(starts, package.start()))
    for m in re.finditer(r"\bimport\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", bare):
        yield Fact("edge", "IMPORTS", target=m.group(2), line=_line_of(starts, m.start()))
    types, around = _scopes(bare, _JAVA_TYPE)
    for start, _, name, kind, head, _ in types:
        abstract = re.search(r"\babstract\s+(?:\w+\s+)*$", bare[max(0, start - 60) : start])
        yield Fact("class", name, around(start), detail="abstract" if abstract and kind == "class" else kind.lstrip("@") if kind != "@interface" else "annotation", line=_line_of(starts, start))
        for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
            m = re.search(rf"\b{word}\s+([\w.,\s<>?&]+?)(?=\bimplements\b|\bpermits\b|$)", head)
            for parent in re.split(r",(?![^<]*>)", m.group(1)) if m else ():
                yield Fact("edge", edge, name, re.sub(r"<.*", "", parent, flags=re.S).strip(), line=_line_of(starts, start))
    for m in _JAVA_METHOD.finditer(bare):
        if m.group("type") in _WORDS or m.group("name") in _WORDS or not around(m.start("name")):
            continue
        made = m.group("type") in _ACCESS  # no type of its own: a constructor
        yield Fact("constructor" if made else "method", m.group("name"), around(m.start("name")), "" if made else m.group("type"), re.sub(r"\s+", " ", text[m.start("params") : m.end("params")]).strip(), _line_of(starts, m.start("name")))
    for m in _JAVA_FIELD.finditer(bare):
        if around(m.start("name")):
            yield Fact("field", m.group("name"), around(m.start("name")), m.group("type"), m.group("mods").strip(), _line_of(starts, m.start("name")))
    for m in _CALL.finditer(bare):
        before = bare[max(0, m.start() - 24) : m.start()]
        word = re.search(r"([\w>\]]+)[ \t]+$|(@)$", before)  # a type before the name makes it a declaration
        if m.group("name") not in _WORDS and (not word or word.group(1) in ("return", "throw", "else", "case", "assert", "yield", "do")):
            yield Fact("edge", "CALLS", around(m.start()), f"{m.group('obj') or '?'}#{m.group('name')}", line=_line_of(starts, m.start()))
    yield from endpoints(text, bare, starts, around)
    yield from resources(text, bare, starts, around)
    yield from concurrency(bare, starts, around)


def endpoints(text: str, bare: str, starts: list[int], around: Callable[[int], str]) -> Iterator[Fact]:
    """HTTP endpoints of mapping annotations and of paths with verbs, the class's prefix joined with the method's path."""
    prefix = {}
    mapping = re.compile(r"@(?P<verb>Get|Post|Put|Delete|Patch|Request)Mapping\b(?:\s*\((?P<args>[^)]*)\))?")
    for m in mapping.finditer(text):
        if bare[m.start()] != "@":
            continue
        path = re.search(r"\"([^\"]*)\"", m.group("args") or "")
        path = path.group(1) if path else ""
        owner = around(m.start())
        if not owner:
            after = _JAVA_TYPE.search(bare, m.end())
            if after:
                prefix[after.group("name")] = path
            continue
        verb = re.search(r"RequestMethod\.(\w+)", m.group("args") or "")
        method = re.compile(r"([A-Za-z_$][\w$]*)\s*\(").search(bare, re.compile(r"\s*\)?").match(bare, m.end()).end())
        full = "/" + "/".join(x.strip("/") for x in (prefix.get(owner, ""), path) if x.strip("/"))
        variables = ",".join(re.findall(r"\{(\w+)(?::[^}]*)?\}", full))
        yield Fact("endpoint", f"{verb.group(1) if verb else 'GET' if m.group('verb') == 'Request' else m.group('verb').upper()} {full}", owner, method.group(1) if method else "", variables, _line_of(starts, m.start()))


_VERB = re.compile(r"@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b")
_PATH = re.compile(r"@Path\s*\(\s*(?:value\s*=\s*)?\"([^\"]*)\"")
_NAME = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")


def resources(text: str, bare: str, starts: list[int], around: Callable[[int], str]) -> Iterator[Fact]:
    """HTTP endpoints of methods with a verb's annotation; paths stand on the class and, in any order with the verb, on the method."""
    prefix, own = {}, []
    for m in _PATH.finditer(text):
        if bare[m.start()] != "@":
            continue
        if around(m.start()):
            own.append((m.start(), m.group(1)))
        elif after := _JAVA_TYPE.search(bare, m.end()):
            prefix[after.group("name")] = m.group(1)
    for m in _VERB.finditer(bare):
        owner = around(m.start())
        if not owner:
            continue
        begins = max(bare.rfind(c, 0, m.start()) for c in ";{}")
        ends = min((x for x in (bare.find("{", m.end()), bare.find(";", m.end())) if x >= 0), default=len(bare))
        path = next((p for at, p in own if begins < at < ends), "")
        plain = re.sub(r"@[\w.]+(?:\s*\([^()]*\))?", lambda x: " " * len(x.group()), bare[m.start() : ends])
        method = _NAME.search(plain)
        full = "/" + "/".join(x.strip("/") for x in (prefix.get(owner, ""), path) if x.strip("/"))
        yield Fact("endpoint", f"{m.group(1)} {full}", owner, method.group(1) if method else "", ",".join(re.findall(r"\{(\w+)(?::[^}]*)?\}", full)), _line_of(starts, m.start()))


_POOLS = r"ExecutorService|ScheduledExecutorService|ThreadPoolExecutor|ForkJoinPool|Executor"
_LOCKS = r"ReentrantLock|ReadWriteLock|ReentrantReadWriteLock|StampedLock|Lock|Semaphore|CountDownLatch"


def concurrency(bare: str, starts: list[int], around: Callable[[int], str]) -> Iterator[Fact]:
    """Thread pools, locks, volatile fields, synchronized methods and asynchronous results."""
    for fact, pattern in (
        ("thread_pool", rf"\b(?:{_POOLS})\s+(?P<name>\w+)\s*[=;]"), ("lock_field", rf"\b(?:{_LOCKS})\s+(?P<name>\w+)\s*[=;]"), ("volatile_field", r"\bvolatile\s+[\w<>.]+\s+(?P<name>\w+)\s*[=;]"),
        ("synchronized_method", r"\bsynchronized\s+[\w<>.\[\]]+\s+(?P<name>\w+)\s*\("), ("async_method", r"@Async\b[^;{]*?\b(?P<name>\w+)\s*\("), ("async_method", r"\b(?:CompletableFuture|CompletionStage|Future|Mono|Flux)\s*<[^;{}()]*>\s+(?P<name>\w+)\s*\("),
    ):
        for m in re.finditer(pattern, bare):
            yield Fact("concurrency", m.group("name"), around(m.start()), detail=fact, line=_line_of(starts, m.start()))


def python(text: str) -> Iterator[Fact]:
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield Fact("error", "syntax")
        yield from _python_lines(text)
        return
    if any(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in module.body):
        yield Fact("class", "<module>", detail="module", line=1)
    stack: list[tuple[ast.AST, str]] = [(x, "") for x in reversed(module.body)]
    while stack:
        node, owner = stack.pop()
        if isinstance(node, ast.ClassDef):
            yield Fact("class", node.name, owner, detail="class", line=node.lineno)
            for base in node.bases:
                yield Fact("edge", "EXTENDS", node.name, ast.unparse(base), line=node.lineno)
            stack += [(x, node.name) for x in reversed(node.body)]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            names = [x.arg + (f": {ast.unparse(x.annotation)}" if x.annotation else "") for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")]
            yield Fact("method", node.name, owner or "<module>", ast.unparse(node.returns) if node.returns else "", ", ".join(names), node.lineno)
            for call in ast.walk(node):
                if isinstance(call, ast.Call):
                    f = call.func
                    target = f"{ast.unparse(f.value)}#{f.attr}" if isinstance(f, ast.Attribute) else f"?#{f.id}" if isinstance(f, ast.Name) else None
                    if target:
                        yield Fact("edge", "CALLS", f"{owner or '<module>'}#{node.name}", target, line=call.lineno)
        elif isinstance(node, ast.Import):
            for x in node.names:
                yield Fact("edge", "IMPORTS", target=x.name, line=node.lineno)
        elif isinstance(node, ast.ImportFrom):
            for x in node.names:
                yield Fact("edge", "IMPORTS", target=f"{'.' * node.level}{node.module or ''}.{x.name}".lstrip(".") if not node.level else f"{'.' * node.level}{node.module or ''}.{x.name}", line=node.lineno)
        elif isinstance(node, (ast.AnnAssign, ast.Assign)) and owner:
            for x in [node.target] if isinstance(node, ast.AnnAssign) else node.targets:
                if isinstance(x, ast.Name):
                    yield Fact("field", x.id, owner, ast.unparse(node.annotation) if isinstance(node, ast.AnnAssign) else "", line=node.lineno)
        elif isinstance(node, (ast.If, ast.Try, ast.With)):
            stack += [(x, owner) for x in reversed(node.body)]


def _python_lines(text: str) -> Iterator[Fact]:
    """What single lines of a broken Python file still tell."""
    owner, indent = "", 0
    for n, line in enumerate(re.split(r"\r\n|\n|\r", text), 1):
        m = re.match(r"(\s*)(class|def|async def)\s+(\w+)", line)
        if m and m.group(2) == "class":
            owner, indent = m.group(3), len(m.group(1))
            yield Fact("class", owner, detail="class", line=n)
        elif m:
            yield Fact("method", m.group(3), owner if len(m.group(1)) > indent else "<module>", line=n)
        elif m := re.match(r"\s*(?:from\s+([\w.]+)\s+import\s+(\w+)|import\s+([\w.]+))", line):
            yield Fact("edge", "IMPORTS", target=m.group(3) or f"{m.group(1)}.{m.group(2)}", line=n)


_SCRIPT_TYPE = re.compile(r"\b(?P<kind>class|interface|enum)\s+(?P<name>[A-Za-z_$][\w$]*)")
_SCRIPT_METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|readonly|async|override|abstract|get|set)\s+)*\*?(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>{}()]*>)?\((?P<params>(?:[^(){};]|\([^()]*\))*)\)\s*(?::\s*(?P<type>[^{};=]+?))?\s*(?=\{)")
_SCRIPT_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*\((?P<params>[^(){};]*)\)\s*(?::\s*(?P<type>[^{};=]+?))?\s*(?=\{)")


def script(text: str) -> Iterator[Fact]:
    bare, starts = _bare(text), _lines(text)
    types, around = _scopes(bare, _SCRIPT_TYPE)
    for m in re.finditer(r"\bimport\s+(?:(?P<what>[^'\";]*?)\s+from\s+)?['\"](?P<path>[^'\"]+)['\"]|\brequire\(\s*['\"](?P<req>[^'\"]+)['\"]", text):
        names = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\bas\s+\w+|\btype\b", "", m.group("what") or ""))
        for name in names or [""]:
            yield Fact("edge", "IMPORTS", target=(m.group("path") or m.group("req")) + (f"#{name}" if name else ""), line=_line_of(starts, m.start()))
    for start, _, name, kind, head, _ in types:
        yield Fact("class", name, around(start), detail="abstract_class" if re.search(r"\babstract\s+$", bare[max(0, start - 12) : start]) else kind, line=_line_of(starts, start))
        for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
            m = re.search(rf"\b{word}\s+([\w.,\s]+?)(?=\bimplements\b|$|<)", head)
            for parent in m.group(1).split(",") if m else ():
                if parent.strip():
                    yield Fact("edge", edge, name, parent.strip(), line=_line_of(starts, start))
    seen = set()
    for pattern in (_SCRIPT_FUNCTION, _SCRIPT_METHOD):
        for m in pattern.finditer(bare):
            at = m.start("name")
            if m.group("name") in _WORDS or at in seen or pattern is _SCRIPT_METHOD and not around(at):
                continue
            seen.add(at)
            yield Fact("method", m.group("name"), around(at) or "<module>", (m.group("type") or "").strip(), re.sub(r"\s+", " ", text[m.start("params") : m.end("params")]).strip(), _line_of(starts, at))
    for m in re.finditer(r"@wire\(\s*(\w+)(?:\s*,\s*\{([^}]*)\})?", text):
        yield Fact("edge", "CALLS", around(m.start()), m.group(1), "wire", _line_of(starts, m.start()))
        for obj in re.findall(r"objectApiName\s*:\s*['\"]?(\w+)", m.group(2) or ""):
            yield Fact("edge", "QUERIES", around(m.start()), obj, "wire", _line_of(starts, m.start()))


_CPP_TYPE = re.compile(r"\b(?P<kind>class|struct)\s+(?:\w+_API\s+)?(?P<name>[A-Za-z_]\w*)(?=\s*(?:final\s*)?(?::[^:{;]|\{))")
_CPP_METHOD = re.compile(r"(?:^|[;{}:\n])\s*(?:(?:virtual|static|inline|explicit|constexpr|friend)\s+)*(?P<type>[A-Za-z_][\w:]*(?:\s*<[^;{}()]*>)?[\s*&]+)(?P<name>(?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\((?P<params>[^(){};]*)\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:=\s*0\s*)?(?=[{;])")


def cpp(text: str) -> Iterator[Fact]:
    bare, starts = _bare(text), _lines(text)
    for m in re.finditer(r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", text):
        yield Fact("edge", "IMPORTS", target=m.group(1), line=_line_of(starts, m.start()))
    spaces = [(m.start(), m.group(1)) for m in re.finditer(r"\bnamespace\s+([\w:]+)\s*\{", bare)]
    types, around = _scopes(bare, _CPP_TYPE)
    for start, _, name, kind, head, _ in types:
        template = re.search(r"\btemplate\s*<[^;{}]*>\s*$", bare[max(0, start - 120) : start])
        space = "::".join(x for at, x in spaces if at < start)
        yield Fact("class", f"{space}::{name}" if space else name, around(start), detail=("template_" if template else "") + kind, line=_line_of(starts, start))
        for parent in re.findall(r"(?:public|protected|private)?\s*([A-Za-z_][\w:]*)(?:<[^,]*>)?\s*(?:,|$)", head.lstrip(" :")) if ":" in head else ():
            yield Fact("edge", "EXTENDS", name, parent, line=_line_of(starts, start))
    for m in _CPP_METHOD.finditer(bare):
        if m.group("name").split("::")[-1] not in _WORDS and m.group("type").strip() not in ("return", "else", "new", "delete"):
            scope, _, name = m.group("name").rpartition("::")
            yield Fact("method", name, scope or around(m.start("name")) or "<module>", m.group("type").strip(), m.group("params").strip(), _line_of(starts, m.start("name")))
    for fact, pattern in (("thread", r"\bstd::j?thread\b"), ("mutex", r"\bstd::(?:\w*mutex|lock_guard|unique_lock|scoped_lock)\b"), ("atomic", r"\bstd::atomic\b"), ("async", r"\bstd::(?:async|future|promise)\b")):
        seen = set()
        for m in re.finditer(pattern, bare):
            if fact != "async" or m.group() not in seen:  # of each asynchronous type the first place tells enough
                seen.add(m.group())
                yield Fact("concurrency", m.group(), detail=fact, line=_line_of(starts, m.start()))


_APEX_TYPE = re.compile(r"\b(?P<kind>class|interface|enum|trigger)\s+(?P<name>[A-Za-z_]\w*)", re.I)


def apex(text: str) -> Iterator[Fact]:
    bare, starts = _bare(text), _lines(text)
    types, around = _scopes(bare, _APEX_TYPE)
    for start, _, name, kind, head, _ in types:
        before = bare[max(0, start - 80) : start]
        sharing = re.search(r"\b(with|without|inherited)\s+sharing\b", before, re.I)
        test = re.search(r"@isTest\b", text[max(0, start - 80) : start], re.I)
        yield Fact("class", name, around(start), sharing.group().lower() if sharing else "", "test_class" if test else "abstract_class" if re.search(r"\babstract\b", before, re.I) else kind.lower(), _line_of(starts, start))
        if m := re.match(r"\s+on\s+(\w+)", head, re.I):
            yield Fact("edge", "USES", name, m.group(1), line=_line_of(starts, start))
        for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
            if m := re.search(rf"\b{word}\s+([\w.,\s]+?)(?=\bimplements\b|$)", head, re.I):
                for parent in m.group(1).split(","):
                    yield Fact("edge", edge, name, parent.strip(), line=_line_of(starts, start))
    for m in _JAVA_METHOD.finditer(bare):
        if m.group("type") not in _WORDS and around(m.start("name")):
            yield Fact("method", m.group("name"), around(m.start("name")), m.group("type"), m.group("params").strip(), _line_of(starts, m.start("name")))
    for m in _JAVA_FIELD.finditer(bare):
        if around(m.start("name")):
            yield Fact("field", m.group("name"), around(m.start("name")), m.group("type"), m.group("mods").strip(), _line_of(starts, m.start("name")))
    for m in re.finditer(r"\[\s*SELECT\b[^\]]*?\bFROM\s+(\w+)", text, re.I):
        yield Fact("edge", "QUERIES", around(m.start()), m.group(1), line=_line_of(starts, m.start()))


def abap(text: str) -> Iterator[Fact]:
    starts, owner = _lines(text), ""
    code = re.sub(r"(?m)^\*.*$|\".*$", lambda m: " " * len(m.group()), text)
    for m in re.finditer(r"(?im)^\s*CLASS\s+(\w+)\s+DEFINITION\b([^.]*)\.", code):
        detail = "abstract" if re.search(r"\bABSTRACT\b", m.group(2), re.I) else "class"
        yield Fact("class", m.group(1).upper(), detail=detail, line=_line_of(starts, m.start(1)))
        if parent := re.search(r"\bINHERITING\s+FROM\s+(\w+)", m.group(2), re.I):
            yield Fact("edge", "EXTENDS", m.group(1).upper(), parent.group(1).upper(), line=_line_of(starts, m.start(1)))
    queried = set()
    for m in re.finditer(r"(?im)^\s*(?:CLASS\s+(?P<cls>\w+)\s+IMPLEMENTATION|METHOD\s+(?P<mth>[\w~]+)|FORM\s+(?P<form>\w+)|FUNCTION\s+(?P<fun>\w+))|\b(?:PERFORM\s+(?P<perf>\w+)|CALL\s+FUNCTION\s+'(?P<call>[^']+)'|GET\s+BADI\s+(?P<badi>\w+)|INCLUDE\s+(?P<inc>\w+)\s*\.)|\b(?:SELECT\b[^.]*?\bFROM|INSERT\s+INTO|INSERT|UPDATE|MODIFY|DELETE\s+FROM)\s+\(?(?P<tab>\w+)", code):
        line = _line_of(starts, m.start())
        if m.group("cls"):
            owner = m.group("cls").upper()
        elif m.group("mth") or m.group("form") or m.group("fun"):
            queried = set()
            yield Fact("method", (m.group("mth") or m.group("form") or m.group("fun")).upper(), owner or "<program>", line=line)
        elif target := m.group("perf") or m.group("call") or m.group("badi") or m.group("inc"):
            yield Fact("edge", "CALLS", owner, target.upper(), line=line)
        elif m.group("tab") and m.group("tab").upper() not in queried:
            queried.add(m.group("tab").upper())
            yield Fact("edge", "QUERIES", owner, m.group("tab").upper(), line=line)


def component_name(tag: str) -> str:
    """The component of a custom tag: ``c-my-part`` is c/myPart, ``ns:part`` is ns/part."""
    space, _, rest = tag.partition(":") if ":" in tag else tag.partition("-")
    words = rest.split("-")
    return f"{space}/{words[0]}{''.join(w[:1].upper() + w[1:] for w in words[1:])}"


def markup(text: str) -> Iterator[Fact]:
    """Child components, event handlers, directives, links and forms of templates."""
    starts, seen = _lines(text), set()
    for m in re.finditer(r"<([a-zA-Z]+(?:[-:][\w-]+)+)\b", text):
        if m.group(1) not in seen:
            seen.add(m.group(1))
            yield Fact("edge", "USES", target=component_name(m.group(1)), line=_line_of(starts, m.start()))
    for kind, pattern in (("event", r"\bon(\w+)\s*=\s*[{\"]"), ("directive", r"\b((?:if|for|iterator|lwc):[\w:]+|aura:\w+)\s*="), ("link", r"\bhref\s*=\s*[\"']([^\"'#{][^\"']*)[\"']"), ("form", r"\baction\s*=\s*[\"']([^\"'{]+)[\"']")):
        for name in dict.fromkeys(re.findall(pattern, text)):
            yield Fact(kind, name)


_NS = re.compile(r"\{[^}]*\}")


def xml(text: str) -> Iterator[Fact]:
    """Flows, objects, permissions and build files by the name of their root."""
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text.lstrip("﻿ \r\n\t")))
    except ET.ParseError:
        yield Fact("error", "xml")
        return
    for x in root.iter():
        if isinstance(x.tag, str):
            x.tag = _NS.sub("", x.tag)
    get = lambda node, name: (node.findtext(name) or "").strip()
    kind = root.tag
    if kind == "Flow":
        yield Fact("class", get(root, "label") or "flow", detail="flow")
        for tag, field, edge in (("actionCalls", "actionName", "CALLS"), ("subflows", "flowName", "CALLS"), ("recordLookups", "object", "QUERIES"), ("recordCreates", "object", "QUERIES"), ("recordUpdates", "object", "QUERIES"), ("recordDeletes", "object", "QUERIES"), ("screens", "name", "USES")):
            for node in root.findall(tag):
                if get(node, field):
                    yield Fact("edge", edge, target=get(node, field), detail=tag)
        for node in root.findall("start"):
            if get(node, "triggerType"):
                yield Fact("annotation", get(node, "triggerType"), target=get(node, "object"))
    elif kind in ("CustomObject", "CustomField"):
        if kind == "CustomObject":
            yield Fact("class", get(root, "label") or "object", detail="sobject")
        for node in root.findall("fields") if kind == "CustomObject" else [root]:
            yield Fact("field", get(node, "fullName"), target=get(node, "type"), detail="required" if get(node, "required") == "true" else "")
            if get(node, "referenceTo"):
                yield Fact("edge", "REFERENCES", get(node, "fullName"), get(node, "referenceTo"))
    elif kind in ("PermissionSet", "Profile"):
        yield Fact("class", get(root, "label") or kind.lower(), detail="permission_set" if kind == "PermissionSet" else "profile")
        for tag, name, test in (("classAccesses", "apexClass", "enabled"), ("objectPermissions", "object", "allowRead"), ("flowAccesses", "flow", "enabled"), ("pageAccesses", "apexPage", "enabled")):
            for node in root.findall(tag):
                if get(node, test) == "true":
                    yield Fact("edge", "GRANTS", target=get(node, name), detail=tag)
        for node in root.findall("fieldPermissions"):
            rights = "+".join(r for r, t in (("r", "readable"), ("w", "editable")) if get(node, t) == "true")
            if rights:
                yield Fact("annotation", f"@field({get(node, 'field')}:{rights})")
    elif kind == "project":
        yield Fact("build", "maven", target=get(root, "artifactId"))
        for node in root.iter("module"):
            yield Fact("module", (node.text or "").strip())
        for node in root.iter("dependency"):
            yield Fact("edge", "DEPENDS_ON", target=f"{get(node, 'groupId')}:{get(node, 'artifactId')}")
    else:
        yield Fact("class", kind, detail="xml")


READERS: dict[str, Callable[[str], Iterator[Fact]]] = {"java": java, "python": python, "javascript": script, "typescript": script, "cpp": cpp, "apex": apex, "abap": abap, "markup": markup, "xml": xml}

# Marker files of build systems, the first in order that a repository has decides.
BUILD_MARKERS = (("settings.gradle", "gradle"), ("settings.gradle.kts", "gradle"), ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"), ("pom.xml", "maven"), ("sfdx-project.json", "sfdx"), ("CMakeLists.txt", "cmake"), ("package.json", "npm"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("Cargo.toml", "cargo"), ("go.mod", "go"), ("Makefile", "make"))


def build_system(files: DataFrame) -> DataFrame:
    """(repo_id, build_tool): by the first marker file in order, ``unknown`` without any. files: repo_id, path."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(*[F.when(name == marker, k) for k, (marker, _) in enumerate(BUILD_MARKERS)])
    tools = F.array(*[F.lit(tool) for _, tool in BUILD_MARKERS])
    return files.groupBy("repo_id").agg(F.min(rank).alias("k")).select("repo_id", F.coalesce(F.get(tools, F.col("k")), F.lit("unknown")).alias("build_tool"))


def read_facts(path: str, text: str | None) -> list[Fact]:
    """The facts of one file; other languages and null texts have none, a reader's failure is one fact."""
    reader = READERS.get(LANGUAGES.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", ""))
    if reader is None or not text:
        return []
    try:
        found = list(reader(text))
        if path.endswith(".field-meta.xml"):  # a field by itself belongs to the object that its grandparent folder is named after
            above = path.split("/")[-3:-2]
            found = [f._replace(owner=above[0]) if above and f.kind == "field" else f._replace(owner=f"{above[0]}.{f.owner}") if above and f.name == "REFERENCES" else f for f in found]
        return found
    except Exception as e:  # noqa: BLE001 - one broken file must not end the job
        return [Fact("error", type(e).__name__)]


def _facts(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = [(repo, path, *f) for repo, path, text in zip(pdf["repo_id"].tolist(), pdf["path"].tolist(), pdf["content"].tolist()) for f in read_facts(path, text)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"line": "int32"})


def facts(files: DataFrame) -> DataFrame:
    """The facts of ``files`` (repo_id, path, content), one row each. Null paths and texts have none."""
    return spread(files.select("repo_id", "path", "content").where("path is not null and content is not null")).mapInPandas(_facts, SCHEMA)
