"""Functions paired with their documentation comment, trivial documentation dropped.

Symbols and files meet by (repo_id, file_path) in one join; each file is parsed once, for all of its methods. A comment's
sentences are judged one by one: what remains of a sentence after the words of the method's own name, parameters and types,
empty tags, placeholders and closed-class words must still say something. The corpus judges what is left: sentences with own
words replaced by slots are templates, counted by their hashes, and a template that stands above too large a share of all
documented methods tells nothing about any of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.functions import extract
from codequarry.tables import cut, read

#: Share of documented methods above which a template is dropped; that of one that holds the method's whole name.
TEMPLATE_SHARE, NAMED_SHARE = 0.1, 0.01
#: Different names that a template must have in any case to be dropped, as few methods make no corpus.
TEMPLATE_LEAST = 20

# Closed-class and generic words of documentation, and words of placeholders.
GENERIC = frozenset(
    "a an the this that these those it its of to for from in on at by with as is are be was were will and or which who whose used use uses using method methods function functions routine procedure constructor getter setter "
    "get gets set sets return returns returned returning value values param params parameter parameters argument arguments arg args given specified provided passed object instance result results type types class new current "
    "performs perform does do doing done executes execute handles handle implementation implements helper utility some any please here self void none null string int integer long double float boolean bool list map optional".split()
)
PLACEHOLDER = frozenset(
    "todo fixme tbd tba xxx hack wip description describe described desc insert add added fill document documented documents documentation docs doc docstring comment comments placeholder stub auto generated autogenerated generate javadoc jsdoc "
    "non inheritdoc inherit inherited see super goes go put text later missing undocumented na n me write lorem ipsum".split()
)
_TAG = re.compile(r"(?m)^\s*[@:\\](\w+):?[ \t]*(.*(?:\n(?!\s*[@:\\]\w).*)*)")
_SKIPPED_TAGS = frozenset("author since version see inheritdoc inheritDoc override date copyright serial generated category".split())
_NAMED_TAGS = frozenset("param arg argument type property throws exception raises".split())
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def parts(name: str) -> list[str]:
    """The words of an identifier, in lower case."""
    return [w.lower() for w in _PART.findall(name or "")]


class _Own:
    """The words of a method's name, parameters and types; a word restates one if it is it, but for an ending."""

    def __init__(self, words: set[str]):
        self.words = words
        self.stems = tuple({o[: max(3, len(o) - 1)] for o in words if len(o) >= 3})

    def has(self, word: str) -> bool:
        if word in self.words:
            return True
        return word.startswith(self.stems) and any(len(o) >= 3 and len(word) - len(o) <= 3 and word.startswith(o[: max(3, len(o) - 1)]) for o in self.words)


def sentences(doc: str) -> list[str]:
    """The sentences of a comment, those of its tags without the tag; author, version and inheritance marks are left out."""
    if "\r" in doc:
        doc = re.sub(r"\r\n?", "\n", doc)
    low = doc.lower()
    if "inheritdoc" in low or "non-javadoc" in low:
        doc = re.sub(r"(?i)\{?@inheritdoc\}?|\(non-javadoc\)", " ", doc)
    if "{@" in doc:
        doc = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", doc)
    if not any(c in doc for c in "@:\\"):
        return [s.strip() for s in _SENTENCE.split(doc) if s.strip()]
    out = []
    for m in _TAG.finditer(doc):
        if m.group(1) in _SKIPPED_TAGS:
            continue
        rest = m.group(2)
        if m.group(1) in _NAMED_TAGS:
            rest = re.sub(r"^\s*(\{[^}]*\}\s*)?\[?[\w.$]+\]?\s*[-:]?\s*", "", rest)
        out.append(rest)
    plain = _TAG.sub("\n\n", doc)
    return [s.strip() for x in [plain, *out] for s in _SENTENCE.split(x) if s.strip()]


@lru_cache(maxsize=20_000)
def _words(sentence: str) -> tuple[str, ...]:
    return tuple(w.lower() for token in _WORD.findall(sentence) for w in (_PART.findall(token) or [token]))


def residue(sentence: str, own: _Own) -> list[str]:
    """The words of a sentence that its method's own names, generic words and placeholders leave over."""
    return [w for w in _words(sentence) if len(w) > 1 and w not in GENERIC and w not in PLACEHOLDER and not own.has(w)]


def _in_order(named: list[str], words: list[str]) -> bool:
    """Whether words restate all of a name's words in their order."""
    spots = iter(words)
    return all(any(one.has(w) for w in spots) for one in [_Own({n}) for n in named])


def judge(doc: str | None, name: str, parameters: list[str] | None, return_type: str | None) -> list[tuple[str, bool]]:
    """(template, named) of each sentence that says something by itself, ``named`` if it holds the method's whole name.

    A template is the sentence with the method's own words replaced by slots. No or blank documentation says nothing.
    """
    if not doc or not doc.strip():
        return []
    named = parts(name)
    own = _Own(set(named) | {w for p in [*(parameters or []), return_type or ""] for w in parts(p)})
    out = []
    for s in sentences(doc):
        if residue(s, own):
            words = parts(s)
            held = [own.has(w) for w in words]
            whole = len(named) > 1 and sum(held) >= len(named) and _in_order(named, [w for w, h in zip(words, held) if h])
            out.append((" ".join("_" if h else w for w, h in zip(words, held)), whole))
    return out


def hash64(template: str) -> int:
    return int.from_bytes(hashlib.blake2b(template.encode(), digest_size=8).digest(), "big", signed=True)


def _pairs(batches: Iterator, texts: bool) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = []
        for path, content, symbols in zip(pdf["file_path"].tolist(), pdf["content"].tolist(), pdf["symbols"].tolist()):
            found = {}
            for f in extract(content, path or ""):
                found.setdefault(f.name, []).append(f)
            for s in symbols:
                parameters = None if s["parameters"] is None else list(s["parameters"])
                code, doc = None, None
                if content is None:
                    lines = s["documentation"]
                    doc = None if lines is None else "\n".join(x for x in lines if x is not None)
                else:
                    f = _chosen(found.get(s["display_name"], ()), s["start_line"], s["type_of"], parameters)
                    if f:
                        code, doc = content[f.start : f.end], f.doc
                        parameters = parameters or f.parameters
                said = judge(doc, s["display_name"] or "", parameters, s["return_type"])
                if said:
                    rows.append((s["symbol_id"], s["display_name"], *((code, doc, parameters, s["return_type"]) if texts else (None,) * 4), [hash64(t) for t, _ in said], [whole for _, whole in said]))
        yield pd.DataFrame(rows, columns=["symbol_id", "display_name", "code", "documentation", "parameters", "return_type", "templates", "named"])


def _chosen(functions, line, owner: str | None, parameters: list[str] | None):
    """The function of a symbol among those of its name: by its line, else by owner and parameters, else the first."""
    if line is not None and line == line:
        return next((f for f in functions if f.line <= line <= f.name_line), None)
    rank = lambda f: (f.owner == owner, [p for p in f.parameters if p not in ("self", "cls")] == (parameters or []))
    return max(functions, key=rank, default=None)


_SCHEMA = "symbol_id long, display_name string, code string, documentation string, parameters array<string>, return_type string, templates array<long>, named array<boolean>"


def pairs(symbols: DataFrame, files: DataFrame, share: float = TEMPLATE_SHARE, named_share: float = NAMED_SHARE, least: int = TEMPLATE_LEAST, texts: bool = True) -> DataFrame:
    """(symbol_id, code, documentation, parameters, return_type) of each method whose documentation says something.

    symbols: symbol_id, kind, symbol, display_name, documentation, repo_id, file_path, start_line, parameters, return_type;
    files: repo_id, file_path, content. Other columns play no part. Repeated symbols and files count once. A symbol without a
    line is looked up by name, owner and parameters; one whose file or content is missing is judged by its own documentation
    and has null code, as is one without repo_id or file_path. Empty tables give no rows. Without ``texts`` only symbol_id is filled.
    """
    fields = F.struct("symbol_id", "display_name", "documentation", "start_line", "parameters", "return_type", F.regexp_extract(F.coalesce("symbol", F.lit("")), r"([\w$]+)#", 1).alias("type_of"))
    own = symbols.where("kind = 'method' and symbol_id is not null").select("repo_id", "file_path", fields.alias("symbol")).repartition("repo_id", "file_path").groupBy("repo_id", "file_path").agg(F.collect_set("symbol").alias("symbols"))
    contents = files.select("repo_id", "file_path", "content").repartition("repo_id", "file_path").groupBy("repo_id", "file_path").agg(F.max("content").alias("content"))
    met = own.join(contents, ["repo_id", "file_path"], "left")  # both sides lie by these keys already
    judged = met.select("file_path", "content", "symbols").mapInPandas(lambda batches: _pairs(batches, texts), _SCHEMA)
    return _settle(judged, share, named_share, least)


def _settle(judged: DataFrame, share: float, named_share: float, least: int) -> DataFrame:
    """Keep the methods with a template that isn't too common."""
    judged = cut(judged)
    each = judged.select("display_name", F.inline(F.arrays_zip("templates", "named")))
    by_name = each.groupBy("templates", "display_name").agg(F.count("*").alias("n"), F.max("named").alias("named"))
    counts = by_name.groupBy("templates").agg(F.sum("n").alias("n"), F.count("*").alias("names"), F.max("named").alias("named"))
    bound = F.when(F.col("named"), named_share).otherwise(share) * F.col("all")
    common = counts.crossJoin(F.broadcast(judged.agg(F.count("*").alias("all")))).where((F.col("n") > bound) & (F.col("names") > least))
    dropped = common.agg(F.collect_list("templates").alias("dropped"))  # one row; its length is bounded by the shares
    kept = judged.crossJoin(F.broadcast(dropped)).where(F.size(F.array_except("templates", "dropped")) > 0)
    return kept.drop("templates", "named", "dropped", "display_name")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "symbols"), read(spark, sf_dir, "source_files", "repo_id", "file_path", "content")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods whose documentation tells a reader something."""
    return pairs(*_inputs(spark, sf_dir), texts=False).select("symbol_id").distinct()


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of each such method."""
    return pairs(*_inputs(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs}
SQL: dict[str, str] = {}
