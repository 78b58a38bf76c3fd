"""Rules in words: a sentence compiles to a small tree, and the tree to a plan over the tables of a code graph.

Nothing of the sentence is ever run as text; its names are literals of the plan. A sentence that fits no phrasing compiles to None.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.detectors import CodeGraph


@dataclass(frozen=True)
class Sentence:
    """kind: one of ``PLANS``; subject and object: the names that the sentence gives."""

    kind: str
    subject: str = ""
    object: str = ""


_QUOTED = r"['\"]?(?P<{}>\w+)['\"]?"
_S, _O, _A = _QUOTED.format("subject"), _QUOTED.format("object"), r"@?(?P<object>\w+)"
# The six phrasings that compile, whatever their case.
PHRASINGS = {
    "path": rf"(?:(?:services?|classes?) in )?{_S} module must not (?:directly )?call {_O}(?: module)?",
    "imports": rf"(?:the )?{_S} layer must not depend on (?:the )?{_O}(?: layer)?",
    "annotated": rf"all class(?:es)? in {_S} module must have annotation {_A}",
    "controllers": r"controllers? must not (?:directly )?call repositor(?:y|ies)(?: directly)?",
    "extends": rf"services? class(?:es)? must not extend {_A}",
    "public": rf"all public methods? in {_S} must (?:be )?annotated with {_A}",
}
#: Steps of imports and calls that a forbidden path may have.
HOPS = 3


def compile_sentence(text: str | None) -> Sentence | None:
    """The tree of a sentence; None of null, empty and other texts."""
    s = re.sub(r"\s+", " ", (text or "").strip().rstrip("."))
    for kind, pattern in PHRASINGS.items():
        m = re.fullmatch(pattern, s, re.I)
        if m:
            names = m.groupdict()
            return Sentence(kind, names.get("subject") or "", names.get("object") or "")
    return None


def _uses(g: CodeGraph) -> DataFrame:
    """(repo_id, source, target): imports, and calls of methods taken as their classes'."""
    owner = lambda c: F.substring_index(c, "#", 1)
    called = g.calls.select("repo_id", owner("caller").alias("source"), owner("callee").alias("target"))
    return g.of("IMPORTS").unionByName(called).where("source <> target").distinct()


def _reaching(g: CodeGraph, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Those of ``sources`` (repo_id, fqn) from which one of ``targets`` is at most ``HOPS`` uses away, walked back from the targets."""
    step = _uses(g)
    front, found = targets.select("repo_id", "fqn").distinct(), []
    for _ in range(HOPS):
        front = front.join(step.withColumnRenamed("target", "fqn"), ["repo_id", "fqn"]).select("repo_id", F.col("source").alias("fqn")).distinct()
        found.append(front)
    return sources.select("repo_id", "fqn").distinct().join(reduce(DataFrame.unionByName, found), ["repo_id", "fqn"], "left_semi")


def _module(g: CodeGraph, name: str) -> DataFrame:
    return g.cls.where(F.col("module") == name)


def _lacks(df: DataFrame, annotation: str) -> DataFrame:
    return df.where(~F.coalesce(F.exists("annotations", lambda a: a.contains(annotation)), F.lit(False)))


def _imports(g: CodeGraph, s: Sentence) -> DataFrame:
    ends = g.of("IMPORTS").join(_module(g, s.subject).select("repo_id", F.col("fqn").alias("source")), ["repo_id", "source"], "left_semi")
    return ends.join(_module(g, s.object).select("repo_id", F.col("fqn").alias("target")), ["repo_id", "target"], "left_semi").select("repo_id", F.col("source").alias("fqn"))


def _named(g: CodeGraph, word: str) -> DataFrame:
    return g.cls.where(F.lower("name").contains(word))


def _extends(g: CodeGraph, s: Sentence) -> DataFrame:
    base = g.cls.where(F.col("name") == s.object).select("repo_id", F.col("fqn").alias("target"))
    own = g.of("EXTENDS").join(base, ["repo_id", "target"], "left_semi").select("repo_id", F.col("source").alias("fqn"))
    return own.join(_named(g, "service").select("repo_id", "fqn"), ["repo_id", "fqn"], "left_semi")


def _public(g: CodeGraph, s: Sentence) -> DataFrame:
    m = g.mth.where(F.exists("modifiers", lambda x: F.lower(x) == "public"))
    return _lacks(m, s.object).join(_module(g, s.subject).select("repo_id", F.col("fqn").alias("class_fqn")), ["repo_id", "class_fqn"], "left_semi")


PLANS = {
    "path": lambda g, s: _reaching(g, _module(g, s.subject), _module(g, s.object)), "imports": _imports, "annotated": lambda g, s: _lacks(_module(g, s.subject), s.object),
    "controllers": lambda g, s: _reaching(g, _named(g, "controller"), _named(g, "repository")), "extends": _extends, "public": _public,
}


def violators(g: CodeGraph, sentence: Sentence) -> DataFrame:
    """(repo_id, violator) of a compiled sentence, each once."""
    return PLANS[sentence.kind](g, sentence).select("repo_id", F.col("fqn").alias("violator")).distinct()


def run(g: CodeGraph, texts: dict[str, str]) -> DataFrame:
    """(policy, repo_id, violator) of the sentences that compile; what doesn't compile has no rows."""
    parts = [violators(g, s).select(F.lit(key).alias("policy"), "repo_id", "violator") for key, text in texts.items() if (s := compile_sentence(text))]
    return reduce(DataFrame.unionByName, parts, g.cls.limit(0).select(F.lit("").alias("policy"), "repo_id", F.col("fqn").alias("violator")))


