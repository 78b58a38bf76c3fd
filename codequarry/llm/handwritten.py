"""Files that nobody wrote by hand: generated, minified or bundled, vendored, or data saved as code.

Three kinds of evidence are weighed for each file, each by itself sufficient:

* its path, through rules for directories of generators, build outputs, vendored code, lock files and telling suffixes;
* the notice in its header, found by one Aho-Corasick pass over the leading comments and then checked at the place of the
  hit, so that remarks about generators, keys or templates are no notices;
* the shape of its whole text, which tells minified code and saved data from code with a long line or a table.

The scan of texts runs in Arrow batches; no row of a file is ever moved for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.tables import read, spread

#: Kinds in the order in which they go before one another where a path comes with several contents.
KINDS = ("vendored", "minified", "generated", "data")

# Directory names that generators, builds and package managers use, and file names and suffixes of their output.
GENERATED_DIRS = ("generated", "__generated__", "_generated", "gen", "autogen", "auto-generated", "auto_generated", "src-gen", "src_gen", "srcgen", "gen-src", "generated-sources", "generated-src", "generated_sources", "generatedsources", "codegen-out", "build", "target", "out", "dist", "bin", "obj", ".next", "__pycache__")
VENDORED_DIRS = ("node_modules", "bower_components", "jspm_packages", "vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "external", "externals", "extern", "deps", "site-packages", "dist-packages", "Pods", "Carthage", "Godeps", "bundled")
PLAIN_DIRS = frozenset(("gen", "build", "target", "out", "dist", "bin", "obj", "external", "externals", "extern", "deps", "vendor", "bundled"))  # of these, words that packages are named by
MINIFIED_SUFFIXES = (".min.js", ".min.css", "-min.js", ".packed.js", ".pack.js", ".bundle.js", ".chunk.js", "-bundle.js", ".min.mjs", ".umd.js")
GENERATED_SUFFIXES = (".generated.java", ".generated.py", ".generated.js", ".generated.ts", ".g.java", ".g.py", ".g.js", ".g.ts", ".g.dart", ".g.cs", ".designer.cs", ".pb.go", ".pb.h", ".pb.cc", "_pb2.py", "_pb2_grpc.py", "_pb.js", "_pb.ts", "Grpc.java", "OuterClass.java", ".gen.ts", ".gen.js", ".gen.go", "_gen.go", "_gen.py")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", "gradle.lockfile")

# Phrases of notices, in lower case. True: only where the words after it name no single thing to keep.
NOTICES = {
    "code generated by": "generated", "@generated": "generated", "<auto-generated": "generated", "autogenerated from": "generated", "autogenerated by": "generated",
    "auto-generated by": "generated", "auto-generated from": "generated", "auto-generated file": "generated", "auto generated by": "generated", "automatically generated by": "generated", "automatically generated from": "generated",
    "file is generated": "generated", "file was generated": "generated", "file is auto": "generated", "was produced automatically": "generated", "was automatically produced": "generated", "was automatically generated": "generated",
    "regenerate instead of edit": "generated", "do not edit": "generated", "do not modify": "generated", "changes will be lost": "generated", "changes will be overwritten": "generated", "machine generated": "generated", "machine-generated": "generated", "generated by the protocol buffer": "generated",
    "third-party code": "vendored", "third party code": "vendored", "copied unchanged from": "vendored", "copied verbatim from": "vendored", "vendored from": "vendored", "vendored copy": "vendored", "keep in sync with upstream": "vendored", "see upstream": "vendored", "@license": "vendored", " contributors |": "vendored", "imported from upstream": "vendored",
}
_COPYRIGHT = re.compile(r"(?:\(c\)|copyright|©).{0,80}\b(?:authors|contributors)\b")
_ONLY_PART = re.compile(r"\s+(?:their|its|these|those|the (?:order|keys?|names?|values?|lines?|list)|this (?:line|list|order|value|constant|method|block))\b")
_BY_HAND = re.compile(r"written by hand|hand-?written|handwritten")
_CODE_START = re.compile(r"^\s*(?:(?:public|private|protected|export|default|abstract|final|static|async|sealed)\s+)*(?:class|interface|enum|record|def|function|trait|struct|@interface)\b|^\s*(?:const|let|var)\s+\w+\s*=\s*(?:\(|function|async)")
_LINES = re.compile(r"\r\n|\n|\r")
_COMMENT = re.compile(r"^\s*(?://|#|/?\*|--|;|<!--|\"\"\"|''')")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, kind in NOTICES.items():
        a.add_word(phrase, (phrase, kind))
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The comment lines before the first definition, in lower case, markers left in place."""
    out, inside = [], False
    for line in _LINES.split(text):
        opens = line.lstrip().startswith("/*")
        if not inside and not opens and _CODE_START.match(line):
            break
        if inside or opens or _COMMENT.match(line):
            out.append(line)
        if opens or inside:
            inside = "*/" not in line
    return "\n".join(out).lower()


def notice(text: str) -> str | None:
    """``generated`` or ``vendored`` by the notice in the text's header, else None."""
    head = header(text)
    if not head:
        return None
    for end, (phrase, kind) in _automaton().iter(head):
        line_from = head.rfind("\n", 0, end) + 1
        line_to = head.find("\n", end)
        line = head[line_from : line_to if line_to >= 0 else len(head)]
        after = head[end + 1 : line_from + len(line)]
        if phrase.startswith("do not") and _ONLY_PART.match(after):
            continue
        if _BY_HAND.search(line):
            continue
        return kind
    return "vendored" if _COPYRIGHT.search(head) else None


_LONG = 300  # characters of a line beyond which it may be minified
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def shape(text: str) -> str | None:
    """``minified`` or ``data`` by the whole text's own shape, else None.

    Comments don't count: a hand-written file with one long remark stays hand-written. Minified: half of the code stands in
    long lines with hardly a blank. Data: of the code, seven tenths are numbers, records or opaque string pieces.
    """
    lines = [s for s in _LINES.split(text) if s.strip() and not _COMMENT.match(s)]
    total = sum(map(len, lines))
    if len(lines) <= 2 and 60 <= total <= _LONG:  # one short piece of minified code
        code = "".join(lines)
        return "minified" if code.count(" ") < 0.08 * total and sum(c in "(){}[];,=:" for c in code) >= 0.2 * total and "{" in code and "}" in code else None
    if len(lines) < 3 and total < 200:
        return None
    long = [s for s in lines if len(s) > _LONG]
    amount = sum(map(len, long))
    if amount >= total / 2 and sum(s.count(" ") for s in long) < 0.12 * amount:
        words = sum(map(len, _WORD.findall(" ".join(long))))
        return "minified" if words >= 0.25 * amount else "data"
    data = 0
    for s in lines:
        t = s.strip()
        opaque = sum(len(x) for x in _STRING.findall(t) if len(x) >= 40 and " " not in x)
        if opaque >= 0.7 * len(t):
            data += len(s)
            continue
        digits = sum(c.isdigit() for c in t)
        marks = sum(c in ";,|\t" for c in t)
        letters = sum(c.isalpha() for c in t) - sum(1 for c in re.findall(r"0x[0-9a-fA-F]+", t) for d in c if d.isalpha())
        if digits and digits + marks >= 0.5 * len(t.replace(" ", "")) and letters <= digits + marks or digits and marks >= 8 and letters <= 0.15 * len(t):
            data += len(s)
    return "data" if data >= 0.7 * total else None


def path_kind(path: Column) -> Column:
    """``generated``, ``vendored`` or ``minified`` by the path alone, else null. Null and empty paths give null.

    A directory counts by its whole name, so ``external-api`` or ``vendors`` are no vendored directories; ``libs`` or
    ``lib`` count only above a name with a version. Below a source root (``src/main/java`` and the like) directories are packages
    of the code there, of which names of ``PLAIN_DIRS`` tell nothing.
    """
    low = F.lower(path)
    outside = F.regexp_replace(low, r"((?:^|/)src/(?:main|test)/(?:java|kotlin|scala|groovy)/).*(/[^/]*)$", "$1$2")
    plain = lambda xs: [x for x in xs if x in PLAIN_DIRS]
    telling = lambda xs: [x for x in xs if x not in PLAIN_DIRS]
    names = lambda xs: "|".join(re.escape(x.lower()) for x in xs)
    return (
        F.when(low.rlike(rf"(^|/)({names(telling(VENDORED_DIRS))})(/|$)") | outside.rlike(rf"(^|/)({names(plain(VENDORED_DIRS))})(/|$)") | low.rlike(r"(^|/)libs?/[^/]+-\d+\.\d+(\.\d+)?(/|$)"), "vendored")
        .when(low.rlike(rf"({names(MINIFIED_SUFFIXES)})$"), "minified")
        .when(low.rlike(rf"(^|/)({names(telling(GENERATED_DIRS))})(/|$)") | outside.rlike(rf"(^|/)({names(plain(GENERATED_DIRS))})(/|$)") | path.rlike("(" + "|".join(re.escape(x) for x in GENERATED_SUFFIXES) + ")$"), "generated")
        .when(low.rlike(rf"(^|/)({names(LOCK_FILES)})$"), "generated")
    )


def _kinds(batches: Iterator) -> Iterator:
    for pdf in batches:
        kinds = []
        for kind, text in zip(pdf["by_path"].tolist(), pdf["content"].tolist()):
            if kind is None and text:
                kind = notice(text) or shape(text)
            kinds.append(kind)
        yield pdf[["repo_id", "path"]].assign(kind=kinds)


def classify(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind) of ``files`` (repo_id, path, content); kind is null for hand-written ones.

    kind is ``generated``, ``vendored``, ``minified`` or ``data``. Texts of null or empty content are judged by their path
    alone; rows without a path are left out. Repeated rows give repeated rows. Other columns play no part.
    """
    own = files.select("repo_id", "path", "content").where("path is not null").withColumn("by_path", path_kind(F.col("path")))
    own = own.withColumn("content", F.when(F.col("by_path").isNull(), F.col("content")))
    return spread(own).mapInPandas(_kinds, "repo_id string, path string, kind string")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file and module with its kind, null for hand-written."""
    files = read(spark, sf_dir, "source_files", "repo_id", F.col("file_path").alias("path"), "content")
    modules = read(spark, sf_dir, "modules", "repo_id", "path").where("path is not null")
    modules = modules.select("repo_id", "path", path_kind(F.col("path")).alias("kind"))
    both = classify(files).unionByName(modules)
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct(F.array_position(F.array(*map(F.lit, KINDS)), "kind").alias("at"), "kind")))
    return both.groupBy("repo_id", "path").agg(first["kind"].alias("kind"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and modules that nobody wrote by hand; all files below such a module are among them."""
    kinds = p5_kinds(spark, sf_dir)
    return kinds.where("kind is not null").select("repo_id", "path")


def p5_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and modules whose path alone tells their kind."""
    files = read(spark, sf_dir, "source_files", "repo_id", F.col("file_path").alias("path"))
    both = files.unionByName(read(spark, sf_dir, "modules", "repo_id", "path")).where("path is not null").distinct()
    return both.select("repo_id", "path", path_kind(F.col("path")).alias("kind")).where("kind is not null")


def _names_sql(names) -> str:
    return "|".join(re.escape(x.lower()) for x in names)


_OUTSIDE = "regexp_replace(lower(path), '((?:^|/)src/(?:main|test)/(?:java|kotlin|scala|groovy)/).*(/[^/]*)$', '\\1\\2')"
_DIR_SQL = "(regexp_matches(lower(path), '(^|/)({0})(/|$)') OR regexp_matches({2}, '(^|/)({1})(/|$)'))"
_DIRS = [_DIR_SQL.format(_names_sql(x for x in dirs if x not in PLAIN_DIRS), _names_sql(x for x in dirs if x in PLAIN_DIRS), _OUTSIDE) for dirs in (VENDORED_DIRS, GENERATED_DIRS)]
QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds, "p5_by_path": p5_by_path}
SQL = {
    "p5_by_path": f"SELECT * FROM (SELECT repo_id, path, CASE WHEN {_DIRS[0]} OR regexp_matches(lower(path), '(^|/)libs?/[^/]+-[0-9]+\\.[0-9]+(\\.[0-9]+)?(/|$)') THEN 'vendored' WHEN regexp_matches(lower(path), '({_names_sql(MINIFIED_SUFFIXES)})$') THEN 'minified' "
    f"WHEN {_DIRS[1]} OR regexp_matches(path, '({'|'.join(re.escape(x) for x in GENERATED_SUFFIXES)})$') OR regexp_matches(lower(path), '(^|/)({_names_sql(LOCK_FILES)})$') THEN 'generated' END AS kind FROM (SELECT repo_id, file_path AS path FROM source_files UNION SELECT repo_id, path FROM modules) WHERE path IS NOT NULL) WHERE kind IS NOT NULL",
}
