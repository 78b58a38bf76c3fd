"""Reading level of documents: smoothed unigram language models, one for each grade.

People's grades of a sample train the models; a document gets the grade with the highest posterior: the likelihood of its words
under the grade's model times the grade's share of the sample. Grades out of range are left out, several grades of one document
become their rounded mean. Since some grades are one off, the models are fitted twice, the second time without the documents
whose grade the first fit contradicts. The words of the sample are counted once, in Python; both fits and the grading between
them are aggregations and joins of that table. What a worker holds is the model, which the sample bounds. Only English prose is
graded: texts that are mainly code or log lines, in another language or of fewer than ``LEAST_WORDS`` words are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.language import detect
from codequarry.tables import cut, read, spread

GRADES = (1, 2, 3, 4)
#: Least words of a graded text, split at white space.
LEAST_WORDS = 40
#: Labelled documents that a fit takes at most, chosen by a hash of their ids; their words, some hundred thousand, are the model's.
LABELLED = 50_000
#: Weight that a word has in each grade before it is counted.
SMOOTHING = 0.5

_CODE_END = re.compile(r"[;{}]\s*$|^\s*[)}\]]+[;,]?\s*$")
_CODE_START = re.compile(r"^\s*(?:def \w+\(|class \w+[:({ ]|import [\w.{*]|from \w[\w.]* import |return\b|public |private |protected |const \w+ =|let \w+ =|var \w+ =|@\w+\s*(?:\(|$)|if \(|if not |for \(|while \(|else\b|elif |try:|#include|//|/\*|\*(?:/|\s|$)|\"\"\"|package [\w.]+;|log\.\w+\(|self\.\w|\w+\(.*\)\s*:?$|[A-Z_]+ = )|=>|^\s*\w+ = \w+[.(]")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:|\d\d:\d\d:\d\d |[IWEFD]\d{4} \d\d:|\d{10}\.\d+ |\d\d/[A-Z][a-z]{2}/\d{4}:|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d|time=\d|\{\"ts\"|\tat |\s+at \w+[.\w]+\(|Traceback |\s*File \"|Caused by: |\w+(?:Error|Exception): )")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w+);")
_HIDDEN = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()}


def is_prose(text: str) -> bool:
    """English text of enough words that isn't mainly code or log lines."""
    if len(text.split()) < LEAST_WORDS:
        return False
    total = other = 0
    for line in _ENTITY.sub(" ", text).splitlines():
        n = len(line.strip())
        total += n
        if n and (_CODE_END.search(line) or _CODE_START.search(line) or _LOG.match(line)):
            other += n
    return other < 0.5 * total and detect(text) == "en"


def _raw(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if text.isascii():
        return text.translate(_PLAIN).split()
    text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text))
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)))


def _token(w: str) -> str:
    if w.isdigit():
        return "<number>"
    return w.lower() if w[1:].islower() or len(w) == 1 or w.isupper() else "<name>"


def tokens(text: str) -> list[str]:
    """The words of a text for the models: lower case, identifiers and numbers as one word each."""
    return list(map(_token, _raw(text)))


class _Places(dict):
    """The row of the model's table that a word as written has; those that it doesn't know have the last, of zeros."""

    def __init__(self, rows: dict[str, int]):
        super().__init__()
        self.rows = rows

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        at = self[w] = self.rows.get(_token(w), len(self.rows))
        return at


class Model:
    """Log probabilities of words by grade, and of the grades."""

    def __init__(self, words: list[str], logs: np.ndarray, prior: np.ndarray):
        self.words, self.logs, self.prior = words, logs, prior
        self._places: _Places | None = None

    def __getstate__(self):
        return {"words": self.words, "logs": self.logs, "prior": self.prior, "_places": None}

    def grades(self, texts: list[str]) -> list[int]:
        """The grade of each text; of equally likely ones the lowest."""
        if self._places is None:
            self._places = _Places({w: k for k, w in enumerate(self.words)})
            self._table = np.vstack([self.logs, np.zeros((1, len(GRADES)))])
        at = [np.fromiter(map(self._places.__getitem__, _raw(t)), "int64") for t in texts]
        return [int(np.argmax((self._table[x].sum(axis=0) + self.prior).round(9))) + 1 for x in at]

    def grade(self, text: str) -> int:
        return self.grades([text])[0]


def _counted(batches: Iterator) -> Iterator:
    """(doc_id, grade, word, n) of each document that is prose."""
    import pandas as pd

    for pdf in batches:
        rows = []
        for doc, text, grade in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["grade"].tolist()):
            if is_prose(text):
                rows += [(doc, grade, w, n) for w, n in Counter(tokens(text)).items()]
        yield pd.DataFrame(rows, columns=["doc_id", "grade", "word", "n"]).astype({"doc_id": "int64", "grade": "int32", "n": "int64"})


def labels(grades: DataFrame) -> DataFrame:
    """(doc_id, grade): one grade of each graded document; null and out-of-range grades are left out."""
    valid = grades.select("doc_id", "grade").where(F.col("grade").between(GRADES[0], GRADES[-1]) & F.col("doc_id").isNotNull())
    return valid.groupBy("doc_id").agg(F.floor(F.avg("grade") + 0.5).cast("int").alias("grade"))


def _fitted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, l1, ...) and the one row (p1, ...): the log probabilities of words and grades in (doc_id, grade, word, n)."""
    per = [F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in GRADES]
    words = counts.groupBy("word").agg(*per)
    sums = words.agg(*(F.sum(F.col(f"n{g}") + SMOOTHING).alias(f"s{g}") for g in GRADES))
    model = words.crossJoin(F.broadcast(sums)).select("word", *(F.log((F.col(f"n{g}") + SMOOTHING) / F.col(f"s{g}")).alias(f"l{g}") for g in GRADES))
    docs = counts.select("doc_id", "grade").distinct()
    prior = docs.agg(*(F.log((F.sum(F.when(F.col("grade") == g, 1).otherwise(0)) + SMOOTHING) / (F.count("*") + SMOOTHING * len(GRADES))).alias(f"p{g}") for g in GRADES))
    return model, prior


def fit(documents: DataFrame, grades: DataFrame, labelled: int = LABELLED) -> Model:
    """The model of ``documents`` (doc_id, text) as graded in ``grades`` (doc_id, grade). Without any labels it knows no words."""
    chosen = labels(grades).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most ``labelled`` rows of two numbers
    counts = cut(spread(texts).select("doc_id", "text", "grade").mapInPandas(_counted, "doc_id long, grade int, word string, n long"))
    model, prior = _fitted(counts)
    names = [f"s{g}" for g in GRADES]
    scored = counts.join(model, "word").groupBy("doc_id", "grade").agg(*(F.sum(F.col("n") * F.col(f"l{g}")).alias(f"s{g}") for g in GRADES))
    scored = scored.crossJoin(F.broadcast(prior)).select("doc_id", "grade", *((F.col(f"s{g}") + F.col(f"p{g}")).alias(f"s{g}") for g in GRADES))
    agreed = scored.where(F.greatest(*names) <= F.element_at(F.array(*names), F.col("grade"))).select("doc_id", "grade")
    second = cut(counts.join(agreed, ["doc_id", "grade"], "left_semi"))
    if second.select("grade").distinct().count() == len(GRADES):
        model, prior = _fitted(second)
    held = model.orderBy("word").toPandas()  # the words of at most ``labelled`` documents
    shares = prior.first()
    shares = np.array([x if x is not None else 0.0 for x in shares])
    return Model(held["word"].tolist(), held[[f"l{g}" for g in GRADES]].to_numpy("float64"), shares)


def _graded(batches: Iterator, model) -> Iterator:
    import pandas as pd

    for pdf in batches:
        own = [(doc, text) for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()) if is_prose(text)]
        yield pd.DataFrame({"doc_id": pd.Series([x[0] for x in own], dtype="int64"), "grade": pd.Series(model.value.grades([x[1] for x in own]), dtype="int32")})


def grade(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, grade) of each row of ``documents`` (doc_id, text) that is English prose; null texts and ids are left out."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"))
    return own.mapInPandas(lambda batches: _graded(batches, shared), "doc_id long, grade int")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of every document that is English prose."""
    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    return grade(documents, fit(documents, read(spark, sf_dir, "reading_grades", "doc_id", "grade")))


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
