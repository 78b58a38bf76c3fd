"""Passages of evaluation items inside documents.

Items and documents become sequences of words, whatever their case, accents, punctuation, markup and line prefixes. Numbers,
names and units become typed placeholders, and every window of the resulting template words is hashed. The windows of the
documents meet those of the items in a hash join, which gives the places that a document and an item share. Pairs that share a
window with its own words in the slots, or ``EXCHANGED`` windows of the template, are aligned word by word from these places;
single words may differ, be missing or be added. An aligned passage counts if its
slots agree: most names are the item's own, or names, numbers and units were exchanged one for one, as in a re-parameterised
question. Text that only shares the template of an item, with names and numbers of its own, thereby is no case.

Both sides of the join are tables, so items and documents may grow alike. The items' windows are broadcast while their number is
within a bound; beyond it windows are joined in salted parts, with the same rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.tables import BROADCAST_BYTES, broadcast_if_small, cut, read, spread

#: Words of a template window.
WINDOW = 6
#: Least words of a passage, and of an item in passages.
PASSAGE, ENOUGH = 12, 20
#: Share of a passage's words that must be the item's.
SAME = 0.8
#: Template windows that a pair must share if no window has the item's own slots: a passage of twenty words whose slots were
#: exchanged may differ in one word besides, which leaves nine windows.
EXCHANGED = 9
#: Different items in which a sentence without names and numbers must stand to be a stock instruction.
STOCK_ITEMS = 5
#: Parts of a window in the join with many items.
SALTS = 16

# Units that take a placeholder.
_UNITS = frozenset("ms s sec secs second seconds min mins minute minutes h hour hours day days kb mb gb tb kib mib gib byte bytes percent px km m cm mm kg g".split())
_DIGITS = frozenset("0123456789")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()}
_BREAK = re.compile(r"(?<=[A-Za-z])-[ \t]*(?:\r\n|\n|\r)[ \t>|*#]*(?=[a-z])")
_CAMEL = re.compile(r"[A-Za-z]+[a-z][A-Z]|[A-Z]{2,}[a-z]+[A-Z]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words(text: str) -> tuple[list[str], list[bool]]:
    """The plain words of a text, and for each whether it is written like a name."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "-\n" in text or "-\r" in text:
        text = _BREAK.sub("", text)
    text = text.replace("'", "").replace("’", "")
    raw = text.translate(_PLAIN).split() if text.isascii() else _WORD.findall(text)
    return [w.lower() for w in raw], [not (w.islower() or w[1:].islower() or w.isdigit()) and w[1:].lower() != w[1:] and _CAMEL.match(w) is not None for w in raw]


def template(plain: list[str], named: list[bool], names: frozenset[str]) -> list[str]:
    """The words with placeholders for names, numbers and units after numbers."""
    out = ["<name>" if is_name else w for w, is_name in zip(plain, named)]
    if names and not names.isdisjoint(plain):
        out = ["<name>" if w in names else w for w in out]
    for k, w in enumerate(plain):
        if w[0] in _DIGITS and w.isdigit() and out[k] == w:
            out[k] = "<number>"
            if k + 1 < len(out) and out[k + 1] in _UNITS:
                out[k + 1] = "<unit>"
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def hashes(sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all windows of all sequences, as signed 64-bit numbers, and the bounds of each sequence's share of them."""
    import pandas as pd

    lengths = np.fromiter(map(len, sequences), "int64", len(sequences))
    bounds = np.concatenate([[0], np.cumsum(np.maximum(lengths - WINDOW + 1, 0))])
    flat = np.array(list(chain.from_iterable(sequences)), dtype=object)
    if len(flat) < WINDOW:
        return np.zeros(0, "int64"), bounds
    codes = pd.util.hash_array(flat)
    total = np.zeros(len(codes) - WINDOW + 1, "uint64")
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            total = total * _BASE + codes[k : len(codes) - WINDOW + 1 + k]
        total ^= total >> np.uint64(29)
    within = np.arange(len(total)) + WINDOW <= np.repeat(np.cumsum(lengths), lengths)[: len(total)]  # windows over two texts are none
    return total[within].astype("int64"), bounds


class Item:
    """The words and template of one item."""

    def __init__(self, text: str):
        self.text, self.named = words(text)
        self.names = frozenset(w for w, is_name in zip(self.text, self.named) if is_name)
        self.template = template(self.text, self.named, self.names)

    def leaked(self, plain: list[str], named: list[bool], places: Iterable[tuple[int, int]]) -> bool:
        """Whether a text of these words repeats enough of the item, from the places (in the text, in the item) of common windows."""
        if len(self.text) < ENOUGH:
            return False
        return self._covered(plain, template(plain, named, self.names), places) >= ENOUGH

    def _covered(self, plain: list[str], t: list[str], places: Iterable[tuple[int, int]]) -> int:
        """Words of the item that stand in passages of the document."""
        own, own_t = self.text, self.template
        covered: set[int] = set()
        seen: set[tuple[int, int]] = set()
        for at, k in sorted(places):
            if (at, k) in seen:
                continue
            pairs = _align(own, own_t, plain, t, k, at)
            seen.update((y, x) for x, y in pairs)
            if not any(own[x] == plain[y] for x, y in pairs):
                continue
            first, last = pairs[0][0], pairs[-1][0]
            if last - first + 1 >= PASSAGE and _agrees(own, own_t, plain, t, pairs, last - first + 1):
                covered.update(range(first, last + 1))
        return len(covered)


def _align(own: list[str], own_t: list[str], plain: list[str], t: list[str], k: int, at: int) -> list[tuple[int, int]]:
    """Pairs of places that stand for each other around a common window, both ways until two words in a row differ."""
    pairs = []
    for step in (-1, 1):
        x, y = (k - 1, at - 1) if step < 0 else (k, at)
        side: list[tuple[int, int]] = []
        while 0 <= x < len(own) and 0 <= y < len(plain):
            if own_t[x] == t[y]:
                side.append((x, y))
                x, y = x + step, y + step
                continue
            for dx, dy in ((1, 1), (0, 1), (1, 0)):  # another word, one more, one less
                nx, ny = x + dx * step, y + dy * step
                mx, my = nx + step, ny + step
                if 0 <= nx < len(own) and 0 <= ny < len(plain) and own_t[nx] == t[ny] and (not (0 <= mx < len(own) and 0 <= my < len(plain)) or own_t[mx] == t[my]):
                    if dx and dy:
                        side.append((x, y))
                    x, y = nx, ny
                    break
            else:
                break
        pairs += side
    pairs.sort()
    while pairs and own[pairs[-1][0]] != plain[pairs[-1][1]]:
        pairs.pop()
    start = 0
    while start < len(pairs) and own[pairs[start][0]] != plain[pairs[start][1]]:
        start += 1
    return pairs[start:]


def _agrees(own: list[str], own_t: list[str], plain: list[str], t: list[str], pairs: list[tuple[int, int]], length: int) -> bool:
    """Enough of the passage's words are the item's, and its names are too or were renamed one for one."""
    slots = [(own[x], plain[y]) for x, y in pairs if own_t[x] == "<name>"]
    kept = sum(a == b for a, b in slots)
    same = sum(own[x] == plain[y] for x, y in pairs)
    if slots and 2 * kept <= len(slots):
        renamed: dict[str, set[str]] = defaultdict(set)
        for a, b in slots:
            renamed[a].add(b)
        often = [a for a, n in Counter(a for a, _ in slots).items() if n > 1]
        one_for_one = all(len(b) == 1 for b in renamed.values()) and len({min(b) for b in renamed.values()}) == len(renamed)
        rest = sum(own_t[x] == t[y] for x, y in pairs)
        return len(often) >= 2 and one_for_one and rest >= 0.95 * length
    return same >= (SAME if slots else 0.9) * length


def _sentences(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item_id"].tolist(), pdf["text"].tolist()):
            for at, s in enumerate(_SENTENCE.split(text)):
                plain, named = words(s)
                slots = any(named) or any(map(str.isdigit, plain))
                rows.append((item, text, at, s, " ".join(plain), slots))
        yield pd.DataFrame(rows, columns=["item_id", "whole", "at", "sentence", "plain", "slots"])


def contents(benchmark: DataFrame, stock_items: int = STOCK_ITEMS) -> DataFrame:
    """(item_id, item): the text of each item of ``benchmark`` (item_id, text) without stock instructions.

    A sentence is one if it has no name or number and stands in ``stock_items`` different texts; whatever else items share,
    as copies of one another do, is content.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    parts = items.mapInPandas(_sentences, "item_id long, whole string, at int, sentence string, plain string, slots boolean")
    often = parts.where("not slots and plain <> ''").groupBy("plain").agg(F.countDistinct("whole").alias("n")).where(F.col("n") >= stock_items)
    kept = parts.join(often, "plain", "left_anti").groupBy("item_id", "whole").agg(F.sort_array(F.collect_list(F.struct("at", "sentence"))).alias("s"))
    return kept.select("item_id", F.array_join(F.col("s.sentence"), " ").alias("item"))


def windows_of(texts: list[str], lowered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the texts' template windows, those of the windows with their own words, and the bounds of each text's.

    ``lowered``: names count as plain words, as in a text of one case.
    """
    seen = [words(text) for text in texts]
    own, bounds = hashes([plain for plain, _ in seen])
    return hashes([template(plain, [False] * len(plain) if lowered else named, frozenset()) for plain, named in seen])[0], own, bounds


def _item_windows(batches: Iterator) -> Iterator:
    """Windows with the names as placeholders and as plain words."""
    import pandas as pd

    for pdf in batches:
        for lowered in (False, True):
            windows, own, bounds = windows_of(pdf["item"].tolist(), lowered)
            n = np.diff(bounds)
            yield pd.DataFrame({"item_id": np.repeat(pdf["item_id"].to_numpy("int64"), n), "window": windows, "item_own": own, "k": (np.arange(len(own)) - np.repeat(bounds[:-1], n)).astype("int32")})


def _document_windows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        windows, own, bounds = windows_of(batch.column("text").to_pylist())
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (windows, own)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *lists], names=["doc_id", "digest", "windows", "own"])


def _verified(batches: Iterator) -> Iterator:
    import pandas as pd

    items: dict[str, Item] = {}
    last, seen = None, ([], [])
    for pdf in batches:
        rows = []
        for doc, item, text, content, at, k in zip(pdf["doc_id"].tolist(), pdf["item_id"].tolist(), pdf["text"].tolist(), pdf["item"].tolist(), pdf["at"].tolist(), pdf["k"].tolist()):
            if text != last:
                last, seen = text, words(text)
            if content not in items:
                if len(items) >= 10_000:
                    items.clear()
                items[content] = Item(content)
            if items[content].leaked(*seen, set(zip(at.tolist(), k.tolist()))):
                rows.append((doc, item))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")


def find(documents: DataFrame, benchmark: DataFrame, stock_items: int = STOCK_ITEMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id): the items of ``benchmark`` (item_id, text) that ``documents`` (doc_id, text) repeat.

    Null and empty texts hold nothing; rows without an id are left out; repeated rows count once; an id with several texts
    counts for each of them; items of fewer than twenty words besides stock instructions can't be found. Empty tables give no
    rows. Other columns play no part.
    """
    items = cut(contents(benchmark, stock_items))
    windows = cut(items.mapInPandas(_item_windows, "item_id long, window long, item_own long, k int").distinct())
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").where("doc_id is not null and text <> ''")
    every = spread(own).mapInArrow(_document_windows, "doc_id long, digest long, windows array<long>, own array<long>")
    salt = F.pmod(F.col("digest"), F.lit(SALTS))
    places = every.select("doc_id", "digest", salt.alias("salt"), F.posexplode(F.arrays_zip("windows", "own")).alias("at", "x")).select("doc_id", "digest", "salt", "at", "x.windows", "x.own").withColumnRenamed("windows", "window")
    windows, small = broadcast_if_small(windows, 28, broadcast_bytes)
    if small:
        hits = places.join(windows, "window")
    else:
        hits = places.join(windows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["window", "salt"])
    pairs = hits.groupBy("doc_id", "digest", "item_id").agg(F.collect_list("at").alias("at"), F.collect_list("k").alias("k"), F.max(F.col("own") == F.col("item_own")).alias("same"), F.size(F.collect_set("k")).alias("n"))
    pairs = cut(pairs.where(F.col("same") | (F.col("n") >= EXCHANGED)).drop("same", "n"))
    met = own.join(pairs, ["doc_id", "digest"]).join(items, "item_id")
    return met.select("doc_id", "item_id", "text", "item", "at", "k").mapInPandas(_verified, "doc_id long, item_id long").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the benchmark that each document leaks."""
    return find(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
