"""Log texts of several programs into entries with timestamp, level, component and message.

A text is read line by line, character by character: each known layout is a grammar, a fixed sequence of literal
delimiters and field scanners, and a line begins an entry when one grammar runs through from its first column. The first
character picks the grammars worth trying. A line starting with ``{`` makes the reader look ahead, quotes respected, for the
line on which the object closes. Every other line continues the entry before it; lines before the first entry belong to none.
"""

from __future__ import annotations

import calendar
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.times import iso_ms
from codequarry.tables import partitions

# Spellings of levels, and English month names.
LEVELS = {
    "debug": "DEBUG", "d": "DEBUG", "dbg": "DEBUG", "trace": "DEBUG", "verbose": "DEBUG",
    "info": "INFO", "i": "INFO", "notice": "INFO", "information": "INFO",
    "warn": "WARN", "warning": "WARN", "w": "WARN",
    "error": "ERROR", "err": "ERROR", "e": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "f": "FATAL", "crit": "FATAL", "critical": "FATAL", "c": "FATAL", "emerg": "FATAL", "alert": "FATAL", "panic": "FATAL",
}
MONTHS = {m: k for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}

_CONTROL = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f﻿​]")
_LINES = re.compile(r"\r\n|\n|\r")
_DAY_MS = 86_400_000


class _No(Exception):
    """The grammar doesn't run through."""


def _number(s: str, i: int, n: int) -> tuple[int, int]:
    """The n digits at i."""
    d = s[i : i + n]
    if len(d) != n or not (d.isascii() and d.isdigit()):
        raise _No
    return int(d), i + n


def _literal(s: str, i: int, text: str) -> int:
    if not s.startswith(text, i):
        raise _No
    return i + len(text)


def _blanks(s: str, i: int) -> int:
    k = i
    while k < len(s) and s[k] == " ":
        k += 1
    if k == i:
        raise _No
    return k


def _until(s: str, i: int, stops: str) -> tuple[str, int]:
    """The field from i to the first of the stop characters, which must come and leave it non-empty."""
    k = i
    while k < len(s) and s[k] not in stops:
        k += 1
    if k == i or k == len(s):
        raise _No
    return s[i:k], k


def _clock(s: str, i: int) -> tuple[int, int]:
    """hh:mm:ss with an optional fraction after a point or comma: milliseconds of the day."""
    h, i = _number(s, i, 2)
    m, i = _number(s, _literal(s, i, ":"), 2)
    sec, i = _number(s, _literal(s, i, ":"), 2)
    if h > 23 or m > 59 or sec > 60:
        raise _No
    ms = ((h * 60 + m) * 60 + sec) * 1000
    if i + 1 < len(s) and s[i] in ".," and s[i + 1].isdigit():
        k = i + 1
        while k < len(s) and s[k].isdigit():
            k += 1
        ms += int(s[i + 1 : k][:3].ljust(3, "0"))
        i = k
    return ms, i


def _offset(s: str, i: int) -> tuple[int, int]:
    """An optional Z, +hh:mm or +hhmm: milliseconds to take off."""
    if i < len(s) and s[i] in "Zz":
        return 0, i + 1
    if i < len(s) and s[i] in "+-":
        h, k = _number(s, i + 1, 2)
        if k < len(s) and s[k] == ":":
            k += 1
        m, k = _number(s, k, 2)
        return (h * 60 + m) * 60_000 * (1 if s[i] == "+" else -1), k
    return 0, i


def _days(year: int, month: int, day: int) -> int:
    if not (1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        raise _No
    return calendar.timegm((year, month, day, 0, 0, 0)) // 86400


def _iso(s: str, i: int) -> tuple[int, int]:
    y, i = _number(s, i, 4)
    m, i = _number(s, _literal(s, i, "-"), 2)
    d, i = _number(s, _literal(s, i, "-"), 2)
    if i >= len(s) or s[i] not in "T ":
        raise _No
    ms, i = _clock(s, i + 1)
    off, i = _offset(s, i)
    return _days(y, m, d) * _DAY_MS + ms - off, i


def _level(word: str) -> str:
    try:
        return LEVELS[word.strip().lower()]
    except KeyError:
        raise _No from None


def _dated(month: int, day: int, ms: int, floor_ms: int | None) -> int | None:
    """The first such day and time from floor_ms on."""
    if floor_ms is None:
        return None
    year = 1970 + int(floor_ms // 31_556_952_000)
    for y in range(year - 1, year + 10):
        try:
            t = _days(y, month, day) * _DAY_MS + ms
        except _No:
            continue
        if t >= floor_ms:
            return t
    raise _No


# Each grammar: (line, floor) -> (ts_ms, level, component, where the message begins).


def _logfmt(s: str, floor: int | None):
    t, i = _iso(s, _literal(s, 0, "time="))
    word, i = _until(s, _literal(s, i, " level="), " ")
    level, comp = _level(word), ""
    if s.startswith(" component=", i):
        comp, i = _until(s + " ", i + 11, " ")
        comp = comp.strip('"')
    return t, level, comp, i


def _access(s: str, floor: int | None):
    d, i = _number(s, 0, 2)
    month = MONTHS.get(s[3:6], 0)
    y, i = _number(s, _literal(s, _literal(s, i, "/") + 3, "/"), 4)
    ms, i = _clock(s, _literal(s, i, ":"))
    off, i = _offset(s, _literal(s, i, " "))
    word, i = _until(s, _literal(s, i, " | "), "|")
    level = _level(word)
    comp, i = _until(s, _literal(s, i, "| "), "|")
    return _days(y, month, d) * _DAY_MS + ms - off, level, comp.strip(), i + 1


def _threaded(s: str, floor: int | None):
    t, i = _iso(s, 0)
    word, i = _until(s, _blanks(s, i), " ")
    level = _level(word)
    _, i = _until(s, _literal(s, _blanks(s, i), "["), "]")
    comp, i = _until(s, _literal(s, i, "] "), " ")
    return t, level, comp, _literal(s, i, " - ")


def _bracketed(s: str, floor: int | None):
    t, i = _iso(s, _literal(s, 0, "["))
    word, i = _until(s, _literal(s, i, "] ["), "]")
    level = _level(word)
    comp, i = _until(s, _literal(s, i, "] ["), "]")
    return t, level, comp, i + 1


def _lettered(s: str, floor: int | None):
    level = _level(s[0])
    month, i = _number(s, 1, 2)
    day, i = _number(s, i, 2)
    ms, i = _clock(s, _literal(s, i, " "))
    _, i = _until(s, _blanks(s, i), " ")
    comp, i = _until(s, _blanks(s, i), ":] ")
    _, i = _until(s, _literal(s, i, ":"), "]")
    return _dated(month, day, ms, floor), level, comp, i + 1


def _syslog(s: str, floor: int | None):
    month = MONTHS.get(s[:3], 0)
    day = s[4:6].replace(" ", "0")
    day, _ = _number(day, 0, 2)
    ms, i = _clock(s, _literal(s, 6, " "))
    _, i = _until(s, _literal(s, i, " "), " ")
    comp, i = _until(s, i + 1, "[: ")
    if s[i] == "[":
        _, i = _until(s, i + 1, "]")
        i += 1
    i = _literal(s, i, ":")
    level, k = "", i + 1
    if s.startswith("<", k):
        word, end = _until(s, k + 1, ">")
        if word.lower() in LEVELS:
            level, i = _level(word), end + 1
    return _dated(month, day, ms, floor), level, comp, i


def _epoch(s: str, floor: int | None):
    sec, i = _number(s, 0, 10)
    k = _literal(s, i, ".")
    while k < len(s) and s[k].isdigit():
        k += 1
    ms = int(s[i + 1 : k][:3].ljust(3, "0"))
    word, i = _until(s, _literal(s, k, " "), " ")
    level = _level(word)
    comp, i = _until(s, i + 1, ": ")
    return sec * 1000 + ms, level, comp, _literal(s, i, ":")


def _timed(s: str, floor: int | None):
    ms, i = _clock(s, 0)
    word, i = _until(s, _literal(s, i, " "), " ")
    level = _level(word)
    if floor is None:
        return None, level, "", i
    t = floor // _DAY_MS * _DAY_MS + ms
    return t + _DAY_MS * (t < floor), level, "", i


_DIGIT = (("threaded", _threaded), ("access", _access), ("epoch", _epoch), ("timed", _timed))
GRAMMARS = {c: _DIGIT for c in "0123456789"} | {c: (("syslog", _syslog),) for c in "JFMASOND"}
GRAMMARS |= {"t": (("logfmt", _logfmt),), "[": (("bracketed", _bracketed),)}
for _c in "IWEFDC":
    GRAMMARS[_c] = (("lettered", _lettered), *GRAMMARS.get(_c, ()))


#: Levels to which an object that takes several lines may be nested.
DEPTH = 200
_BRACKET = re.compile(r'"(?:[^"\\\n]|\\.)*"?|[{}\[\]]|\n')


def closings(lines: list[str]) -> dict[int, int]:
    """For each line whose first column opens an object the line on which that closes, by one pass over all brackets.

    Objects that don't close, and those nested deeper than ``DEPTH``, are left out. A quotation ends with its line.
    """
    out: dict[int, int] = {}
    stack: list[list[int]] = []  # line if the bracket is its first column else -1, levels inside
    line = 0
    for m in _BRACKET.finditer("\n".join(lines)):
        c = m.group()
        if c == "\n":
            line += 1
        elif c in ("{", "["):
            at = line if c == "{" and (m.start() == 0 or m.string[m.start() - 1] == "\n") else -1
            stack.append([at, 1])
        elif c in ("}", "]") and stack:
            at, levels = stack.pop()
            if stack:
                stack[-1][1] = max(stack[-1][1], levels + 1)
            if at >= 0 and levels <= DEPTH:
                out[at] = line
    return out


def _header(s: str, floor: int | None):
    for name, grammar in GRAMMARS.get(s[0], ()):
        try:
            return name, *grammar(s, floor)
        except (_No, IndexError):
            continue
    return None


def _object(lines: list[str], at: int, closed: dict[int, int]) -> tuple[tuple, int] | None:
    """The entry of the JSON object that opens on line ``at``, and the line that ends it. ``closed`` is filled when needed."""
    end = at
    try:
        x = json.loads(lines[at])
    except (ValueError, RecursionError):
        if not closed:
            closed.update(closings(lines) or {-1: -1})
        end = closed.get(at, at)
        if end == at:
            return None
        try:
            x = json.loads("\n".join(lines[at : end + 1]))
        except ValueError:
            return None
    if not isinstance(x, dict):
        return None
    first = lambda *names: next((x[n] for n in names if isinstance(x.get(n), (str, int, float))), "")
    try:
        t = _iso(str(first("ts", "timestamp", "time", "@timestamp")).strip(), 0)[0]
    except (_No, IndexError):
        t = None
    level = LEVELS.get(str(first("level", "severity", "lvl")).strip().lower(), "")
    return ("json", t, level, str(first("logger", "component", "name", "service")), str(first("msg", "message"))), end


def parse(text: str | None, started_ms: int | None) -> list[tuple]:
    """(entry_no, ts_ms, level, component, n_lines, layout, message) of each entry of one text."""
    if not text:
        return []
    floor = None if started_ms is None else started_ms // 1000 * 1000
    lines = [_CONTROL.sub("", s) if not s.isprintable() else s for s in _LINES.split(text)]
    heads: list[tuple] = []
    closed: dict[int, int] = {}
    k = 0
    while k < len(lines):
        s = lines[k]
        if s[:1] == "{":
            got = _object(lines, k, closed)
            if got:
                heads.append((k, *got[0]))
                k = got[1]
        elif s and s[0] in GRAMMARS and (got := _header(s, floor)):
            heads.append((k, *got[:4], s[got[4] :].strip()))
        k += 1
    out = []
    for n, (at, layout, t, level, comp, message) in enumerate(heads):
        end = heads[n + 1][0] if n + 1 < len(heads) else len(lines)
        while end > at + 1 and not lines[end - 1].strip():
            end -= 1
        more = "" if layout == "json" else "\n".join(lines[at + 1 : end])
        out.append((n + 1, t, level, comp, end - at, layout, message + ("\n" + more if more else "")))
    return out


_SCHEMA = "scan_id long, entry_no int, ts_ms long, log_level string, component string, n_lines int, layout string, message string"


def _entries(batches: Iterator) -> Iterator:
    import pandas as pd

    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for scan, started, text in zip(pdf["scan_id"].tolist(), pdf["started"].tolist(), pdf["logs"].tolist()):
            rows += [(scan, *e) for e in parse(text, None if started != started or started is None else int(started))]
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"scan_id": "int64", "entry_no": "int32", "ts_ms": "Int64", "n_lines": "int32"})


def entries(scans: DataFrame) -> DataFrame:
    """Entries of the logs in ``scans`` (id, started_at, finished_at, logs; other columns play no part).

    A scan that came several times counts once: its finished form goes before a running one, one with logs before one
    without. Null and empty logs, and logs without any header, give no entry; a null id gives none either. A layout without
    a date needs started_at: where that is null or unreadable, ts_ms is null. A missing level or component is ''.
    """
    own = scans.select(F.col("id").cast("long").alias("scan_id"), iso_ms(F.col("started_at")).alias("started"), F.col("finished_at").isNotNull().alias("done"), "logs")
    own = own.where("scan_id is not null and logs is not null and logs <> ''")
    own = own.repartition(partitions(scans.sparkSession), "scan_id").groupBy("scan_id").agg(F.max(F.struct("done", F.length("logs").alias("n"), "started", "logs")).alias("x"))
    return own.select("scan_id", "x.started", "x.logs").mapInPandas(_entries, _SCHEMA)
