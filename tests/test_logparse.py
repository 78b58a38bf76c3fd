from codequarry.operators.logparse import entries, parse

START = 1496275200000  # 2017-06-01T00:00:00Z


def one(line, start=START):
    got = parse(line, start)
    assert len(got) == 1, got
    return got[0][1:4]


def test_layouts():
    assert one('{"ts": "2017-06-01T00:00:01.5Z", "level": "WARNING", "service": "s", "logger": "kg.writer", "msg": "x"}') == (START + 1500, "WARN", "kg.writer")
    assert one('time=2017-06-01T00:00:01.002Z level=info component=hygiene msg="a"') == (START + 1002, "INFO", "hygiene")
    assert one("01/Jun/2017:02:00:01 +0200 | crit | parser.java | m") == (START + 1000, "FATAL", "parser.java")
    assert one("2017-06-01 00:00:01,250 ERROR [pool-1-thread-2] c.m.w.Audit - m") == (START + 1250, "ERROR", "c.m.w.Audit")
    assert one("[2017-06-01T02:00:00.007+02:00] [\x1b[34mINFO\x1b[0m] [kg.writer] m") == (START + 7, "INFO", "kg.writer")
    assert one("W0601 00:00:03.894772   76198 java.go:183] m") == (START + 3894, "WARN", "java.go")
    assert one("Jun  1 00:00:44 runner-2 parser-java[9049]: <debug> m") == (START + 44000, "DEBUG", "parser-java")
    assert one("Jun 10 00:00:44 runner-2 hygiene[9049]: m") == (START + 9 * 86400000 + 44000, "", "hygiene")
    assert one("1496275201.406 D pattern.detector: m") == (START + 1406, "DEBUG", "pattern.detector")
    assert one("00:00:02 WARN m") == (START + 2000, "WARN", "")


def test_times_without_date_are_not_before_the_start():
    assert one("00:00:02 WARN m", START + 2999)[0] == START + 2000
    assert one("00:00:02 WARN m", START + 3000)[0] == START + 86400000 + 2000
    assert one("I0531 00:00:00.000000 1 a.go:1] m")[0] == START + 364 * 86400000
    assert one("I0229 00:00:00.000000 1 a.go:1] m")[0] == 1582934400000
    assert one("00:00:02 WARN m", None)[0] is None


def test_continuations_and_blank_lines():
    text = "lost\r\n00:00:01 INFO a\r\n  more\r\n\r\n\tat x\n\n\n00:00:02 INFO b\n    quoted: 2016-01-01 00:00:00,000 ERROR [main] c - x\n\n"
    assert [(e[0], e[4]) for e in parse(text, START)] == [(1, 4), (2, 2)]
    assert parse("00:00:01 INFO a\n  more", START)[0][6] == "a\n  more"


def test_objects_of_several_lines():
    text = '{\n  "ts": "2017-06-01T00:00:01Z",\n  "msg": "a } b {",\n  "level": "fatal"\n}\n{\nnot json\n00:00:02 INFO b\n{"broken": \n'
    got = parse(text, START)
    assert [(e[0], e[1], e[2], e[4]) for e in got] == [(1, START + 1000, "FATAL", 7), (2, START + 2000, "INFO", 2)]


def test_no_header():
    assert parse("", START) == parse(None, START) == parse("MATCH (c)\nRETURN c\n== x 3.2 ==\n25:61:00 INFO x\nJun 31 00:00:00 h p[1]: x", START) == []


def test_table(spark):
    rows = [(1, "2017-06-01T00:00:00Z", None, None, 7), (1, "2017-06-01T00:00:00Z", "2017-06-01T01:00:00Z", "00:00:01 INFO a", 7), (1, "2017-06-01T00:00:00Z", "2017-06-01T01:00:00Z", "00:00:01 INFO a", 7), (2, None, None, "00:00:01 INFO a", 1), (3, "x", "y", "", 1), (None, None, None, "00:00:01 INFO a", 1)]
    got = {tuple(r[:3]) for r in entries(spark.createDataFrame(rows, "id long, started_at string, finished_at string, logs string, entry_no int")).collect()}
    assert got == {(1, 1, START + 1000), (2, 1, None)}


def test_objects_of_several_lines_in_one_pass():
    text = '{"ts": "2017-06-01T00:00:00Z",\n "level": "warn", "x": {"y": [1,\n "}"]}}\n rest\n{"a": 1} tail\n{"level": "info",\nW0601 00:00:03.894772   76198 java.go:183] m\n'
    got = parse(text, START)
    assert [(e[0], e[2], e[4], e[5]) for e in got] == [(1, "WARN", 6, "json"), (2, "WARN", 1, "lettered")]


def test_long_logs_take_time_in_proportion():
    import time

    for text in ("{\n" * 250_000, "{\n" * 100_000 + "}\n" * 100_000, '{"a":\n' * 80_000 + "1\n" + "}\n" * 80_000, '{"a": 1,\n' * 60_000):
        began = time.thread_time()
        assert len(parse(text, START)) <= 1  # of objects nested too deep the inner part counts
        assert time.thread_time() - began < 8
