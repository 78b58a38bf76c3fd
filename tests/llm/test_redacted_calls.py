"""Every field that is searched for personal data has a redacted result, row by row."""

from collections import Counter

from codequarry.llm.personal import CALLS, QUERIES, TURNS, redact
from codequarry.tables import read

FOLDER = "/root/testdata/sf0.001"


def test_every_searched_field_is_redacted(spark):
    fields = {c for name, q in QUERIES.items() if name.startswith("p2_redacted") for c in q(spark, FOLDER).columns}
    assert {*TURNS, *CALLS} <= fields


def test_calls_keep_their_rows(spark):
    own = [tuple(r) for r in read(spark, FOLDER, "llm_calls", "id", "input_text").collect()]
    got = Counter(tuple(r) for r in QUERIES["p2_redacted_calls"](spark, FOLDER).collect())
    assert got == Counter((k, redact(x)) for k, x in own)
    assert any(redact(x) != x for _, x in own)
