"""Names written as one word or two."""

import re
from re import _parser as parser

import pytest

from gridlark.llm.licenses import NEEDLES, license_scan, numbered, rules

CASES = [
    ("Creative Commons Attribution-ShareAlike 4.0", (0, 6, 2, "cc-by-sa")),
    ("Creative Commons Attribution Share-Alike 4.0", (0, 7, 2, "cc-by-sa")),
    ("Licensed under the Creative Commons Attribution-NonCommercial", (0, 7, 3, "cc-by-nc")),
    ("See Creative Commons Attribution Non-Commercial 4.0 for details", (1, 8, 2, "cc-by-nc")),
]


def test_one_word_and_two(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    for r, (_, expected) in zip(license_scan(df).orderBy("doc_id").collect(), CASES, strict=True):
        assert expected in [tuple(x) for x in r["licenses"]] and "cc-by" not in [x["label"] for x in r["licenses"]]


@pytest.mark.parametrize("text", [t for t, _ in CASES])
def test_numbered_rules_match_what_plain_ones_do(text):
    words = re.findall("[a-z0-9]+", text.lower())
    plain, numbers = " ".join(words), " ".join(f"{k}:{w}" for k, w in enumerate(words))
    for _, _, pattern, _ in rules():
        slow = [(plain[: m.start()].count(" "), m[0].count(" ")) for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", plain)]
        assert [(int(m[0].split(":")[0]), m[0].count(" ")) for m in re.finditer(numbered(pattern), numbers)] == slow


def example(pattern: str, choice: int = 0) -> str:
    """A shortest text that the pattern matches, with the choice-th of each set of alternatives, or the last."""

    def of(items) -> str:
        out = ""
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "MAX_REPEAT":
                out += of(value[2]) * value[0]
            elif name == "SUBPATTERN":
                out += of(value[3])
            elif name == "BRANCH":
                out += of(value[1][min(choice, len(value[1]) - 1)])
            elif name == "IN":
                out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "w", "NEGATE": lambda v: "w"}[str(value[0][0])](value[0][1])
            elif name == "NOT_LITERAL":
                out += "w"
            else:
                raise ValueError(name)
        return out

    return of(parser.parse(pattern))


def test_every_rule_finds_its_own_example(spark):
    """So no rule is kept from its texts by the strings that gate it."""
    known = [(p, label, example(pattern)) for p, _, pattern, label in rules()]
    frame = spark.createDataFrame([(k, text) for k, (_, _, text) in enumerate(known)], "doc_id long, text string")
    for (priority, label, text), r in zip(known, license_scan(frame).orderBy("doc_id").collect(), strict=True):
        whole = [x for x in r["licenses"] if (x["start"], x["end"]) == (0, len(text.split()))]
        assert whole and max(x["priority"] for x in whole) >= priority, text
        assert priority < max(x["priority"] for x in whole) or label in [x["label"] for x in whole], text


def test_every_alternative_has_a_gating_string():
    for _, keyword, pattern, _ in rules():
        for choice in range(6):
            text = example(pattern, choice)
            assert keyword in text.split() and ("cc" in text.split() or any(n in text for n in NEEDLES)), text


def test_many_detections_of_a_text(spark):
    text = " word ".join(["mit license"] * 5000)
    (r,) = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [b["start"] for b in r["base"]] == list(range(0, 15_000, 3)) == [x["start"] for x in r["licenses"]]
