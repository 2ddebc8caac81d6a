import re
import unicodedata

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions import classify, text
from docketry.schema import ABBREVIATIONS


def run(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_clean(x):
    """The cleaning rules once more, in the order they are stated."""
    if not x:
        return ""
    x = unicodedata.normalize("NFKD", re.sub(r"<[^>]+>", "", x))
    for short, full in ABBREVIATIONS.items():
        x = x.replace(short, full)
    x = re.sub(r"[^\w\s.,\-()/:]", " ", re.sub(r"\s+", " ", x))
    return re.sub(r"\s+", " ", x.strip())


CLEAN = [
    None, "", "plain", "  padded\t\n text ", "<b>bold</b> & <i>x</i>", "a < b > c", "naïve café ½ ﬁne ²",
    "Acme Inc. vs. Foo Corp. et al., e.g. LLC; i.e. Ltd. etc.", "under_score (x) a/b c:d e-f",
    "日本語 テスト ｱｲｳ", "Ωμέγα ы ß", "nbsp here there end", "\x1funit\x85sep", "<<x>>", "<>",
]


def test_clean_text(spark):
    assert run(spark, text.clean_text, CLEAN) == [plain_clean(x) for x in CLEAN]


def test_clean_each(spark):
    got = run(spark, text.clean_each, [[x for x in CLEAN if x is not None], [], None], "array<string>")
    assert got == [[plain_clean(x) for x in CLEAN if x is not None], [], None]


# Letters that every Unicode version in use agrees on.
LETTERS = st.characters(max_codepoint=0x52F, exclude_categories=["Cs", "Cn", "Co"]) | st.sampled_from("½²ﬁ①ｱ한テ\u2003\u3000＜b＞<>.")


@settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(LETTERS, max_size=60), min_size=40, max_size=60))
def test_clean_text_property(spark, values):
    # Python counts some letter-like symbols as words that have no letter or number class.
    odd = {c for v in values for c in unicodedata.normalize("NFKD", v) if c.isalnum() != (unicodedata.category(c)[0] in "LN")}
    values = [v for v in values if "\x00" not in v and not odd & set(unicodedata.normalize("NFKD", v))]
    assert run(spark, text.clean_text, values) == [plain_clean(v) for v in values]


def test_extract_claims(spark):
    section = (
        "What is claimed: 1. A device comprising a first widget [12] (3). 2. The device of claim 1, with gears of "
        "0.5 inch and some more text here. 3. Short one. 4. Another device that is étrange enough"
    )
    assert run(spark, text.extract_claims, [section, "no numbers at all", "", None]) == [
        [
            "A device comprising a first widget 12 .",
            "The device of claim 1, with gears of",
            "5 inch and some more text here.",
            "Another device that is e trange enough",
        ],
        [], [], [],
    ]


def test_many_claims_keep_their_digits(spark):
    section = " ".join(f"{i}. 1{i} widgets in a box of considerable size" for i in range(1, 20))
    assert run(spark, text.extract_claims, [section]) == [
        [f"1{i} widgets in a box of considerable size" for i in range(1, 20)]
    ]


def test_extract_inventors(spark):
    got = run(spark, text.extract_inventors, ["Dr. Al; Jo PhD, Dr.Bo | ;", "", None])
    assert got == [["Dr. Al", "Jo", "Bo"], [], []]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (text.extract_inventors_variant, '["Al MD", {"full_name": "Bo"}, {"inventor_name": "Cy"}, 5, null, ["x"]]', ["Al", "Bo", "Cy"]),
        (text.extract_inventors_variant, '{"name": "Al"}', ["Al"]),
        (text.extract_inventors_variant, '{"inventor_name": "Al"}', []),
        (text.extract_inventors_variant, '"Al; Bo"', ["Al", "Bo"]),
        (text.extract_inventors_variant, "7", []),
        (text.extract_assignees_variant, '[{"company": "Acme Inc."}, {"name": "", "organization": "Org"}]', ["Acme Incorporated", "Org"]),
        (text.extract_assignees_variant, '{"company": "Acme"}', []),
        (text.extract_classification_codes_variant, '[{"class": "g06f"}, "h04l9/00", "ab"]', ["G06F", "H04L9/00"]),
        (text.extract_classification_codes_variant, '{"class": "g06f"}', []),
    ],
)
def test_names_of_json(spark, f, value, expected):
    assert run(spark, lambda c: f(F.parse_json(c)), [value]) == [expected]


def test_extract_codes(spark):
    assert run(spark, text.extract_classification_codes, ["g06n3/00; ab | a61b,x1y", None]) == [["G06N3/00", "A61B", "X1Y"], []]


def test_format_date(spark):
    given_dates = ["991231", "490101", "20200131", "2020-01-31", "on 2020/01/31", "2020-1-1", "", None]
    assert run(spark, text.format_date, given_dates) == [
        "1999-12-31", "2049-01-01", "2020-01-31", "2020-01-31", "2020-01-31", "2020-1-1", "", "",
    ]


def test_classify(spark):
    contents = ["a bitcoin for a robot", "quantum computing and robot robot robot", "nothing here", "contains rain", None]
    # A tie goes to the earlier field; `quantum` counts inside `quantum computing`, `ai` inside words.
    assert run(spark, classify.classify_content, contents) == ["Blockchain", "Robotics", "Unknown", "Machine Learning", None]
    assert run(spark, classify.classify_ipc, [["g06f", "A1"], ["X1"], [""], [], None], "array<string>") == [
        "Physics", "Unknown", "Unknown", "Unknown", "Unknown",
    ]
