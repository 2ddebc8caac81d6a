import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import langid, toxicity
from docketry.llm.chat import Template, format_conversations, token_mask
from docketry.llm.licenses import scan_licenses, word_weights
from docketry.llm.oracle import llm_oracles
from docketry.llm.queries import URL_RULES, llm_queries, op6_toxicity, op8_language_id
from docketry.llm.urls import RULES, judge_urls
from tests.compare import connect, differences

SF = "/root/testdata/sf0.1"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\"]), st.text(alphabet="[/INST]<s>|\\\nab", max_size=30)), max_size=4))
def test_template_is_reversible(turns):
    template = Template()
    formatted, starts, ends, _ = template.render(turns)
    assert template.parse(formatted) == turns
    assert [template.unescape(formatted[a:b]) for a, b in zip(starts, ends)] == [t for _, t in turns]
    for a, b in zip(starts, ends):
        assert not any(mark in formatted[a:b] for mark in template.control)


def test_token_mask():
    mask, low, high = token_mask(np.array([0, 3, 5, 9]), np.array([3, 5, 9, 12]), np.array([4, 9]), np.array([6, 10]))
    assert mask.tolist() == [False, True, True, True]
    assert low[mask].tolist() == [4, 5, 9] and high[mask].tolist() == [5, 6, 10]
    assert not token_mask(np.array([0]), np.array([3]), np.array([], int), np.array([], int))[0].any()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi 😀 ü"), (1, 0, "user", None), (1, 2, None, "x"), (None, None, "assistant", "</s>"), (2, 0, "user", ""), (2, 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.conv_id: r for r in format_conversations(frame, path).collect()}
    template = Template()
    assert template.parse(got[1].formatted) == [("user", ""), ("assistant", "hi 😀 ü"), ("", "x")]
    loss = lambda r: template.unescape("".join(r.formatted[a:b] for a, b in zip(r.loss_starts, r.loss_ends)))
    assert loss(got[1]) == "hi 😀 ü" and loss(got[None]) == "</s>" and loss(got[2]) == ""
    assert got[2].n_turns == 2 and len(got[1].ids) == len(got[1].loss_mask)
    assert format_conversations(frame.limit(0), path).count() == 0


def test_url_rules(spark):
    urls = [
        ("https://Example.ORG/en/12?x", "org/", "example.org/en/1", "block"), ("x://a.example.org/es/#f", None, "example.org/es/", "block"),
        ("x://notexample.org/es/", None, "org/", "allow"), ("x://a.com/de/x", None, "com/de/", "block"), ("x://a.net/de/", None, None, "allow"),
        ("x://org", None, None, "allow"), (None, None, None, "allow"), ("no scheme", None, None, "allow"), ("", None, None, "allow"),
        ("x://org:80/", None, None, "allow"), ("x://" + "a." * 5000 + "org/" + "b" * 5000, None, "org/", "allow"),
    ]
    rows = spark.createDataFrame([(i, u[0], "r") for i, u in enumerate(urls)] + [(0, urls[0][0], "r"), (None, None, "r")], "page_id bigint, url string, rule string")
    got = judge_urls(rows, spark.createDataFrame(URL_RULES, RULES)).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.rule, r.verdict) == urls[r.page_id][2:], urls[r.page_id]
    assert [(r.host, r.path) for r in got if r.page_id is None] == [("", "")]
    assert judge_urls(rows.limit(0), spark.createDataFrame(URL_RULES, RULES)).count() == 0
    assert {r.verdict for r in judge_urls(rows, spark.createDataFrame([], RULES), default="block").collect()} == {"block"}


def test_a_later_scheme_is_no_path(spark, tmp_path):
    """Redirects hold a second `://`; host and path are those of the first. Also as SQL tells."""
    urls = ["http://a.com?next=https://c.com/de/1", "http://www.example.org#x://y/es/", "x://?://a.com/de/", "http://c.com/de/?u=http://example.org/es/",
            "://example.org/es/x", "a://b://c.com/de/1", "http://" + "a?" * 50_000 + "://c.com/de/"]
    spark.createDataFrame([*enumerate(urls)], "page_id bigint, url string").coalesce(1).write.parquet(f"{tmp_path}/p")
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    got = {r.page_id: r for r in llm_queries()["op9_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[i].path for i in range(len(urls))] == ["", "", "", "/de/", "/es/x", "//c.com/de/1", ""]
    assert [got[i].verdict for i in range(4)] == ["allow", "allow", "allow", "block"]
    _, problems = differences(spark, connect(str(tmp_path)), llm_queries()["op9_url_filter"], llm_oracles()["op9_url_filter"], str(tmp_path))
    assert not problems, problems


def test_rows_without_text_do_not_crowd_out_a_language(spark):
    rows = [(i, "le chat et la maison " + str(i), "fr") for i in range(6)] + [(100 + i, "the cat and the house " + str(i), "en") for i in range(6)]
    rows = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    nothing = spark.range(1000, 21_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '12 !' END AS text", "'fr' AS lang")
    same = spark.range(20_000).selectExpr("CAST(21 AS bigint) AS doc_id", "concat('el gato y la casa ', id) AS text", "'es' AS lang")
    model = langid.fit(rows.unionByName(nothing).unionByName(same))
    assert model.languages == ["en", "es", "fr"]


def test_licenses(spark):
    texts = [
        "Released under the MIT  License. mit-license", "GNU General Public License, version 3", None, "", "limit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing", "é" * 50_000 + " apache license",
    ]
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in scan_licenses(rows, word_weights(rows)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 3, 5, "mit")
    assert (got[1].base_labels, got[1].labels, got[1].score) == ("gpl", "gpl,gpl3", 1.0)
    assert [(got[i].n_words, got[i].first_word, got[i].labels, got[i].score) for i in (2, 3)] == [(0, None, "", 0.0)] * 2
    assert got[4].n_base == 0
    assert got[5].labels == "mit-text" and 0.5 <= got[5].score < 1 and got[5].base_labels == ""
    assert got[6].n_words == 3 and got[6].base_labels == "apache"
    assert scan_licenses(rows.limit(0), word_weights(rows.limit(0))).count() == 0


def test_nearest_examples_equal_a_full_scan():
    rng = np.random.default_rng(5)
    presence = (rng.random((700, 40)) < 0.1).astype("float32")
    labels = (rng.random(700) < 0.3).astype("int64")
    model = toxicity.build([(str(i), 1) for i in range(40)], rng.random(40).astype("float32") + 0.5, np.arange(700), presence, labels, (900, 100))
    asked = model.unit((rng.random((60, 40)) < 0.1).astype("float32"))
    where, cosine, opened = model.nearest(asked)
    full = np.round(asked @ model.vectors.T, 6)
    best = -np.sort(-full, axis=1)[:, :toxicity.NEAREST]
    assert np.allclose(np.where(best > 0, best, 0), cosine, atol=2e-6)
    assert opened < len(asked) * len(model.maxima)


def test_toxicity_held_out(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    rows = op6_toxicity(spark, SF).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p, _ in held)
    assert np.mean([p == y for _, p, y in held]) > 0.97
    assert np.mean([p for _, p, y in held if y == 1]) > 0.88


def test_language_held_out(spark):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.995


def test_classifiers_on_edges(spark):
    schema = "doc_id bigint, text string, lang string, score double"
    docs = spark.createDataFrame([(i, t, l, 0.0) for i, (t, l) in enumerate([(None, "en"), ("", None), ("12 !!", "fr"), ("the cat sat", "en"), ("le chat dort", "fr")] * 3)] + [(None, "x", "en", 0.0)], schema)
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, empty)
    assert {r.p for r in docs.select(toxicity.toxicity_column(F.col("text"), model, docs)["predicted"].alias("p")).collect()} <= {0, 1}
    known = langid.fit(docs)
    got = docs.select("text", langid.language_column(F.col("text"), known, docs)["lang_pred"].alias("p")).collect()
    assert all(r.p == "und" for r in got if not r.text or r.text == "12 !!")
    assert all(r.p == ("en" if "cat" in r.text else "fr") for r in got if r.text and "t" in r.text)
    none = docs.limit(0)
    assert langid.fit(none) is None
    assert none.select(langid.language_column(F.col("text"), None, none)).count() == 0
    assert none.select(toxicity.toxicity_column(F.col("text"), toxicity.fit(none, empty), none)).count() == 0


def test_term_matrix_counts():
    texts = pa.array(["aaaa aaaa b", None, "AAAA, c"])
    got = np.concatenate([*toxicity.term_matrix(texts, {"aaaa": [(1, 0), (2, 1)], "aaaa*": [(2, 2)]}, 3)])
    assert got.tolist() == [[1, 1, 1], [0, 0, 0], [1, 0, 0]]
    found = toxicity.sample_terms(texts, np.array([1, 0, 0]))
    assert found["aaaa", 1, 1] == 1 and found["aaaa", 1, 0] == 1 and ("aaaa", 4, 1) not in found
