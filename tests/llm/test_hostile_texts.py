"""One long text must not stop a job: texts of 300 KB to 1 MB of the kinds that make pattern matching deep or quadratic."""
import time

import pytest

from fpengine.llm import audit, jaccard, mixing, pages, pii, toxicity, winnowing

HOSTILE = {
    "dots": "a@" + "b." * 300_000 + "1 x", "labels": "a@" + "b-" * 300_000 + ".", "ats": "a@b." * 250_000, "spaces": "x" + " " * 1_000_000 + "y",
    "spaces and words": ("w" + " " * 40) * 20_000, "digits": "7" * 1_000_000, "digit groups": "1234 " * 200_000, "plus": "+1 " * 300_000, "dates": "2020-01-" * 120_000,
    "octets": "1.2.3." * 150_000, "iban": "DE12 " + "ABCD " * 200_000, "iban run": "DE12" * 250_000, "secret": "password=" * 100_000, "one word": "w" * 1_000_000,
    "quotes": '"' * 1_000_000, "brackets": "(" * 1_000_000, "capitals": "A" * 1_000_000, "keys": "api_key:" * 120_000}


@pytest.fixture(scope="module")
def hostile(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(HOSTILE.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).cache()


@pytest.mark.parametrize("kind", list(HOSTILE))
def test_pseudonyms_of_one_text(spark, kind):
    df = spark.createDataFrame([(1, HOSTILE[kind])], "doc_id long, text string")
    t = time.time()
    out = pii.pseudonymise(df).collect()
    assert len(out) == 1 and len(out[0].text) >= 0.5 * len(HOSTILE[kind]) and time.time() - t < 60


def test_short_and_long_domains(spark):
    df = spark.createDataFrame([(1, "a.b9@mail.example.org"), (2, "x@" + "a." * 100 + "com"), (3, "x@" + "a." * 400 + "com")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df).collect()}
    assert got[1] != "a.b9@mail.example.org" and got[2] != "x@" + "a." * 100 + "com" and got[3] == "x@" + "a." * 400 + "com"


def test_other_operators(spark, hostile):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    n = hostile.count()
    for run in (lambda: mixing.mix_counts(hostile), lambda: audit.audit(hostile, labels), lambda: jaccard.similar_components(hostile),
                lambda: winnowing.fingerprint_edits(hostile)):
        t = time.time()
        assert run().count() in (n, 3 * 600) and time.time() - t < 120


def test_word_counts(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), (" a  b\x0bc ",), ("a",), (" x y",)], "t string")
    from fpengine.llm.common import n_words
    assert [r[0] for r in df.select(n_words("t")).collect()] == [0, 0, 0, 3, 1, 2]


def test_reject_where_read(spark):
    bad, good = "you filthy vermin leave now", "a calm walk along the river bank"
    rows = [(i, bad if i % 2 else good, "en", "s", 1) for i in range(80)] + [(None, good, "en", "s", 1), (7, good, "en", "s", 1), (7, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    out = toxicity.drop_toxic(docs, labels)
    got = [r.text for r in out.collect()]
    assert out.schema == docs.schema and bad not in got and got.count(good) == 42 and got.count(None) == 1
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a ">" ' * 100_001 + '"', "<div>" * 100_000 + "</b>" * 100_000, "<script " * 100_000, "<![CDATA[" * 100_000,
                                  "<!x" * 300_000, "<a '>" + "<a " * 300_000 + ">" + "<b " * 300_000])
def test_broken_pages_take_one_pass(page):
    t = time.time()
    pages.page_lines(page)
    assert time.time() - t < 20


def test_open_quote_leaves_no_markup():
    assert pages.page_lines('<p title="x>Hello world</p>') == [("Hello world", pages.OTHER)]
    assert pages.page_lines("<p title='a>b'>Hi <b>you</b>") == [("Hi you", pages.OTHER)]
    assert pages.page_lines("x < y and <b") == [("x < y and", pages.OTHER)]
