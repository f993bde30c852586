"""Queries and operators that SQL can state, on the small tables and on odd rows."""

import duckdb
import pyarrow as pa
import pytest

from flowkeel.llm import mixing, urlfilter, winnow
from flowkeel.llm.catalog import ORACLES, QUERIES
from tests.compare import mismatch, oracle_connection
from tests.llm.odd import SCHEMA, documents, rows

URLS = ["http://Example.NET/en/a", "https://a.b.example.net/en/", "http://example.net/de/", "http://xexample.net/en/x", "http://example.com/de",
        "http://example.com/de/", "http://M.example.com/de/1?x=/en/", "http://org/fr/", "http://a.org/fr/x#y", "http://a.org", "http://net",
        "http://net/", "HTTP://NET?x", "no scheme", "", None, "http://", "://x.net/", "http://m.ads-track.example.com/fr/1", "http://ads2.example.org/fr/",
        "http://ads.example.com/", "http://x.com/ads/1", "a\nb://h.net/p\nq", "http://é.net/ü/", "http://x.net/://y.org/fr/", "http://a.org/FR/"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert mismatch(QUERIES[name](spark, sf_dir), oracle_connection(sf_dir), ORACLES[name]) is None


def con(**tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(f"{name}_arrow", t)
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return c


def arrow_documents(data):
    return pa.table({"doc_id": pa.array([r[0] for r in data], pa.int64()), "text": pa.array([r[1] for r in data], pa.string()),
                     "source": pa.array([r[3] for r in data], pa.string())})


def test_odd_urls(spark):
    data = [(i % 20 or None, u, "html", "h", "p") for i, u in enumerate([*URLS, URLS[0]])]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, host string, token string")
    t = pa.table({"page_id": pa.array([r[0] for r in data], pa.int64()), "url": pa.array([r[1] for r in data], pa.string())})
    assert mismatch(urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES)), con(pages=t), urlfilter.ORACLE) is None
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def test_rules_are_indexed_by_their_rarest_token(spark):
    rules = (urlfilter.prefix_rule("block", "a.com", "/x/rare/"), urlfilter.pattern_rule("allow", "x", ), urlfilter.pattern_rule("block", "never", "never"))
    pages = spark.createDataFrame([(1, "http://a.com/x/rare/1"), (2, "http://a.com/x/2"), (3, "http://b.com/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules), "block").collect()}
    assert got == {1: ("a.com/x/rare/", "block"), 2: (None, "allow"), 3: (None, "block")}


@pytest.mark.parametrize("keep", [lambda r: True, lambda r: r[3] == "s1", lambda r: False, lambda r: not (r[1] or "").strip()])
def test_mixing_odd_documents(spark, keep):
    data = [r for r in rows() if keep(r)]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).select("doc_id", "size", "source_size", "target", "taken")
    assert mismatch(got, con(documents=arrow_documents(data)), mixing.ORACLE) is None


def test_mixing_comes_near_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs.drop("text_hash")).collect()
    by = {}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in got:
        assert r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        t = by.setdefault(sources[r["doc_id"]], [0, r["target"], 0, r["source_size"]])
        t[0], t[2] = t[0] + r["taken"], max(t[2], r["size"])
    for taken, target, longest, size in by.values():
        assert abs(taken - target) <= longest / 2 and target <= 3 * size
    assert sum(t[1] for t in by.values()) == pytest.approx(sum(t[3] for t in by.values()))


def test_mixed_rows_repeat_whole_rows(spark):
    docs = documents(spark)
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns and got.count() == want


BENCH = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item of five words"), (3, "Solo"), (None, "alpha BETA gamma"),
         (4, None), (5, "..."), (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (6, "rep rep rep rep rep rep rep rep rep rep rep rep")]
LEAKS = ["x alpha beta gamma delta epsilon zeta eta theta iota kappa y", "alpha beta gamma delta epsilon zeta eta theta iota", "SHORT-item of five words, solo",
         "short item of five word", "rep " * 30, "rep " * 9, "alpha beta gamma", "solo", "", None, "w " * 3000 + BENCH[0][1] + " w" * 3000, "é solo ü",
         "iota kappa lambda mu alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"]


def test_contamination_of_odd_documents(spark):
    data = [(i % 11 or None, t, "en", "s", 1) for i, t in enumerate([*LEAKS, *LEAKS[:3]])] + [r[:5] for r in rows()]
    docs = spark.createDataFrame([(*r, "c") for r in data], "doc_id long, text string, lang string, source string, n_chars long, item string")
    bench = spark.createDataFrame([(*b, "c") for b in BENCH], "item_id long, text string, words string")
    b = pa.table({"item_id": pa.array([r[0] for r in BENCH], pa.int64()), "text": pa.array([r[1] for r in BENCH], pa.string())})
    got = winnow.contamination(docs, bench)
    assert mismatch(got.drop("text_hash"), con(documents=arrow_documents(data), benchmark=b), winnow.ORACLE) is None
    clean = winnow.clean_rows(docs, bench)
    assert clean.columns == docs.columns and clean.count() == got.filter("not contaminated").count()
    assert winnow.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert winnow.contamination(docs.limit(0), bench).count() == 0


def test_positions_wrap(spark, monkeypatch):
    monkeypatch.setattr(winnow, "PLACE_BITS", 3)
    data = [(1, "w " * 100 + BENCH[0][1] + " w" * 100), (2, "a b c")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in winnow.contamination(docs, spark.createDataFrame(BENCH[:1], "item_id long, text string")).collect()}
    assert got == {1: 12, 2: 0}
