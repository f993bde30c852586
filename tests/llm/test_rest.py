"""Page text, quality grades, packed ids, and the pipeline."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from flowkeel.llm import ordinal, packed, template, winnow
from tests.llm.odd import documents, lower, rows

TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packed_fields_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, (1 << bits) - 1, 777, dtype=np.uint32, endpoint=True)
    raw = packed.pack(ids, bits)
    assert len(raw) == -(-777 * bits // 8) and np.array_equal(packed.unpack(raw, 777, bits), ids)


@pytest.mark.parametrize("bits", [16, 13])
def test_random_access(tmp_path, bits):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint32) for n in (0, 1, 5000, 3, 70_000, 0, 4096)]
    writer = packed.Writer(f"{tmp_path}/x/a.ids", bits)
    for i, d in enumerate(docs):
        writer.add([i if i != 3 else None], d, np.array([len(d)]))
    assert writer.close() == (7, sum(map(len, docs)))
    file = packed.Reader(f"file:{tmp_path}/x/a.ids")
    assert all(np.array_equal(file.document(i), d) for i, d in enumerate(docs)) and file.nulls.tolist() == [0, 0, 0, 1, 0, 0, 0]
    assert np.array_equal(file.ids(4990, 5010), np.concatenate(docs)[4990:5010])


@pytest.mark.parametrize("parts", [1, 5])
def test_ids_equal_the_tokenizers(spark, parts, monkeypatch):
    t = Tokenizer.from_file(TOKENS)
    special = [(50, "It's <|endoftext|> NOT we'll 12345 <|ENDOFTEXT|> x Å ́y \x1c z\u0085q ﬁ İstanbul ŐŰ"), (51, "á\nb\r\n\tc")]
    data = [(r[0], r[1]) for r in rows()] + special
    got = [tuple(r) for r in packed.token_table(spark.createDataFrame(data, "doc_id long, text string").repartition(3), TOKENS, parts=parts).collect()]
    ids = [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for d, x in data]
    want = sorted(((-1 if d is None else d), len(i), zlib.crc32(i.tobytes())) for d, i in ids)
    assert sorted(((-1 if d is None else d), n, c) for d, _, n, c in got) == want
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [(-1 if d is None else d) for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)
    assert packed.token_table(documents(spark, lambda r: False), TOKENS).count() == 0


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


SHELL = ('<nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav><header><p>Site head</p></header><div class="ad">Buy {i}</div><article><h1>Head {i}</h1>{main}'
         '</article><aside>side {i}</aside><div id="comments"><p>A reader says {i}</p></div><form><p>Mail?<input></p></form><footer>foot &copy; {i}</footer>')
CASES = [
    ("<p>One &amp; two<br>three<p>Four <b>bold</b>\n five", "Head 0\n\nOne & two three\n\nFour bold five"),
    ("<p>A</p>tail text<ul><li>x<li>y</ul><!-- no <p>q</p> -->", "Head 1\n\nA\n\ntail text\n\nx\n\ny"),
    ('<p>Keep</p><div class="cookie notice">drop</div><p>a < b &lt;c&gt; &#233;&nbsp;z</p>', "Head 2\n\nKeep\n\na < b <c> é z"),
    ("<table><tr><td>1<td>2</table><script>x<y</script><p hidden>h</p>", "Head 3\n\n1\n\n2"),
    ("", "Head 4"),
]


def test_page_text(spark):
    data = [(i, "http://h.example/x", page(SHELL.format(i=i, main=m))) for i, (m, _) in enumerate(CASES)]
    odd = [(90, None, None), (91, "http://h.example/y", ""), (92, "nonsense", "plain &amp; text"), (93, "http://h.example/z", page("<p>no article <i>here</p><nav>n</nav>")),
           (94, "http://h.example/cut", page(SHELL.format(i=9, main="<p>cut off"))[:330]), (None, "http://h.example/x", data[0][2]), (0, "http://h.example/x", data[0][2])]
    pages = spark.createDataFrame([(*r, "c", "d") for r in data + odd], "page_id long, url string, html string, host string, token string").repartition(3)
    got = template.main_text(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert [text[i] for i in range(len(CASES))] == [w for _, w in CASES]
    assert text[90] == text[91] == "" and text[92] == "plain & text" and text[93] == "no article here" and text[None] == text[0]
    assert len(got) == len(data) + len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert template.main_text(pages.limit(0)).count() == 0


def test_template_classes(spark):
    data = [(i, "http://h.example/x", page(SHELL.format(i=i, main=m))) for i, (m, _) in enumerate(CASES)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", template.host_of("url"))
    classed = template.classes(pages)
    rows_ = {r["token"]: r for r in classed.collect()}
    article = rows_["/html/body/article"]
    assert article["valid"] and article["class"] == rows_["/html/body/article/h1"]["class"] == rows_["/html/body"]["class"]
    assert article["class"] != rows_["/html/body/article/p"]["class"] and not rows_["/html/body/article/p"]["valid"]
    assert [tuple(r) for r in template.templates(classed).collect()] == [("h.example", "/html/body/article")]


def texts_of(spark, bodies, host="h.example"):
    """Main text of each body; each is a page of one host."""
    data = [(i, f"http://{host}/{i}", page(b)) for i, b in enumerate(bodies)]
    got = template.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_page_text_keeps_all_of_the_article(spark):
    long = "many words " * 30
    assert texts_of(spark, [f"<article><h1>Head</h1><p>{long}</p></article>"]) == ["Head\n\n" + long.strip()]
    one = [f"<article><h1>Head {i}</h1><p>{long}{i}</p></article>" for i in range(4)]
    assert texts_of(spark, one) == [f"Head {i}\n\n{long}{i}" for i in range(4)]
    parts = [f'<article><h1>H {i}</h1><div class="lead">L {i}</div><div class="body"><p>{long}{i}</p><p>x {i}</p></div><div class="part2">P {i}</div></article>'
             for i in range(4)]
    assert texts_of(spark, parts) == [f"H {i}\n\nL {i}\n\n{long}{i}\n\nx {i}\n\nP {i}" for i in range(4)]
    fragments = [f"<div>{long}{i}</div><p>tail {i}</p>" for i in range(3)]
    assert texts_of(spark, fragments) == [f"{long}{i}\n\ntail {i}" for i in range(3)]


def test_page_text_leaves_out_the_hosts_template_text(spark):
    bodies = [f'<article><h1>Head {i}</h1><h2>Results</h2><p>{"own words " * 20}{i}</p><p>Share this article</p><div class="c3">Accept our terms</div></article>'
              for i in range(4)]
    assert texts_of(spark, bodies) == [f"Head {i}\n\nResults\n\n{'own words ' * 20}{i}" for i in range(4)]
    assert all("Accept our terms" in t for t in texts_of(spark, bodies[:2])), "two pages are no evidence"
    copies = [bodies[0]] * 5
    assert len(set(texts_of(spark, copies))) == 1 and "own words" in texts_of(spark, copies)[0] and "Share" in texts_of(spark, copies)[0]
    near = [f"<article><p>{'the same words ' * 20}</p><p>edit {i}</p></article>" for i in range(4)]
    assert all(t.startswith("the same words") for t in texts_of(spark, near))


def test_page_text_keeps_article_parts_with_names_like_boilerplate(spark):
    body = ('<article><h2 id="related-work">Related work</h2><section id="social-structure"><p>Social</p></section>'
            '<div id="comments-on-the-proof">Proof</div><p class="notice-period">Period</p><p>x is <math><mi>x</mi></math></p><svg><text>axis</text></svg></article>')
    assert texts_of(spark, [body]) == ["Related work\n\nSocial\n\nProof\n\nPeriod\n\nx is x\n\naxis"]
    assert "No article" in texts_of(spark, ['<h2 id="related-work">No article</h2><p>here</p>'])[0]
    marked = [f'<article><p>{"own words " * 9}{i}</p><div class="share-buttons">Tweet {i}</div></article>' for i in range(4)]
    assert texts_of(spark, marked) == [f"{'own words ' * 9}{i}" for i in range(4)]


def test_grades_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.filter("doc_id % 2 = 0")
    got = ordinal.grade_documents(docs, half).join(ordinal.graded(labels.filter("doc_id % 2 = 1")), "doc_id").toPandas()
    toxic, good = got[got.grade == 0], got[got.grade == 2]
    assert len(toxic) > 100 and (~toxic.keep).mean() > 0.8 and good.keep.mean() > 0.985
    means = got.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]
    assert ((got.p_not_toxic >= got.p_good) & (got.expected_grade - got.p_not_toxic - got.p_good).abs().lt(1e-9)).all()


def test_held_out_toxic_and_poor_documents_are_rejected(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = ordinal.grade_documents(docs, labels.filter("doc_id % 2 = 0")).join(
        ordinal.graded(labels.filter("doc_id % 2 = 1")), "doc_id").toPandas()
    rejected = 1 - got.groupby("grade").keep.mean()
    print(rejected)
    assert rejected[0] > 0.9 and rejected[1] > 0.35 and rejected[2] < 0.015


def test_grades_of_odd_documents(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1, 0, "x"), (1, 0, 0, "x"), (1, 1, 1, "x"), (2, None, None, "x"), (None, 1, 1, "x"), (9999, 1, 1, "x"), (5, None, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    assert sorted(tuple(r) for r in ordinal.graded(labels).collect()) == [(0, 2), (1, 0), (5, 0), (9999, 0)]
    assert ordinal.grade_documents(docs, labels).count() == len(rows())
    unlabelled = ordinal.grade_documents(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(rows()) and all(r["keep"] and r["p_good"] > 0.9 for r in unlabelled)
    assert ordinal.grade_documents(docs.limit(0), labels).count() == 0
    kept = ordinal.good_documents(docs, labels)
    assert kept.columns == docs.columns


def test_a_repeated_id_counts_once_in_the_fit(spark):
    texts = [(i, f"{('vile', 'dull', 'fine')[i % 3]} w{i % 7} and w{i % 5}") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    once, often = (ordinal.train(spark.createDataFrame(d, "doc_id long, text string").repartition(3), ordinal.graded(labels))
                   for d in (texts, texts + [texts[4]] * 500))
    assert once[0].any() and np.array_equal(once[0], often[0]) and np.array_equal(once[1], often[1])


def test_thresholds_ascend_and_separate():
    x = [np.array([1, i % 7 + 100]) for i in range(60)] + [np.array([2, i % 7 + 100]) for i in range(60)] + [np.array([3, i % 7 + 100]) for i in range(60)]
    y = np.repeat([0, 1, 2], 60)
    w, cuts = ordinal.fit(x, y, sparse=0.1)
    s = np.array([w[r].sum() for r in x])
    assert cuts[0] < cuts[1] and ((s > cuts[0]).astype(int) + (s > cuts[1]) == y).mean() > 0.95


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if number < 4:
            assert out.dtypes == docs.dtypes
            before, docs = docs.count(), spark.createDataFrame(out.collect(), docs.schema)
            assert 0 < docs.count() and (number == 3 or docs.count() < before)
    last = out.toPandas()
    t = Tokenizer.from_file(TOKENS)
    want = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sorted(zip(last.doc_id.tolist(), last.n_tokens.tolist(), strict=True)) == want
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_bear_odd_documents(spark, sf_dir, number):
    docs = spark.createDataFrame([r[:5] for r in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[number][1](spark, d, sf_dir)
        got = out.collect()
        if number < 4:
            assert out.dtypes == docs.dtypes
        if number == 0 or number == 2:
            assert len(got) <= d.count()


def test_words_are_digits_letters_and_all_beyond_ascii(spark):
    texts = ["".join(chr(c) for c in range(0, 0x180)), "Aİé_b \U0001f600x\U00020000 c-d　e", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(winnow.words_of("text").alias("w")).collect()
    for row, t in zip(got, texts, strict=True):
        assert row["w"] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


@pytest.mark.parametrize("span", [1, 2, 3, 4, 5, 6, 7])
def test_runs_from_shorter_runs(spark, span):
    values = [[5, 3, 9, 1, 7, 7, 2, 8, 4], [1] * span, list(range(span, 0, -1))]
    got = spark.createDataFrame([(v,) for v in values], "v array<long>").select(
        winnow.folded(F.col("v"), span, lambda a, b: F.least(a, b)).alias("low"),
        winnow.folded(F.col("v").cast("array<string>"), span, lambda a, b: F.concat(a, F.lit(" "), b)).alias("run")).collect()
    for row, v in zip(got, values, strict=True):
        runs = [v[i:i + span] for i in range(len(v) - span + 1)]
        assert row["low"] == [min(r) for r in runs] and row["run"] == [" ".join(map(str, r)) for r in runs]
