"""Benchmark decontamination by winnowing. Native expressions only.

Of every six consecutive 5-gram hashes of words the smallest is a fingerprint, so that any ten
words that two texts share have a fingerprint in common, at the same place. Fingerprints
carry their position in their low bits. Those of the documents meet those of the
benchmark in an equality join; every hit is extended to the windows around it, and a
window counts only if its ten words are equal. Items of fewer words are looked up by their
whole sequence in the same way.

Defined cases: null texts have no words, are not contaminated and have no items. Repeated
rows each get the result of their text; repeated benchmark rows change nothing. A null
item id counts as one item and is listed as an empty string. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.llm.frames import keyed, lower_ascii, same_row, sized
from flowkeel.session import materialise

#: ASCII digits and letters and all that is not ASCII. Said without a negation: Java matches that several times as fast.
WORD = "[\\p{Alnum}\\P{ASCII}]+"
WINDOW = 10
GRAM = 5
#: Low bits of a fingerprint that hold its position; longer texts repeat positions.
PLACE_BITS = 20
KEY_ROWS = 1_000_000


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def tail(values: Column, skip: int) -> Column:
    """The array without its first elements."""
    return F.slice(values, skip + 1, F.greatest(F.size(values) - skip, F.lit(0)))


def beside(values: Column, other: Column, ahead: int, merge) -> Column:
    """merge(values[i], other[i + ahead]) for every i that has both; `other` is no longer than `values`."""
    return F.zip_with(F.slice(values, 1, F.greatest(F.size(other) - ahead, F.lit(0))), tail(other, ahead), merge)


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def folded(values: Column, span: int, merge) -> Column:
    """All runs of `span` values merged, each from two shorter runs."""
    if span == 1:
        return values
    if span % 2:
        return bound(values, lambda v: beside(folded(v, span - 1, merge), v, span - 1, merge))
    return bound(folded(values, span // 2, merge), lambda h: beside(h, h, span // 2, merge))


def fingerprints(words: str, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Distinct winnowed fingerprints of a text of `window` words or more: hash above, position below.

    Each word is hashed once; hashes of grams and minima of windows come from those of shorter runs.
    """
    mask = (1 << PLACE_BITS) - 1
    hashes = F.transform(F.col(words), lambda w: F.xxhash64(w))
    placed = F.transform(folded(hashes, gram, lambda a, b: F.xxhash64(a, b)), lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(
        i.cast("long").bitwiseAND(F.lit(mask))))
    return F.array_distinct(folded(placed, window - gram + 1, lambda a, b: F.least(a, b)))


def pieces(words: str, length: int) -> Column:
    """Hash of every run of `length` words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: F.xxhash64(F.slice(words, i + 1, length)))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, start, length, item for every benchmark window in a document."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of("text").alias("w")).filter(
        F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    n = F.size("w")
    wanted = materialise(items.select("item", size.alias("length"), F.explode(F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.slice("w", i + 1, size))).alias("words")).distinct(), "windows")
    marks = items.filter(n >= window).select(F.explode(fingerprints("w", window, gram)).alias("v")).select(
        F.shiftright("v", PLACE_BITS).alias("mark")).distinct()
    short = [r[0] for r in wanted.filter(F.col("length") < window).select("length").distinct().collect()]  # at most window - 1

    w = keyed(docs).select("doc_id", "text_hash", words_of("text").alias("w"))
    read = w.filter(n >= window).select("doc_id", "text_hash", n.alias("n"), F.explode(fingerprints("w", window, gram)).alias("v"))
    hits = read.select("doc_id", "text_hash", "n", "v", F.shiftright("v", PLACE_BITS).alias("mark")).join(sized(marks), "mark")
    reach = window - gram
    place = F.col("v").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    places = F.transform(F.sequence(F.lit(0), F.shiftright(F.col("n") - 1, PLACE_BITS)), lambda t: place.cast("int") + F.shiftleft(t, PLACE_BITS))
    starts = hits.select("doc_id", "text_hash", "n", F.explode(places).alias("place")).filter(
        F.col("place") <= F.col("n") - gram).select(
        "doc_id", "text_hash", F.lit(window).alias("length"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - reach), F.least("place", F.col("n") - window))).alias("start"))
    for length in sorted(short):
        known = wanted.filter(F.col("length") == length).select(F.xxhash64("words").alias("mark")).distinct()
        tried = w.filter(n >= length).select("doc_id", "text_hash", F.posexplode(pieces("w", length)).alias("start", "mark"))
        starts = starts.union(tried.join(sized(known), "mark").select("doc_id", "text_hash", F.lit(length).alias("length"), "start"))
    found = materialise(starts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("length", "start")).alias("starts")), "hits")
    # Only the documents with hits are split into words again: their keys, 16 bytes each, are broadcast up to a bound.
    keys = sized(found.select("doc_id", "text_hash"), KEY_ROWS)
    hit = keyed(docs)
    hit = hit.join(keys, same_row(hit, keys), "left_semi").select("doc_id", "text_hash", words_of("text").alias("w"))
    at = found.join(hit, same_row(found, hit)).select(found["doc_id"], found["text_hash"], F.explode(F.transform("starts", lambda s: F.struct(
        s["start"].alias("start"), s["length"].alias("length"), F.slice("w", s["start"] + 1, s["length"]).alias("words")))).alias("o"))
    return at.select("doc_id", "text_hash", "o.*").join(sized(wanted), ["length", "words"]).select(
        "doc_id", "text_hash", "start", "length", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text)."""
    found = materialise(occurrences(docs, benchmark, window, gram), "occurrences")
    key = ["doc_id", "text_hash"]
    spans = found.select(*key, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    words = covered.groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = found.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    each_doc = words.join(named, (words["doc_id"].eqNullSafe(named["doc_id"])) & (words["text_hash"] == named["text_hash"])).select(
        words["doc_id"], words["text_hash"], "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(
        F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("n_words"))
    none = F.array().cast("array<string>")
    return base.join(each_doc, same_row(base, each_doc), "left").select(
        base["doc_id"], base["text_hash"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs."""
    hit = materialise(occurrences(docs, benchmark, window, gram).select("doc_id", "text_hash").distinct(), "contaminated")
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    return rows.join(hit, rows["doc_id"].eqNullSafe(hit["doc_id"]) & (rows["_hash"] == hit["text_hash"]), "left_anti").drop("_hash")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, t)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
