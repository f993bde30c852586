"""Quality grades by ordinal cumulative-link regression on hashed text.

Grades rise from toxic (0) over poor (1) to good (2). One weight vector serves all
thresholds: P(grade <= j) = sigmoid(t[j] - s), t ascending, s being the sum of the weights of a
text's features. Features are hashed: each distinct word (letters and digits, lower-cased), its
first four, five and six bytes, and coarse bins of a few measures of style. The model's
expected grade and its tail probabilities serve to select documents: the floors of P(not toxic) and of the
expected grade are what all but a few of the good documents in a held-out fifth of the sample reach under a
model of the rest. The final model is fitted to the whole sample.

The fit reads at most `sample` labelled documents, those whose ids hash lowest, in one task; all
else runs over every document. Defined cases: null and empty texts have no words and are judged
by their style bins alone. Labels that repeat an id count with their lowest grade; a null
label says nothing, and labels of unknown ids are ignored. Without labels all weights and
thresholds are fixed so that every text is good. Repeated rows each get their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkeel.llm import text as T
from flowkeel.session import ship_package

SAMPLE = 12_000
BITS = 20
GRADES = 3
EPOCHS = 10
LEAST_DOCS = 4
SPARSE = 1.5
RATE = 0.3
#: Thresholds without any labels: every text is good.
NO_CUTS = np.array([-5.0, -4.0])
PREFIXES = (4, 5, 6)
KEEP_TAIL = 0.1
#: Shares of good held-out documents that the floors of P(not toxic) and of the expected grade may cost.
LOSSES = (0.005, 0.0075)
#: Floors where fewer than LEAST_HELD good documents are held out.
LEAST_HELD = 50
FLOORS = (0.5, 1.0)

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[48:58] = NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SIGN = NOT_LETTER & ~T.SPACE


def slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (T.mix(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature slots of each text, and where each text's begin."""
    data, at = T.text_buffers(column)
    start, end, first = T.word_spans(data, at, NOT_LETTER)
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    words = T.span_hashes(data, start, end)
    order = np.lexsort((words, text))
    fresh = np.ones(len(order), bool)
    w, t = words[order], text[order]
    fresh[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    pick = np.sort(order[fresh])
    owner, got = [text[pick]], [slots(words[pick], 0)]
    for k in PREFIXES:
        long = pick[(end - start)[pick] >= k]
        owner.append(text[long])
        got.append(slots(T.span_hashes(data, start[long], start[long] + k), k))
    size = np.maximum(1, np.diff(at)).astype(float)
    count = np.diff(first)
    distinct = np.bincount(text[pick], minlength=n)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return (sums[at[1:]] - sums[at[:-1]]) / size

    style = [distinct / np.maximum(1, count), share(UPPER), share(SIGN), np.minimum(1, size / np.maximum(1, count) / 40)]
    level = np.minimum(6, np.log2(count + 1) / 2).astype(int)
    for k, x in enumerate(style):
        owner.append(np.arange(n))
        # Distinct words get rarer with length, so the bins are told apart by it.
        got.append(slots((np.minimum(15, x * 16).astype(np.uint64) * np.uint64(8) + level.astype(np.uint64)), 100 + k))
    owner, got = np.concatenate(owner), np.concatenate(got)
    order = np.argsort(owner, kind="stable")
    return got[order], np.searchsorted(owner[order], np.arange(n + 1))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def below(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade <= j) for every cut j, and 1 for the last grade."""
    return np.concatenate([sigmoid(cuts[None] - scores[:, None]), np.ones((len(scores), 1))], axis=1)


def fit(slots_: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES, epochs: int = EPOCHS,
        least_docs: int = LEAST_DOCS, sparse: float = SPARSE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by follow-the-regularised-leader over mini-batches.

    Slots that fewer than `least_docs` documents hold have no weight, and the absolute penalty
    keeps those at zero that say little, so that long texts do not add up noise.
    """
    w = np.zeros(1 << BITS, np.float32)
    share = np.cumsum(np.bincount(grades, minlength=grades_n)[:-1] + 0.5) / (len(grades) + 0.5 * grades_n)
    cuts = np.log(share / (1 - share))
    if len(np.unique(grades)) < 2:
        return w, NO_CUTS if len(grades) == 0 else cuts
    held = np.bincount(np.concatenate([np.unique(x) for x in slots_]), minlength=1 << BITS) >= least_docs
    slots_ = [x[held[x]] for x in slots_]
    z, seen = np.zeros(1 << BITS), np.zeros(1 << BITS)
    seen_c = np.full(grades_n - 1, 1.0)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(grades))
        for lo in range(0, len(order), 32):
            rows = order[lo:lo + 32]
            x = np.concatenate([slots_[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(slots_[i]) for i in rows])
            s = np.bincount(owner, w[x], minlength=len(rows))
            upto = np.concatenate([np.zeros((len(rows), 1)), below(s, cuts)], axis=1)
            y, k = grades[rows], np.arange(len(rows))
            hi, lo_p = upto[k, y + 1], upto[k, y]
            p = np.maximum(hi - lo_p, 1e-12)
            d_hi, d_lo = hi * (1 - hi), lo_p * (1 - lo_p)
            g = (d_hi - d_lo) / p
            touched, back = np.unique(x, return_inverse=True)
            grad = np.bincount(back, g[owner])
            more = seen[touched] + grad * grad
            z[touched] += grad - (np.sqrt(more) - np.sqrt(seen[touched])) / RATE * w[touched]
            seen[touched] = more
            over = np.abs(z[touched]) - sparse
            w[touched] = np.where(over > 0, -np.sign(z[touched]) * over / ((1 + np.sqrt(more)) / RATE), 0)
            g_cut = np.zeros(grades_n - 1)
            np.add.at(g_cut, y[y < grades_n - 1], (-d_hi / p)[y < grades_n - 1])
            np.add.at(g_cut, y[y > 0] - 1, (d_lo / p)[y > 0])
            seen_c += g_cut * g_cut
            cuts = np.maximum.accumulate(cuts - 0.3 * g_cut / np.sqrt(seen_c) + np.arange(grades_n - 1) * 1e-9)
    return w, cuts


def tails(s: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(not toxic), expected grade and P(good) of each score."""
    tail = 1 - below(s, cuts)[:, :-1]
    return tail[:, 0], tail.sum(axis=1), tail[:, -1]


def floors(slots_: list[np.ndarray], grades: np.ndarray, epochs: int = EPOCHS) -> tuple[float, float]:
    """Least P(not toxic) and expected grade of a document that stays, set on every fifth document."""
    held = np.arange(len(grades)) % 5 == 0
    good = np.flatnonzero(held & (grades == GRADES - 1))
    if len(good) < LEAST_HELD or len(np.unique(grades[~held])) < 2:
        return FLOORS
    w, cuts = fit([slots_[i] for i in np.flatnonzero(~held)], grades[~held], epochs=epochs)
    measures = tails(np.array([w[slots_[i]].sum(dtype=float) for i in good]), cuts)
    return tuple(float(np.quantile(m, loss)) for m, loss in zip(measures, LOSSES, strict=False))


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.blocks(batches, "text"):
        got, first = features(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(
            pa.array(first.astype(np.int32)), pa.array(got))], names=["doc_id", "grade", "slots"])


def trainer(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grades, rows = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            grades += batch.column(1).to_pylist()
            flat, at = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(2).offsets)
            rows += [flat[a - at[0]:b - at[0]] for a, b in zip(at[:-1], at[1:], strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(rows[i]), rows[i].tobytes()))
        rows, grades = [rows[i] for i in order], np.array([grades[i] for i in order], np.int64)
        w, cuts = fit(rows, grades, epochs=epochs)
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()], "cuts": [cuts.tolist()], "floors": [list(floors(rows, grades, epochs))]},
                                         schema=pa.schema([("weights", pa.binary()), *[(c, pa.list_(pa.float64())) for c in ("cuts", "floors")]]))
    return run


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labels (doc_id, quality, toxic): toxic 0, poor 1, good 2."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(
        F.min("grade").cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Weights, thresholds and floors, fitted on at most `sample` labelled documents; of rows that share an id, on the text with the lowest hash."""
    ship_package(docs.sparkSession)
    known = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "grade").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).mapInArrow(
        featurise, "doc_id long, grade int, slots array<int>")
    got = rows.repartition(1).mapInArrow(trainer(epochs), "weights binary, cuts array<double>, floors array<double>").collect()  # one model, at most one row
    if not got:
        return np.zeros(1 << BITS, np.float32), NO_CUTS, FLOORS
    return np.frombuffer(got[0]["weights"], np.float32), np.array(got[0]["cuts"]), tuple(got[0]["floors"])


def scorer(model, keep_tail: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts, least = model.value
        for batch in T.blocks(batches, "text"):
            got, first = features(batch.column(batch.schema.get_field_index("text")))
            n = batch.num_rows
            s = np.bincount(np.repeat(np.arange(n), np.diff(first)), w[got], minlength=n)
            not_toxic, expected, good = tails(s, cuts)
            keep = (good >= keep_tail) & (not_toxic >= least[0]) & (expected >= least[1])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(s), pa.array(expected), pa.array(not_toxic), pa.array(good), pa.array(keep)],
                names=["doc_id", "text_hash", "score", "expected_grade", "p_not_toxic", "p_good", "keep"])
    return run


def fitted(docs: DataFrame, labels: DataFrame, sample: int):
    return docs.sparkSession.sparkContext.broadcast(train(docs, graded(labels), sample))  # 2^BITS weights, whatever the input


def chooser(model, keep_tail: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts, least = model.value
        for batch in T.blocks(batches, "text"):
            got, first = features(batch.column(batch.schema.get_field_index("text")))
            s = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(first)), w[got], minlength=batch.num_rows)
            not_toxic, expected, good = tails(s, cuts)
            yield batch.filter(pa.array((good >= keep_tail) & (not_toxic >= least[0]) & (expected >= least[1])))
    return run


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of docs, with all their columns, that reach the floors and are good with probability `keep_tail` or more."""
    return docs.mapInArrow(chooser(fitted(docs, labels, sample), keep_tail), docs.schema)


def grade_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """doc_id, text_hash, score, expected_grade, p_not_toxic, p_good, keep for every row of docs (doc_id, text).

    A document stays if it reaches the floors and is good with probability `keep_tail` or more.
    """
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        scorer(fitted(docs, labels, sample), keep_tail), "doc_id long, text_hash long, score double, expected_grade double, p_not_toxic double, p_good double, keep boolean")
