"""Odd documents that every operator must bear: nulls, empty, long and repeated texts, clashing columns."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node string, bucket long, size string, "
          "text_hash string, root string, hash string, token string, b string")


def words(seed, n, of=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def texts():
    base = words(1, 300)
    near = base.split()
    near[150] = "changed"
    far = base.split()
    for i in range(0, 300, 12):
        far[i] = f"other{i}"
    return [base, " ".join(near), " ".join(far), base, base.upper(), None, "", " \t\n", "one", "one two three", "one two three",
            words(2, 6000), words(3, 40) + "\n" + base[:900], "é ü ß 漢字 \U0001f600 ", "x" * 5000, words(4, 1200), words(5, 7)]


def rows():
    out = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    out += [out[3], out[5], (None, texts()[0], None, None, None), (None, None, "de", None, 0), (2, "a text of another row with this id", "en", "s1", 5)]
    return [r + ("x", 1, "y", "z", "r", "h", "t", "b") for r in out]


def documents(spark, only=None):
    got = rows() if only is None else [r for r in rows() if only(r)]
    return spark.createDataFrame(got, SCHEMA).repartition(3)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def shingles(t, k=5):
    w = split(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
