"""The filter audit against applying the filters one after the other."""

import itertools
import random

from turnstate.llm import filter_audit

DRAW = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, cell int, digest string, `key` string, none int"


def failures(rows):
    """Failed letters of each (doc_id, text) by the wording of the conditions."""
    found = []
    for key, text in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            own.add("C")
        if any(c in "#$%&*|" for c in text):
            own.add("D")
        if key is not None and any(k is not None and k < key and (t or "") == text for k, t in rows):
            own.add("E")
        found.append(own)
    return found


def brute(rows, labels):
    """rows: (doc_id, text, lang)"""
    failed, result = failures([r[:2] for r in rows]), {}
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                fails = sum(letter in f for _, f in own)
                only = sum(f == {letter} for _, f in own)
                shapley[letter] += len(gone)
                lost = [sum(k is not None and k in s for k, _ in gone) for s in (good, toxic)]
                result[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), only, *lost, letter]
        for (p, _, _), figures in result.items():
            if p == part:
                figures[-1] = shapley[figures[-1]]
    return {k: tuple(v) for k, v in result.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in df.collect()}


def text():
    words = [DRAW.choice(["alpha", "beta", "gamma", "Delta", "EPS", "é", "w%d" % DRAW.randint(0, 400)]) for _ in range(DRAW.choice([5, 199, 200, 240]))]
    return DRAW.choice([" ", "\n", "  "]).join(words) + DRAW.choice(["", "", " 5 $", "|"])


def test_equals_filters_one_after_the_other(spark):
    texts = [text() for _ in range(60)]
    rows = [(k, DRAW.choice(texts + [None, ""]), DRAW.choice(["en", "de", None, ""])) for k in range(150)]
    rows += [(None, texts[0], "en"), (None, "nobody else has this", "en"), rows[0], rows[0], (rows[3][0], rows[3][1], "fr")]
    labels = [(k, DRAW.choice([0, 1, None]), DRAW.choice([0, 1, None])) for k in range(0, 170, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(5)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(filter_audit.audit(docs, frame)) == brute(rows, labels)


def test_a_third_of_the_rows_are_copies(spark):
    rows = [(k, "same text", "en" if k % 2 else "de") for k in range(400)] + [(k, f"own {k}", "en") for k in range(400, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = found(filter_audit.audit(docs, labels))
    assert got["de", "EABCD", 1][:2] == (1, 199) and got["en", "EABCD", 1][:2] == (800, 200)
    alike = filter_audit.cell_counts(docs, labels, "lang", "doc_id", "text")
    assert alike.count() <= 2 * 32


def test_tensors_stay_exact():
    import pandas as pd

    big = 1 << 60
    cells = pd.DataFrame({"part": ["x", "x"], "cell": [0, 16], "docs": [big + 1, 3], "good": [0, 1], "toxic": [0, 0]})
    rows = filter_audit.audit_part(cells).set_index(["filter_order", "step"])
    assert rows.loc[("ABCDE", 1), "kept"] == big + 1 and rows.loc[("ABCDE", 1), "removed"] == 3
    assert rows.loc[("BACDE", 1), "kept"] == big + 4 and rows.loc[("BACDE", 2), "shapley"] == 360
    assert len(rows) == 600


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert len(found(filter_audit.audit(one, labels))) == 600
