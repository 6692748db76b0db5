"""Cases in which a shortcut would lose rows: repeats, long texts, large blocks."""

import random

from turnstate.llm import simhash

DRAW = random.Random(21)


def words(n):
    return ["".join(DRAW.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def kept(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(r["doc_id"] for r in simhash.keep_one(frame).collect())


def test_near_copies_that_repeat_a_line(spark):
    """Repeats change the fingerprint, not the shingle set; these pairs have a similarity over 0.9."""
    rows = []
    for k in range(40):
        text, line = words(200), words(12)
        rows += [(2 * k, " ".join(text + line)), (2 * k + 1, " ".join(text + line * 20))]
    assert kept(spark, rows) == [2 * k for k in range(40)]


def test_long_texts_are_compared_whole(spark):
    """Texts of about 2,000 shingles a little above and a little below the similarity."""
    rows, wanted = [], []
    for k in range(40):
        # n of 2,000 shingles are shared, so the similarity is n / (4,000 - n).
        n = 1785 if k % 2 else 1770
        text = words(n + 4)
        rows += [(2 * k + side, " ".join(words(2000 - n) + text)) for side in (0, 1)]
        wanted.append((2 * k, 2 * k + 1))
    sets = {i: set(simhash.shingles(t, 5)) for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in wanted}
    assert kept(spark, rows) == sorted(i for (a, b), same in alike.items() for i in ([a] if same else [a, b]))
    assert len(set(alike.values())) == 2


def test_near_copies_are_joined_by_fingerprints_first(spark, monkeypatch):
    """Without any shared shingle to go by, copies with close fingerprints are still one group."""
    real, rows, close = simhash.prefixes, [], []
    monkeypatch.setattr(simhash, "prefixes", lambda *a: real(*a).filter("false"))
    for k in range(30):
        text = words(300)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + words(1 + k % 4)))]
        a, b = (simhash.fingerprint(simhash.shingle_set(t, 5)) for _, t in rows[-2:])
        close.append((a ^ b).bit_count() <= 3)
    assert kept(spark, rows) == sorted({2 * k for k in range(30)} | {2 * k + 1 for k in range(30) if not close[k]})
    assert 10 < sum(close) < 30


def test_texts_of_one_fingerprint_are_compared_whole(spark, monkeypatch):
    """A fingerprint that all texts share proposes links, and only the similar ones are made."""
    monkeypatch.setattr(simhash, "fingerprint", lambda hashes: 5)
    rows = []
    for k in range(10):
        text = words(60)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + words(1)))]
    assert kept(spark, rows) == [2 * k for k in range(10)]


def test_no_list_grows_with_its_block(spark, monkeypatch):
    """Fingerprints of one block and of one cell, most of them apart: whole result, short lists."""
    monkeypatch.setattr(simhash, "HOT", 16)
    prints = sorted({sum(1 << b for b in DRAW.sample(range(40, 62), DRAW.randint(0, 9))) for _ in range(300)})
    real = simhash.link_batches

    def watched(radius, count):
        def run(batches):
            for batch in batches:
                assert all(len(m) <= 64 for m in batch["members"])
                yield from real(radius, count)(iter([batch]))

        return run

    monkeypatch.setattr(simhash, "link_batches", watched)
    joined = {p: {p} for p in prints}
    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= 3 and joined[a] is not joined[b]:
                joined[a] |= joined[b]
                for x in joined[b]:
                    joined[x] = joined[a]
    links = simhash.linked_prints(spark.createDataFrame([(p,) for p in prints], "bits long"))
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {p: found.get(p, p) for p in prints} == {p: min(joined[p]) for p in prints}
