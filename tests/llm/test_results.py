"""Each registered query against SQL, a brute-force version, an exact round trip or held-out labels."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from turnstate.llm import byte_bpe, decontaminate, secrets, simhash, templates, toxicity
from turnstate.llm.oracle import ORACLE
from turnstate.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(sf, name, columns):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    found = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SMALL}/{file}'")
    wanted = con.sql(f"select {', '.join(found.columns)} from ({ORACLE[name]})").fetchall()
    assert collections.Counter(wanted) == collections.Counter(tuple(r) for r in found.collect())


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(rows_of(SMALL, "documents", "doc_id, text"))
    for r in QUERIES["op2_byte_level_bpe"](spark, SMALL).collect():
        text = texts[r["doc_id"]] or ""
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    own = byte_bpe.codec(path, public_tokenizers.PATTERN)
    draw = random.Random(1)
    odd = ["".join(draw.choices("aaabb \n\t\x0b12²½éß日本😀'sdtre.!\x85\xa0\x1c​", k=draw.choice([0, 1, 3, 40]))) for _ in range(800)]
    odd += ["a" * 64, "ab" * 400, " " * 300, "=" * 1000, "日" * 200, "".join(draw.choices("thewrions", k=700))]
    assert [x.tolist() for x in own.encode(odd)] == [library.encode_ordinary(x) for x in odd]


def crc_token(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = chr(secrets.BASE62[rest]) + digits
    return prefix + body + digits


def plain_scan(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN.decode(), text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_equal_a_full_scan(spark):
    texts = dict(rows_of(MIDDLE, "documents", "doc_id, text"))
    found = QUERIES["op8_secret_scans"](spark, MIDDLE).collect()
    assert len(found) == len(texts) and sum(r["n_assign"] for r in found) > 0
    for r in found:
        base = plain_scan(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == base
    scanner, draw = secrets.Scanner(), random.Random(2)
    for _ in range(3000):
        parts = ["pass", "word", "password", "passwd", "tok", "en", "token", "AKIA", "api_key", "APIKEY", " ", "=", ":", '"', "'", "é", "ab12", "0123456789abcdef", "Z9", "ſecret", "A" * 20]
        text = "".join(draw.choices(parts, k=draw.randint(1, 14)))
        data = text.encode()
        spans = secrets.in_code_points(data, scanner.spans(data))
        assert ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans) == plain_scan(text)


def test_checksums_add_spans():
    good = crc_token("ghp_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f"é token: {good} and {bad}"
    frame = secrets.scan_texts(__import__("pandas").Series([text]))
    assert frame["n_validated"][0] == 1 and "crc:9:49" in frame["spans"][0].split(",")


def fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes)), set(runs)


def reachable(names, linked):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if find(a) != find(b) and linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {n: find(n) for n in names}


def test_simhash_equals_brute_force(spark):
    prints = {i: fingerprint(t, 3)[0] for i, t in rows_of(SMALL, "documents", "doc_id, text")}
    wanted = reachable(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, SMALL).collect()}
    assert found == {i: (f"{prints[i]:016x}", wanted[i]) for i in prints}


def test_dense_and_hot_blocks(spark, monkeypatch):
    """Fingerprints around a few centres, with blocks dealt out by pivots from 8 members on."""
    monkeypatch.setattr(simhash, "HOT", 8)
    draw = random.Random(3)
    prints = sorted({c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for c in (draw.getrandbits(64) for _ in range(4)) for _ in range(60)})
    wanted = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = {p: p - 2**64 if p >= 2**63 else p for p in prints}
    links = simhash.linked_prints(spark.createDataFrame([(p,) for p in signed.values()], "bits long"))
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    by_wanted, by_found = collections.defaultdict(set), collections.defaultdict(set)
    for p in prints:
        by_wanted[wanted[p]].add(p)
        by_found[found.get(signed[p], signed[p])].add(p)
    assert sorted(map(sorted, by_wanted.values())) == sorted(map(sorted, by_found.values()))


def test_one_of_each_group_of_similar_texts_stays(spark):
    rows = rows_of(MIDDLE, "documents", "doc_id, text")[:400]
    runs = {i: fingerprint(t, 5)[1] for i, t in rows}
    similar = lambda a, b: len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])
    wanted = sorted(set(reachable(sorted(runs), similar).values()))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(frame).collect()) == wanted


def test_line_templates(spark):
    rows = [
        (1, "Job 17 took 30 seconds on the big node today\nalpha beta gamma delta\nown one"),
        (2, "Job 99 took 4 seconds on the big node today\nalpha beta gamma other\nown two"),
        (3, "served by host red at noon on the last day of may\nown three"),
        (4, "served by host blue at noon on the last day of may\nown four\nown four"),
        (5, "served by host of quite different words all along the line\nown five"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = dict(tuple(r) for r in templates.drop_recurring_lines(frame).collect())
    assert found == {1: rows[0][1], 2: "alpha beta gamma other\nown two", 3: rows[2][1], 4: "own four\nown four", 5: rows[4][1]}


def test_leaks_equal_brute_force(spark):
    words = lambda t: " " + " ".join(decontaminate.words_of(t)) + " "
    items = [(i, words(t)) for i, t in rows_of(MIDDLE, "benchmark", "item_id, text")]
    wanted = {(d, i) for d, t in rows_of(MIDDLE, "documents", "doc_id, text") for i, own in items if own in words(t)}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_benchmark_decontamination"](spark, MIDDLE).collect()}
    assert wanted and found == wanted


def test_split_bytes_equal_the_pattern():
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choices("abZ09_ -.\n\t\x1c\x85\xa0«ªµ²½éßİœǅɏɐΣς日😀'", k=draw.randint(0, 25))).lower()
        if not decontaminate.ODD.search(text):
            split = text.encode().translate(decontaminate.SEPARATED).split()
            assert [w.decode() for w in split] == decontaminate.WORD.findall(text)
    assert not decontaminate.ODD.search("déjà vu, œuvre 12²") and decontaminate.ODD.search("«x»")


def test_paraphrases_and_short_items(spark):
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("bdklmnrst", k=2)) + "".join(draw.choices("aeiou", k=2)) + str(k) for k in range(3000)]
    text = lambda n: draw.choices(vocabulary, k=n)
    long, short = text(40), ["what", "is", "zyx", "then"]
    edited = [w if k % 4 else draw.choice(vocabulary) for k, w in enumerate(long)]
    rows = [
        (1, text(300) + long + text(300)), (2, text(70) + edited + text(50)), (3, text(500)), (4, text(90) + short + text(90)),
        (5, text(100) + edited[:-8] + text(100)), (6, ["what", "is", "not", "zyx", "then"] + text(60)), (None, long),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(long)), (11, " ".join(short))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    # Three quarters of the words with the answer are a leak, fewer without it are not.
    assert found == {(1, 10), (2, 10), (None, 10), (4, 11)}
    assert sorted((r["doc_id"] for r in decontaminate.remove_leaks(docs, items).collect())) == [3, 5, 6]


def test_benchmark_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS", 15)
    assert whole == {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}


def test_toxicity_on_rows_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    left_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.filter(~left_out))
    rows = toxicity.score(docs, model).join(labels.filter(left_out), "doc_id").select("toxic", "toxicity").collect()
    flagged = [r["toxicity"]["grade"] >= 1 for r in rows]
    toxic = [r["toxic"] == 1 for r in rows]
    assert sum(a and not b for a, b in zip(flagged, toxic)) <= 2
    assert sum(a and b for a, b in zip(flagged, toxic)) >= 0.85 * sum(toxic)
    assert all(np.diff(model.thresholds) > 0)


def test_given_grades_are_ordered(spark):
    draw = random.Random(6)
    words = {0: "calm", 1: "rude", 2: "vile"}
    rows = []
    for k in range(600):
        grade = k % 3
        own = [draw.choice(["one", "two", "three", "four"]) for _ in range(30)] + [words[g] for g in range(1, grade + 1)]
        rows.append((k, " ".join(own), int(grade > 0), grade))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, grade int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic", "grade"))
    found = toxicity.score(frame, model).collect()
    assert all(r["toxicity"]["grade"] == r["grade"] for r in found)
    by_grade = [np.mean([r["toxicity"]["severity"] for r in found if r["grade"] == g]) for g in range(3)]
    assert by_grade == sorted(by_grade)


def test_language_of_documents_left_out(spark):
    langs = dict(rows_of(MIDDLE, "documents", "doc_id, lang"))
    rows = QUERIES["op7_language_id"](spark, MIDDLE).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "restored"]
    got = rows.collect()
    assert 0 < len(got) < docs.count() and all(r["restored"] and len(r["ids"]) == r["n_tokens"] for r in got)
    assert len({r["doc_id"] for r in got}) == len(got)


def test_key_checksums():
    """A key made from any payload is found, and one with a changed digit is not."""
    payload = bytes.fromhex("0488ade4") + bytes(range(74))
    raw = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    number, key = int.from_bytes(raw, "big"), ""
    while number:
        number, rest = divmod(number, 58)
        key = chr(secrets.BASE58[rest]) + key
    assert key.startswith(secrets.XPRV_PREFIX) and len(key) == secrets.XPRV_LENGTH
    scanner = secrets.Scanner()
    kinds = lambda text: [secrets.KINDS[k] for _, k, _ in scanner.spans(text.encode())]
    assert kinds(f"a {key} b") == ["xprv"]
    assert kinds(f"a {key[:-1]}{'2' if key[-1] != '2' else '3'} b") == []
