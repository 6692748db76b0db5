"""Best-fit packing: pieces against the tokenizer library, places, and how full sequences are."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from turnstate.llm import packing
from turnstate.llm.vocabularies import ByteLevelEncoder, PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
DRAW = random.Random(11)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def checked(rows, capacity, key="name"):
    """Sequences are gapless and within the capacity; returns their number."""
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_ids_are_those_of_the_library(library):
    encoder = ByteLevelEncoder(PATH)
    texts = ["", " ", "x<|endoftext|> y", "don't  stop\n\n now 's", "日本 語 テキ スト", "x" * 5000]
    texts += ["".join(DRAW.choices("ab 1'!\n\té　  日sx\x1c\x85", k=DRAW.randint(0, 40))) for _ in range(500)]
    # Every code point of the first plane, with white space, a letter and a number next to it.
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts += [" ".join("!" + c + "a 1" + c for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for text in texts:
        assert encoder.ids(text) == library(text), text[:40]
        assert b"".join(encoder.table[i] for i in encoder.ids(text)) == text.encode()


def test_piece_cuts():
    assert packing.piece_cuts(1, 8) == [(0, 1)]
    assert packing.piece_cuts(8, 8) == [(0, 8)]
    assert packing.piece_cuts(16, 8) == [(0, 8), (8, 8)]
    assert packing.piece_cuts(17, 8) == [(0, 1), (1, 8), (9, 8)]


def test_documents_come_back_from_their_sequences(spark, library):
    texts = {1: None, 2: "", 3: "a short text", 4: "one two three " * 300, None: "no id", 5: "x" * 3000}
    docs = spark.createDataFrame([*texts.items(), (3, "a short text")], "doc_id long, text string").repartition(3)
    packed = packing.pack(packing.pieces(docs, PATH, 64), 64)
    rows = packed.collect()
    checked(rows, 64)
    tokens = {r["sequence_id"]: np.frombuffer(r["tokens"], "<u4") for r in packing.sequences(packed).collect()}
    for key, text in texts.items():
        own = sorted((r["piece"], r["sequence_id"], r["offset"], r["length"], r["start"]) for r in rows if r["doc_id"] == key)
        if key == 3:
            assert [p[0] for p in own] == [0, 0]  # a repeated row is packed twice
            own = own[:1]
        assert [p[0] for p in own] == list(range(len(own)))
        assert all(p[3] == 64 for p in own[1:])
        ids = [int(i) for _, s, at, size, _ in own for i in tokens[s][at : at + size]]
        assert ids == [*library(text or ""), 0]


@pytest.mark.parametrize("tasks", [1, 20])
def test_few_sequences_over_many_tasks(spark, tasks):
    capacity = 512
    lengths = [min(capacity, int(DRAW.lognormvariate(4.5, 1.1)) + 1) for _ in range(6000)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "name long, length int").repartition(tasks)
    found = packing.pack(rows, capacity).collect()
    assert sorted(r["name"] for r in found) == list(range(6000))
    assert checked(found, capacity) <= 1.01 * sum(lengths) / capacity + 1


def test_bounded_space_closes_the_fullest(monkeypatch):
    state = packing.OpenSequences(10, places=2)
    assert state.place(6) == (0, 0, []) and state.place(7) == (1, 0, [])
    # Neither takes 5, and both places are taken: the fuller one closes.
    assert state.place(5) == (2, 0, [1])
    assert state.place(4) == (0, 6, [0])  # the tightest fit, filled to the end
    assert state.place(5) == (2, 5, [2]) and state.open == 0 and state.bits == 0


def test_odd_rows(spark):
    schema = "length long, sequence_id string, `offset` int, task int, open int, `row` string, `a.b` int"
    rows = spark.createDataFrame([(None, "s", 1, 1, 1, "r", 1), (0, "s", 1, 1, 1, "r", 1), (3, None, None, None, None, None, None), (3, None, None, None, None, None, None)], schema)
    found = packing.pack(rows, 4).collect()
    assert [c for c in found[0].asDict()] == ["length", "task", "open", "row", "a.b", "sequence_id", "offset"]
    assert sorted((r["length"] or 0, r["offset"]) for r in found if r["offset"] is not None) == [(3, 0), (3, 0)]
    assert sum(r["sequence_id"] is None for r in found) == 2
    assert packing.pack(rows.limit(0), 4).count() == 0
    with pytest.raises(Exception, match="over the capacity"):
        packing.pack(rows, 2).count()


def test_piece_model_bytes():
    encoder = PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    table = encoder.token_bytes()
    for text in ("plain words", "tab\tand\nline", "日本 🙂 é"):
        assert b"".join(table[i] for i in encoder.encode([text])[0]) == (" " + text).encode()
