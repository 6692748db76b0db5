"""Cross-tokenizer alignment against a plain walk over all tokens of all texts."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from turnstate.llm import alignment
from turnstate.llm.vocabularies import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DRAW = random.Random(3)


def tokens(text):
    """(id, bytes) of both kinds, by the libraries."""
    byte_level = Tokenizer.from_file(A)
    byte_level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = byte_alphabet()
    first = [(i, bytes(alphabet[c] for c in byte_level.id_to_token(i))) for i in byte_level.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in pieces.encode(text):
        piece = pieces.id_to_piece(i)
        second.append((i, bytes([int(piece[1:-1], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
    return first, second


def spans(own):
    at, found = 0, []
    for token, data in own:
        found.append((token, at, at + len(data)))
        at += len(data)
    return found


def brute(texts):
    per, counts = [], Counter()
    for text in texts:
        a, b = tokens(text or "")
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(d for _, d in own) != whole for own in (a, b)):
            per.append(None)
            continue
        a, b = spans(a), spans(b)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        ends = sorted({e for _, _, e in a} & {f for _, _, f in b})
        groups = []
        for begin, end in zip([0, *ends], ends):
            inside = lambda own: ",".join(str(x) for x, s, e in own if begin <= s and e <= end)  # noqa: E731, B023
            groups.append(inside(a) + "|" + inside(b))
        per.append((len(a), len(b), groups, links))
        counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for own in per:
        if own is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = own
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


TEXTS = [
    None, "", " ", "two words", "Unbelievable antidisestablishmentarianism, isn't it?", "  leading  and   inner spaces\n\tlines ",
    "日本語 のテキスト 🙂 naïve café", "a▁b holds the mark of the model", "x<|endoftext|> <s> </s> <0x41>", "word " * 300, "y" * 700, "word " * 300,
]
TEXTS += [" ".join("".join(DRAW.choices("abcdeéß1.,", k=DRAW.randint(1, 9))) for _ in range(DRAW.randint(1, 60))) for _ in range(60)]
SCHEMA = "doc_id long, text string, alignment string, chunk int, `row` string, `a.b` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1, "y", 2) for k, t in enumerate(TEXTS)] + [(None, "two words", None, None, None, None)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_equals_a_plain_walk(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_TOKENS", 400)  # several chunks a task
    wanted = brute([*TEXTS, "two words", "two words"])
    got = [(r["doc_id"], tuple(r["alignment"])) for r in alignment.align(docs, A, B).collect()]
    assert len(got) == len(wanted)
    for key, figures in got:
        assert figures == wanted[len(TEXTS) if key is None else key], key
    assert wanted[7] == (0, 0, 0, 0, 0, 0, "")  # the mark in a text does not come back as it was


def test_groups_themselves(docs):
    wanted = {k: w[6] for k, w in enumerate(brute(TEXTS))}
    for r in alignment.aligned_groups(docs, A, B).collect():
        line = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in r["groups"])
        digest = hashlib.sha256(line.encode()).hexdigest() if line else ""
        assert r["doc_id"] is None or digest == wanted[r["doc_id"]]


def test_windows_are_cut_at_anchors_and_remembered():
    windows = alignment.Windows(A, B)
    ids = windows.encode(["the cat saw the dog"])[0]
    cut = windows.cut(*ids)
    assert len(cut) == 5 and cut[0] == cut[3] and len(set(cut)) == 4
    assert windows.aligned(cut[0]) is windows.aligned(cut[3])
    assert len(windows.memo) == 1


def test_a_new_memo_changes_nothing(spark, docs, monkeypatch):
    line = lambda df: sorted(df.collect(), key=repr)
    wanted = line(alignment.align(docs, A, B)), line(alignment.aligned_groups(docs, A, B))
    monkeypatch.setattr(alignment, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 10)
    assert (line(alignment.align(docs, A, B)), line(alignment.aligned_groups(docs, A, B))) == wanted


def test_empty_table_and_only_empty_texts(spark, docs):
    assert alignment.align(docs.limit(0), A, B).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r["alignment"]) for r in alignment.align(none, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}
