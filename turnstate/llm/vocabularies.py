"""Public tokenizer vocabularies inside tasks: ids of whole texts, and the bytes of their tokens."""

from __future__ import annotations

import json

import sentencepiece
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pieces a byte-level tokenizer file merges separately.
BYTE_LEVEL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Byte-level entries write printable bytes as themselves and the others, in order, from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevelEncoder:
    """Ids of a byte-level tokenizer file as its library gives them; special tokens are plain text.

    Where the file's merges stand in the order of their results' ids, the ids are ranks, and the
    rank library gives the same ids in a quarter of the time (tested over all letters). Any other
    file is left to its own library.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary, merges = described["model"]["vocab"], described["model"]["merges"]
        special = {entry["content"] for entry in described.get("added_tokens", [])}
        byte_of = byte_alphabet()
        self.table = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.table[k] = token.encode() if token in special else bytes(byte_of[c] for c in token)
        results = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        split = described.get("pre_tokenizer") or {}
        ranked = results == sorted(results) and described.get("normalizer") is None
        if ranked and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
            ranks = {self.table[k]: k for token, k in vocabulary.items() if token not in special}
            ranked_form = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PIECES, mergeable_ranks=ranks, special_tokens={})
            self.ids = ranked_form.encode_ordinary
        else:
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.ids = lambda text: library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.ids(text) for text in texts]

    def token_bytes(self) -> list[bytes]:
        return self.table


class PieceEncoder:
    """Ids of a sentence-piece model, which puts a space before the text."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        """U+2581 is a space, and an entry <0xHH> the byte HH."""
        table = []
        for k in range(self.model.get_piece_size()):
            if self.model.is_byte(k):
                table.append(bytes([int(self.model.id_to_piece(k)[1:-1], 16)]))
            else:
                table.append(self.model.id_to_piece(k).replace("▁", " ").encode())
        return table
