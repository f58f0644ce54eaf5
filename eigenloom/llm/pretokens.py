"""Token ids of whole texts through a byte-level vocabulary, each distinct piece encoded once."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

# A worker forgets its chunks, or its pieces too, beyond this many characters, and learns anew.
REMEMBERED_CHARS = 8_000_000
REMEMBERED_PIECE_CHARS = 12_000_000
# Whitespace of the Unicode property. Pieces of other characters than these are left to the tokenizer whole.
SIMPLE = re.compile("[!-~¡-ɏ\n]*")
# How a byte-level pre-tokenizer parts such a text: a fixed pattern, letters and digits below U+0250 spelled out.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGIT = "0-9²³¹¼-¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^ \\n{LETTER}{DIGIT}]+|\\n+(?!\\S)|\\n")
# A chunk of letters and then signs that are neither letters nor digits, or any other chunk.
SIGN = "!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷"
PLAIN = re.compile(f"^(?:([{LETTER}]*)([{SIGN}]*)|(.+))$", re.MULTILINE)
IRREGULAR = re.compile(r" (?:\s|$)")
SPLIT = re.compile(r" (?=\S)")


def byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: printable ones as they are, then from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def tokenizer_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def gather(ids: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids that codes stand for, end to end, and the length of each."""
    sizes = length[codes]
    ends = np.cumsum(sizes)
    place = np.repeat(start[codes] - (ends - sizes), sizes)
    place += np.arange(len(place))
    return ids[place], sizes


class Numbered(dict):
    """Numbers keys as they are first looked up, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.new.append(key)
        return number


class PieceEncoder:
    """Token ids equal to those of the library on whole texts.

    A byte-level pre-tokenizer with its usual pattern always parts a text ahead of a space that a
    non-space follows. So a text's ids are those of its chunks, and a chunk's are those of its pieces; each
    distinct one is encoded once while it is remembered. Files with any other normalizer or pre-tokenizer,
    and texts that hold a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        parts = settings.get("pre_tokenizer") or {}
        self.by_pieces = (
            settings.get("normalizer") is None
            and parts.get("type") == "ByteLevel"
            and parts.get("use_regex", True)
            and not parts.get("add_prefix_space")
            and not settings["model"].get("dropout")
            and not settings.get("truncation")
            and not settings.get("padding")
        )
        self.special = [t["content"] for t in settings.get("added_tokens") or []]
        self.clear()

    def clear(self) -> None:
        self.clear_chunks()
        self.piece_chars = 0
        self.pieces: dict[str, int] = {}
        self.piece_ids = np.zeros(0, np.uint32)
        self.piece_start, self.piece_length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def clear_chunks(self) -> None:
        self.chars = 0
        self.chunks = Numbered()
        self.ids = np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn_pieces(self, new: list[str | tuple[str]]) -> None:
        """Single pieces go straight to the merges of the library's model, tuples through all of it."""
        merge, found = self.tokenizer.model.tokenize, []
        for piece in new:
            if isinstance(piece, str):
                letters = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
                found.append([token.id for token in merge(letters)])
            else:
                found.append(self.whole(piece[0]))
        length = np.array([len(f) for f in found], np.int64)
        self.pieces.update(zip(new, range(len(self.piece_start), len(self.piece_start) + len(new))))
        self.piece_start = np.append(self.piece_start, np.cumsum(length) - length + len(self.piece_ids))
        self.piece_length = np.append(self.piece_length, length)
        self.piece_ids = np.append(self.piece_ids, np.fromiter(chain.from_iterable(found), np.uint32))
        self.piece_chars += sum(len(p) if isinstance(p, str) else len(p[0]) for p in new)

    def parted(self, text: str) -> list[str | tuple[str]]:
        """The pieces of a text, or the text as a tuple where its parting is left to the library."""
        if self.by_pieces and SIMPLE.fullmatch(text, 1 if text[0] == " " and text[1:2] not in ("", "\n") else 0):
            if not any(s in text for s in self.special):
                return PIECES.findall(text)
        return [(text,)]

    def learn(self, new: list[str | tuple[str]]) -> None:
        """Remember the ids of chunks: those of their pieces, one after another."""
        lines = [key for key in new if isinstance(key, str) and "\n" not in key]
        rest = list(set(new).difference(lines))
        found = []
        for letters, signs, other in PLAIN.findall("\n".join(lines)) if lines else ():
            if other:
                found.append(self.parted(f" {other}"))
            elif letters and signs:
                found.append((f" {letters}", signs))
            else:
                found.append((f" {letters or signs}",))
        for key in rest:
            text = f" {key}" if isinstance(key, str) else key[0]
            found.append(self.parted(text) if text else ())
        new = lines + rest
        unknown = set(chain.from_iterable(found)).difference(self.pieces)
        if unknown:
            self.learn_pieces(list(unknown))
        n = np.array([len(f) for f in found], np.int64)
        codes = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(found)), np.int64, n.sum())
        ids, sizes = gather(self.piece_ids, codes, self.piece_start, self.piece_length)
        ends = np.cumsum(sizes)
        bounds = np.append(0, ends)[np.append(0, np.cumsum(n))]
        place = np.fromiter(map(self.chunks.__getitem__, new), np.int64, len(new))
        self.start = np.append(self.start, np.zeros(len(new), np.int64))
        self.length = np.append(self.length, np.zeros(len(new), np.int64))
        self.start[place], self.length[place] = bounds[:-1] + len(self.ids), np.diff(bounds)
        self.ids = np.append(self.ids, ids)
        self.chars += sum(len(key) if isinstance(key, str) else len(key[0]) for key in new)

    def chunked(self, text: str) -> list[str | tuple[str]]:
        """The first chunk, as a tuple, then the others without the space that leads each."""
        parts = SPLIT.split(text) if IRREGULAR.search(text) else text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text's followed by ``end_id``, and where each text begins."""
        if self.piece_chars > REMEMBERED_PIECE_CHARS:
            self.clear()
        elif self.chars > REMEMBERED_CHARS:
            self.clear_chunks()
        split = [self.chunked(t) if self.by_pieces and not any(s in t for s in self.special) else [(t,)] for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, n.sum())
        if self.chunks.new:
            self.learn(self.chunks.new)
            self.chunks.new = []
        ids, sizes = gather(self.ids, codes, self.start, self.length)
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(n)]
        return np.insert(ids, ends, end_id), np.append(0, ends + np.arange(1, len(texts) + 1))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
