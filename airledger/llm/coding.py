"""Files of public tokenizers for tasks: read once on the driver, checked in size and broadcast."""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

#: Largest tokenizer file that is broadcast.
MAX_FILE_BYTES = 64 << 20
#: Words whose ids a worker remembers (at about 200 bytes 120 MB); beyond that it starts afresh.
KNOWN_WORDS = 600_000
#: How byte-level pre-tokenizers split a text (fixed value).
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts without number forms other than digits and without FEW, in the faster module.
COMMON = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
FEW = frozenset("\x1c\x1d\x1e\x1f")


def share_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a tokenizer's file, which only the driver has to see."""
    with open(path, "rb") as file:
        data = file.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is beyond the broadcast bound of {MAX_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


class ByteLevelCoder(dict):
    """Encodes texts as a byte-level tokenizer does, without added special tokens. A pre-token's ids
    depend on nothing else, so each is encoded once and remembered (as little-endian 32-bit ids).

    plain: the strings of special tokens are ordinary text; otherwise they stand for their ids.
    """

    def __init__(self, file: bytes, plain: bool):
        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = plain
        #: Without a normaliser and a template, a pre-token's ids are those that the model alone finds.
        self.model = self.tokenizer.model if self.tokenizer.normalizer is None and self.tokenizer.post_processor is None else None
        self.shown = {b: c for c, b in _byte_of().items()}
        self.split, self.split_common = regex.compile(BYTE_LEVEL).findall, re.compile(COMMON).findall
        special = {} if plain else {x.content: np.uint32(i).tobytes() for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")").split if special else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if self.model is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            ids = [x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]
        packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def ids(self, text: str) -> np.ndarray:
        used = set(text)
        kinds = set() if text.isascii() else set(map(unicodedata.category, used))
        if "Cn" in kinds:  # newer characters, of which libraries differ
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        split = self.split if kinds & {"No", "Nl"} or used & FEW else self.split_common
        parts = self.cut(text) if self.cut else [text]
        if len(parts) == 1:
            packed = b"".join(map(self.__getitem__, split(text)))
        else:
            packed = b"".join(self.special[x] if k % 2 else b"".join(map(self.__getitem__, split(x))) for k, x in enumerate(parts))
        return np.frombuffer(packed, dtype="<u4")


_coders: dict[tuple[int, bool], ByteLevelCoder] = {}


def byte_level_coder(file: bytes, plain: bool) -> ByteLevelCoder:
    """The coder of a file, which a worker keeps from task to task with the words that it knows."""
    key = hash(file), plain
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteLevelCoder(file, plain)
    return _coders[key]


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable bytes stand for themselves,
    the others for the characters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_tokens(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    byte_of = _byte_of()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        tokens[number] = bytes(byte_of[c] for c in token)
    return tokens
