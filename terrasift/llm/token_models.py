"""Vocabulary files as tasks read them: token bytes, character pairs that no token joins, and places where texts may be cut."""

from __future__ import annotations

import json
import os
import re
from itertools import accumulate

import numpy as np

#: White space at which texts are cut, and other white space, after which they are not: splitting patterns may hold both together.
_CUT_SPACE = " \n"
_OTHER_SPACE = "".join(map(chr, (0x9, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

#: Marks that are units of their own behind a letter and before white space, so that a word is one unit wherever it stands.
_MARKS = ".,;:!?"
_LETTER = r"[^\W\d_]"

#: A unit: white space and other characters, cut only between a character that is no white space and white space, and at such marks.
UNIT = re.compile(
    rf"[{_CUT_SPACE}]*(?:[^{_CUT_SPACE}{_MARKS}]+|[{_MARKS}]+(?![{_CUT_SPACE}{_MARKS}]|\Z)|(?<!{_LETTER})(?<![{_MARKS}])[{_MARKS}]+|(?<=[{_OTHER_SPACE}])[{_CUT_SPACE}]+)+"
    rf"|[{_MARKS}]+|[{_CUT_SPACE}]+")

_SPACE = chr(0x2581)


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write a visible Latin-1 byte as itself and the n-th other one as character 256 + n."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(other)}


class ByteModel:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens inside texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel unit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        byte = byte_characters()
        size = max(described["model"]["vocab"].values(), default=-1) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, n in described["model"]["vocab"].items():
            self.token_bytes[n] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        before = described.get("pre_tokenizer") or {}
        #: The byte-level pattern never joins white space to another character before it, nor a mark to a letter or digit before it.
        self.cuts_at_space = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not described.get("normalizer")

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and (begin, end) byte spans; a character that several tokens share is the span of each of them."""
        out = []
        for text, found in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            spans = found.offsets
            if not text.isascii():
                byte = _byte_offsets(text)
                spans = [(byte[b], byte[e]) for b, e in spans]
            out.append((found.ids, spans))
        return out


def _byte_offsets(text: str) -> list[int]:
    """Byte offset of every character place of a text, its end included."""
    return [0, *accumulate(len(c.encode()) for c in text)]


class PieceModel:
    """A sentencepiece vocabulary. With prefix=False the library's own leading space is switched off, for parts of a text."""

    def __init__(self, path: str, prefix: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        #: Whether a text without its leading space added is encoded like the rest of one that has it.
        self.adds_space = proto.normalizer_spec.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix
        if not prefix:
            proto.normalizer_spec.add_dummy_prefix = False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        plain = proto.normalizer_spec
        #: Texts reach the model as they are, but for spaces.
        self.identity = not plain.precompiled_charsmap and not plain.remove_extra_whitespaces and plain.escape_whitespaces
        self.token_bytes: list[bytes] = []
        #: Every two neighbouring characters inside some piece: merging never joins characters that are not among them.
        self.inner: set[str] = set()
        bpe = proto.trainer_spec.model_type == 2
        for piece in proto.pieces:
            if piece.type == 6:
                self.token_bytes.append(bytes([int(piece.piece[1:-1], 16)]))
            else:
                self.token_bytes.append(piece.piece.replace(_SPACE, " ").encode())
                if piece.type not in (2, 3):
                    self.inner.update(a + b for a, b in zip(piece.piece, piece.piece[1:]))
        self.proven = bpe and self.identity
        space = {_SPACE, "\n"}
        self.cuts_at_space = self.proven and not any(p[1] in space and p[0] not in space or p[1] in _MARKS and p[0].isalpha() for p in self.inner)

    def stable(self, left: str, right: str) -> bool:
        """Whether every encoding of a text has a token boundary between these characters, and none of its sides sees the other."""
        return self.proven and (left + right).replace(" ", _SPACE) not in self.inner

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(texts, return_type="numpy", num_threads=1)]

    def begins(self, text: str) -> np.ndarray:
        """Character offset at which each token begins."""
        return np.array([b for b, _ in self.processor.encode(text, return_type="offset_mapping")["offsets"]], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and (begin, end) byte spans; all byte tokens of a character but the last are empty spans before it."""
        found = self.processor.encode([t.encode() for t in texts], return_type="offset_mapping", num_threads=1)
        return [(f["ids"], f["offsets"]) for f in found]


_models: dict[tuple, object] = {}


def load(path: str, **options) -> ByteModel | PieceModel:
    """The model of a vocabulary file, read once in each Python worker."""
    key = (path, *sorted(options.items()))
    if key not in _models:
        _models[key] = PieceModel(path, **options) if path.endswith(".model") else ByteModel(path)
    return _models[key]
