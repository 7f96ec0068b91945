"""A sentencepiece model file read without its library, and rebuilt as a pipeline of the tokenizers library."""

from __future__ import annotations

import struct
from collections.abc import Iterator

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int | float | memoryview]]:
    """(field number, value) of a protocol buffer message; 32-bit values are read as floats."""
    data, at = memoryview(data), 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = bytes(data[at : at + 8]), at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"not a sentencepiece model: wire type {kind}")
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.trim_spaces, self.escape = b"", True, True, True
        self.as_suffix = False
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((bytes(piece[1]).decode() if 1 in piece else "", piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.byte_fallback, self.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
                self.as_suffix = bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap = bytes(spec.get(2, b""))
                self.dummy_prefix, self.trim_spaces, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    @property
    def user_defined(self) -> list[str]:
        return [p for p, _, t in self.pieces if t == USER_DEFINED]

    @property
    def splits_at_spaces(self) -> bool:
        """No piece has a space after another character, and spaces are neither trimmed nor made by the normaliser."""
        inner = any(SPACE in p.lstrip(SPACE) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED))
        return not inner and not self.charsmap and self.dummy_prefix and not self.trim_spaces and self.escape and not self.as_suffix

    def rebuild(self):
        """A `tokenizers.Tokenizer` that encodes and decodes as the model does."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.as_suffix or not self.escape:
            raise ValueError("models with the space marker behind words, or without one, aren't rebuilt")
        names = [p for p, _, _ in self.pieces]
        if self.kind == UNIGRAM:
            low = min(s for _, s, t in self.pieces if t == NORMAL) - 10
            scores = [(p, low if t in (CONTROL, UNKNOWN, BYTE, UNUSED) else 0.0 if t == USER_DEFINED else s) for p, s, t in self.pieces]
            model = models.Unigram(scores, self.unk_id, self.byte_fallback)
        elif self.kind == BPE:
            plain = {p: (s, i) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED)}
            merges = []
            for p, (s, i) in plain.items():
                for k in range(1, len(p)):
                    if p[:k] in plain and p[k:] in plain:
                        merges.append((-s, i, plain[p[:k]][1], p[:k], p[k:]))
            merges.sort()
            model = models.BPE({p: i for i, p in enumerate(names)}, [m[3:] for m in merges], unk_token=names[self.unk_id], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} isn't rebuilt")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        trim = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *trim])
        return out
