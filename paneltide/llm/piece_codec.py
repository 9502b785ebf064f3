"""SentencePiece models run by the tokenizers library.

The model file is read as plain protocol-buffer fields. Its normaliser, the space marker, pieces
with scores or merges, and byte fallback are rebuilt as a tokenizers pipeline: a unigram model
keeps its scores; for a merge model, each way to join a piece from two others becomes a merge,
ranked by the piece's score. Batches are encoded by several threads, and the ids of every text can
be held against those of the sentencepiece library. Where no piece crosses a marker and the
normaliser changes nothing else, a batch's distinct runs between markers are encoded, decoded and
compared once each.

Defined results: null counts as the empty text, which has no ids; special and control pieces in a
text are ordinary characters, as in sentencepiece; decoding gives the normalised text, and spaces
for the marker itself where a text holds it. A model with user-defined pieces, which sentencepiece
matches before all others, is refused.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from dataclasses import dataclass
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame

from paneltide.llm.common import map_texts, release

MARK = "▁"
UNIGRAM, BPE = 1, 2
STEP = 1 << 21
#: Bytes that runs, their ids and texts take at most in a worker, of one of them, and letters of the longest that is kept.
KEPT_BYTES, ENTRY_BYTES, LONGEST_KEPT = 80 << 20, 400, 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def wire_fields(data: bytes):
    """(field number, value) of a protocol-buffer message: ints for varints, bytes for the rest."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, shift, at = value | (b & 0x7F) << shift, shift + 7, at + 1
            if b < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as file:
            data = file.read()
        made = cls([], UNIGRAM, False, 0, b"", True, True)
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                made.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(wire_fields(value))
                made.kind, made.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(wire_fields(value))
                made.charsmap, made.dummy_prefix, made.squeeze = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        made.unknown = next(i for i, p in enumerate(made.pieces) if p[2] == UNKNOWN)
        return made

    def merges(self) -> list[tuple[str, str]]:
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for piece, at in usable.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in usable and b in usable:
                    found.append((-self.pieces[at][1], at, usable[a], usable[b], a, b))
        return [(a, b) for *_, a, b in sorted(found)]

    def cut_at_marks(self) -> bool:
        """Whether no piece has the marker behind another character, so that none crosses a cut before it."""
        return all(MARK not in p[1:] or not p.strip(MARK) for p, _, _ in self.pieces)

    def backend(self):
        """The tokenizers pipeline with the same ids."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = self.pieces[self.unknown][0]
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("user-defined pieces are not supported")
        if self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError("only unigram and merge models")
        made = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if self.cut_at_marks():
            made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return made


class Codec:
    """Encodes and decodes lists of texts with the rebuilt pipeline, several threads at a time."""

    RUN = re.compile(f"{MARK}+[^{MARK}]*")

    def __init__(self, path: str, threads: int = 1):
        import sentencepiece
        from tokenizers import Tokenizer

        self.judge, self.threads = sentencepiece.SentencePieceProcessor(model_file=path), threads
        model = PieceModel.read(path)
        self.tool = model.backend()
        self.by_runs = model.cut_at_marks() and model.dummy_prefix and not (model.charsmap or model.squeeze)
        #: The same model for runs that are normalised and cut already.
        self.bare = Tokenizer(self.tool.model)
        self.ids, self.back, self.apart, self.room = {}, {}, set(), KEPT_BYTES

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tool.decode_batch(ids, skip_special_tokens=False)

    def checked(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """Ids of each text as little-endian 32-bit integers, what they are decoded to, and whether sentencepiece gives the same ids.

        A run begins with a marker, and where no piece has a marker behind another character neither
        library joins anything across runs, so a text's ids agree where those of all its runs do. A
        marker alone can only be a text's end, and is no text of its own; such texts are compared whole.
        """
        if not self.by_runs:
            ids = self.encode(texts)
            return [(array("I", i).tobytes(), back, i == e) for i, back, e in zip(ids, self.decode(ids), self.expected(texts))]
        runs = [self.RUN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set().union(*runs) - self.ids.keys())
        ids = [e.ids for e in self.bare.encode_batch_fast(new, add_special_tokens=False)]
        # The prefix that a library puts before a text is a run's first marker; decoding takes its space away.
        self.apart.update(r for r, i, e in zip(new, ids, self.expected([r[1:] for r in new])) if i != e and r != MARK)
        fresh_ids = {r: array("I", i).tobytes() for r, i in zip(new, ids)}
        fresh_back = {r: " " + back for r, back in zip(new, self.decode(ids))}
        ids_of, back_of = (self.ids | fresh_ids).__getitem__, (self.back | fresh_back).__getitem__
        if self.room > 0:
            self.keep(fresh_ids, fresh_back)
        made = [(b"".join(map(ids_of, r)), "".join(map(back_of, r))[1:], self.apart.isdisjoint(r)) for r in runs]
        whole = [k for k, r in enumerate(runs) if r and r[-1] == MARK]
        for k, e in zip(whole, self.expected([texts[k] for k in whole])):
            made[k] = (*made[k][:2], made[k][0] == array("I", e).tobytes())
        return made

    def expected(self, texts: list[str]) -> list[list[int]]:
        return self.judge.encode(texts, num_threads=self.threads)

    def keep(self, ids: dict[str, bytes], back: dict[str, str]) -> None:
        """Remember short runs while there is room: the frequent come early."""
        for r, i in ids.items():
            if len(r) <= LONGEST_KEPT:
                self.ids[r], self.back[r] = i, back[r]
                self.room -= ENTRY_BYTES
                if self.room <= 0:
                    return


@cache
def codec(path: str, threads: int) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Codec(path, threads)


def encoded(df: DataFrame, vocabulary: str = "piece_bpe_32k.model", threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every text."""

    def kernel(ids, texts):
        return {"doc_id": ids, "ids": codec(public_tokenizers.path(vocabulary), threads).encode([t or "" for t in texts])}

    return map_texts(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), kernel, "doc_id long, ids array<int>", step=1 << 20)


def decoded(df: DataFrame, vocabulary: str = "piece_bpe_32k.model", threads: int = 2, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of every list of ids; null and an empty list give the empty text."""

    def run(batches):
        import pyarrow as pa

        try:
            for batch in batches:
                made = codec(public_tokenizers.path(vocabulary), threads).decode([x or [] for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])
        finally:
            release()

    return df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id long, text string")


def round_trips(df: DataFrame, vocabulary: str = "piece_bpe_32k.model", threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: counts, digests, and whether ids and text are as they should be.

    parity: the ids are those of the sentencepiece library; round_trip: the decoded text is the
    text itself (so only for models whose normaliser changes nothing).
    """

    def kernel(ids, texts):
        path, texts = public_tokenizers.path(vocabulary), [t or "" for t in texts]
        made = codec(path, threads).checked(texts)
        return {
            "doc_id": ids, "n_chars": [len(t) for t in texts], "n_tokens": [len(m) // 4 for m, _, _ in made],
            "ids_crc32": [zlib.crc32(m) for m, _, _ in made],
            "decoded_sha256": [hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest() for _, back, _ in made],
            "round_trip": [t == back for t, (_, back, _) in zip(texts, made)],
            "parity": [same for _, _, same in made],
        }

    schema = "doc_id long, n_chars long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean"
    return map_texts(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), kernel, schema, step=STEP)
