"""Byte-level BPE by a sentencepiece BPE model that is serialised from a rank file.

Every byte becomes one printable character, every token of the rank file a piece scored by its negative rank, so that the
model merges the pair of lowest rank first, the leftmost of equals. A text is split by the tokenizer's pattern and each
pre-token is encoded on its own; a pre-token that is itself a token takes that token's rank. Decoding looks the bytes up.

Null and empty texts give no ids; repeated rows give repeated results; nothing but the named columns is read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.common import map_rows

#: Code point of byte 0; the 256 characters from here on are letters, none of them white space.
FIRST = 0x100
#: Pre-tokens kept with their ids in each task, and the longest that is kept. A thousand take 0.2 MB or less.
CACHED, CACHED_CHARS = 120_000, 48
LETTERS = {b: FIRST + b for b in range(256)}
UNKNOWN = "<unknown>"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; ranks run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


def as_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(LETTERS)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the piece for unknowns comes last and is never used."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=as_letters(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id, spec.unk_piece = pb.TrainerSpec.BPE, len(tokens) + 1, len(tokens), UNKNOWN
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    rules = model.normalizer_spec
    rules.name, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class PreTokens(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit integers, made when first asked for.

    Once half of ``CACHED`` are kept, they become the older half, of which only those asked for again are kept on.
    """

    def __init__(self, tokens: list[bytes], model: bytes):
        import sentencepiece

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            data = word.encode()
            rank = self.ranks.get(data)
            ids = rank.to_bytes(4, "little") if rank is not None else np.array(self.encode(as_letters(data)), "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _encoder(tokens, model, pattern: str, key: str, text: str) -> Callable:
    def make():
        import regex

        split, ids = regex.compile(pattern).findall, PreTokens(tokens.value, model.value)

        def step(batch: dict) -> dict:
            packed = [b"".join(map(ids.__getitem__, split(x))) if x else b"" for x in batch[text]]
            return {key: batch[key], "n_tokens": [len(p) // 4 for p in packed], "ids": packed}

        return step

    return make


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every text.

    The driver reads the rank file and sends tokens and model to the tasks; their size is the vocabulary's.
    """
    tokens = read_ranks(rank_file)
    context = docs.sparkSession.sparkContext
    make = _encoder(context.broadcast(tokens), context.broadcast(serialise(tokens)), pattern, key, text)
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null ids give no bytes."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    kept = [f for f in encoded.schema.fields if f.name != out]

    def make():
        pieces = tokens.value

        def step(batch: dict) -> dict:
            numbers = [np.frombuffer(x or b"", "<u4").tolist() for x in batch[ids]]
            return batch | {out: [b"".join([pieces[i] for i in n]) for n in numbers]}

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_rows(encoded.select([f"`{f.name}`" for f in kept]), make, f"{schema}, `{out}` binary")
