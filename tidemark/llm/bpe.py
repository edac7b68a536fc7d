"""Operator 6: byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory, slices


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, take
    the code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a vocabulary file: its characters through the reversed byte table."""
    to_byte = {c: b for b, c in enumerate(byte_characters())}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(to_byte[c] for c in token)
    return table


@lru_cache(maxsize=4)
def known_table(path: str) -> list[bytes]:
    """:func:`byte_table`, read once a process."""
    return byte_table(path)


def check_ranks(ranks_path: str, path: str) -> None:
    """ValueError unless a file of ranks (base64 bytes and rank per line) says of each id what the vocabulary says."""
    with open(ranks_path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}
    table = known_table(path)
    # The vocabulary may go on with special tokens, which have no rank and are never produced.
    if any(i >= len(table) or table[i] != token for i, token in ranks.items()):
        raise ValueError(f"{ranks_path} and {path} disagree")


def decode_ids(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def load_model(path: str):
    """The library's tokenizer of a vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return model


class ByteBpe:
    """Encoder around a byte-level vocabulary file of the tokenizers library.

    The pattern splits a text first; each piece is encoded by the library once and kept, by its
    number, in a table of ``limit`` pieces at most, since most pieces repeat. A batch's pieces are looked up as
    numbers, and their ids gathered at once.
    """

    def __init__(self, path: str, pattern: str, limit: int = 300_000):
        self.model = load_model(path)
        self.split = regex.compile(pattern).findall
        self.numbers: dict[str, int] = {}
        self.limit = limit
        #: Ids of all pieces one after another, and where each piece's begin; there is one begin more than pieces.
        self.ids, self.begins = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.lengths = np.array([len(b) for b in known_table(path)], np.int64)

    def _learn(self, new: list[str]) -> None:
        """Number the pieces and add their encodings."""
        # As words of one sequence, the pieces are encoded apart but come back together.
        found = self.model.encode(new, is_pretokenized=True, add_special_tokens=False)
        sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(new))
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.ids = np.concatenate((self.ids, np.array(found.ids, np.int32)))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(sizes)))

    def _forget(self, pieces: list[str]) -> None:
        for piece in pieces:
            del self.numbers[piece]
        self.begins = self.begins[: len(self.numbers) + 1]
        self.ids = self.ids[: self.begins[-1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        pieces = list(chain.from_iterable(split))
        new = list(set(pieces).difference(self.numbers))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        begins, sizes = self.begins[at], np.diff(self.begins)[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        if len(self.numbers) > self.limit:
            self._forget(new)
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def offsets(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code-point start and end of each token; tokens that share a split character overlap in it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        number = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, 0)  # of the character that holds a byte
        ends = np.cumsum(self.lengths[ids])
        return number[ends - self.lengths[ids]], number[ends - 1] + 1


def _encoder(path: str, pattern: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Vocabulary and table of pieces go with the task, so that later stages find the memory free.
        bpe = ByteBpe(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = bpe.encode(texts)
                cuts = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                arrays = [np.concatenate(ids)]
                if offsets:
                    spans = [bpe.offsets(i, t) for i, t in zip(ids, texts, strict=True)]
                    arrays += [np.concatenate([s[k] for s in spans]).astype(np.int32) for k in (0, 1)]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(a, pa.int32())) for a in arrays]
                yield pa.record_batch([part.column(0), *lists], ["doc_id", "ids", "starts", "ends"][: 1 + len(lists)])
        del bpe
        release_memory()

    return run


def _decoder(path: str, digests: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known_table(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1)
            values, cuts = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
            rows = [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            raw = [decode_ids(table, r) for r in rows]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw]) if digests else pa.array(raw, pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256" if digests else "decoded"],
            )

    return run


def _key_type(df: DataFrame, column: str) -> str:
    return df.select(column).dtypes[0][1]


def bpe_encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False
) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; with ``offsets`` also starts and ends.

    ``path`` is a byte-level vocabulary of the tokenizers library; ``pattern`` splits a
    text, and its matches are encoded separately, special tokens as ordinary text. Starts
    and ends count code points; tokens that split a character both cover it. Null and
    empty texts give no ids; null and repeated ids of rows keep their rows; an empty table
    gives an empty result. Other columns are not read. Nothing is shuffled, and a task
    holds a few megabytes of text at a time.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {_key_type(known, 'doc_id')}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return known.mapInArrow(_encoder(path, pattern, offsets), schema)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded binary) of token ids.

    Each id's characters go back through the reversed byte table, and bytes are joined
    before they are read as text, so characters split between tokens come back whole.
    ``ids_sha256`` digests the ids as little-endian unsigned 32-bit integers. Null ids
    count as none.
    """
    known = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    schema = f"doc_id {_key_type(known, 'doc_id')}, n_tokens long, ids_sha256 string, decoded binary"
    return known.mapInArrow(_decoder(path), schema)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what :func:`bpe_decode` says of :func:`bpe_encode`.

    Ids and decoded bytes stay in the one worker that encodes and decodes; only digests leave it.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {_key_type(known, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    encode, decode = _encoder(path, pattern, False), _decoder(path, digests=True)
    return known.mapInArrow(lambda batches: decode(encode(batches)), schema)
