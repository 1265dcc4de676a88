"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by a pattern; each piece is turned into one character per byte (the byte table below), and the
library's BPE model merges those characters, so the model's character offsets are byte offsets of the piece. Decoding
reverses the byte table; a character whose bytes lie in two tokens comes back whole because bytes are joined before
they are read as UTF-8.

Pieces repeat, so each Python worker keeps the ids of pieces that it has met, in a table that is emptied when it
has MEMO_PIECES entries: memory is bounded, results don't depend on it.

Defined results: a null text is an empty text (no ids); equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

MEMO_PIECES = 400_000
#: Longer pieces are encoded anew each time.
MEMO_LENGTH = 64


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def _model_from_ranks(ranks: dict[bytes, int]):
    """A BPE model that merges as ranks do: any two neighbours whose join has a rank may merge, the lowest rank first."""
    from tokenizers import Tokenizer, models

    table = byte_table()
    spell = lambda b: "".join(map(table.__getitem__, b))
    merges = [(spell(t[:i]), spell(t[i:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return Tokenizer(models.BPE({spell(t): i for t, i in ranks.items()}, merges, ignore_merges=True))


def _model_from_json(path: str):
    """The BPE model of a tokenizer file, without its splitting and added tokens; and the id of each added token."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return Tokenizer(whole.model), {token.content: i for i, token in whole.get_added_tokens_decoder().items()}


@lru_cache(maxsize=1)
def _newer_letters():
    """Search for letters and digits that regex knows and the tokenizers library, with an older Unicode table, does not."""
    from tokenizers import Regex, pre_tokenizers

    known = pre_tokenizers.Split(Regex(r"\p{L}|\p{N}"), "removed").pre_tokenize_str
    letter = regex.compile(r"[\p{L}\p{N}]").match
    newer = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and letter(c) and known(c)]
    return regex.compile("[" + "".join(map(regex.escape, newer)) + "]").search if newer else lambda _: None


def _latin(pattern: str) -> str | None:
    """The pattern for texts of code points under 256, with classes spelled out, for the quicker re; None if it has others."""
    bodies = {name: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in bodies if pattern.startswith(n, at)), None)
        if name:
            out.append(bodies[name] if inside else f"[{bodies[name]}]")
            at += len(name)
        elif pattern.startswith(r"\S", at) and not inside:
            out.append(f"[^{bodies[chr(92) + 's']}]")
            at += 2
        elif pattern[at] == "\\":
            return None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return "".join(out)


class _Memo(dict):
    """The ids, as unsigned 32-bit numbers, of pieces; a new piece is merged by the library's model, and kept unless it is long."""

    def __init__(self, merge, spell):
        self.merge, self.spell = merge, spell

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", map(_ID, self.merge(self.spell(piece)))).tobytes()
        if len(piece) <= MEMO_LENGTH:
            self[piece] = ids
        return ids


_ID = attrgetter("id")


class ByteBPE:
    """Codec of one vocabulary file: `.tiktoken` (base64 token and rank a line) or a byte-level `tokenizers` JSON file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, pre_tokenizers

        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.model, self.added = _model_from_ranks(ranks), {}
        else:
            self.model, self.added = _model_from_json(path)
        table = byte_table()
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in self.model.get_vocab().items() if all(c in back for c in t)}
        self.split_known = regex.compile(pattern).findall
        self.split_latin = re.compile(_latin(pattern)).findall if _latin(pattern) else self.split_known
        self.split_any = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str
        self.newer = _newer_letters()
        self.spelling = {b: c for b, c in enumerate(table)}  # a Latin-1 text's translation: one character a byte
        self.memo = _Memo(self.model.model.tokenize, self._spell)

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer(text):
                return [piece for piece, _ in self.split_any(text)]
            return self.split_known(text)
        return self.split_latin(text)

    def _spell(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.spelling)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, unsigned 32-bit."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split(text))), dtype=np.uint32)

    def encode_marked(self, text: str) -> np.ndarray:
        """Ids as the library's own encode gives them: where a text spells an added token of the file, that token's id."""
        if not any(token in text for token in self.added):
            return self.encode(text)
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text)
        return np.concatenate([np.array([self.added[x]], dtype=np.uint32) if x in self.added else self.encode(x) for x in parts])

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the byte offset at which each token starts and ends in the text's UTF-8."""
        ids, starts, ends, at = [], [], [], 0
        for piece in self.split(text):
            e = self.model.encode(self._spell(piece), add_special_tokens=False)
            ids += e.ids
            starts += [at + a for a, _ in e.offsets]
            ends += [at + b for _, b in e.offsets]
            at += len(piece.encode())
        return ids, starts, ends

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; a KeyError names an id that the vocabulary lacks."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; where ids begin or end inside a character, U+FFFD stands for its bytes."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each file, pattern and Python worker; the library runs no threads beside Spark's tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBPE(path, pattern)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids array<int>) of every whole text; offsets=True adds starts and ends, byte offsets of each token."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if offsets:
                found = [own.encode_with_offsets(t) for t in texts]
                columns = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(3)]
            else:
                columns = [pa.array([own.encode(t) for t in texts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "ids", "starts", "ends"][: 1 + len(columns)])

    schema = f"`{id_col}` {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids); null ids are no ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(encoded[id_col], encoded["ids"]).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again, in one pass; return counts and digests of both instead of ids.

    (id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = {i: str(i) for i in own.bytes_of}
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py() or "").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
