"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi search.

The text is read once. At each position the automaton's output links name every piece that ends there, and each
relaxes the best score of that position; the best path back is the segmentation with the highest sum of piece
scores (ties: the longest last piece). Characters that no piece covers become byte pieces. Where no piece of
the vocabulary crosses from another character into the space mark, runs of space marks start independent
chunks, so equal chunks are searched once.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, sliced, table

MARK = "▁"
_NONE = (1, 0.0, -1)
#: How far a character without a piece is below the lowest score of a piece; at least as high are all pieces.
UNKNOWN = 10.0


def read_pieces(path: str) -> tuple[tuple[str, float, int], ...]:
    """(piece, score, kind) by id; kinds as the model file has them: 1 normal, 2 unknown, 3 control, 4 user, 6 byte."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    kind = lambda i: 2 if p.is_unknown(i) else 3 if p.is_control(i) else 6 if p.is_byte(i) else 1
    return tuple((p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size()))


class PieceModel:
    """The vocabulary, its automaton and the searches over it."""

    def __init__(self, pieces: tuple[tuple[str, float, int], ...], kept: int = 400_000):
        self.pieces, self.kept, self.cache = pieces, kept, {}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_at = {i: b for b, i in self.bytes.items()}
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4) and p]
        self.floor = min((s for _, s, _ in normal if s > -1e8), default=0.0) - UNKNOWN
        normal = [(p, max(s, self.floor + 1.0), i) for p, s, i in normal]  # pieces that the model's own merges never reach
        self.automaton = ahocorasick.Automaton()
        for p, s, i in normal:
            self.automaton.add_word(p, (len(p), s, i))
        if normal:
            self.automaton.make_automaton()
        self.apart = not any(MARK in p.lstrip(MARK) for p, _, _ in normal)
        self.text_of = [p.replace(MARK, " ") if kind in (1, 4) else "" for p, _, kind in pieces]

    def search(self, chunk: str) -> list[int]:
        """The ids of the best segmentation of a chunk, in which spaces are marks."""
        n, floor = len(chunk), self.floor
        best, step, at = [0.0], [_NONE], 0
        for end, piece in self.automaton.iter(chunk) if len(self.automaton) else ():  # by end; the output links give each piece that ends there
            while at <= end:
                at += 1
                best.append(best[-1] + floor)
                step.append(_NONE)
            s = best[at - piece[0]] + piece[1]
            if s > best[at]:
                best[at], step[at] = s, piece
        while at < n:
            at += 1
            best.append(best[-1] + floor)
            step.append(_NONE)
        ids: list[int] = []
        while n:
            size, _, i = step[n]
            ids += [i] if i >= 0 else [self.bytes.get(b, 0) for b in reversed(_raw(chunk[n - 1]))]
            n -= size
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        """A space mark is put before the text. Marks that the text itself holds become byte pieces."""
        if not text:
            return []
        marked = MARK + text.replace(MARK, _ALIEN).replace(" ", MARK)
        if not self.apart:
            return self.search(marked)
        ids: list[int] = []
        cache = self.cache
        for chunk in CHUNK.findall(marked):
            got = cache.get(chunk)
            if got is None:
                got = self.search(chunk)
                if len(chunk) < 64:
                    if len(cache) >= self.kept:  # only speed depends on what is kept
                        cache.clear()
                    cache[chunk] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        if self.byte_at.keys().isdisjoint(ids):
            out = "".join(map(self.text_of.__getitem__, ids))
        else:
            raw = bytearray()
            for i in ids:
                if i in self.byte_at:
                    raw.append(self.byte_at[i])
                else:
                    raw += self.text_of[i].encode("utf-8", "surrogatepass")
            out = raw.decode("utf-8", "surrogatepass")
        return out[1:] if out.startswith(" ") else out


_MODELS: dict[tuple, PieceModel] = {}


def piece_model(pieces: tuple) -> PieceModel:
    """One model for all tasks of a worker, with the chunks that it has searched."""
    if pieces not in _MODELS:
        _MODELS.clear()
        _MODELS[pieces] = PieceModel(pieces)
    return _MODELS[pieces]


#: Stands for a mark of the text itself during the search: no piece holds it.
_ALIEN = "\U0010fffd"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _raw(ch: str) -> bytes:
    return (MARK if ch == _ALIEN else ch).encode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add token_ids (array of int), n_tokens (long) and round_trip (boolean: decoding gives the text back).

    Whole texts are encoded. Null and empty texts have no tokens (a null counts as given back). Any string
    decodes to itself: what the vocabulary lacks goes through byte pieces. Incoming columns of these names are
    replaced. The pieces are read from `model_path` on the driver and shipped to the tasks (a vocabulary's size).
    """
    names = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    src = docs.select(*[F.col(f"`{c}`") for c in names])
    held = shipped(docs.sparkSession, read_pieces(model_path))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), "token_ids array<int>, n_tokens bigint, round_trip boolean"])
    at, names = names.index(text), [*names, "token_ids", "n_tokens", "round_trip"]

    def encoded(batches):
        m = piece_model(held())
        for part in sliced(batches):
            texts = part.column(at).to_pylist()
            ids = [m.encode(t) for t in texts]
            same = [m.decode(i) == (t or "") for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(same)], names=names)

    return src.mapInArrow(encoded, schema)


def decode_documents(tokens: DataFrame, model_path: str, ids: str = "token_ids") -> DataFrame:
    """Add decoded (string) to rows of token ids; null ids give an empty text. An incoming `decoded` is replaced."""
    names = [c for c in tokens.columns if c != "decoded"]
    src = tokens.select(*[F.col(f"`{c}`") for c in names])
    held = shipped(tokens.sparkSession, read_pieces(model_path))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), "decoded string"])
    at, names = names.index(ids), [*names, "decoded"]

    def decoded(batches):
        m = piece_model(held())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.decode(i or []) for i in b.column(at).to_pylist()], pa.string())], names=names)

    return src.mapInArrow(decoded, schema)


def op6_sentencepiece(spark, sf_dir, model_path: str = "/opt/tokenizers/piece_bpe_32k.model"):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, model_path).select("doc_id", "n_tokens", "round_trip", "token_ids")
