"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A model of this type merges the adjacent pair whose joint piece scores
best, the leftmost of equals, until no pair is a piece. A sequence of
pieces is what that gives for a text exactly if it is for each adjacent
pair: merges inside a piece run alike in the pair and in the whole, and
the first merge across a boundary would be the best in its pair as well.

So no text is merged as a whole. The pieces' Aho-Corasick automaton gives
the longest piece at a place, one after the other. Encoding takes these,
tries shorter pieces where the last piece and the next would merge otherwise
(adjacent pieces are merged again from their characters, the outcome kept),
and goes back where nothing fits. Each prefix has one correct sequence, so a place from which
there is no way on stays so: a bitfield holds these, each is tried once,
and time grows with the length however long a text without spaces is.

A text is cut where no piece joins the two characters; equal parts are
encoded once while a task remembers them, up to ``CACHE_BYTES``; a worker
keeps outcomes of pairs, up to as much.

Characters without a piece become the byte pieces of their UTF-8 form.
Null texts read as empty and have no ids. Rows keep their other columns,
nulls and repeats included; columns named like the results are replaced.
An empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalflow.llm.shared import returning, small_batches

#: Bytes, about, that a task may keep of parts, and a worker of pairs of pieces, before it starts anew.
CACHE_BYTES = 48 << 20
#: What a pair of pieces takes there.
PAIR_BYTES = 200
#: Longest part worth remembering.
REMEMBERED = 64
#: Rows whose results stand in memory together.
ROWS = 256

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MERGES = 2  # model_type of TrainerSpec


def fields(message: bytes):
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """The tables of a model file, of merge type with byte pieces and without text normalisation."""

    def __init__(self, path: str):
        import struct

        with open(path, "rb") as f:
            message = f.read()
        listed, trainer, normalizer = [], {}, {}
        for number, value in fields(message):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                listed.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        kinds = {kind for _, _, kind in listed}
        plain = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if trainer.get(3, 1) != _MERGES or not plain or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError(f"{path}: only merge models with byte pieces, identity normalisation and no user-defined pieces are read")
        self.prefix = " " if normalizer.get(3, 1) else ""
        self.label: list[str | None] = [None] * len(listed)  # what decoding emits; None: control, unknown and byte pieces
        self.byte: dict[int, int] = {}  # byte pieces
        self.byte_id = [0] * 256
        self.unknown: set[int] = set()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, (piece, score, kind) in enumerate(listed):
            if kind == NORMAL:
                own = piece.replace(SPACE, " ")
                self.label[i], self.id[own], self.score[own] = own, i, score
            elif kind == BYTE:
                value = int(piece[3:5], 16)
                self.byte[i], self.byte_id[value] = value, i
            elif kind == UNKNOWN:
                self.unknown.add(i)
        self.pairs: dict[tuple[str, str], bool] = {}  # whether two pieces stay apart; bounded by those who enter
        self.listed = {piece: f",{i}" for piece, i in self.id.items()}
        if any(" " in piece.lstrip(" ") for piece in self.id):
            raise ValueError(f"{path}: pieces reach over spaces")
        self.match = ahocorasick.Automaton()
        for piece in self.id:
            self.match.add_word(piece, piece)
        self.match.make_automaton()
        self.shorter: dict[str, str] = {}  # the longest piece, or else the character, that begins a piece
        for piece in self.id:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.id), "")
        # Words take the spaces before them. A character in no piece joins nothing: runs of such stand alone.
        known = {c for piece in self.id for c in piece}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in known)
        self.cut = re.compile(rf"[{alone}]+| *[^ {alone}]+| +" if alone else r" *[^ ]+| +")

    def emits(self, i: int) -> bool:
        return i in self.byte or i in self.unknown or 0 <= i < len(self.label) and self.label[i] is not None

    def merged(self, text: str) -> list[str]:
        """``text``, a few characters, merged by score."""
        score, none = self.score.get, float("-inf")
        out = list(text)
        scores = [score(a + b, none) for a, b in zip(out, out[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            joined = out[at] + out[at + 1]
            out[at : at + 2] = [joined]
            del scores[at]
            if at:
                scores[at - 1] = score(out[at - 1] + joined, none)
            if at < len(scores):
                scores[at] = score(joined + out[at + 1], none)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The tables once for each worker process and file."""
    return Pieces(path)


class Encoder:
    """Encodes texts; remembers parts and pairs within its bound."""

    def __init__(self, tables: Pieces, cache_bytes: int = CACHE_BYTES):
        self.tables, self.cache_bytes = tables, cache_bytes
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.pairs = tables.pairs
        self.kept = 0

    def fits(self, last: str, piece: str) -> bool:
        """Whether merging both again gives both; with no last piece, whether the piece comes from merges at all."""
        if len(self.pairs) * PAIR_BYTES > self.cache_bytes:
            self.pairs.clear()
        found = self.pairs[last, piece] = self.tables.merged(last + piece) == ([last, piece] if last else [piece])
        return found

    def run(self, part: str) -> list[str]:
        """The pieces of ``part``; characters without one stand for themselves."""
        n, tables = len(part), self.tables
        pairs, fits, shorter = self.pairs, self.fits, tables.shorter
        out: list[str] = []
        failed: bytearray | None = None  # bits of the places from which no way leads on
        at, last = 0, ""
        ahead = tables.match.iter_long(part)  # longest matches, one after the other
        start, found = -1, ""
        while at < n:
            if start < at:
                end, found = next(ahead, (n, ""))
                start = end - len(found) + 1
            piece, kept = found if start == at else part[at], True
            while True:
                to = at + len(piece)
                if failed is None or not failed[to >> 3] >> (to & 7) & 1:
                    open_ = pairs.get((last, piece))
                    if open_ or open_ is None and fits(last, piece):
                        break
                piece, kept = shorter.get(piece), False
                while not piece:
                    if failed is None:
                        failed = bytearray((n >> 3) + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    at -= len(piece)
                    piece = shorter.get(piece)
                    last = out[-1] if out else ""
            out.append(piece)
            last, at = piece, to
            if not kept and at < n:
                ahead, start = tables.match.iter_long(part, at), -1
        return out

    def part(self, part: str) -> tuple[int, str, str]:
        """Number of ids, ids as text with a leading comma each, and the part decoded."""
        found, tables = self.run(part), self.tables
        try:
            out = len(found), "".join([tables.listed[x] for x in found]), "".join(found)
        except KeyError:  # a character that only byte pieces can say
            ids = [i for x in found for i in ([tables.id[x]] if x in tables.id else [tables.byte_id[b] for b in x.encode()])]
            out = len(ids), "".join([f",{i}" for i in ids]), emitted(tables, ids)
        if len(part) <= REMEMBERED:
            self.kept += 400 + 2 * len(part) + len(out[1])
            if self.kept > self.cache_bytes:
                self.parts.clear()
                self.kept = 0
            self.parts[part] = out
        return out

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, decimal ids joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        get, part = self.parts.get, self.part
        whole = (self.tables.prefix + text).replace(SPACE, " ")
        found = [get(x) or part(x) for x in self.tables.cut.findall(whole)]
        return sum([x[0] for x in found]), "".join([x[1] for x in found])[1:], "".join([x[2] for x in found])[len(self.tables.prefix) :]


def emitted(tables: Pieces, ids: list[int]) -> str:
    """The pieces' texts; a run of byte pieces is read as UTF-8, a byte that is none as U+FFFD; control pieces emit nothing."""
    out, raw = [], bytearray()
    for i in [*ids, -1]:
        byte = tables.byte.get(i)
        if byte is not None:
            raw.append(byte)
            continue
        if raw:
            out.append(utf8(bytes(raw)))
            raw.clear()
        if i in tables.unknown:
            out.append(" ⁇ ")
        elif 0 <= i < len(tables.label):
            out.append(tables.label[i] or "")
    return "".join(out)


def utf8(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def decode_ids(tables: Pieces, ids: list[int] | None) -> str:
    """The text of ``ids``; a space that begins the first piece is the one that encoding put there."""
    text = emitted(tables, list(ids or []))
    first = next((i for i in ids or [] if tables.emits(i)), -1)
    return text[1:] if tables.prefix and first >= 0 and (tables.label[first] or "").startswith(" ") else text


def encode(documents: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Adds n_tokens and, unless ``digest``, ids (array of int) and decoded; with it ids_sha256 and decoded_sha256 instead.

    ``path`` names the model file on every executor.
    """
    kinds = {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digest else {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    extra = [T.StructField("n_tokens", T.LongType()), *(T.StructField(name, kind) for name, kind in kinds.items())]
    rest = small_batches(documents).drop(*(f.name for f in extra))
    schema = T.StructType([*rest.schema.fields, *extra])
    names = [f.name for f in schema.fields]

    def run(batches):
        from hashlib import sha256

        encoder = Encoder(pieces(path))
        for batch in batches:
            for rows in (batch.slice(i, ROWS) for i in range(0, len(batch), ROWS)):
                found = [encoder.encode(x) for x in rows.column(rows.schema.get_field_index("text")).to_pylist()]
                counts = pa.array([x[0] for x in found], pa.int64())
                if digest:
                    results = [pa.array([sha256(x[k].encode()).hexdigest() for x in found], pa.string()) for k in (1, 2)]
                else:
                    ids = pa.array([[int(i) for i in x[1].split(",")] if x[1] else [] for x in found], pa.list_(pa.int32()))
                    results = [ids, pa.array([x[2] for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns, counts, *results], names=names)
        del encoder

    return rest.mapInArrow(returning(run), schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` from an array column of ids (null: empty); ids outside the model emit nothing."""
    rest = small_batches(rows).drop("decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        tables = pieces(path)
        for batch in batches:
            texts = [decode_ids(tables, x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return rest.mapInArrow(run, schema)
