"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens: its states stand for "the last token was x",
and an arc y leaves state x exactly if y may follow x in a correct
tokenization. It is compiled by one merge gadget for each merge (u, v), in
rank order: the state that u leads to is replaced by a copy without its v
arc, and a new arc uv leads where v led. A gadget changes one state, so it
is kept as one entry: arc v closed at the state of u from this rank on. The
state of a merged token starts as that of its right part, the arc of a
merged token exists where that of its left part did, each as of the
token's own rank; ``Automaton.arc`` reads both chains.

Every prefix of a word has exactly one correct tokenization, so the
automaton is run deterministically on bytes. The tokens' Aho-Corasick
automaton, compiled once per worker, goes from node to node by its
transition table; a node lists the tokens that end there. Of these exactly
one continues the correct tokenization of what stands before it: the one
whose arc leaves the state, the last token, reached there. Arcs once worked
out are read from a table too. So a word takes one pass, without going
back, however long it is. The tokens are read off from the end: the last
token of the whole word, then that of the prefix before it. Arc labels are
the tokens' bytes; decoding emits them.

Words are split by the vocabulary's pre-tokenizer pattern; added special
tokens in the text are cut out first, as the tokenizers library does.
``encode`` gives ids, count and decoded text; null texts read as empty.
Rows keep their other columns, nulls and repeats included. An empty table
gives an empty one. What a worker remembers of words and arcs has a
bound in bytes.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalflow.llm.shared import kept_by_worker, returning, small_batches

#: The byte-level pre-tokenizer's pattern (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes, about, that a worker keeps of words, and of arcs.
WORD_BYTES, CACHE_BYTES = 112 << 20, 48 << 20
#: What an arc takes there.
ARC_BYTES = 130


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the rest for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.label: dict[int, bytes] = {}
        self.id: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.label[i] = raw(token)
        base = {c: vocabulary[c] for c in letters}
        self.id = {bytes([b]): base[c] for c, b in letters.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        self.closed: dict[int, int] = {}  # state's token << 20 | arc: rank of the gadget
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            u, v, uv = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if u << 20 | v in self.closed:
                continue
            self.closed[u << 20 | v] = rank
            if uv not in self.parts:
                self.parts[uv] = rank, u, v
                self.id[self.label[uv]] = uv
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(PATTERN)
        self.id = {token: i for token, i in self.id.items() if self.canonical(self.label[i]) == (i,)}
        # The tokens' Aho-Corasick automaton: node 0 is the empty prefix.
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.depth = [0]
        self.token = [-1]  # the token that a node spells
        for token, i in self.id.items():
            node = 0
            for byte in token:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = to
            self.token[node] = i
        # A node's fail link is its longest proper suffix that begins a token; a breadth-first order serves.
        fail = [0] * len(self.depth)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.depth)  # tokens that end in a node and their sizes, longest first
        for edge in sorted(self.child, key=lambda e: self.depth[e >> 8]):
            node, byte, to = edge >> 8, edge & 255, self.child[edge]
            at = fail[node]
            while node and at and at << 8 | byte not in self.child:
                at = fail[at]
            fail[to] = self.child.get(at << 8 | byte, 0) if node else 0
            own = ((self.token[to], self.depth[to]),) if self.token[to] >= 0 else ()
            self.ends[to] = own + self.ends[fail[to]]
        self.fail = fail
        # The transition table by node: also what fail links lead to, once met (at most four times as many entries).
        self.goto: list[dict[int, int]] = [{} for _ in self.depth]
        for edge, to in self.child.items():
            self.goto[edge >> 8][edge & 255] = to
        self.room = 3 * len(self.child)
        self.arcs: list[dict[int, bool]] = [{} for _ in range(max(self.label) + 1)]  # by token
        self.n_arcs = 0
        self.listed = {i: f",{i}" for i in self.label}
        # Words met lately, and those before them: a word met again moves on, so that common ones stay.
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.kept = 0

    def step(self, node: int, byte: int) -> int:
        """The longest suffix of the node's bytes and one more that begins a token; enters it in the table."""
        edge = node << 8 | byte
        to = self.child.get(edge)
        while to is None:
            if not node:
                to = 0
                break
            node = self.fail[node]
            to = self.child.get(node << 8 | byte)
        if self.room:
            self.room -= 1
            self.goto[edge >> 8][byte] = to
        return to

    def canonical(self, word: bytes) -> tuple[int, ...]:
        """Merging from the bytes in rank order, for the vocabulary's own tokens: some are never reached."""
        tokens = [self.id[word[i : i + 1]] for i in range(len(word))]
        while len(tokens) > 1:
            rank, at = min((self.closed.get(u << 20 | v, 1 << 40), i) for i, (u, v) in enumerate(zip(tokens, tokens[1:])))
            if rank == 1 << 40:
                break
            tokens[at : at + 2] = [self.id[self.label[tokens[at]] + self.label[tokens[at + 1]]]]
        return tuple(tokens)

    def arc(self, x: int, y: int) -> bool:
        """Whether arc y leaves the state of token x; enters it in the table."""
        # The state of x descends from those of its right parts, each as of the rank that took it up;
        # arc y goes back to those of its left parts likewise.
        states, arcs = self.right.get(x) or self.chain(self.right, x, 2), self.left.get(y) or self.chain(self.left, y, 1)
        closed, open_ = self.closed, True
        for a, a_until in states:
            for b, b_until in arcs:
                rank = closed.get(a << 20 | b)
                # A merge of the pair closes the arc if both tokens still stand at its rank. One rank
                # takes up both only for a run of equal tokens, merged from the left: b's is later.
                if rank is not None and rank < a_until and rank <= b_until:
                    open_ = False
        if self.n_arcs * ARC_BYTES > CACHE_BYTES:
            for known in self.arcs:
                known.clear()
            self.n_arcs = 0
        self.arcs[x][y] = open_
        self.n_arcs += 1
        return open_

    def chain(self, kept: dict[int, tuple], token: int, part: int) -> tuple[tuple[int, int], ...]:
        """A token, its right (2) or left (1) part, that part's own and so on, each with the rank that took it up."""
        out, at, until = [], token, 1 << 40
        while True:
            out.append((at, until))
            if at not in self.parts:
                break
            until, at = self.parts[at][0], self.parts[at][part]
        kept[token] = tuple(out)
        return kept[token]

    def run(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        whole = self.id.get(word)
        if whole is not None:
            return [whole]
        goto, ends, arcs, label = self.goto, self.ends, self.arcs, self.label
        node, at = 0, 0
        last = [-1]  # the last token of each prefix
        for byte in word:
            at += 1
            try:
                node = goto[node][byte]
            except KeyError:
                node = self.step(node, byte)
            for token, size in ends[node]:
                before = last[at - size]
                if before < 0:
                    break
                try:
                    if arcs[before][token]:
                        break
                except KeyError:
                    if self.arc(before, token):
                        break
            last.append(token)
        out = []
        while at:
            token = last[at]
            out.append(token)
            at -= len(label[token])
        out.reverse()
        return out

    def word(self, word: str) -> tuple[int, str, bytes]:
        """Number of tokens, ids as text with a leading comma each, and the bytes that their arcs emit."""
        out = self.words.get(word) or self.older.get(word)
        if out is None:
            ids = self.run(word.encode())
            out = len(ids), "".join([self.listed[i] for i in ids]), b"".join([self.label[i] for i in ids])
        if len(word) <= 64:
            self.kept += 400 + 3 * len(word) + len(out[1])
            if self.kept > WORD_BYTES // 2:
                self.older, self.words, self.kept = self.words, {}, 0
            self.words[word] = out
        return out

    def pieces(self, text: str) -> list[tuple[int, str, bytes]]:
        get, word = self.words.get, self.word
        if self.cut is None or not any(t in text for t in self.special):
            return [get(piece) or word(piece) for piece in self.split.findall(text)]
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append((1, f",{self.special[part]}", part.encode()))
            else:
                out += [get(piece) or word(piece) for piece in self.split.findall(part)]
        return out

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, decimal ids joined by commas, decoded text."""
        found = self.pieces(text or "")
        ids = "".join([x[1] for x in found])[1:]
        return ids.count(",") + bool(ids), ids, b"".join([x[2] for x in found]).decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.label.get(i, b"") for i in ids).decode(errors="replace")


@kept_by_worker
def automaton(path: str) -> Automaton:
    """One automaton for each worker process, that of the last file."""
    return Automaton(path)


def encode(documents: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Adds n_tokens and, unless ``digest``, ids (array of int) and decoded; with it ids_sha256 and decoded_sha256 instead.

    ``path`` names the vocabulary file on every executor. Columns of these names are replaced.
    """
    extra = (
        [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        if digest
        else [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )
    rest = small_batches(documents).drop(*(f.name for f in extra))
    schema = T.StructType([*rest.schema.fields, *extra])

    def run(batches):
        from hashlib import sha256

        machine = automaton(path)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                found = [machine.encode(x) for x in part.column(part.schema.get_field_index("text")).to_pylist()]
                counts = pa.array([x[0] for x in found], pa.int64())
                if digest:
                    columns = [counts, *(pa.array([sha256(x[k].encode()).hexdigest() for x in found], pa.string()) for k in (1, 2))]
                else:
                    ids = pa.array([[int(i) for i in x[1].split(",")] if x[1] else [] for x in found], pa.list_(pa.int32()))
                    columns = [counts, ids, pa.array([x[2] for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[f.name for f in schema.fields])

    return rest.mapInArrow(returning(run, automaton), schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` from an array column of token ids (null: empty); ids outside the vocabulary emit nothing."""
    rest = small_batches(rows).drop("decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            texts = [machine.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return rest.mapInArrow(returning(run, automaton), schema)
