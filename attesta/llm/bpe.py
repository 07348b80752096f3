"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the segmentations
that BPE yields. It starts as one state with a loop for each base symbol. The gadget of merge ``k = (u, v)`` sends
every arc labelled ``u`` to a copy of its target that has no ``v`` arc, and puts an arc labelled ``uv`` beside every
``u`` arc whose target had one, leading where ``v`` leads. So where an arc leads depends on its label alone, a state is
the history of the arcs it lost, and copies share that history: the state behind token ``u`` is, by the right parts of
``u``, a chain of earlier states, and the arc ``c`` exists as long as the arcs of its left parts did. The automaton is
therefore compiled as differences: for each label its two parts and its birth, and for each lost arc the merge that took
it. Written out, its transition table would have billions of cells, so cells are written out as words need them and kept:
encoding looks transitions up in the table, and only a cell that no word has needed before is computed from the
differences. Arcs are read off a word by a second table, from node and symbol to node, of the labels that have arcs.

A word has one accepted segmentation. It is found by taking labels longest first along existing arcs, and positions
from which no path leads on are marked, so that work is linear in the word's length. Decoding emits the arc labels of
the ids, as the tokenizer file names no decoder: joined by single spaces.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; special tokens that
stand in a text are taken as such, as the library does; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import lean

#: Words kept with their ids by a worker, and cells of its transition table; when there are more, all are forgotten.
MEMO, CELLS = 150_000, 200_000
_NEVER = 1 << 60

# The pattern of the vocabulary file, with white space named as that file's regex engine knows it.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next free from U+0100."""
    free = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(free)) for b in range(256)]


class Automaton:
    """Tables of the compiled merges. ``end`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str, special: dict[str, int]):
        self._known, self.end, self.special = vocab, end, special
        size = max([*vocab.values(), *special.values()]) + 1
        self.size = size
        self.labels = [""] * size
        for label, i in [*vocab.items(), *special.items()]:
            self.labels[i] = label
        self.left, self.right, self.born, self.lost = array("i", [-1]) * size, array("i", [-1]) * size, array("q", [-1]) * size, {}
        made = {u + v for u, v in merges}
        if len(made) < len(merges):
            raise ValueError("two merges make the same label")
        self.vocab = {label: i for label, i in vocab.items() if label not in made}  # of labels with an arc
        for k, (u, v) in enumerate(merges):
            self._gadget(k, u, v)
        self._nodes: list[tuple[dict, int, int]] | None = None
        self._cells: dict[int, bool] = {}

    def __getstate__(self) -> dict:
        """Without the tables that each worker fills for itself."""
        return self.__dict__ | {"_nodes": None, "_cells": {}}

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"] or "", {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _gadget(self, k: int, u: str, v: str) -> None:
        """Merge k. Where no ``u`` arc is followed by a ``v`` arc, earlier merges always win and nothing is added."""
        a, b = self.vocab.get(u), self.vocab.get(v)
        if a is None or b is None or not self.arc(a, b):
            return
        self.vocab[u + v] = made = self._known[u + v]
        self.lost[a * self.size + b] = k
        self.left[made], self.right[made], self.born[made] = a, b, k

    def arc(self, state: int, label: int) -> bool:
        """Whether the state behind token ``state`` has an arc ``label``."""
        lost, size, left, right, born = self.lost, self.size, self.left, self.right, self.born
        y, held = state, _NEVER
        while y >= 0:
            x, stands = label, _NEVER
            while x >= 0:
                k = lost.get(y * size + x, _NEVER)
                if k < held and k <= stands and k < _NEVER:
                    return False
                stands, x = born[x], left[x]
            held, y = born[y], right[y]
        return True

    def step(self, state: int, label: int) -> bool:
        """The cell of the transition table: whether ``label`` leads on from ``state``. It leads to the state ``label``."""
        cell = state * self.size + label
        found = self._cells.get(cell)
        if found is None:
            if len(self._cells) >= CELLS:
                self._cells.clear()
            found = self._cells[cell] = self.arc(state, label)
        return found

    def nodes(self) -> list[tuple[dict, int, int]]:
        """A table of (next node by symbol, label that ends here within a word, label that ends here with the word)."""
        if self._nodes is None:
            after: list[dict[str, int]] = [{}]
            within, last = [-1], [-1]
            for label, i in self.vocab.items():
                ends = bool(self.end) and label.endswith(self.end)
                node = 0
                for c in label.removesuffix(self.end) if ends else label:
                    if c not in after[node]:
                        after[node][c] = len(after)
                        after.append({})
                        within.append(-1)
                        last.append(-1)
                    node = after[node][c]
                if ends or not self.end:
                    last[node] = i
                if not ends:
                    within[node] = i
            self._nodes = list(zip(after, within, last, strict=True))
        return self._nodes

    def arcs(self, symbols: str, at: int) -> list[tuple[int, int]]:
        """(stop, label) of the labels that stand at ``at``, the longest last."""
        nodes, n, out = self.nodes(), len(symbols), []
        after = nodes[0][0]
        while at < n:
            node = after.get(symbols[at])
            if node is None:
                break
            at += 1
            after, within, last = nodes[node]
            label = last if at == n else within
            if label >= 0:
                out.append((at, label))
        return out

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given in byte symbols."""
        at, n, out, path, dead = 0, len(symbols), [], [], set()
        options = self.arcs(symbols, 0)
        while at < n:
            while options:
                stop, label = options.pop()
                if stop not in dead and (not out or self.step(out[-1], label)):
                    path.append((at, options))
                    out.append(label)
                    at, options = stop, self.arcs(symbols, stop)
                    break
            else:
                if not out:
                    raise ValueError(f"no accepted segmentation: {symbols!r}")
                dead.add(at)
                out.pop()
                at, options = path.pop()
        return out


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        self.automaton, self.symbols = automaton, byte_symbols()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        symbols = word if word.isascii() and word.isalnum() else "".join([self.symbols[b] for b in word.encode()])
        self[word] = ids = array("I", self.automaton.word(symbols)).tobytes()
        return ids


class Codec:
    """``encode`` gives ids as little-endian unsigned 32-bit integers, ``decode`` takes them."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.memo = automaton, _Memo(automaton)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True))) + ")").split if automaton.special else lambda text: [text]

    def encode(self, text: str) -> bytes:
        ids = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                ids.append(array("I", [self.automaton.special[part]]).tobytes())
            elif part.isascii():
                ids += map(self.memo.__getitem__, _ASCII_WORDS.findall(part.lower()))
            else:
                # Letter by letter, so a final sigma is no exception.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                ids += map(self.memo.__getitem__, _WORDS.findall(part))
        return b"".join(ids)

    def forget(self) -> None:
        """Give back what was filled in, as the automaton outlives the task in its worker."""
        self.memo.clear()
        self.automaton._cells, self.automaton._nodes = {}, None

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.automaton.labels.__getitem__, array("I", ids)))


def _apply(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.load(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                columns = zip(*[row(codec, text or "") for text in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, types)], names)
        codec.forget()

    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names, types = ["doc_id", *(n for n, _ in fields)], [kinds[k] for _, k in fields]
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, {schema}")


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids."""

    def row(codec: Codec, text: str):
        ids = array("I", codec.encode(text))
        return len(ids), ids.tolist()

    return _apply(docs, path, id_col, text_col, "n_tokens bigint, ids array<int>", row)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the text decoded from them, in one pass."""

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        numbers = array("I", ids)
        return len(numbers), numbers.tolist(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    return _apply(docs, path, id_col, text_col, "n_tokens bigint, ids array<int>, decoded_sha256 string", row)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, from the rows of :func:`encode`; a null list of ids decodes to an empty text."""
    labels = encoded.sparkSession.sparkContext.broadcast(Automaton.load(path).labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(map(labels.value.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them, in one pass."""

    def row(codec: Codec, text: str):
        ids = codec.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    return _apply(docs, path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
