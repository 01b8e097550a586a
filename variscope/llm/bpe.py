"""BPE encoding and decoding by a deterministic token automaton.

The automaton reads tokens: a path of arcs is the tokenization of its text, and no other path
spells the same text. It is compiled from the merges in order, one gadget each. At the
start one state has an arc for every symbol. The gadget of a merge (u, v):

* the state reached by u is split off, and loses the arc v: u and v never stand side by side again;
* every state that has the arc u gets the arc uv, which leads where v leads.

Where an arc leads depends on its label alone, so a state is the token last read. Arcs
lost are kept instead of arcs left. A token made by a merge hangs below its left part in a
tree whose children are ordered by age; a state that loses v at some time also lacks what was
built on v later, and that is one interval of the tree's preorder. A state is thus a
sorted table of intervals, and a transition is a binary search in it.

Encoding follows the arcs that spell a word. Each prefix has one tokenization at most, so a
position is visited once and the walk is linear. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from variscope.llm.common import map_column

#: Entries of a task's memory of chunks already encoded; it is emptied when full.
MEMORY = 100_000
#: White space between chunks that are encoded apart (ASCII; part of no token).
GAP = re.compile("[\t-\r ]+")
#: Texts of ASCII and the Latin letters from U+00C0 to U+00FF: composed, and lower-cased letter by letter.
LATIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The file's own pattern for such a text in lower case (fixed value).
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ÿ]+")


class _States(dict):
    """Borders of the lost arcs of each state; a state's table is laid out when it is first entered."""

    def __init__(self, borders_of) -> None:
        super().__init__()
        self.borders_of = borders_of

    def __missing__(self, token: int) -> array:
        borders = self[token] = self.borders_of(token)
        return borders


class TokenAutomaton:
    """Transitions over the tokens of one merge table."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.labels = {i: t for t, i in vocab.items()}
        made: dict[int, tuple[int, int, int]] = {}  # token: left, right, time
        children: dict[int, list[int]] = {}  # in order of time
        lost: dict[int, list[tuple[int, int]]] = {}  # token: (arc lost, time)
        at: dict[tuple[int, int], int] = {}
        dead: set[int] = set()

        def spine(token: int, side: int) -> list[tuple[int, int]]:
            """Tokens down one side with the time before which they count."""
            out, until = [], len(merges)
            while True:
                out.append((token, until))
                if token not in made:
                    return out
                until = made[token][2]
                token = made[token][side]

        def open_arc(u: int, v: int) -> bool:
            left = spine(v, 0)
            for a, until in spine(u, 1):
                for b, built in left:
                    t = at.get((a, b))
                    if t is not None and t < until and t <= built:
                        return False
            return True

        for time, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if u in dead or v in dead or not open_arc(u, v):
                dead.add(uv)
            at[u, v] = time
            lost.setdefault(u, []).append((v, time))
            made[uv] = (u, v, time)
            children.setdefault(u, []).append(uv)
        first, last = self._preorder(vocab, made, children)
        self.place = first

        def borders_of(token: int) -> array:
            spans = []
            for state, until in spine(token, 1):
                for arc, time in lost.get(state, ()):
                    if time < until:
                        spans.append((first[arc], first[arc] + 1))
                        young = children.get(arc, ())
                        k = bisect_left(young, time, key=lambda c: made[c][2])
                        if k < len(young):
                            spans.append((first[young[k]], last[arc]))
            return self._merged(spans)

        self.states = _States(borders_of)
        n = len(suffix)
        self.root: dict = {}  # a node: next nodes by symbol, its token at 0 inside a word and at 1 at the end
        for token, i in vocab.items():
            if i not in dead:
                node = self.root
                ends = token.endswith(suffix)
                for symbol in token[:-n] if ends else token:
                    node = node.setdefault(symbol, {})
                node[int(ends)] = i

    @staticmethod
    def _preorder(vocab, made, children) -> tuple[dict[int, int], dict[int, int]]:
        first, last, n = {}, {}, 0
        for root in vocab.values():
            if root in made:
                continue
            stack = [(root, iter(children.get(root, ())))]
            first[root] = n
            n += 1
            while stack:
                token, rest = stack[-1]
                child = next(rest, None)
                if child is None:
                    last[token] = n
                    stack.pop()
                else:
                    first[child] = n
                    n += 1
                    stack.append((child, iter(children.get(child, ()))))
        return first, last

    @staticmethod
    def _merged(spans: list[tuple[int, int]]) -> array:
        """Borders of the union of intervals: inside after an odd number of borders."""
        borders = array("i")
        for a, b in sorted(spans):
            if borders and a <= borders[-1]:
                borders[-1] = max(borders[-1], b)
            else:
                borders.extend((a, b))
        return borders

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word.

        From each position the longest arc is tried first. A position is reached by one
        path only, so one that leads nowhere is closed for good.
        """
        root, states, place, n = self.root, self.states, self.place, len(word)
        out: list[int] = []
        path: list[tuple] = []
        closed: set[int] = set()
        i, borders, arcs = 0, (), None
        while i < n:
            if arcs is None:
                arcs, node = [], root
                for j in range(i, n):
                    node = node.get(word[j])
                    if node is None:
                        break
                    token = node.get(j + 1 == n)
                    if token is not None:
                        arcs.append((j + 1, token))
            while arcs:
                j, token = arcs.pop()
                if j not in closed and not bisect_right(borders, place[token]) & 1:
                    path.append((i, borders, arcs))
                    out.append(token)
                    i, borders, arcs = j, states[token], None
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a symbol of the word")
                closed.add(i)
                i, borders, arcs = path.pop()
                out.pop()
        return out


class Memory(dict):
    """Packed ids by text, kept in two generations: what was not asked for again goes first."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(text)
        if ids is None:
            ids = array("i", self.encode(text)).tobytes()
        self[text] = ids
        return ids


class Packer:
    """Packed ids of whole texts, by words where a text is Latin and by chunks elsewhere.

    ``word`` encodes a lower-case pre-split word, ``chunk`` a text without ASCII white space, across which
    no normalization and no word reaches.
    """

    def __init__(self, word, chunk, special: list[str]) -> None:
        self.words, self.chunks, self.special = Memory(word), Memory(chunk), special

    def __call__(self, text: str) -> bytes:
        if LATIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, filter(None, GAP.split(text))))


class Encoder:
    """The automaton of a tokenizer file with that file's normalizer, pre-tokenizer and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.presplit = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.pack = Packer(self.word, self.chunk, list(self.special))

    def word(self, word: str) -> list[int]:
        """Tokens of a lower-case word; its symbols are its characters in ASCII, else its bytes'."""
        if word.isascii():
            return self.automaton.encode(word)
        return [i for w, _ in self.presplit(word) for i in self.automaton.encode(w)]

    def chunk(self, chunk: str) -> list[int]:
        """Tokens of a text without ASCII white space."""
        out: list[int] = []
        for piece in self.split.split(chunk) if self.split else [chunk]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                for word, _ in self.presplit(self.normalize(piece)):
                    out.extend(self.automaton.encode(word))
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The compiled automaton of a file, once for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def arc_labels(path: str) -> dict[int, str]:
    """What the arc of each token emits, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def encode_bpe(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text (array<int>); null counts as empty.

    ``path`` names a tokenizer file that every worker can read.
    """

    def make():
        pack = encoder_of(path).pack

        def work(texts):
            packed = [pack(t or "") for t in texts]
            offsets = np.cumsum([0, *map(len, packed)]) // 4
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            return {ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}

        return work

    return map_column(df, text, make, pa.schema([(ids, pa.list_(pa.int32()))]))


def decode_bpe(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the labels of the arcs in ``ids``, joined by one space; null ids give an empty text.

    Needs the labels of the automaton only, not its tables.
    """

    def make():
        by_id = arc_labels(path)
        labels = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())

        def work(rows: pa.ListArray):
            whole = pc.fill_null(rows, [])
            emitted = pa.ListArray.from_arrays(pc.subtract(whole.offsets, whole.offsets[0]), labels.take(whole.flatten()))
            return {decoded: pc.binary_join(emitted, " ")}

        return work

    return map_column(df, ids, make, pa.schema([(decoded, pa.string())]), as_arrow=True)
