"""Token counts with a linear longest-match automaton.

The pieces of a vocabulary form a trie.  Every node gets a failure link (the node
reached once the longest pieces inside the node's string are popped) and the
number of pieces popped on the way, both worked out beforehand.  A word is then
read byte by byte, once: where the trie has no child, the automaton adds the
popped count and follows the link.  The sum is the number of pieces that greedy
longest-match segmentation makes, without building a piece.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, each read with a leading
space, the word mark of the vocabulary.  A word that the vocabulary cannot cover
counts as one unknown piece.  Word counts are remembered per worker in a table
of bounded size.

Defined results: null and empty texts have 0 words and 0 tokens; repeated rows
are counted alike.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cadence.llm.common import WORD, with_text_columns

#: Words remembered by a worker before it starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """Letter -> byte in byte-level vocabularies: printable Latin-1 characters stand
    for their own byte, the other bytes for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file (JSON), special tokens left out."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file.get("added_tokens", [])}
    letters = byte_letters()
    return [bytes(letters[c] for c in piece) for piece in file["model"]["vocab"] if piece not in special]


@dataclass
class Automaton:
    """Trie edges as sorted keys (node * 256 + byte) with their children; for each
    node its failure link (-1: none) and the pieces popped on following it."""

    keys: np.ndarray
    children: np.ndarray
    link: np.ndarray
    popped: np.ndarray

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": None}

    def counter(self) -> WordCounts:
        if self._ready is None:
            self._ready = WordCounts(self)
        return self._ready


def build(pieces: list[bytes]) -> Automaton:
    edges: dict[int, int] = {}
    ends = [False]
    for piece in pieces:
        node = 0
        for b in piece:
            key = node << 8 | b
            node = edges.get(key, 0)
            if not node:
                node = edges[key] = len(ends)
                ends.append(False)
        ends[node] = ends[node] or bool(piece)
    link, popped = [-1] * len(ends), [0] * len(ends)
    by_node: dict[int, list[int]] = {}
    for key in edges:
        by_node.setdefault(key >> 8, []).append(key)
    queue = [0]
    for node in queue:  # breadth first: the parent's link is known
        for key in by_node.get(node, ()):
            child = edges[key]
            queue.append(child)
            if ends[child]:
                link[child], popped[child] = 0, 1
                continue
            at, count = link[node], popped[node]
            while at >= 0 and (at << 8 | key & 255) not in edges:
                count += popped[at]
                at = link[at]
            if at >= 0:
                link[child], popped[child] = edges[at << 8 | key & 255], count
    keys = np.array(sorted(edges), dtype=np.int64)
    return Automaton(keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int32),
                     np.array(link, dtype=np.int32), np.array(popped, dtype=np.int32))


class WordCounts(dict):
    """word -> its number of pieces, filled as words are met."""

    def __init__(self, a: Automaton) -> None:
        super().__init__()
        self.edges = dict(zip(a.keys.tolist(), a.children.tolist()))
        self.link, self.popped = a.link.tolist(), a.popped.tolist()

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.pieces(b" " + word.encode("utf-8", "surrogatepass"))
        self[word] = n
        return n

    def pieces(self, data: bytes) -> int:
        """Pieces of greedy longest match over ``data`` (1 if it cannot be covered)."""
        edges, link, popped = self.edges, self.link, self.popped
        node = count = 0
        for b in data:
            child = edges.get(node << 8 | b)
            while child is None:
                if link[node] < 0:
                    return 1
                count += popped[node]
                node = link[node]
                child = edges.get(node << 8 | b)
            node = child
        while node:
            if link[node] < 0:
                return 1
            count += popped[node]
            node = link[node]
        return count


def count_tokens(documents: DataFrame, vocabulary: str, text: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """``documents`` with n_words, n_tokens and longest_word (tokens of the word
    with the most).  The vocabulary is read on the driver; the automaton (some
    MB, as large as the vocabulary) goes to the tasks."""
    automaton = build(byte_pieces(vocabulary))

    def run(texts: list[str]):
        pieces = automaton.counter().__getitem__
        found = [list(map(pieces, WORD.findall(t))) for t in texts]
        return [[len(f) for f in found], [sum(f) for f in found], [max(f, default=0) for f in found]]

    return with_text_columns(documents, text, run, "n_words long, n_tokens long, longest_word long", keep)
