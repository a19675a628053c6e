"""The lattice of all ways to spell words with the pieces of a subword vocabulary.

A piece has a probability; a spelling of a word has the product of its pieces',
and the word the sum over all its spellings, which a forward recursion over the
word's bytes gives in log space.  Words of equal length are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

START = b" "  # stands before each word; vocabularies write it as U+2581
GROUP = 16_384  # words worked on together, at most
GROUP_CELLS = 1 << 20  # words times length, at most (one longer word makes its own group)
_automata: dict[int, "Automaton"] = {}


class Automaton:
    """The pieces as a tree of bytes: ``step[node, byte]`` is the next node (0: none), ``piece[node]`` the piece that ends there or -1."""

    def __init__(self, pieces: list[bytes]):
        nodes: list[dict[int, int]] = [{}, {}]  # node 1 is the root
        ends = {}
        for number, piece in enumerate(pieces):
            at = 1
            for byte in piece:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                at = nodes[at][byte]
            ends[at] = number
        self.step = np.zeros((len(nodes), 256), np.int32)
        for node, out in enumerate(nodes):
            for byte, to in out.items():
                self.step[node, byte] = to
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())


def automaton(pieces: list[bytes]) -> Automaton:
    """Built once per worker process and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(pieces)
    return _automata[key]


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model and first log probabilities from its scores.

    Scores of the file are minus the rank of a merge, so the probability is
    taken in proportion to 1 / (10 + rank).  Pieces with A-Z or an inner word
    start cannot occur and are left out; every byte is a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            weight.setdefault(bytes([int(model.id_to_piece(i)[1:-1], 16)]), 1e-5)
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if START in piece[1:] or any(65 <= b <= 90 for b in piece):
            continue
        weight[piece] = max(weight.get(piece, 0.0), 1 / (10 - model.get_score(i)))
    for byte in range(256):
        weight.setdefault(bytes([byte]), 1e-5)
    pieces = sorted(weight)
    total = np.array([weight[p] for p in pieces])
    return pieces, np.log(total / total.sum())


def _edges(words: np.ndarray, tool: Automaton) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces) of all pieces in words of one length, by start."""
    n, length = words.shape
    for start in range(length):
        rows, node = np.arange(n), np.ones(n, np.int32)
        for end in range(start + 1, length + 1):
            node = tool.step[node, words[rows, end - 1]]
            alive = np.flatnonzero(node)
            if not len(alive):
                break
            rows, node = rows[alive], node[alive]
            piece = tool.piece[node]
            found = np.flatnonzero(piece >= 0)
            if len(found):
                yield start, end, rows[found], piece[found]


def forward(words: np.ndarray, tool: Automaton, log_p: np.ndarray) -> np.ndarray:
    """Log probability of each word (a row of bytes, START first), over all spellings."""
    total = np.full((words.shape[1] + 1, words.shape[0]), -np.inf)
    total[0] = 0.0
    for start, end, rows, piece in _edges(words, tool):
        total[end, rows] = np.logaddexp(total[end, rows], total[start, rows] + log_p[piece])
    return total[-1]


def expected(words: np.ndarray, weights: np.ndarray, tool: Automaton, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each counted ``weights`` times."""
    n, length = words.shape
    ahead, behind = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
    ahead[0], behind[length] = 0.0, 0.0
    edges = list(_edges(words, tool))
    for start, end, rows, piece in edges:
        ahead[end, rows] = np.logaddexp(ahead[end, rows], ahead[start, rows] + log_p[piece])
    for start, end, rows, piece in reversed(edges):
        behind[start, rows] = np.logaddexp(behind[start, rows], behind[end, rows] + log_p[piece])
    counts = np.zeros(len(log_p))
    for start, end, rows, piece in edges:
        share = weights[rows] * np.exp(ahead[start, rows] + log_p[piece] + behind[end, rows] - ahead[length, rows])
        if len(rows) > 4096:
            counts += np.bincount(piece, share, len(log_p))
        else:
            np.add.at(counts, piece, share)
    return counts


def by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their bytes with START before them) in groups of one length."""
    length = ends - starts
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order])) + 1
    for same in np.split(order, edges):
        if not len(same):
            continue
        size = int(length[same[0]])
        step = max(1, min(GROUP, GROUP_CELLS // (size + 1)))
        for i in range(0, len(same), step):
            some = same[i:i + step]
            words = np.full((len(some), size + 1), START[0], np.uint8)
            words[:, 1:] = data[starts[some][:, None] + np.arange(size)]
            yield some, words
