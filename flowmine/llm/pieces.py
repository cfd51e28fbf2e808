"""A subword vocabulary with log-probabilities, and the lattice of pieces over a text.

The file is a public SentencePiece model whose scores are minus the rank of a
piece. Ranks become unigram log-probabilities by Zipf's law: the piece of rank r
weighs 1 / (r + 1), and weights are normalised over all pieces. Byte pieces and
runs of blanks weigh as much as the last rank.

A text is written with a blank before it and blanks shown as the mark U+2581.
No piece of the vocabulary holds a mark after another character, nor a line
feed, so the lattice of a text falls apart into *units*: blanks with the word
after them, or one line feed. Best paths, N-best paths and path sums of a text
follow from those of its units. A character without a piece of its own, and a
mark that stands in the text itself, is spelt in byte pieces, so every text can
be written and read back exactly.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A blank run with its word, or a line feed; on the text before blanks become marks.
UNIT = re.compile(r"\n| *[^ \n]+| +")


@dataclass
class Pieces:
    """log_p: by piece text; prefixes: every start of a piece, to end a search early."""

    texts: list[str]
    ids: dict[str, int]
    log_p: dict[str, float]
    byte_ids: list[int]
    byte_log_p: float
    end_log_p: float
    prefixes: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.prefixes = {t[:k] for t in self.log_p for k in range(1, len(t) + 1)}
        bad = [t for t in self.log_p if (MARK in t[1:] and t.strip(MARK)) or "\n" in t or " " in t]
        if bad:
            raise ValueError(f"pieces cross the bounds of units: {bad[:3]}")

    def bytes_of(self) -> list[bytes]:
        """UTF-8 bytes of each piece, blanks for marks, nothing for control pieces."""
        out = [t.replace(MARK, " ").encode() for t in self.texts]
        for value, i in enumerate(self.byte_ids):
            out[i] = bytes([value])
        known = set(self.ids.values()) | set(self.byte_ids)
        return [b if i in known else b"" for i, b in enumerate(out)]


def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    byte_ids = [i for i in range(n) if model.is_byte(i)]
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if len(byte_ids) != 256:
        raise ValueError(f"{path} has no byte pieces")
    ranks = {i: min(-model.get_score(i), float(n)) for i in normal}
    weights = {i: 1.0 / (r + 1.0) for i, r in ranks.items()}
    last = 1.0 / (n + 1.0)
    total = sum(weights.values()) + last * (len(byte_ids) + 1)       # one more for the end
    return Pieces(texts, {texts[i]: i for i in normal}, {texts[i]: math.log(w / total) for i, w in weights.items()},
                  byte_ids, math.log(last / total), math.log(last / total))


Edge = tuple[int, int, float, tuple[int, ...]]


def lattice(pieces: Pieces, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    """For each start in ``unit`` the edges (stop, log-probability, ids)."""
    shown = unit.replace(MARK, "\0").replace(" ", MARK)               # a mark of the text itself has no piece
    log_p, ids, prefixes, n = pieces.log_p, pieces.ids, pieces.prefixes, len(unit)
    out = []
    for i in range(n):
        edges, j = [], i + 1
        while j <= n:
            part = shown[i:j]
            if part not in prefixes:
                break
            score = log_p.get(part)
            if score is not None:
                edges.append((j, score, (ids[part],)))
            j += 1
        if not edges or edges[0][0] != i + 1:
            spelt = unit[i].encode("utf-8", "surrogatepass")
            edges.insert(0, (i + 1, len(spelt) * pieces.byte_log_p, tuple(pieces.byte_ids[b] for b in spelt)))
        out.append(edges)
    return out


def forward(edges) -> list[float]:
    """Viterbi: the best log-probability of reaching each position from the start."""
    best = [-math.inf] * (len(edges) + 1)
    best[0] = 0.0
    for i, row in enumerate(edges):
        b = best[i]
        for j, score, _ in row:
            if b + score > best[j]:
                best[j] = b + score
    return best


def nbest(edges, n: int, best: list[float] | None = None) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best paths, by A* from the end with the forward scores as exact estimate.

    A state is a position with the path from there to the end; its priority is
    the best score of reaching the position plus that of the path, which is the
    score of the best whole path through it. Paths therefore come out best
    first. Scores within 1e-7 count as tied, and ties go on with the path that
    was extended last, so that long periodic units stay cheap.
    """
    best = best or forward(edges)
    into: list[list] = [[] for _ in best]
    for i, row in enumerate(edges):
        for j, score, ids in row:
            into[j].append((i, score, ids))
    end = len(edges)
    heap = [(round(-best[end], 7), 0, (), end, 0.0)]
    out, age = [], 0
    while heap and len(out) < n:
        _, _, path, at, score = heapq.heappop(heap)
        if at == 0:
            flat: list[int] = []
            while path:
                ids, path = path
                flat.extend(ids)
            out.append((score, tuple(flat)))
            continue
        for i, s, ids in into[at]:
            age -= 1
            heapq.heappush(heap, (round(-(best[i] + s + score), 7), age, (ids, path), i, s + score))
    return out


def total_log_p(edges) -> float:
    """Log of the summed probability of all paths: forward recursion in log space."""
    reach = [-math.inf] * (len(edges) + 1)
    reach[0] = 0.0
    for i, row in enumerate(edges):
        a = reach[i]
        for j, score, _ in row:
            x, y = a + score, reach[j]
            if y == -math.inf:
                reach[j] = x
            elif x > y:
                reach[j] = x + math.log1p(math.exp(y - x))
            else:
                reach[j] = y + math.log1p(math.exp(x - y))
    return reach[-1]
