"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is cut into words, each a run of space marks and what follows it; no piece reaches
over such a border. The distinct words of a batch are searched by length: words of one
length advance together. At each position the hashes of the substrings that end there
probe the sorted hashes of the pieces, and the maximum over them stores a backpointer.

For a unigram model the maximum is of score sums, with the longer last piece first among equals.
A merge (BPE) model has ranks and no probabilities: there the trellis has steps
between compatible pieces only, those that merging the two pieces' text by rank leaves as they are. Of
all segmentations just one has only compatible neighbours, the one that merging the
whole word gives, so both kinds return the ids that the model itself defines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches, pieces

#: The mark that pieces have for a space, and a stand-in for that character in a text.
MARK = 0x2581
LITERAL_MARK = 0x110000
#: Below every piece's score, as SentencePiece has it for unknown characters.
UNKNOWN_PENALTY = 10.0
BASE = 0x9E3779B97F4A7C15
FILTER_BITS = 18
#: Longer words are searched in windows of equal length that overlap, all windows of a word together.
LONG_WORD = 64
WINDOW, OVERLAP = 512, 128
#: Words of one length that advance together at most.
TOGETHER = 1 << 14
BATCH_ROWS = 4096
BATCH_CHARS = 1 << 20
#: Characters of the words whose ids a task keeps for its next batches.
KNOWN_CHARS = 1 << 20


@dataclass
class PieceTable:
    """A vocabulary as arrays: bounded by its size, not by the input.

    Searchable pieces are numbered in the order of their hashes.
    """

    keys: np.ndarray  # sorted hashes
    ids: np.ndarray
    scores: np.ndarray
    points: np.ndarray  # code points, padded with zeros
    lengths: np.ndarray  # characters of every piece
    maybe: np.ndarray  # which leading bits of a hash occur
    max_length: int
    byte_ids: np.ndarray  # of every byte, or the unknown id 256 times
    has_bytes: bool
    unknown_score: float
    out: np.ndarray  # bytes of all pieces in a row
    out_start: np.ndarray
    merges: Merges | None  # None for a unigram model


@dataclass
class Merges:
    """How pieces of a merge model come about: rank, and both halves of the last merge."""

    rank: np.ndarray  # -1 for a single character
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray  # left * size + right of all pairs that merge, sorted
    pair_ranks: np.ndarray


def _mixed(points: np.ndarray) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 modulo 2^64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(BASE, -1, 1 << 64)


def load_pieces(path: str) -> PieceTable:
    """Read a SentencePiece model file; its path is the caller's."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kinds = proto.ModelProto.SentencePiece
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
    by_merges = model.trainer_spec.model_type == proto.TrainerSpec.BPE
    score_of, ids, out = {}, {}, []
    byte_ids = np.full(256, unknown, np.int32)
    for i, entry in enumerate(model.pieces):
        piece = entry.piece
        if entry.type == kinds.BYTE:
            byte_ids[int(piece[1:-1], 16)] = i
            out.append(bytes([int(piece[1:-1], 16)]))
        elif entry.type in (kinds.CONTROL, kinds.UNUSED):
            out.append(b"")
        elif entry.type == kinds.UNKNOWN:
            out.append(" ⁇ ".encode())
        else:
            if chr(MARK) in piece.lstrip(chr(MARK)):
                raise ValueError(f"piece {piece!r} reaches over a word border")
            score_of[piece], ids[piece] = entry.score, i
            out.append(piece.replace(chr(MARK), " ").encode())
    ranks = {p: r for r, p in enumerate(sorted(score_of, key=lambda p: (-score_of[p], ids[p])))}
    halves = {p: _last_merge(p, ranks) for p in score_of} if by_merges else {}
    words = [p for p in score_of if not by_merges or halves[p] is not None]
    longest = max(map(len, words))
    points = np.zeros((len(words), longest), np.uint32)
    for row, word in enumerate(words):
        points[row, : len(word)] = list(map(ord, word))
    factor = np.where(points > 0, _powers(BASE, longest)[None, :], np.uint64(0))
    keys = (_mixed(points) * factor).sum(axis=1, dtype=np.uint64)
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces have one hash")
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    words = [words[i] for i in order]
    return PieceTable(
        keys[order],
        np.array([ids[p] for p in words], np.int32),
        # With merges any piece is better than an unknown character; the borders decide the rest.
        np.zeros(len(words)) if by_merges else np.array([score_of[p] for p in words]),
        points[order],
        np.array([len(p) for p in words], np.int64),
        maybe,
        longest,
        byte_ids,
        bool((byte_ids != unknown).any()),
        -1.0 if by_merges else min(score_of.values()) - UNKNOWN_PENALTY,
        np.frombuffer(b"".join(out), np.uint8),
        np.r_[0, np.cumsum([len(x) for x in out])],
        _merge_table(words, ranks, halves) if by_merges else None,
    )


def _last_merge(piece: str, ranks: dict[str, int]) -> tuple[str, str] | None:
    """Both halves of the merge that completes a piece; None if merging never yields it."""
    parts = list(piece)
    last = (piece, "")
    while len(parts) > 1:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return None
        k = min(found)[1]
        last = (parts[k], parts[k + 1])
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return last


def _merge_table(words: list[str], ranks: dict[str, int], halves: dict[str, tuple[str, str]]) -> Merges:
    number = {p: i for i, p in enumerate(words)}
    single = np.array([len(p) == 1 for p in words])
    rank = np.where(single, -1, [ranks[p] for p in words])
    left = np.array([number[halves[p][0]] for p in words])
    right = np.array([i if len(p) == 1 else number[halves[p][1]] for i, p in enumerate(words)])
    pairs = sorted(
        (number[p[:k]] * len(words) + number[p[k:]], ranks[p])
        for p in words
        for k in range(1, len(p))
        if p[:k] in number and p[k:] in number
    )
    return Merges(rank, left, right, np.array([k for k, _ in pairs]), np.array([r for _, r in pairs]))


NEVER = np.iinfo(np.int64).max


def _compatible(first: np.ndarray, second: np.ndarray, merges: Merges) -> np.ndarray:
    """Whether merging the text of two adjacent pieces by rank gives just these two.

    Their own merges are undone from the latest on. If what then meets at the border merges
    before the undone step (or with it, on the left), the border would not have lasted.
    """
    ok = np.ones(len(first), bool)
    rows, a, b = np.arange(len(first)), first, second
    limit = np.full(len(first), NEVER)
    size = len(merges.rank)
    while len(rows):
        key = a * size + b
        place = np.minimum(np.searchsorted(merges.pair_keys, key), len(merges.pair_keys) - 1)
        bad = (merges.pair_keys[place] == key) & (merges.pair_ranks[place] < limit)
        ok[rows[bad]] = False
        rank_a, rank_b = merges.rank[a], merges.rank[b]
        go = ~bad & ((rank_a >= 0) | (rank_b >= 0))
        rows, a, b, rank_a, rank_b = rows[go], a[go], b[go], rank_a[go], rank_b[go]
        undo_a = rank_a > rank_b
        limit = np.where(undo_a, rank_a, rank_b + 1)
        a, b = np.where(undo_a, merges.right[a], a), np.where(undo_a, b, merges.left[b])
    return ok


class Borders:
    """Which pairs of pieces are compatible, with the answers of the latest pairs kept."""

    BITS = 20

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pair = np.full(1 << self.BITS, -1)
        self.answer = np.zeros(1 << self.BITS, bool)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first * len(self.merges.rank) + second
        slot = (key.astype(np.uint64) * np.uint64(BASE) >> np.uint64(64 - self.BITS)).astype(np.int64)
        ok = self.answer[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            ok[new] = _compatible(first[new], second[new], self.merges)
            self.pair[slot[new]] = key[new]
            # Of several new pairs of one slot only the one that got it leaves its answer.
            kept = new[self.pair[slot[new]] == key[new]]
            self.answer[slot[kept]] = ok[kept]
        return ok


class KnownWords:
    """Words already searched, with their ids, for the batches to come.

    A word is found by its hash and compared character by character, so the ids do not depend on what
    is kept. At most ``KNOWN_CHARS`` characters are: beyond them it begins anew with the latest words.
    """

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        none = np.empty(0, np.int64)
        self.keys = np.empty(0, np.uint64)  # sorted
        self.start, self.length, self.id_start, self.id_count = none, none, none, none
        self.points, self.ids = np.empty(0, np.uint32), np.empty(0, np.int32)

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        return place, self.keys[place] == keys

    def find(
        self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, length: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and their places here."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, hit = self._place(keys)
        rows = np.flatnonzero(hit & (self.length[place] == length))
        if not len(rows):
            return rows, rows
        place, size = place[rows], length[rows]
        same = points[_spread(start[rows], size)] == self.points[_spread(self.start[place], size)]
        same = np.logical_and.reduceat(same, np.cumsum(size) - size)
        return rows[same], place[same]

    def add(
        self,
        keys: np.ndarray,
        points: np.ndarray,
        start: np.ndarray,
        length: np.ndarray,
        ids: np.ndarray,
        id_start: np.ndarray,
        id_count: np.ndarray,
    ) -> None:
        """Keep words of different hashes; one whose hash another word has is left out."""
        if int(length.sum()) + len(self.points) > KNOWN_CHARS:
            self._clear()
        new = np.flatnonzero(np.cumsum(length) <= KNOWN_CHARS)
        if len(self.keys):
            new = new[~self._place(keys[new])[1]]
        size, number = length[new], id_count[new]
        merged = np.r_[self.keys, keys[new]]
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.start = np.r_[self.start, len(self.points) + np.cumsum(size) - size][order]
        self.length = np.r_[self.length, size][order]
        self.id_start = np.r_[self.id_start, len(self.ids) + np.cumsum(number) - number][order]
        self.id_count = np.r_[self.id_count, number][order]
        self.points = np.r_[self.points, points[_spread(start[new], size)]]
        self.ids = np.r_[self.ids, ids[_spread(id_start[new], number)]]


def _probe(table: PieceTable, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are those of pieces, and the places of these in the table."""
    rows = np.flatnonzero(table.maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    place = np.searchsorted(table.keys, hashes[rows])
    place[place == len(table.keys)] = 0
    hit = table.keys[place] == hashes[rows]
    return rows[hit], place[hit]


def _search(table: PieceTable, words: np.ndarray, borders: Borders | None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words of one length (a matrix of code points), and each word's number.

    A token is a piece's number, or minus the code point less one where no piece fits.
    """
    n, length = words.shape
    prefix = np.zeros((length + 1, n), np.uint64)
    np.cumsum(_mixed(words.T) * _powers(BASE, length)[:, None], axis=0, out=prefix[1:])
    inverse = _powers(_INVERSE, length)
    best = np.zeros((length + 1, n))
    width = np.ones((length + 1, n), np.int8)
    token = np.zeros((length + 1, n), np.int64)
    letters, spelt = words.ravel(), table.points.ravel()
    for end in range(1, length + 1):
        best[end] = best[end - 1] + table.unknown_score
        token[end] = -1 - words[:, end - 1].astype(np.int64)
        # All substrings that end here, the longest first, in one probe.
        low = max(0, end - table.max_length)
        found, place = _probe(table, ((prefix[end] - prefix[low:end]) * inverse[low:end, None]).ravel())
        start, rows = np.divmod(found, n)
        start += low
        size = end - start
        fits = np.flatnonzero(table.lengths[place] == size)
        rows, place, start, size = rows[fits], place[fits], start[fits], size[fits]
        if not len(rows):
            continue
        same = letters[_spread(rows * length + start, size)] == spelt[_spread(place * table.max_length, size)]
        exact = np.logical_and.reduceat(same, np.cumsum(size) - size)
        if borders is not None:
            before = token[start, rows]
            open_ = np.flatnonzero(exact & (start > 0) & (before >= 0))
            exact[open_] = borders(before[open_], place[open_])
        score = best[start, rows] + table.scores[place]
        # A piece for the single character always replaces the unknown one.
        kept = np.flatnonzero(exact & ((score > best[end, rows]) | (size == 1)))
        rows, place, size, score = rows[kept], place[kept], size[kept], score[kept]
        top = np.full(n, -np.inf)
        np.maximum.at(top, rows, score)
        # Among equals the longest is written last.
        won = np.flatnonzero(score == top[rows])[::-1]
        rows = rows[won]
        best[end, rows], width[end, rows], token[end, rows] = score[won], size[won], place[won]
    at = np.full(n, length)
    found, rows = [], np.arange(n)
    while len(rows):
        here = at[rows]
        found.append((rows, token[here, rows]))
        at[rows] = here - width[here, rows]
        rows = rows[at[rows] > 0]
    owner = np.concatenate([r for r, _ in found[::-1]])
    tokens = np.concatenate([t for _, t in found[::-1]])
    order = np.argsort(owner, kind="stable")
    return tokens[order], np.bincount(owner, minlength=n)


def _widths(table: PieceTable, tokens: np.ndarray) -> np.ndarray:
    """Characters of tokens."""
    known = np.maximum(tokens, 0)
    return np.where(tokens < 0, 1, (table.points[known] > 0).sum(axis=1))


def _search_long(table: PieceTable, word: np.ndarray, borders: Borders | None) -> np.ndarray:
    """Tokens of one long word.

    With a merge model, whether a sequence of pieces is the word's own shows in its neighbouring pairs. So the
    tokens of two windows go together wherever both have the same piece in their overlap. Where they
    have none, and for a model of scores, the word is searched character by character.
    """
    n, step = len(word), WINDOW - OVERLAP
    if borders is None or n <= WINDOW:
        return _search_steps(table, word, borders)
    starts = np.arange(0, n - WINDOW + 1, step)
    tokens, counts = _search(table, word[starts[:, None] + np.arange(WINDOW)], borders)
    found = np.split(tokens, np.cumsum(counts)[:-1])
    if starts[-1] + WINDOW < n:
        starts = np.append(starts, n - WINDOW)
        found.append(_search(table, word[None, n - WINDOW :], borders)[0])
    out = [np.empty(0, np.int64)]
    own, at = found[0], np.r_[0, np.cumsum(_widths(table, found[0]))]
    for start, other in zip(starts[1:], found[1:], strict=True):
        place = start + np.r_[0, np.cumsum(_widths(table, other))]
        both, i, j = np.intersect1d(at[:-1], place[:-1], assume_unique=True, return_indices=True)
        same = np.flatnonzero((own[i] == other[j]) & (own[i] >= 0))
        if not len(same):
            return _search_steps(table, word, borders)
        # Far from the ends of both windows, where neither lacks what stands around it.
        middle = same[len(same) // 2]
        out.append(own[: i[middle]])
        own, at = other[j[middle] :], place[j[middle] :]
    return np.concatenate([*out, own])


def _search_steps(table: PieceTable, word: np.ndarray, borders: Borders | None) -> np.ndarray:
    """Tokens of one word, character by character."""
    n = len(word)
    prefix = np.r_[np.uint64(0), np.cumsum(_mixed(word) * _powers(BASE, n))]
    inverse = _powers(_INVERSE, n)
    matches: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for size in range(min(n, table.max_length), 0, -1):
        starts, place = _probe(table, (prefix[size:] - prefix[:-size]) * inverse[: n - size + 1])
        for start, p in zip(starts.tolist(), place.tolist(), strict=True):
            if (table.points[p, :size] == word[start : start + size]).all() and not table.points[p, size:].any():
                matches[start + size].append((size, p))
    known: dict[tuple[int, int], bool] = {}

    def fits(a: int, b: int) -> bool:
        if borders is None or a < 0:
            return True
        if (a, b) not in known:
            known[a, b] = bool(borders(np.array([a]), np.array([b]))[0])
        return known[a, b]

    best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
    for end in range(1, n + 1):
        top, step = best[end - 1] + table.unknown_score, (1, -1 - int(word[end - 1]))
        for size, p in matches[end]:
            if end > size and not fits(back[end - size][1], p):
                continue
            score = best[end - size] + float(table.scores[p])
            if score > top or (size == 1 and step[1] < 0):
                top, step = score, (size, p)
        best[end], back[end] = top, step
    out = []
    while n:
        out.append(back[n][1])
        n -= back[n][0]
    return np.array(out[::-1], np.int64)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + counts[i]``, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _with_bytes(tokens: np.ndarray, counts: np.ndarray, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters as the ids of their UTF-8 bytes."""
    odd = np.flatnonzero(tokens < 0)
    tokens = np.where(tokens < 0, tokens, table.ids[np.maximum(tokens, 0)])
    point = -1 - tokens[odd].astype(np.int64)
    point[point == LITERAL_MARK] = MARK
    if not table.has_bytes:
        tokens[odd] = table.byte_ids[0]
        return tokens.astype(np.int32), counts
    size = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
    repeat = np.ones(len(tokens), np.int64)
    repeat[odd] = size
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.repeat(tokens, repeat)
    first = (np.cumsum(repeat) - repeat)[odd]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for k in range(4):
        some = size > k
        bits = point[some] >> (6 * (size[some] - 1 - k))
        byte = np.where(k == 0, lead[size[some]] | bits, 0x80 | (bits & 0x3F))
        out[first[some] + k] = table.byte_ids[byte]
    return out.astype(np.int32), np.bincount(owner, weights=repeat, minlength=len(counts)).astype(np.int64)


def encode_batch(
    texts: list[str], table: PieceTable, borders: Borders | None = None, known: KnownWords | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and ``n + 1`` offsets. ``borders`` and ``known`` may be kept between batches."""
    borders = borders or (Borders(table.merges) if table.merges else None)
    known = KnownWords() if known is None else known
    spaced = [" " + t if t else "" for t in texts]
    lengths = np.array([len(t) for t in spaced], np.int64)
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    literal = points == MARK
    points = np.where(points == 0x20, np.uint32(MARK), points)
    points[literal] = LITERAL_MARK
    text_start = np.cumsum(lengths) - lengths
    mark = points == MARK
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    begins[text_start[lengths > 0]] = True
    start = np.flatnonzero(begins)
    word_of_text = np.searchsorted(start, np.r_[text_start, len(points)])
    length = np.diff(np.r_[start, len(points)])
    prefix = np.r_[np.uint64(0), np.cumsum(_mixed(points) * _powers(BASE, len(points)))]
    key = (prefix[start + length] - prefix[start]) * _powers(_INVERSE, len(points))[start]
    key ^= length.astype(np.uint64) * np.uint64(BASE)
    del prefix, mark, begins, literal
    keys, first, which = np.unique(key, return_index=True, return_inverse=True)
    apart = (points == points[_spread(start[first[which]], length)]).all() and (length[first[which]] == length).all()
    if not apart:
        first = which = np.arange(len(start))  # two words of one hash: each word for itself
    start, length_of = start[first], length[first]
    counts, begin = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    todo = np.ones(len(first), bool)
    if apart:
        rows, place = known.find(keys, points, start, length_of)
        counts[rows], begin[rows], todo[rows] = known.id_count[place], known.id_start[place], False
    todo = np.flatnonzero(todo)
    flat = np.empty(0, np.int32)
    if len(todo):
        order = todo[np.argsort(length_of[todo], kind="stable")]
        flat, counts[order] = _with_bytes(*_search_words(table, points, start[order], length_of[order], borders), table)
        begin[order] = len(known.ids) + np.cumsum(counts[order]) - counts[order]
    found = np.r_[known.ids, flat]
    ids = found[_spread(begin[which], counts[which])]
    if apart:
        short = todo[length_of[todo] <= LONG_WORD]
        known.add(keys[short], points, start[short], length_of[short], found, begin[short], counts[short])
    return ids, np.r_[0, np.cumsum(counts[which])][word_of_text]


def _search_words(
    table: PieceTable, points: np.ndarray, start: np.ndarray, length: np.ndarray, borders: Borders | None
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words in the order of their lengths, and each word's number; words of one length together."""
    tokens, counts = [], []
    at = 0
    while at < len(start):
        size = int(length[at])
        if size > LONG_WORD:
            found = _search_long(table, points[start[at] : start[at] + size], borders)
            number, stop = np.array([len(found)]), at + 1
        else:
            stop = min(int(np.searchsorted(length, size, "right")), at + TOGETHER)
            found, number = _search(table, points[start[at:stop, None] + np.arange(size)], borders)
        tokens.append(found)
        counts.append(number)
        at = stop
    return np.concatenate(tokens), np.concatenate(counts)


def decode_batch(ids: np.ndarray, offsets: np.ndarray, table: PieceTable) -> list[str]:
    """Texts of id rows; bytes that are no UTF-8 become replacement characters."""
    size = table.out_start[ids + 1] - table.out_start[ids]
    data = table.out[_spread(table.out_start[ids], size)].tobytes()
    ends = np.r_[0, np.cumsum(size)][offsets].tolist()
    out = []
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        if data[start : start + 1] == b" ":
            start += 1
        out.append(data[start:end].decode("utf-8", "replace"))
    return out


def _rows(batches: Iterator[pa.Array], table: PieceTable) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each batch its parts: which texts are null, the ids of all, and offsets."""
    borders = Borders(table.merges) if table.merges else None
    known = KnownWords()
    for texts in batches:
        parts = []
        for start, stop in pieces(texts, BATCH_ROWS, BATCH_CHARS):
            part = texts[start:stop]
            found = encode_batch([t or "" for t in part.to_pylist()], table, borders, known)
            parts.append((part.is_null().to_numpy(zero_copy_only=False), *found))
        yield parts


def encode(text: Column, table: PieceTable) -> Column:
    """``array<int>`` of ids; null for a null text, empty for an empty one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for parts in _rows(batches, table):
            arrays = [
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=pa.array(nulls))
                for nulls, ids, offsets in parts
            ]
            yield pa.concat_arrays(arrays) if arrays else pa.array([], pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, table: PieceTable) -> Column:
    """The text of an id array; null for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            lists = rows.to_pylist()
            flat = np.array([i for row in lists if row for i in row], np.int64)
            offsets = np.r_[0, np.cumsum([len(row or ()) for row in lists], dtype=np.int64)]
            texts = decode_batch(flat, offsets, table)
            yield pa.array([None if row is None else t for row, t in zip(lists, texts, strict=True)], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def round_trip(text: Column, table: PieceTable) -> Column:
    """``struct<n_pieces, ids_sha256, decoded_sha256>``: encoded and decoded again."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for parts in _rows(batches, table):
            number, of_ids, of_text = [], [], []
            for _, ids, offsets in parts:
                number += np.diff(offsets).tolist()
                for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
                    of_ids.append(hashlib.sha256(ids[start:stop].astype("<i4").tobytes()).hexdigest())
                of_text += [hashlib.sha256(t.encode()).hexdigest() for t in decode_batch(ids, offsets, table)]
            yield pa.StructArray.from_arrays(
                [pa.array(number, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["n_pieces", "ids_sha256", "decoded_sha256"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_pieces long, ids_sha256 string, decoded_sha256 string")(text)


def with_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns, with ``piece_ids`` and ``n_pieces`` (0 for a null text)."""
    bound_batches(docs.sparkSession)
    found = docs.withColumn("piece_ids", encode(F.col(text_col), load_pieces(path)))
    return found.withColumn("n_pieces", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long"))
