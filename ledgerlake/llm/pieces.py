r"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text gets a leading space, spaces become the marker U+2581, and the pieces (with their log scores) of a model file
segment it so that the sum of scores is largest; of equal sums the one whose last piece is longest is taken, position by
position. A character that no piece covers costs UNKNOWN below the least score and is written as its UTF-8 bytes. Decoding joins
pieces, turns markers into spaces and byte pieces into bytes, and drops the leading space; a literal U+2581 in a text
goes through byte pieces, so that every text survives the round trip.

No piece crosses from a non-space to a space or touches a line end (checked when the model is read; else whole texts
are segmented), so texts fall into words, and each distinct word of a batch is segmented once. All words of a batch
walk the trie and the Viterbi lattice together, in NumPy.

Cases: a null text is the empty one (a lone leading space); very long words take more steps, not more memory a step;
repeated rows and ties keep a row each; null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LITERAL = b"\xff"  # stands for a literal marker; no byte of UTF-8
UNKNOWN = 10.0
REMEMBERED = 150_000  # words that a Python worker remembers, tens of MB
WORDS_AT_ONCE = 50_000
SLICE_CHARS = 1 << 20  # characters of text that are looked at together


@dataclass
class Trie:
    """Double array: child of s by byte c is base[s] + c + 1 if check there is s; value is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(pieces: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                node = nxt
            ends[node] = number
        size = 2 * len(children) + 1024
        used, base, check, value = bytearray(size), [0] * size, [-1] * size, [-1] * size
        used[0], slot, free, tail = 1, {0: 0}, 257, 257  # from here on any free slot suits a lone child
        queue = [0]
        for node in queue:
            codes = sorted(children[node])
            here = slot[node]
            value[here] = ends.get(node, -1)
            if not codes:
                continue
            while used[free]:
                free += 1
            tail = max(tail, free)
            at, tries = (tail if len(codes) > 1 else free), 0  # forks look only past what earlier forks have crowded
            while used[at]:
                at += 1
            while True:
                b = at - codes[0] - 1
                if b >= 0 and not any(used[b + c + 1] for c in codes if b + c + 1 < size):
                    break
                at, tries = at + 1, tries + 1
                while at < size and used[at]:
                    at += 1
            if tries > 8:
                tail = at
            if b + 260 > size:
                more = size
                used, base, check, value = used + bytearray(more), base + [0] * more, check + [-1] * more, value + [-1] * more
                size += more
            base[here] = b
            for c in codes:
                used[b + c + 1], check[b + c + 1] = 1, here
                slot[children[node][c]] = b + c + 1
                queue.append(children[node][c])
        top = max(slot.values()) + 260
        pad = max(0, top - size)
        return Trie(np.array(base[:top] + [0] * pad, np.int32), np.array(check[:top] + [-1] * pad, np.int32), np.array(value[:top] + [-1] * pad, np.int32))


@dataclass
class Model:
    trie: Trie
    score: np.ndarray  # by piece
    byte_piece: np.ndarray  # by byte
    surface: list[bytes]  # by piece, as decoded
    by_word: bool  # no piece crosses a word's end
    unknown: float = field(init=False)
    flat_surface: tuple[np.ndarray, np.ndarray] = field(init=False)
    key: str = field(init=False)

    def __post_init__(self):
        own = self.score[self.trie.value[self.trie.value >= 0]]
        self.unknown = float(own.min(initial=0.0)) - UNKNOWN
        sizes = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        self.flat_surface = np.frombuffer(b"".join(self.surface), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        self.key = hashlib.sha256(b"".join([*self.surface, self.score.tobytes(), self.byte_piece.tobytes()])).hexdigest()


def build(pieces: list[tuple[str, float]], byte_pieces: list[int]) -> Model:
    """pieces: (piece, log score) by number, "" where a number is no ordinary piece; byte_pieces: the number for each byte."""
    keys = {p.encode(): i for i, (p, _) in reversed(list(enumerate(pieces))) if p}
    surface = [p.replace("▁", " ").encode() for p, _ in pieces]
    for b, i in enumerate(byte_pieces):
        surface[i] = bytes([b])
    crosses = re.compile("[^▁]▁|\n")
    return Model(Trie.of(keys), np.array([s for _, s in pieces], np.float64), np.array(byte_pieces, np.int32), surface, not any(crosses.search(p) for p, _ in pieces))


def load(path: str = MODEL) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
    return build([("" if special[i] else sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def segment(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of each word (spaces already markers): flat piece numbers and offsets by word."""
    trie = model.trie
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    code = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int32) + 1
    code[begin[1:] - 1] = 0  # between words; leads nowhere
    inside = code > 0
    raw = code - 1
    starts = np.flatnonzero(inside & ((raw & 0xC0) != 0x80))
    # all matches, from all positions at once
    edge_from, edge_to, edge_piece, found_one = [], [], [], np.zeros(len(code) + 1, bool)
    nxt_start = np.full(len(code) + 1, 0, np.int64)  # where the character at a start ends
    if len(starts):
        ends = np.append(starts[1:], len(code))
        word_end = begin[np.searchsorted(begin, starts, "right")] - 1
        nxt_start[starts] = np.minimum(ends, word_end)
    at, state, step = starts, np.zeros(len(starts), np.int32), 0
    while len(at):
        c = code[np.minimum(at + step, len(code) - 1)]
        child = trie.base[state] + c
        ok = (c > 0) & (trie.check[child] == state) & (child > 0)
        at, state = at[ok], child[ok]
        step += 1
        hit = trie.value[state] >= 0
        edge_from.append(at[hit])
        edge_to.append(at[hit] + step)
        edge_piece.append(trie.value[state[hit]])
        single = hit & (nxt_start[at] == at + step)
        found_one[at[single]] = True
    alone = starts[~found_one[starts]]
    e_from = np.concatenate([*edge_from, alone])
    e_to = np.concatenate([*edge_to, nxt_start[alone]])
    e_piece = np.concatenate([*edge_piece, np.full(len(alone), -1, np.int32)])
    e_score = np.where(e_piece >= 0, model.score[e_piece], model.unknown)
    # Viterbi, one offset in all words at a time; later assignments win, so shorter last pieces come first
    owner = np.searchsorted(begin, e_from, "right") - 1
    level = e_to - begin[owner]
    order = np.lexsort((-e_from, level))
    e_from, e_to, e_piece, e_score, level = e_from[order], e_to[order], e_piece[order], e_score[order], level[order]
    best, back = np.full(len(code) + 1, -np.inf), np.full(len(code) + 1, -1, np.int64)
    best[begin[:-1]] = 0
    cuts = np.flatnonzero(np.diff(level)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(level)), strict=True) if len(level) else ():
        got = best[e_from[a:b]] + e_score[a:b]
        np.maximum.at(best, e_to[a:b], got)
        won = np.flatnonzero((got == best[e_to[a:b]]) & (got > -np.inf)) + a
        back[e_to[won]] = won
    # back from all word ends at once
    word, pos = np.flatnonzero(sizes > 0), begin[1:][sizes > 0] - 1
    ids_word, ids_edge = [], []
    while len(word):
        e = back[pos]
        ids_word.append(word)
        ids_edge.append(e)
        pos = e_from[e]
        on = pos > begin[word]
        word, pos = word[on], pos[on]
    if not ids_word:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    w, e, turn = np.concatenate(ids_word), np.concatenate(ids_edge), np.repeat(np.arange(len(ids_word)), [len(x) for x in ids_word])
    order = np.lexsort((-turn, w))
    w, e = w[order], e[order]
    piece, width = e_piece[e], np.where(e_piece[e] >= 0, 1, e_to[e] - e_from[e])
    literal = (piece < 0) & (raw[e_from[e]] == 0xFF)
    width[literal] = len(MARK)
    first = np.cumsum(width) - width
    out = np.repeat(piece, width)
    for k in np.flatnonzero(piece < 0):
        text = np.frombuffer(MARK, np.uint8) if literal[k] else raw[e_from[e[k]] : e_to[e[k]]]
        out[first[k] : first[k] + width[k]] = model.byte_piece[text]
    return out.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(w, weights=width, minlength=len(words)).astype(np.int64))])


class Encoder:
    """Encodes texts, remembering the pieces of up to REMEMBERED words."""

    def __init__(self, model: Model):
        self.model, self.words = model, re.compile(r" *[^ \n]+|\n| +") if model.by_word else re.compile(r"(?s).+")
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        flats, offsets = [self.flat], [self.offset]
        for i in range(0, len(new), WORDS_AT_ONCE):
            some = [w.encode().replace(MARK, LITERAL).replace(b" ", MARK) for w in new[i : i + WORDS_AT_ONCE]]
            flat, offset = segment(some, self.model)
            offsets.append(offset[1:] + offsets[-1][-1])
            flats.append(flat)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat, self.offset = np.concatenate(flats), np.concatenate(offsets)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, one after another, and offsets by text."""
        words, sizes = [], []
        for t in texts:
            words += (found := self.words.findall(" " + t))
            sizes.append(len(found))
        if len(self.known) > REMEMBERED:
            self.reset()
        new = list(set(words).difference(self.known))
        if new:
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return _gathered(self.flat, self.offset, index, np.array(sizes, np.int64))


def _gathered(flat: np.ndarray, offset: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows index of a ragged array, flat, and the offsets of runs of so many rows each."""
    width = offset[index + 1] - offset[index]
    upto = np.concatenate([[0], np.cumsum(width)])
    out = flat[np.repeat(offset[index] - upto[:-1], width) + np.arange(upto[-1])]
    return out, upto[np.concatenate([[0], np.cumsum(sizes)])]


def decode_all(ids: np.ndarray, offset: np.ndarray, model: Model) -> list[bytes]:
    """UTF-8 of the texts whose pieces are ids[offset[i]:offset[i + 1]]."""
    out, cut = _gathered(*model.flat_surface, ids, np.diff(offset))
    return [out[a + 1 : b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]


def decode(ids: np.ndarray, model: Model) -> str:
    return b"".join(map(model.surface.__getitem__, ids.tolist()))[1:].decode()


def _sliced(column: pa.Array):
    """Runs of texts with a bounded number of characters (or one text), with their first row."""
    some, size, first = [], 0, 0
    for i, t in enumerate(column):
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size > SLICE_CHARS:
            yield first, some
            some, size, first = [], 0, i + 1
    if some:
        yield first, some


_encoders: dict[str, Encoder] = {}  # of this Python worker; a later task goes on with the words that earlier ones met


def _encode(batches, model: Model, with_ids: bool):
    if model.key not in _encoders:
        _encoders.clear()
        _encoders[model.key] = Encoder(model)
    encoder = _encoders[model.key]
    is_byte = np.isin(np.arange(len(model.surface)), model.byte_piece)
    for batch in batches:
        for first, texts in _sliced(batch.column(1)):
            ids, offset = encoder.encode(texts)
            parts = [ids[a:b] for a, b in zip(offset, offset[1:], strict=False)]
            back = decode_all(ids, offset, model)
            spent = np.concatenate([[0], np.cumsum(is_byte[ids])])
            arrays = [
                batch.column(0).slice(first, len(texts)), pa.array(np.diff(offset)), pa.array(spent[offset[1:]] - spent[offset[:-1]]),
                pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()), pa.array([a == b.encode() for a, b in zip(back, texts, strict=True)], pa.bool_()),
            ]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "text_sha256", "round_trip"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def encode(docs: DataFrame, model: Model | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, text) to doc_id, n_pieces, n_byte_pieces, ids_sha256, text_sha256 (of the decoded text), round_trip and ids."""
    model = model or load()
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, text_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, model, with_ids), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
