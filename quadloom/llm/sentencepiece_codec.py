"""SentencePiece encoding and decoding with a unigram model.

Pieces come from a SentencePiece model file. Encoding writes each space as the marker U+2581, puts one marker in front, and
finds the segmentation with the largest sum of log scores (Viterbi over a double-array trie of the pieces' bytes).
A character that no piece covers costs UNKNOWN below the worst score and falls back to its byte pieces; so does a marker
character of the text itself, so that decoding gives back every text exactly.

The vocabulary files at hand were made by pair merging: their scores are merge ranks, not log probabilities. A file whose
scores are such ranks gets the log probabilities of Zipf's law over them; others keep their scores.

No piece goes on with a marker after another character; then a text may be cut before each run of markers, and each
chunk's best segmentation is part of the text's. Workers remember chunks. If a vocabulary breaks this, texts are not cut.

Defined cases: null and empty texts have no pieces; rows are treated one by one, so repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, SPACE = "▁", "▁".encode()
#: Stands for a marker character of the text itself while it is encoded: a byte that UTF-8 never has.
OWN = b"\xff"
RUNS = re.compile(b"(?:" + SPACE + b")+(?:(?!" + SPACE + b")[\x00-\xff])*")
#: What an uncovered character costs below the worst piece; chunks that a worker remembers; texts encoded together.
UNKNOWN, REMEMBERED, TOGETHER = 10.0, 500_000, 256
DEAD = -1
#: Places in the trie that are tried at once.
WINDOW = 1024


@dataclass
class DoubleArray:
    """A trie: child(s, byte) = base[s] + byte + 1 where check[that] == s; value[s] is the piece that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: dict[bytes, int]) -> DoubleArray:
        words = sorted(keys)
        size = 1 << 18
        base, check, value = [np.full(size, x, dtype=np.int32) for x in (0, DEAD, DEAD)]
        free, hint, check[0] = 1, 1, 0
        todo = [(0, 0, len(words), 0)]  # node, its words, their common length
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo]) == depth:
                value[node] = keys[words[lo]]
                lo += 1
            if lo == hi:
                continue
            starts = [i for i in range(lo, hi) if i == lo or words[i][depth] != words[i - 1][depth]]
            labels = np.array([words[i][depth] + 1 for i in starts])
            while check[free] != DEAD:
                free += 1
            single = len(labels) == 1 and free >= labels[0]
            at = max(0, (free if single else max(free, hint)) - int(labels[0]))
            while not single:
                if at + WINDOW + 300 > len(check):
                    base, check, value = [np.concatenate([a, np.full(len(a), x, dtype=np.int32)]) for a, x in ((base, 0), (check, DEAD), (value, DEAD))]
                fits = np.logical_and.reduce([check[at + x : at + x + WINDOW] == DEAD for x in labels])
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += WINDOW
                hint = at + int(labels[0])  # what lies before is nearly full
            base[node], check[at + labels] = at, node
            for i, end, label in zip(starts, [*starts[1:], hi], labels, strict=True):
                todo.append((at + int(label), i, end, depth + 1))
        end = int(np.flatnonzero(check != DEAD).max()) + 300
        return cls(base[:end], check[:end], value[:end])


@dataclass
class UnigramModel:
    trie: DoubleArray
    #: By piece id: what it decodes to (b"" for control pieces), its log score.
    pieces: list[bytes]
    scores: np.ndarray
    #: The id of the piece of each byte.
    byte_ids: np.ndarray
    longest: int
    unknown: float
    cuts: bool
    known: dict[bytes, bytes] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}


def load_model(path: str) -> UnigramModel:
    """The unigram model of a SentencePiece file; reads the pieces only."""
    from sentencepiece import SentencePieceProcessor

    file = SentencePieceProcessor(model_file=path)
    n = file.get_piece_size()
    plain = [i for i in range(n) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
    texts = {i: file.id_to_piece(i) for i in plain}
    scores = np.array([file.get_score(i) for i in range(n)], dtype=np.float64)
    ranks = scores[plain]
    if len(plain) and np.array_equal(ranks, np.round(ranks)) and ranks.min() < -1000:
        zipf = 1.0 / (1.0 - ranks)
        scores[plain] = np.log(zipf / zipf.sum())
    pieces, byte_ids = [b""] * n, np.full(256, DEAD, dtype=np.int64)
    for i in plain:
        pieces[i] = texts[i].encode()
    for i in range(n):
        if file.is_byte(i):
            byte = int(file.id_to_piece(i)[3:5], 16)
            pieces[i], byte_ids[byte] = bytes([byte]), i
    if (byte_ids == DEAD).any():
        raise ValueError("the vocabulary has no piece for some bytes")
    keys = {pieces[i]: i for i in plain}
    return UnigramModel(DoubleArray.of(keys), pieces, scores, byte_ids, max(map(len, keys)), float(scores[plain].min()) - UNKNOWN, all(MARK not in t.lstrip(MARK) for t in texts.values()))


def viterbi(model: UnigramModel, chunks: list[bytes]) -> list[list[int]]:
    """The piece ids of chunks of as many bytes each (UTF-8, spaces as markers, the text's own markers as OWN)."""
    text = np.frombuffer(b"".join(chunks), dtype=np.uint8).reshape(len(chunks), -1)
    count, length = text.shape
    trie, rows = model.trie, np.arange(count)
    best = np.full((count, length + 1), -np.inf)
    best[:, 0] = 0.0
    came = np.zeros((count, length + 1), dtype=np.int32)
    piece = np.full((count, length + 1), DEAD, dtype=np.int32)
    for i in range(length):
        live = rows[best[:, i] > -np.inf]
        if not len(live):
            continue
        lead = text[live, i]
        width = np.where(lead == OWN[0], 1, 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))
        for w in np.unique(width):
            end = min(length, i + int(w))
            at = live[width == w]
            better = best[at, i] + model.unknown > best[at, end]
            at = at[better]
            best[at, end], came[at, end], piece[at, end] = best[at, i] + model.unknown, i, DEAD
        node = np.zeros(len(live), dtype=np.int64)
        for j in range(i, min(length, i + model.longest)):
            child = trie.base[node] + text[live, j].astype(np.int64) + 1
            ok = trie.check[child] == node
            if not ok.any():
                break
            live, node = live[ok], child[ok]
            value = trie.value[node]
            ends = value >= 0
            if ends.any():
                at, ids = live[ends], value[ends]
                score = best[at, i] + model.scores[ids]
                better = score > best[at, j + 1]
                at, ids = at[better], ids[better]
                best[at, j + 1], came[at, j + 1], piece[at, j + 1] = score[better], i, ids
    out = []
    for chunk, back, ids in zip(chunks, came.tolist(), piece.tolist(), strict=True):
        path, end = [], length
        while end:
            start = back[end]
            if ids[end] == DEAD:
                char = SPACE if chunk[start:end] == OWN else chunk[start:end]
                path += model.byte_ids[list(char[::-1])].tolist()
            else:
                path.append(ids[end])
            end = start
        out.append(path[::-1])
    return out


def _chunks(model: UnigramModel, text: str) -> list[bytes]:
    if not text:
        return []
    marked = f" {text}".encode("utf-8", "surrogatepass").replace(SPACE, OWN).replace(b" ", SPACE)
    if not model.cuts:
        return [marked]
    if SPACE + SPACE in marked or marked.endswith(SPACE):
        return RUNS.findall(marked)
    return [SPACE + c for c in marked.split(SPACE)[1:]]


def encode(model: UnigramModel, texts: list[str]) -> list[np.ndarray]:
    """Piece ids of each text."""
    known = model.known
    if len(known) > REMEMBERED:
        known.clear()
    cut = [_chunks(model, t) for t in texts]
    by_length: dict[int, list[bytes]] = {}
    for c in {c for cs in cut for c in cs if c not in known}:
        by_length.setdefault(len(c), []).append(c)
    for length, chunks in by_length.items():
        step = max(1, 200_000 // (length + 1))
        for i in range(0, len(chunks), step):
            for c, ids in zip(chunks[i : i + step], viterbi(model, chunks[i : i + step]), strict=True):
                known[c] = np.array(ids, dtype="<i4").tobytes()
    return [np.frombuffer(b"".join([known[c] for c in cs]), dtype="<i4") for cs in cut]


def decode(model: UnigramModel, ids: np.ndarray) -> str:
    """The text of piece ids: markers of pieces become spaces, bytes of byte pieces stay, the first marker goes."""
    spaced = _spaced(model)
    return b"".join([spaced[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def _spaced(model: UnigramModel) -> list[bytes]:
    found = model.__dict__.get("spaced")
    if found is None:
        bytes_ = set(model.byte_ids.tolist())
        found = model.__dict__["spaced"] = [p if i in bytes_ else p.replace(SPACE, b" ") for i, p in enumerate(model.pieces)]
    return found


def _batches(docs: DataFrame, model: UnigramModel, row, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: a fixed size

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                part = batch.iloc[i : i + TOGETHER]
                texts = [t or "" for t in part["text"]]
                ids = encode(sent.value, texts)
                yield pd.DataFrame([row(sent.value, t, x) for t, x in zip(texts, ids, strict=True)]).assign(doc_id=part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(rows, schema)


def encoded(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """doc_id, ids, n_pieces of every row of docs."""
    return _batches(docs, model, lambda m, t, ids: {"ids": ids, "n_pieces": len(ids)}, "doc_id long, ids array<int>, n_pieces long")


def codec_report(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_crc32 (of the ids as little-endian 32-bit integers), and whether decoding gives back the text."""

    def row(m: UnigramModel, text: str, ids: np.ndarray) -> dict:
        fallback = np.isin(ids, m.byte_ids, kind="table") if len(ids) else ids
        return {"n_pieces": len(ids), "n_bytes": int(fallback.sum()), "ids_crc32": zlib.crc32(ids.tobytes()), "round_trip": decode(m, ids) == text}

    return _batches(docs, model, row, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
