"""Token ids in files, compressed by a static range asymmetric numeral system.

Documents are range-partitioned and sorted by doc_id; each partition is a shard. A shard is a sequence of frames of
whole documents (FRAME_TOKENS ids or more each). A frame has one frequency table, shared by its blocks; a block is
BLOCK_TOKENS ids, dealt to LANES interleaved coder states that write one stream of 24-bit words. Blocks do not depend on
each other. Every CHECKPOINT steps a block records its states and its place in the stream, so that a decoder can start
there; the decoder here runs all checkpoint stretches of all blocks of a frame side by side. Each block carries the
CRC-32 of its ids, and decoding raises if it does not match.

Frames are rows of a Parquet table, so Spark's commit protocol covers lost and repeated tasks, and reading them back is
an ordinary scan. A frame's memory is bounded by FRAME_TOKENS plus the longest document.

Defined cases: null text counts as empty and gives the end id alone; rows that share a doc_id are written in the order
of their texts; a null doc_id is written first; an empty table writes a file without frames; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

#: Bits of a frequency table's total, lanes of a block, ids of a block, steps between checkpoints, ids of a frame.
PRECISION, LANES, BLOCK_TOKENS, CHECKPOINT, FRAME_TOKENS = 20, 32, 32_768, 512, 1 << 21
#: A state stays in LOW .. LOW * 2**24 and gives off words of 24 bits. So states are below 2**52: doubles hold them
#: exactly, and the floor of a state's quotient by a frequency is exact too, which integer division would take longer for.
LOW, WORD = float(1 << 28), float(1 << 24)
SCALE, ROOM = float(1 << PRECISION), LOW / (1 << PRECISION) * WORD
#: Chunks whose ids a worker remembers, in each of two generations; characters of the longest of them; characters of the
#: texts that are cut together.
REMEMBERED, LONGEST, SLICE = 500_000, 200, 1 << 22
FRAME_SCHEMA = (
    "shard int, frame int, doc_ids array<long>, lengths array<long>, n_tokens long, freq binary, "
    "blocks array<struct<n:int,words:int,crc:long,states:binary,places:binary>>, stream binary"
)


# ---- the coder ------------------------------------------------------------------------------------------------------


def frequency_table(ids: np.ndarray) -> np.ndarray:
    """Frequencies of ids 0 .. max that sum to 2**PRECISION; every id that occurs has at least 1."""
    counts = np.bincount(ids)
    total = 1 << PRECISION
    freq = np.where(counts > 0, np.maximum(1, counts * total // counts.sum()), 0)
    order = np.argsort(-freq, kind="stable")
    short = total - int(freq.sum())
    if short >= 0:
        freq[order[0]] += short
    for s in order:
        if short >= 0:
            break
        take = min(-short, int(freq[s]) - 1)
        freq[s] -= take
        short += take
    if freq.sum() != total:
        raise ValueError("more distinct ids than the table has room for")
    return freq.astype(np.float64)


def encode_blocks(ids: np.ndarray, freq: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids: (blocks, steps, LANES). Of each block: its words, its states at each checkpoint, and its places there."""
    blocks, steps, lanes = ids.shape
    cum = np.cumsum(freq) - freq
    state = np.full((blocks, lanes), LOW)
    stream = np.zeros((blocks, (steps + 1) * lanes), dtype=np.uint32)
    flat, begin = stream.reshape(-1), np.arange(blocks)[:, None] * stream.shape[1] - 1
    place = np.zeros(blocks, dtype=np.int64)
    states, places = [], []
    for t in range(steps - 1, -1, -1):
        now = ids[:, t]
        f = freq[now]
        full = state >= f * ROOM
        later = np.cumsum(full[:, ::-1], axis=1)[:, ::-1]  # lanes from here on that write, this one included
        writing = np.flatnonzero(full)
        if len(writing):
            kept = np.floor(state * (1 / WORD))
            flat[(begin + place[:, None] + later).reshape(-1)[writing]] = (state - kept * WORD).reshape(-1)[writing]
            place += later[:, 0]
            state = np.where(full, kept, state)
        quotient = np.floor(state / f)
        state = quotient * (SCALE - f) + state + cum[now]
        if t % CHECKPOINT == 0:
            states.append(state)
            places.append(place.copy())
    return [(stream[b, : place[b]], np.stack([s[b] for s in states[::-1]]), np.array([p[b] for p in places[::-1]])) for b in range(blocks)]


def decode_stretches(stream: np.ndarray, state: np.ndarray, place: np.ndarray, steps: int, freq: np.ndarray) -> np.ndarray:
    """Stretches of as many steps each, side by side. state: (stretches, LANES); place: past each one's next word."""
    cum = np.cumsum(freq) - freq
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    out = np.empty((state.shape[0], steps, state.shape[1]), dtype=np.uint32)
    place = place.astype(np.int64)
    for t in range(steps):
        quotient = np.floor(state * (1 / SCALE))
        slot = state - quotient * SCALE
        out[:, t] = ids = symbol[slot.astype(np.int32)]
        state = freq[ids] * quotient + slot - cum[ids]
        empty = state < LOW
        sofar = np.cumsum(empty, axis=1)
        reading = np.flatnonzero(empty)
        if len(reading):
            at = (place[:, None] - sofar).reshape(-1)[reading]
            state.reshape(-1)[reading] = state.reshape(-1)[reading] * WORD + stream[at]
            place = place - sofar[:, -1]
    return out


def _packed(words: np.ndarray) -> bytes:
    return words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    wide[:, :3] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
    return wide.view("<u4").reshape(-1)


def encode_frame(ids: np.ndarray) -> dict:
    """A frame's table, blocks and stream. ids: unsigned 32-bit, one at least."""
    freq = frequency_table(ids)
    full = len(ids) // BLOCK_TOKENS * BLOCK_TOKENS
    parts = [(ids[:full].reshape(-1, BLOCK_TOKENS // LANES, LANES), BLOCK_TOKENS)] if full else []
    if rest := len(ids) - full:
        padded = np.concatenate([ids[full:], np.full(-rest % LANES, ids[0], dtype=ids.dtype)])
        parts.append((padded.reshape(1, -1, LANES), rest))
    blocks, streams, first = [], [], 0
    for part, n in parts:
        for words, states, places in encode_blocks(part, freq):
            crc = zlib.crc32(ids[first : first + n].astype("<u4").tobytes())
            blocks.append({"n": n, "words": len(words), "crc": crc, "states": states.astype("<f8").tobytes(), "places": places.astype("<i8").tobytes()})
            streams.append(_packed(words))
            first += n
    return {"n_tokens": len(ids), "freq": zlib.compress(freq.astype("<u4").tobytes()), "blocks": blocks, "stream": b"".join(streams)}


def decode_frame(freq: bytes, blocks: list, stream: bytes) -> np.ndarray:
    """The frame's ids; raises ValueError if a block's checksum does not match."""
    table = np.frombuffer(zlib.decompress(freq), dtype="<u4").astype(np.float64)
    words = _unpacked(stream)
    stretches: dict[int, list] = {}
    begin = first = 0
    for b in blocks:
        steps = -(-b["n"] // LANES)
        states = np.frombuffer(b["states"], dtype="<f8").reshape(-1, LANES)
        places = np.frombuffer(b["places"], dtype="<i8") + begin
        for k, (state, place) in enumerate(zip(states, places, strict=True)):
            stretches.setdefault(min(CHECKPOINT, steps - k * CHECKPOINT), []).append((first + k * CHECKPOINT * LANES, state, place))
        begin += b["words"]
        first += b["n"]
    out = np.empty(first + LANES, dtype=np.uint32)
    last = blocks[-1]["n"] if blocks else 0
    for steps, found in sorted(stretches.items(), reverse=True):
        ids = decode_stretches(words, np.stack([s for _, s, _ in found]), np.array([p for _, _, p in found]), steps, table)
        for (at, _, _), got in zip(found, ids.reshape(len(found), -1), strict=True):
            out[at : at + len(got)] = got[: len(out) - at]
    first = 0
    for b in blocks:
        if zlib.crc32(out[first : first + b["n"]].astype("<u4").tobytes()) != b["crc"]:
            raise ValueError("a block's checksum does not match its ids")
        first += b["n"]
    return out[: first if last else 0]


# ---- texts to ids ---------------------------------------------------------------------------------------------------


def _pair_table(chars: Iterable[int]) -> np.ndarray:
    """True at each number of two bytes (256 * the one before + the last) with which one of these characters ends."""
    found = np.zeros(1 << 16, dtype=bool)
    for data in (chr(c).encode() for c in chars):
        found[np.arange(256) << 8 | data[0] if len(data) == 1 else data[-2] << 8 | data[-1]] = True
    return found


class ChunkEncoder:
    """Ids of texts by a byte-level BPE tokenizer of the tokenizers library, remembered by chunk.

    The pretokenizer never joins what stands on both sides of the start of a run of white space, nor a letter or digit and
    a sign after it, and never looks back. So a text may be cut there, and each chunk encoded once. Cuts are looked for in
    the bytes of many texts at a time, and Arrow tells which chunks are the same, so that Python sees distinct ones only.
    Texts are not cut for tokenizers of another kind, or whose added tokens hold a character that is cut at."""

    #: Cuts come before these: at the start of a run of white space, or after a letter or digit.
    BLANKS, SIGNS = " \n\t\r", ".,;:!?)"
    #: Where the text before ends with white space (or what may be: three bytes are told by the last two); with a letter or digit.
    WHITE = _pair_table(c for c in range(0x3001) if c < 32 or chr(c).isspace())
    WORD_END = _pair_table(c for c in (*range(0x80), *range(0xC0, 0x250), *range(0x400, 0x482)) if chr(c).isalnum())

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part; the library's threads would spin beside them
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.kind = np.zeros(256, dtype=np.uint8)
        if self.may_cut(json.loads(tokenizer_json)):
            self.kind[list(self.BLANKS.encode())], self.kind[list(self.SIGNS.encode())] = 1, 2
        # Blanks as the vocabulary writes them.
        blanks = tuple(self.tokenizer.encode(f"{c}a", add_special_tokens=False).tokens[0][0] for c in self.BLANKS)
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(blanks)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def may_cut(self, spec: dict) -> bool:
        added, pre = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
        split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        clear = not any(t.get("lstrip") or t.get("rstrip") or set(t["content"]) & set(self.BLANKS + self.SIGNS) for t in added)
        return bool(split and clear and not spec.get("normalizer"))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks. Those without white space but a blank in front are encoded in a row, a line feed before those without
        one: a token that begins with a blank begins a chunk there."""
        found: dict[str, bytes] = {}
        plain = [c for c in new if c.split() == [c[1:] if c[0] in self.BLANKS else c]] if self.kind.any() else []
        for i in range(0, len(plain), 1024):
            some = plain[i : i + 1024]
            bare = np.array([c[0] not in self.BLANKS for c in some])
            row = "".join([f"\n{c}" if b else c for c, b in zip(some, bare.tolist(), strict=True)])
            ids = np.array(self.tokenizer.encode_batch_fast([row], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some):
                ends, data = [*(starts[1:] * 4).tolist(), len(ids) * 4], ids.tobytes()
                found.update(zip(some, [data[a:b] for a, b in zip(((starts + bare) * 4).tolist(), ends, strict=True)], strict=True))
        rest = [c for c in new if c not in found] if len(found) < len(new) else []
        found.update(zip(rest, self.whole(rest), strict=True))
        return found

    def ids_of(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct chunks, remembered or new."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, distinct))
        missing = [c for c, x in zip(distinct, ids, strict=True) if x is None]
        if missing:
            kept = {c: x for c in missing if (x := self.older.get(c)) is not None}
            kept |= self.chunks([c for c in missing if c not in kept])
            ids = [kept[c] if x is None else x for c, x in zip(distinct, ids, strict=True)]
            self.known |= {c: x for c, x in kept.items() if len(c) <= LONGEST}
        return ids

    def cuts(self, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks begin in texts that stand one after the other, as bytes, and begin there."""
        cut = np.zeros(len(text), dtype=bool)
        cut[begins[begins < len(text)]] = True
        kind = self.kind[text]
        at = np.flatnonzero(kind)
        before = text.take(at - 2, mode="wrap").astype(np.uint16) << 8 | text.take(at - 1, mode="wrap")
        cut[at[np.where(kind[at] == 1, ~self.WHITE[before], self.WORD_END[before])]] = True
        return np.flatnonzero(cut)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        coded = [t.encode() for t in texts]
        data = b"".join(coded)
        bounds = np.cumsum([0, *map(len, coded)])
        starts = self.cuts(np.frombuffer(data, dtype=np.uint8), bounds[:-1])
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        chunks = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(data)).dictionary_encode()
        found, which = self.ids_of(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), chunks.indices.to_numpy()
        sizes = np.array([len(x) for x in found], dtype=np.int64) // 4
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        # Each chunk's ids are copied from where its first occurrence's stand.
        shift = (np.cumsum(sizes) - sizes)[which] - (ends - lengths)
        out = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes()
        places = (np.append(0, ends)[np.searchsorted(starts, bounds)] * 4).tolist()
        return [out[a:b] for a, b in zip(places, places[1:], strict=False)]


def slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about SLICE characters together, or one longer text at the end."""
    part = np.cumsum([len(t) for t in texts]) // SLICE
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return (slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if a < b)


_encoders: dict[int, ChunkEncoder] = {}


def encoder_of(tokenizer_json: str) -> ChunkEncoder:
    """This process's encoder: the next task finds it with what it remembers."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(tokenizer_json)
    return _encoders[key]


def write_token_files(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encode docs (doc_id, text) and write the frames, in ascending doc_id order, as the Parquet table at path."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer_json)  # a tokenizer's file: a fixed size
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shard, frame = encoder_of(sent.value), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list[int] = []

        def done() -> pd.DataFrame:
            row = encode_frame(np.frombuffer(b"".join(ids), dtype="<u4"))
            return pd.DataFrame([{"shard": shard, "frame": frame, "doc_ids": list(doc_ids), "lengths": [len(b) // 4 for b in ids], **row}])

        held = 0
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts):
                for doc_id, got in zip(batch["doc_id"].iloc[part], encoder(texts[part]), strict=True):
                    ids.append(got + end)
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    held += len(ids[-1]) // 4
                    if held >= FRAME_TOKENS:
                        yield done()
                        ids, doc_ids, held, frame = [], [], 0, frame + 1
        if ids:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInPandas(frames, FRAME_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit).

    With checksums, ids_crc32 takes the place of ids, so that the join that adds the starts moves a few bytes a row."""
    table = spark.read.schema(FRAME_SCHEMA).parquet(path)
    # A row per frame of two million ids: a few bytes for each 8 MB of tokens go through this window.
    before = F.sum("n_tokens").over(Window.orderBy("shard", "frame").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bases = table.select("shard", "frame", "n_tokens").select("shard", "frame", (before - F.col("n_tokens")).alias("base"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = decode_frame(row.freq, list(row.blocks), row.stream)
                ends = np.cumsum(np.asarray(row.lengths, dtype=np.int64))
                at = ends - np.asarray(row.lengths, dtype=np.int64)
                for i in range(0, len(at), 1000):
                    some = slice(i, i + 1000)
                    got = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[some], ends[some], strict=True)]
                    found = {"shard": row.shard, "frame": row.frame, "doc_id": pd.array(list(row.doc_ids)[some], dtype="Int64"), "within": at[some], "n_tokens": ends[some] - at[some]}
                    yield pd.DataFrame(found | ({"ids_crc32": [zlib.crc32(b) for b in got]} if checksums else {"ids": got}))

    last = "ids_crc32 long" if checksums else "ids binary"
    decoded = table.mapInPandas(documents, f"shard int, frame int, doc_id long, within long, n_tokens long, {last}")
    return decoded.join(bases, ["shard", "frame"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", last.split()[0])


def token_files(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Write docs' token files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "token_files")
    path = f"{scratch.root}/files"
    write_token_files(docs, tokenizer_json, path)
    return read_token_files(docs.sparkSession, path, checksums=True)
