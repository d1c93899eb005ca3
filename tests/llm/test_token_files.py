import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadloom.llm import token_files as F

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a\n b", "a \nb", "a \n b", "a ", "a  ", " a", "\n", "\n \n x", "a\xa0 b", "x <|endoftext|> y", "tab\t here \t", "日本 語 🎉 é", "it's we're don't ", "foo\n bar\n \nbaz", "a　 b 　 c"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def chunked():
    with open(PATH, encoding="utf-8") as f:
        return F.ChunkEncoder(f.read())


def ids_of(plain, text):
    return np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


def test_chunks_are_whole_texts(plain, chunked):
    assert chunked(ODD) == [ids_of(plain, t).tobytes() for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n\t \xa0é'1　", max_size=30), min_size=1, max_size=5))
def test_chunks_property(texts):
    if not hasattr(test_chunks_property, "pair"):
        with open(PATH, encoding="utf-8") as f:
            test_chunks_property.pair = Tokenizer.from_file(PATH), F.ChunkEncoder(f.read())
    plain, chunked = test_chunks_property.pair
    assert chunked(texts) == [ids_of(plain, t).tobytes() for t in texts]


def test_chunks_part_at_signs_and_lines(plain):
    """Each new chunk costs a call into the tokenizer: words are not new for the sign or the line that follows."""
    with open(PATH, encoding="utf-8") as f:
        encoder = F.ChunkEncoder(f.read())
    new, chunks = [], encoder.chunks
    encoder.chunks = lambda some: new.extend(some) or chunks(some)
    words = ["alpha", "bêta", "gammá", "дельта", "x9"]
    texts = [f"to {a}{sign} to" for a in words for sign in ".,;:!?)"] + [f"to {a}\n{b} to" for a in words for b in words]
    assert encoder(texts) == [ids_of(plain, t).tobytes() for t in texts]
    assert sorted(new) == sorted(["to", " to", *".,;:!?)", *(f" {w}" for w in words), *(f"\n{w}" for w in words)])


BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab9.,;:!?)('<|-" + BLANK + "  \n\n\t\r\u180e\u200béÀ×÷ªͅд҂҃語䠀倀…”«\x1c\x00", max_size=25), min_size=1, max_size=5))
def test_cuts_property(texts):
    if not hasattr(test_cuts_property, "pair"):
        with open(PATH, encoding="utf-8") as f:
            test_cuts_property.pair = Tokenizer.from_file(PATH), F.ChunkEncoder(f.read())
    plain, chunked = test_cuts_property.pair
    assert chunked(texts) == [ids_of(plain, t).tobytes() for t in texts]


def test_slices_and_long_chunks(plain, monkeypatch):
    monkeypatch.setattr(F, "SLICE", 50)
    texts = ["", "ab " * 5, "", "x" * 500, "y, z" * 30, "", "<|endoftext|>. a"]
    parts = [texts[p] for p in F.slices(texts)]
    assert sum(parts, []) == texts and len(parts) > 2 and list(F.slices([])) == []
    with open(PATH, encoding="utf-8") as f:
        encoder = F.ChunkEncoder(f.read())
    assert [x for p in parts for x in encoder(p)] == [ids_of(plain, t).tobytes() for t in texts]
    assert encoder(["", ""]) == [b"", b""] and encoder([]) == []
    assert max(map(len, encoder.known)) <= F.LONGEST < 500


@pytest.mark.parametrize("change", ["prefix", "added", "strip", "normalizer"])
def test_other_tokenizers_are_not_cut(change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    if change == "prefix":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "normalizer":
        spec["normalizer"] = {"type": "Replace", "pattern": {"String": "b, "}, "content": "bb"}
    else:
        spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "b, c" if change == "added" else "<x>", "rstrip": change == "strip"})
    data = json.dumps(spec)
    texts = ["a b, c d", "a\nb", "e<x>  f", ""]
    other = Tokenizer.from_str(data)
    assert F.ChunkEncoder(data)(texts) == [ids_of(other, t).tobytes() for t in texts]


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1000, F.BLOCK_TOKENS - 1, F.BLOCK_TOKENS, F.BLOCK_TOKENS + 1, 3 * F.BLOCK_TOKENS + 777])
@pytest.mark.parametrize("skew", [0, 1.3, "one"])
def test_round_trip(n, skew):
    rng = np.random.default_rng(n)
    ids = np.zeros(n, dtype=np.uint32) if skew == "one" else (rng.integers(0, 50_257, n) if not skew else np.minimum(rng.zipf(skew, n), 50_256)).astype(np.uint32)
    frame = F.encode_frame(ids)
    assert (F.decode_frame(frame["freq"], frame["blocks"], frame["stream"]) == ids).all()


def test_checksum():
    frame = F.encode_frame(np.arange(5000, dtype=np.uint32))
    broken = bytearray(frame["stream"])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        F.decode_frame(frame["freq"], frame["blocks"], bytes(broken))


def brute(plain, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(ids_of(plain, text or ""), [0]).astype("<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files(odd, small, none, plain):
    with open(PATH, encoding="utf-8") as f:
        tokenizer = f.read()
    for docs in (odd, small):
        got = sorted(map(tuple, F.token_files(docs, tokenizer).collect()), key=lambda r: r[1])
        assert got == brute(plain, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert F.token_files(none, tokenizer).count() == 0


def test_ids_come_back(spark, small, plain, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        F.write_token_files(small.limit(20), f.read(), f"file://{tmp_path}/t", shards=3)
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in F.read_token_files(spark, f"file://{tmp_path}/t").collect():
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == [*ids_of(plain, texts[r["doc_id"]]).tolist(), 0]
