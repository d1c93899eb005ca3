import dataclasses

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import sentencepiece_codec as C


@pytest.fixture(scope="module")
def model():
    return C.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def best_score(m, text):
    plain = {p: i for i, p in enumerate(m.pieces) if p and i not in set(m.byte_ids.tolist())}
    b = f" {text}".encode().replace(C.SPACE, C.OWN).replace(b" ", C.SPACE)
    best = [0.0] + [-1e300] * len(b)
    for i in range(len(b)):
        if best[i] < -1e299:
            continue
        w = 1
        while i + w < len(b) and 0x80 <= b[i + w] < 0xC0:
            w += 1
        best[i + w] = max(best[i + w], best[i] + m.unknown)
        for j in range(i + 1, min(len(b), i + m.longest) + 1):
            if (v := plain.get(b[i:j])) is not None:
                best[j] = max(best[j], best[i] + m.scores[v])
    return best[-1]


def score(m, ids):
    total, i, ids, of_bytes = 0.0, 0, ids.tolist(), set(m.byte_ids.tolist())
    while i < len(ids):
        if ids[i] in of_bytes:
            lead = m.pieces[ids[i]][0]
            total, i = total + m.unknown, i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        else:
            total, i = total + m.scores[ids[i]], i + 1
    return total


TEXTS = ["", "Hello world", "  two  spaces\n\tand ▁own▁ marks ▁▁ 日本語 🎉\x00 end  ", " ", "▁", "a" * 3000, "née Ωμέγα — ok", "x  y   z \n\n", "tail ", "\xad​"]


def test_best_and_back(model):
    for text, ids in zip(TEXTS, C.encode(model, TEXTS), strict=True):
        assert C.decode(model, ids) == text
        if text:
            assert score(model, ids) == pytest.approx(best_score(model, text))


def test_uncut_is_the_same(model):
    whole = dataclasses.replace(model, cuts=False, known={})
    for text in TEXTS[1:5]:
        assert C.encode(whole, [text])[0].tolist() == C.encode(model, [text])[0].tolist()


def test_random_texts(model):
    @settings(max_examples=80, deadline=None)
    @given(st.text(alphabet="abcde ▁é日\n🎉THE", max_size=40))
    def run(text):
        (ids,) = C.encode(model, [text])
        assert C.decode(model, ids) == text
        if text:
            assert score(model, ids) == pytest.approx(best_score(model, text))

    run()


def test_trie(model):
    trie = C.DoubleArray.of({b"a": 1, b"ab": 2, b"b\xff": 3, b"abcd": 4})

    def find(key):
        node = 0
        for byte in key:
            child = trie.base[node] + byte + 1
            if trie.check[child] != node:
                return None
            node = child
        return trie.value[node]

    assert [find(k) for k in (b"a", b"ab", b"abc", b"abcd", b"b", b"b\xff", b"c")] == [1, 2, -1, 4, -1, 3, None]


def test_query(model, odd, small, none):
    for docs in (odd, small):
        rows = C.codec_report(docs, model).collect()
        assert len(rows) == docs.count()
        assert all(r["round_trip"] for r in rows)
    got = C.encoded(odd, model).collect()
    assert {r["doc_id"]: len(r["ids"]) for r in got}[0] == 0
    assert all(len(r["ids"]) == r["n_pieces"] for r in got)
    assert C.codec_report(none, model).count() == 0
