import io
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadspeed.llm import pretokens as P
from roadspeed.llm import token_counts as C
from roadspeed.llm import token_files as T

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIB = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENCODERS = {p: P.CachedEncoder(p, list, limit=50) for p in (WORD, BYTE)}
ODD = "aB éÉßŸǅıİſ'st llm've 19²½ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  .,!$_-世ñ̃ <|endoftext|> <|startoftext|>"
TEXT = st.text(alphabet=st.sampled_from(ODD), max_size=50) | st.text(max_size=30) | st.lists(
    st.sampled_from(["the", " ", "  ", "'s", "I'LL", "\n\n", "<|endoftext|>", "12", "é", "!?", "\t", "x_y"]), max_size=12).map("".join)


def own(path, text):
    return [i for lists in ENCODERS[path].values([text]) for values in lists for ids in values for i in ids]


@pytest.mark.parametrize("path", [WORD, BYTE])
@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_ids_are_the_library_s(path, text):
    assert own(path, text) == LIB[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_split_character_alone_and_between_words(path):
    for c in map(chr, range(0x250)):
        if P._UNSAFE.search(c) is None:
            assert unicodedata.normalize("NFC", c) == c
            text = f"a{c}b {c}{c} 1{c}.{c}"
            assert own(path, text) == LIB[path].encode(text, add_special_tokens=False).ids, hex(ord(c))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_texts_are_cut_without_effect(path, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "12", "'s", ". "]) for _ in range(30000))
    assert "".join(P.pieces(text, 500)) == text and len(list(P.pieces(text, 500))) > 10
    whole = LIB[path].encode(text, add_special_tokens=False).ids
    assert own(path, text) == whole
    enc = P.CachedEncoder(path, list, limit=20)
    monkeypatch.setattr(P, "GROUP", 300)
    monkeypatch.setattr(P.pieces, "__defaults__", (200,))
    texts = [text, "a b", "", "世 x", "c d" * 90, text[:250], text[:290]]
    got = [[i for values in lists for ids in values for i in ids] for lists in enc.values(texts)]
    assert got == [LIB[path].encode(t, add_special_tokens=False).ids for t in texts]


TEXTS = [None, "", "The cat's 12 hats.", "ÉTÉ été  \n\n x", "<|endoftext|> in text", "世界 mixed", "long " * 40000, "the the the",
         "The cat's 12 hats."]


def test_new_words_are_encoded_many_in_one_text(monkeypatch):
    monkeypatch.setattr(P, "JOINED", 5)
    rng, calls = random.Random(5), []
    words = ["".join(rng.choice("aeésßtŁnX") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    text = "".join(f"{rng.choice([' ', ' ', '  ', chr(10), '. ', ' 1'])}{w}{rng.choice(['', '', chr(39) + 's', '7', '!'])}" for w in words)
    want = LIB[BYTE].encode(text, add_special_tokens=False).ids

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return self.library.encode_batch_fast(texts, **how)
    for broken in (False, True):
        encoder = P.CachedEncoder(BYTE, list, limit=50)
        new = len({t for t in encoder.splitter.tokens(text) if t[0] == " " and t[1:2].isalpha()})
        encoder.library = Counted(encoder.library)
        if broken:  # words that cannot be told apart are encoded one by one
            encoder.bytes = encoder.bytes + 1
        assert [i for lists in encoder.values([text]) for values in lists for ids in values for i in ids] == want
        assert calls[0] == -(-new // 5) and (calls[1] >= new) == broken
        calls.clear()


@pytest.mark.parametrize("table", [None, {}, {"the": 1}])
def test_counts_match_the_library(docs, table):
    rows = list(enumerate(TEXTS)) + [(2, TEXTS[2])]
    df = docs(rows).selectExpr("*", "1 as n_tokens", "2 as id")
    got = sorted(tuple(r) for r in C.token_counts(df, WORD, table=table).collect())
    want = sorted((i, len((t or "").encode()), n, n > 2048) for i, t in rows
                  for n in [len(LIB[WORD].encode(t or "", add_special_tokens=False).ids)])
    assert got == want
    assert C.token_counts(docs([]), WORD).collect() == []


def test_frequent_table_is_exact_and_bounded(docs):
    rows = [(i, "hot " * 50 + f"rare{i} warm") for i in range(40)]
    got = C.frequent_lengths(docs(rows, 4), WORD, size=3, width=5)
    assert set(got) <= {"hot", "warm", "rare"} and got["hot"] == 1 and len(got) <= 3
    many = Counter({f"t{i}": 1 for i in range(100)} | {"big": 90})
    assert C.shrink(many, 5) == Counter({"big": 89})


def write(rows, **how):
    sink = io.BytesIO()
    w = T.Writer(sink, **how)
    for doc_id, ids in rows:
        w.begin(doc_id)
        w.add(np.array(ids, f"<u{how.get('width', 2)}").tobytes())
    w.close()
    return sink.getvalue()


ROWS = [(None, [5]), (1, []), (1, [1, 2, 3]), (7, list(range(5000))), (9, [65535])]


@pytest.mark.parametrize("width,frame", [(2, 64), (4, 64), (2, 1 << 18), (2, 2)])
def test_file_round_trip(width, frame):
    data = write(ROWS if frame > 2 else ROWS[:3], width=width, frame_bytes=frame)
    r = T.Reader(io.BytesIO(data), len(data))
    assert [(i, r.document(k).tolist()) for k, i in enumerate(r.ids)] == (ROWS if frame > 2 else ROWS[:3])


def test_standard_readers_see_plain_frames_and_damage_is_found():
    import zstandard

    data = write(ROWS, frame_bytes=64)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == [i for _, ids in ROWS for i in ids]
    r = T.Reader(io.BytesIO(data), len(data))
    class Spy(io.BytesIO):
        read_bytes = 0
        def read(self, n=-1):
            out = super().read(n)
            Spy.read_bytes += len(out)
            return out
    big = write([(i, [i % 500] * 3000 + list(range(i, i + 900))) for i in range(200)])
    spy = Spy(big)
    one = T.Reader(spy, len(big))
    assert one.document(120).tolist() == [120] * 3000 + list(range(120, 1020)) and Spy.read_bytes < len(big) / 2
    for k in range(len(r.sums) - 1):
        bad = T.Reader(io.BytesIO(data), len(data))
        bad.sums = bad.sums.copy()
        bad.sums[k] ^= 1
        with pytest.raises(ValueError):
            bad.frame(k)
    with pytest.raises(ValueError):
        T.Reader(io.BytesIO(data[:-1]), len(data) - 1)


def test_written_and_read_back(docs, spark, tmp_path):
    rows = [(10 * i - 50, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (-50, "again")] + [(1000 + i, f"t {i}") for i in range(200)]
    folder = f"file://{tmp_path}/ids"
    manifest = T.write_ids(docs(rows, 5).selectExpr("*", "1 as part"), folder, BYTE)
    got = [tuple(r) for r in T.read_digests(spark, folder).collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = LIB[BYTE].encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert manifest.agg({"n_ids": "sum"}).first()[0] == start
    some = T.read_documents(spark, folder, [-30, 1100, 5])
    assert some == {i: LIB[BYTE].encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows if i in (-30, 1100)}


def test_empty_table(docs, spark, tmp_path):
    T.write_ids(docs([]), str(tmp_path / "none"), BYTE)
    assert T.read_digests(spark, str(tmp_path / "none")).collect() == []
