import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadspeed.llm import pieces as X

MODEL = public_tokenizers.path("piece_bpe_32k.model")
P = X.Pieces(MODEL, 4, limit=40)


def brute(p, text):
    """All segmentations of an escaped text, by score."""
    def ways(rest):
        if not rest:
            yield 0.0, ()
            return
        for k in range(1, len(rest) + 1):
            found = p.table.get(rest[:k])
            if found:
                step = found[1], (found[0],)
            elif k == 1:
                step = p.lost, p.unknown_ids(rest[0])
            else:
                continue
            for s, ids in ways(rest[k:]):
                yield s + step[0], step[1] + ids
    return sorted(ways(text), key=lambda w: -w[0])


@pytest.mark.parametrize("text", ["a", "the cat", "  two", "x ", "naïve é", "世界", "a\nb", "aaaaaa", "don't.", "\x00", "of of", "▁a"])
def test_n_best_matches_all_segmentations(text):
    want = brute(P, P.escaped(text))
    got = P.encode(text)
    assert [s for s, _ in got] == [s for s, _ in want[:4]]
    assert len({ids for _, ids in got}) == len(got) and {w for w in got} <= set(want)
    assert X.summary(P, text)[1] == [s for s, _ in want[:4]]


@given(st.lists(st.text(alphabet="thecains .,'é\n世", max_size=7), max_size=3).map(" ".join))
@settings(max_examples=60, deadline=None)
def test_short_texts(text):
    got, n = P.encode(text), X.summary(P, text)
    if text and len(text) <= 12:
        want = brute(P, P.escaped(text))[:4]
        assert [s for s, _ in got] == [s for s, _ in want]
    assert n[1] == [s for s, _ in got] and all(P.decode(list(ids)) == text for _, ids in got)


def test_search_on_long_parts_and_equal_scores():
    word = "".join(random.Random(2).choice("abcdein") for _ in range(300))
    got = P.search(word)
    assert len(got) == 4 and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
    assert all("".join(P.library.id_to_piece(i) for i in ids) == word for _, ids in got)
    ids, score, least = P.best(word)
    assert (tuple(ids), score) == got[0][::-1] and score - least == got[1][0]


def test_unigram_model_matches_the_library(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    del m.pieces[3:]
    rng = random.Random(5)
    units = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abc", repeat=n)] + ["▁", "▁a", "▁ab", "▁b", "▁▁"]
    for u in units:
        m.pieces.add(piece=u, score=-rng.randint(1, 4000) / 8 - 1, type=1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = 1, False, len(m.pieces)
    path = str(tmp_path / "toy.model")
    open(path, "wb").write(m.SerializeToString())
    toy, lib = X.Pieces(path, 5), sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(40):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 9)))
        want = lib.nbest_encode_as_ids(text, 5)
        score = {i: lib.get_score(i) for i in range(lib.vocab_size())}
        got = toy.encode(text)
        assert [sum(score[i] for i in w) for w in want] == pytest.approx([s for s, _ in got], abs=1e-3), text


def test_cheapest_and_combine():
    rng = random.Random(3)
    for _ in range(50):
        lists = [sorted([0.0, *(rng.randint(0, 6) for _ in range(rng.randint(0, 3)))]) for _ in range(rng.randint(0, 4))]
        want = sorted(sum(c) for c in itertools.product(*lists))[:5]
        assert [x for x, _ in X.cheapest(lists, 5)] == want
        assert [x for x, _ in X.cheapest(X._nearest(lists, 4), 5)] == want
        paths = [[(-x, (k, j)) for j, x in enumerate(lst)] for k, lst in enumerate(lists)]
        assert [-s for s, _ in X.combine(paths, 5)] == want


TEXTS = [None, "", "The cat sat.", " lead  and trail ", "世界 \x00\n", "word " * 50000, "a" * 3000, "▁sign", "The cat sat."]


def test_documents(docs, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(2, TEXTS[2])]
    df = docs(rows).selectExpr("*", "1 as ids", "2 as score")
    out = X.encode_documents(df, MODEL, with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        text = TEXTS[r.doc_id] or ""
        best = P.encode(text)
        assert r.ids == list(best[0][1]) and r.scores == [s for s, _ in best] and r.score == r.scores[0]
        assert r.n_pieces == len(r.ids) and r.n_bytes == len(text.encode()) and r.n_best == len(r.scores)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.round_trip == ("▁" not in text) and r.decoded_sha256 == hashlib.sha256(P.decode(r.ids).encode()).hexdigest()
    back = X.decode_documents(X.encode_documents(df, MODEL, with_ids=True), MODEL).collect()
    assert all(r.text == (TEXTS[r.doc_id] or "").replace("▁", " ") for r in back)
    assert X.encode_documents(docs([]), MODEL).collect() == []


def test_texts_in_blocks(monkeypatch):
    text = "the cat  sat. on " * 300
    want = X.summary(P, text)
    monkeypatch.setattr(X, "STEP", 50)
    assert X.summary(P, text) == want


@pytest.mark.parametrize("with_ids", [False, True])
def test_documents_have_all_segmentations(docs, with_ids):
    texts = [*TEXTS[:5], "of of of of", "the cat sat on the mat. " * 40, TEXTS[6]]
    for r in X.encode_documents(docs(list(enumerate(texts))), MODEL, with_ids=with_ids).collect():
        text = texts[r.doc_id] or ""
        best = P.encode(text)
        got = r.segmentations
        assert [s.score for s in got] == r.scores == [s for s, _ in best] and got[0].ids_crc32 == r.ids_crc32
        assert len({s.ids_crc32 for s in got}) == len(got) == r.n_best
        if with_ids:
            score = dict(x for x in P.table.values() if x)
            for s in got:
                assert s.n_pieces == len(s.ids) and s.ids_crc32 == zlib.crc32(np.array(s.ids, "<u4").tobytes())
                assert P.decode(s.ids) == text.replace(X.BLANK, " ")
                if all(i in score for i in s.ids):
                    assert sum(score[i] for i in s.ids) == s.score
