import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from tallyfield.llm import sentencepiece_codec as sc

TEXTS = ["", " ", "   ", "Hello world", "  two  blanks \n\n lines\tand ☃ wörld 梦", "naïve space", "a" * 3000, "x\n y\n", " lead", "trail ", "\n", "𝔘 \x00 \x7f"]


def test_equals_all_segmentations():
    r = random.Random(3)
    for _ in range(60):
        pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): (i, -float(r.randint(0, 9))) for i in range(12)}
        trie = sc.SharedPrefixViterbi(pieces, -30.0, lambda c: [100 + ord(c)])
        words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(0, 8))) for _ in range(30)})
        score = {i: s for i, s in pieces.values()}

        def best(w, memo):
            if not w:
                return 0.0
            if w not in memo:
                memo[w] = max((pieces[w[:k]][1] if w[:k] in pieces else -30.0) + best(w[k:], memo) for k in range(1, len(w) + 1) if w[:k] in pieces or k == 1)
            return memo[w]

        for w, ids in zip(words, trie.segment(words)):
            assert sum(score.get(i, -30.0) for i in ids) == best(w, {})


def test_equals_the_library_on_the_same_scores(spark):
    """The library's own Viterbi, over the same pieces and scores."""
    proto = pb.ModelProto()
    with open(sc.piece_bpe(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec = sc.Codec(sc.piece_bpe())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["Hello world", "don't stop 12.5%", "naïve 梦 x"]
    # line by line and without characters that have no piece: their score, near -1e9, costs the library's floats the rest
    lines = [x for t in texts for x in t.split("\n") if x and "  " not in x and all(c == " " or c in codec.pieces for c in x)]
    assert len(lines) > 300
    score = lambda x: sum(map(library.get_score, x))
    words = sorted({w for x in lines for w in x.split(" ") if w})
    theirs = [library.encode(w) for w in words]
    ours = codec.encode(words)
    assert all(score(a) >= score(b) for a, b in zip(ours, theirs))
    assert np.mean([a == b for a, b in zip(ours, theirs)]) > 0.95


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    codec = sc.Codec(sc.piece_bpe())
    assert codec.decode(codec.encode([text])[0]) == text


def test_whole_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "b", "x"), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sc.encode(df)
    assert out.count() == len(rows) and out.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in sc.decode(out).collect() if r.doc_id is not None}
    assert back == {d: t or "" for d, t, _ in rows if d is not None}
    assert sc.encode(df.limit(0)).count() == 0
    codec = sc.Codec(sc.piece_bpe())
    assert [len(x) for x in codec.encode([None])] == [0]
