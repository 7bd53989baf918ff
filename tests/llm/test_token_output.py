import zlib

import numpy as np
import pytest

from tallyfield.llm import token_output as to
from tallyfield.llm.wavelet import WaveletMatrix, build


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 1), (1000, 2), (70000, 49408), (200000, 1 << 20)])
def test_wavelet_matrix(n, top):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % top).astype(np.uint32)
    w = WaveletMatrix(build(ids, np.arange(1), np.array([n])))
    assert np.array_equal(w.decode(), ids) and w.n == n
    for i in r.integers(0, n, 20) if n else ():
        assert w.access(int(i)) == ids[i]
        token = int(ids[i])
        at = np.flatnonzero(ids == token)
        assert w.count(token) == len(at)
        assert w.count(token, n // 3, n // 2) == np.count_nonzero(ids[n // 3 : n // 2] == token)
        k = int(r.integers(len(at)))
        assert w.locate(token, k) == at[k]
    assert w.count(top + 5) == np.count_nonzero(ids == top + 5)


def test_equals_the_plain_tokenizer(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(to, "SHARD_IDS", 20000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "A<|endoftext|> b c\x1fd e'S don't 12.5 İx é café"), (1004, "z " * 40000)]
    df = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, start int").repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in to.encode_and_read_back(df).collect()}
    tokenizer, start = Tokenizer.from_file(to.word_bpe()), 0
    for d, t in sorted(rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert got.pop(d) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a"), (7, "a"), (None, "b")], "doc_id long, text string")
    assert to.encode_and_read_back(df.limit(0)).count() == 0
    got = sorted(((r.doc_id, r.start) for r in to.encode_and_read_back(df).collect()), key=lambda x: x[1])
    assert got == [(None, 0), (7, 2), (7, 4)]
