import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import odd_texts
from wirebook.llm import packing, token_files
from wirebook.llm.encoder import Encoder, default_tokenizer
from wirebook.sources.tables import shared_dir


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(plain):
    import pyarrow as pa

    texts = [t for _, t in odd_texts()] + ["don't, we'll. THE'S", "...!? a.b,c", "ﬁ Å Å K"]
    own = Encoder(default_tokenizer(), max_words=20)
    for _ in range(2):
        got = []
        for _, _, bounds, ids in own.encode(pa.array(texts, pa.string()), 1):
            got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
        assert got == [[*plain(t), 1] for t in texts]


def test_runs_of_marks_behind_letters(plain):
    import pyarrow as pa

    stems = ["word", "\u00fcber", "AL\u0130", "don't", "x1", "it's", "a-b", "\u6f22\u5b57", "e\u0301", ""]
    runs = ["", "$$$", "%%%", "!!", "###", "***", "&&&", "'", "''", "'s", ".,", "|", "\\", "_", "...\u2026", "$a", "\u0338", "`~^"]
    texts = [f"{w}{r}" for w in stems for r in runs]
    texts += [" ".join(texts), "\n".join(texts * 3)]
    own = Encoder(default_tokenizer(), max_words=60)
    column = pa.array(["left out", *texts, "left out"], pa.string()).slice(1, len(texts))
    for _ in range(3):
        for _, _, bounds, ids in own.encode(column, 1):
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[*plain(t), 1] for t in texts]


def test_table_keeps_words_of_several_slices(plain):
    import pyarrow as pa

    own = Encoder(default_tokenizer(), max_words=50)
    for k in range(30):
        text = "the same old story " + " ".join(f"w{chr(97 + k % 26)}{chr(97 + j)}" for j in range(12))
        for _, _, _, ids in own.encode(pa.array([text], pa.string()), 1):
            assert ids.tolist() == [*plain(text), 1]
        assert len(own.known) <= 50 + 16
    assert {"the", "same", "old", "story"} <= set(own.known)


def test_letters_that_become_marks(plain):
    import pyarrow as pa

    ends = ["AL\u0130", "\u0995\u09dc", "\u0915\u0958", "\u05d0\ufb2a", "\u0130a", "\u00c4", "\u212b"]
    words = [f"{w}{m}" for w in ends for m in ("", ".", ",")]
    texts = [*words, " ".join(words)]
    for _, _, bounds, ids in Encoder(default_tokenizer()).encode(pa.array(texts, pa.string()), 1):
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[*plain(t), 1] for t in texts]


def test_token_files(spark, docs, plain):
    path = f"{shared_dir(spark)}/tokens"
    token_files.write_token_files(docs(*odd_texts()), path)
    got = token_files.digests(token_files.read_token_files(spark, path)).collect()
    start = 0
    expected = []
    for i, text in sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0])):
        ids = [*plain(text), 1]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    one = token_files.read_token_files(spark, path, ["doc_id", "ids"]).where("doc_id = 4").first()
    assert one.ids == [*plain("word"), 1]


def test_token_files_of_nothing(spark, docs):
    path = f"{shared_dir(spark)}/tokens"
    token_files.write_token_files(docs((1, "a")).where("false"), path)
    assert token_files.read_token_files(spark, path).collect() == []


def check_packed(rows, texts, plain, capacity):
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    expected = sorted(
        ((i, p // capacity, p, len(ids[p : p + capacity]), crc(ids[p : p + capacity])))
        for i, text in texts
        for ids in [[*plain(text), 0]]
        for p in range(0, len(ids), capacity)
    )
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    return len(places)


def test_packing(docs, plain):
    texts = [(i if i is not None else -1, t) for i, t in odd_texts()]
    rows = packing.pack_documents(docs(*texts)).collect()
    check_packed(rows, texts, plain, 2048)
    assert packing.pack_documents(docs(*texts).where("false")).collect() == []


def test_packing_rounds_stay_near_the_bound(spark):
    random.seed(5)
    rows = [(i, 0, 0, random.choice([1, 3, 10, 40, 60, 64, 90]), 0) for i in range(600)]
    pieces = spark.createDataFrame([(i, p, s, min(n, 64), c) for i, p, s, n, c in rows], packing.PIECES)
    got = packing.pack_pieces(pieces, capacity=64, items_per_task=50, fan_in=3).collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    fills = {}
    for r in got:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in fills.values():
        ends = 0
        for offset, length in sorted(place):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(fills) <= 1.1 * sum(min(n, 64) for _, _, _, n, _ in rows) / 64 + 1


def test_packing_of_pieces_that_never_share(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 40, 0) for i in range(300)], packing.PIECES)
    got = packing.pack_pieces(pieces, capacity=64, items_per_task=20).collect()
    assert len({r.sequence_id for r in got}) == 300
