import os
import random

import numpy as np
import pytest

from framequarry.llm.sentencepiece_codec import Matcher, Vocabulary, decode, encode

MODEL = os.environ.get("TEST_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer file")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_are_the_library_s(vocabulary, library):
    rnd = random.Random(1)
    m = Matcher(vocabulary)
    texts = [" a  b\n c\td ▁ x", "", " ", "  ", "a   ", "\u0000é日𝔘", "    日本 語語", "\n\n  \n x", "<s> <0x0A> </s>", "a" * 700, "x" * 3000, " " * 17 + "a", " " * 40, "the  \n"]
    texts += ["".join(rnd.choice('ab the in  \nerон日ß😀="_-./<>') for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["".join(rnd.choice(vocabulary.pieces[259:]) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    texts += ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=20_000))]
    got = [np.frombuffer(g, "<i4").tolist() for g in m.encode(texts)]
    assert got == library.encode(texts)
    assert all(m.decode(g) == t.encode() for g, t in zip(got, texts, strict=True) if "▁" not in t)


def test_round_trip(spark, vocabulary):
    rows = [(1, "some text\n  here"), (2, None), (3, ""), (None, "x"), (1, "some text\n  here"), (4, "a ▁ b"), (5, "word " * 50_000)]
    df = encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary)
    got = df.collect()
    assert len(got) == len(rows) and all(r.round_trip == (r.doc_id != 4) and r.n_pieces == len(r.ids) for r in got)
    back = sorted((str(r.doc_id), r.text) for r in decode(df, vocabulary).collect())
    assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []
