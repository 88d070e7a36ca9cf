import os
import random

import pytest

from pairlight.llm import encode

FILE = f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")
PARTS = ["a", "b", "e", "th", " ", "  ", "\n", "é", "ß", "中", "ก", "the", "ing", "'s", "'", "9", "1", ".", "!", "…", "​", "aaaa", "😀", "tion", "\t", "\xa0", "<|endoftext|>", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["".join(r.choice("abcdefghinorst") for _ in range(r.randint(5, 60))) for _ in range(n)]


def test_equals_the_library(library):
    t = texts(3000) + ["a" * n for n in range(120)] + [" " * n + "x" for n in range(60)] + ["", " ", "\r\n", "x" * 5000]
    e = encode.encoder()
    assert [e.encode(x) for x in t] == library(t)
    assert [e.count(x) for x in t] == [len(x) for x in library(t)]


def test_every_prefix_of_a_piece(library):
    table = encode.PrefixTable(encode.encoder().vocabulary)
    word = b"internationalizationsss"
    for k in range(0, len(word), 5):
        table.extend(word[k : k + 5])
    for n in range(len(word) + 1):
        assert table.ids(n) == library([word[:n].decode()])[0]


def test_appends_and_edits_stay_exact():
    e = encode.encoder()
    r = random.Random(2)
    for start in texts(150, 3):
        x = encode.EditableText(e, start)
        for piece in texts(2, r.random()):
            a = r.randint(0, len(x.text))
            x.replace(a, r.randint(a, min(len(x.text), a + 6)), piece[:9])
            assert x.ids() == e.encode(x.text)
            x.append(piece[:4])
            assert x.ids() == e.encode(x.text)


def test_documents(spark, library):
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (4, "  ", "x"), (5, "Hello there", "x"), (5, "two\r\nlines", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode.encode_documents(df).collect())
    want = sorted((d, library([t])[0] if t else []) for d, t, _ in rows)
    assert got == want
    assert encode.encode_documents(df.limit(0)).count() == 0


def test_round_trip():
    e = encode.encoder()
    back = {i: b for b, i in e.vocabulary.id_of.items()}
    for t in texts(200, 5):
        assert b"".join(back[i] for i in e.encode(t)).decode() == t
