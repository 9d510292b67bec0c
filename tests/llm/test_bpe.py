import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
OURS = bpe.Codec(PATH, PATTERN)


THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text) and OURS.decode(ids) == text.encode()


def test_long_pieces_and_white_space():
    rng = random.Random(2)
    for n in (25, 60, 100, 333, 3000):
        for letters in ("a", "ab", "etaoinshrdlu", "éèß", "0123456789", "-=_", " ", "\n \t", "人口的"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    for text in ("a\x1cb \x1d\x85 \xa0c", "᠎ ​ x", "don't  I'LL 've", "\x00\x00 a"):
        assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_join_equals_whole():
    rng = random.Random(4)
    for _ in range(400):
        raw = "".join(rng.choice("thetion ingéreß") for _ in range(rng.randrange(2, 200))).encode()
        at = rng.randrange(1, len(raw))
        assert OURS.join(OURS.reduce(raw[:at]), OURS.reduce(raw[at:])) == OURS.merge(raw)


def test_tables(spark):
    rows = [(1, "The theory of it, 12 30.\n\n x"), (1, "The theory of it, 12 30.\n\n x"), (2, None), (3, ""), (None, "é" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' ids", "1 n_tokens")
    got = sorted(map(tuple, bpe.round_trip(df, PATH, PATTERN).collect()), key=str)
    want = []
    for d, t in rows:
        ids = THEIRS.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(d), (t or "").encode()) for d, t in rows)
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).collect() == []
