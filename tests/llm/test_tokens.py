import base64
import hashlib
import random
import struct

import public_tokenizers as tokens
import pytest
import tiktoken
from tokenizers import Tokenizer

from prosodia.llm import bpe, token_count

SCHEMA = "n_tokens string, doc_id long, text string, ids int"
JSON, RANKS = tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken")


def texts():
    draw = random.Random(2)
    alphabets = ["abc de", "ÄÖß éñ", "漢字かな ", "0123 ", " \t\n\r  ", "'s're'LL", "🙂👩‍👩‍👧 a", "<|endoftext|> x", "\x00\x7f́"]
    made = ["".join(draw.choices(a, k=draw.randint(1, 60))) for a in alphabets for _ in range(12)]
    mixed = ["".join(draw.choices("".join(alphabets), k=200)) for _ in range(40)]
    return [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "a" * 30_000, "word " * 40_000, "\n" * 5000, "aaaa" * 3, *made, *mixed]


def frame(spark):
    rows = [("", i, t, 0) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [("", 4, "twice", 0), ("", None, "no id", 0)], SCHEMA).repartition(3)


@pytest.mark.parametrize("head", [{}, {"head_terms": 3}, {"head_docs": 1, "head_terms": 1}])
def test_counts_as_the_library(spark, head):
    library = Tokenizer.from_file(JSON)
    library.no_truncation()
    got = sorted(map(tuple, token_count.token_counts(frame(spark), JSON, tokens.PATTERN, **head).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts()), (4, "twice"), (None, "no id")]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)


def test_ids_as_tiktoken_and_round_trip(spark):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.round_trips(frame(spark), RANKS, tokens.PATTERN, with_ids=True).collect()}
    for i, t in [*enumerate(texts()), (4, "twice"), (None, "no id")]:
        ids = library.encode_ordinary(t or "")
        row = got[i, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()]
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["exact"]
        assert row["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert len(got) == len(texts()) + 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_count.token_counts(empty, JSON, tokens.PATTERN).collect() == []
    assert bpe.round_trips(empty, RANKS, tokens.PATTERN).collect() == []


def test_decoding_is_the_inverse():
    coder = bpe.codec(RANKS, tokens.PATTERN)
    whole = b"".join(coder.tokens)
    ids = struct.pack(f"<{len(coder.tokens)}I", *range(len(coder.tokens)))
    assert coder.decode(ids) == whole


def test_ranks_with_gaps_are_refused(tmp_path):
    (tmp_path / "gap").write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 2\n")
    with pytest.raises(ValueError):
        bpe.load_ranks(str(tmp_path / "gap"))
