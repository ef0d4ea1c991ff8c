import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import docs
from trailmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", " ", "  ", "\n", "\t", "a", "s", "t", "re", "é", "ß", "1", "²", "!", "?", "\x85", "漢", "😀", "\x00", "\x1c", "​", "'S", "\r\n"]


@pytest.fixture(scope="module")
def both():
    data = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Ranks(data), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(both):
    coder, library = both
    r = random.Random(5)
    texts = ["", " ", "\n ", "x" * 3000, "-" * 900, *("".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(1500))]
    ids, ends = coder.encode(texts)
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(t), repr(t)
        assert coder.decode(ids[a:b]) == t.encode()


def test_bounded_cache_keeps_results(both, monkeypatch):
    coder, library = both
    monkeypatch.setattr(bpe, "CACHE", 3)
    for t in ("one two three four five", "six seven one two"):
        assert coder.encode([t])[0].tolist() == library.encode_ordinary(t)
    assert len(coder.cache) <= 8


def test_tables(both, spark):
    library = both[1]
    texts = ["it's fine", "", "<null>", "it's fine", "<no id>", "a\n\n b", "🙂" * 9]
    rows = docs(spark, texts)
    found = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(rows, PATH).collect()))
    want = []
    for r in rows.collect():
        t = r.text or ""
        ids = library.encode_ordinary(t)
        want.append((r.doc_id if r.doc_id is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert found == sorted(want)
    back = bpe.decode(bpe.encode(rows, PATH), PATH).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r.text or "").encode() for r in rows.collect())
    assert bpe.round_trip(rows.limit(0), PATH).count() == 0
