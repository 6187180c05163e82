import hashlib
import random

import numpy as np
import pytest
from helpers import awkward, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from orebed.llm import bpe
from orebed.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = vocabulary()
    with open(path, "rb") as f:
        return bpe.Codec(f.read()), tokenizers.Tokenizer.from_file(path)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def plain_merges(word, merges):
    """The textbook way: the first merge in order, everywhere, again and again."""
    parts = [bytes([b]) for b in word]
    while pairs := [(merges[p], p) for p in zip(parts, parts[1:]) if p in merges]:
        _, (u, v) = min(pairs)
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.binary(min_size=1, max_size=30).map(lambda b: bytes(c % 3 + 97 for c in b)))
def test_gadgets_agree_with_merging_for_random_merge_lists(seed, word):
    r = random.Random(seed)
    labels, merges = [b"a", b"b", b"c"], []
    while len(merges) < 12:
        u, v = r.randrange(len(labels)), r.randrange(len(labels))
        made = labels[u] + labels[v]
        if made in labels:
            continue
        labels.append(made)
        merges.append((u, v))
    automaton = bpe.Automaton(labels, merges)
    order = {(labels[u], labels[v]): i for i, (u, v) in enumerate(merges)}
    # a merge list is proper if each token is its own tokenization; others can't come from training
    if all(plain_merges(x, order) == [x] for x in labels):
        assert [labels[t] for t in automaton.path(word)] == plain_merges(word, order)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(both, text):
    codec, library = both
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)) == text


def test_long_and_repeated_words(both):
    codec, library = both
    for text in ("a" * 4000, "ab" * 3000, " " * 500 + "x", "=" * 999, "<|endoftext|><|endoftext|> <|endof", "İß" * 300):
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_digests_of_awkward_rows(spark, both):
    _, library = both
    rows = awkward()
    got = sorted(map(str, bpe.digests(frame(spark, rows, clashes=True), vocabulary()).collect()))
    from pyspark.sql import Row

    want = []
    for i, text, *_ in rows:
        encoded = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(encoded, skip_special_tokens=False)
        want.append(str(Row(doc_id=i, n_tokens=len(encoded), ids_sha256=hashlib.sha256(np.array(encoded, "<u4").tobytes()).hexdigest(), decoded_sha256=hashlib.sha256(decoded.encode()).hexdigest())))
    assert got == sorted(want)


def test_empty_table(spark):
    assert bpe.digests(frame(spark, []), vocabulary()).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(b'{"model": {"type": "WordPiece"}}')
