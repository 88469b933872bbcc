"""Tokenizer machines against the tokenizers themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from snaptrail.llm import queries, token_counts, transducers

BYTES = queries.tokenizer_path("byte_bpe_50k.json")
PIECES = ["a", "b", "ab", " ", "  ", "\n", "\r\n", "\t", "'", "'s", "'re", "'r", "'ll ", "''t", "!", "?!", "1", "23", "é", "漢字", "😀", "é", "\x1c", "\x85", " ", "²", "Ⅷ", "ÿ", "<|endoftext|>", "<|", "|>", "----", " the", "tion", "aaaa"]


@pytest.fixture(scope="module")
def counter():
    return transducers.TokenCounter(BYTES, transducers.character_classes(BYTES))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def by_library(library, texts):
    return [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=6))
@example(["a" * 3000, "-" * 2999, " " * 3001 + "x", "", "\n" * 500 + " "])
def test_counts_equal_the_library(counter, library, texts):
    assert counter.count(pa.array(texts, pa.string())).tolist() == by_library(library, texts)


def test_counts_of_all_kinds_of_characters(counter, library):
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000), 32])) for _ in range(400)) for _ in range(50)]
    assert counter.count(pa.array(texts)).tolist() == by_library(library, texts)


def test_words_equal_the_splitter(counter, library):
    text = "".join(random.Random(5).choices([p for p in PIECES if p != "<|endoftext|>"], k=3000))
    words = counter.words(pa.array([text]))[0].to_pylist()
    assert [w.decode() for w in words] == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_character_classes_equal_the_splitter(counter, library):
    for p in [*range(0x3000), *range(0x10D00, 0x11800), 0x3000, 0x1FBF5, 0x10FFFF]:
        if 0xD800 <= p < 0xE000:
            continue
        cuts = {a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(f"a{chr(p)}1!{chr(p)}!")}
        kind = transducers.LETTER if 1 not in cuts else transducers.SPACE if p == 0x20 else transducers.NUMBER if 2 not in cuts else transducers.SPACE if 4 in cuts else transducers.OTHER
        assert counter.splitter.classes[p] == kind, hex(p)


def test_state_maps_compose_to_one_walk(counter):
    symbols = np.random.default_rng(1).integers(0, 16, (37, 64)).astype(np.uint8)
    maps = counter.splitter.scan(counter.splitter.state_maps(symbols))
    for start in range(8):
        state = start
        for i, row in enumerate(symbols):
            for s in row:
                state = counter.splitter.follow[s, state]
            assert maps[i, start] == state


def test_transducer_emits_only_what_is_certain(counter, library):
    """The emitted tokens of a prefix are never more than any longer word has, and forgetting states changes nothing."""
    machine = transducers.CountTransducer(sorted_merges(library), library.get_vocab(with_added_tokens=False), most=40)
    for word in (b"internationalisation", b"-" * 300, b"aaaabbbbaaab" * 20, bytes(range(256)), b""):
        state = n = 0
        for byte in word:
            step = counter.transducer.transitions.get(state << 8 | byte) or counter.transducer.compile(state << 8 | byte)
            assert 0 <= step & 0xFF
            state, n = step >> 8, n + (step & 0xFF)
        assert n <= counter.transducer.count(word) == machine.count(word) == brute_count(library, word)


def sorted_merges(library):
    import json

    return [tuple(m) for m in json.loads(library.to_str())["model"]["merges"]]


def brute_count(library, word):
    """BPE by its definition: the first of the lowest-ranked pairs merges until none is left."""
    alphabet = {b: c for c, b in transducers.byte_alphabet().items()}
    ranks, parts = {m: i for i, m in enumerate(sorted_merges(library))}, [alphabet[b] for b in word]
    while len(parts) > 1:
        best = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 30:
            break
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
    return len(parts)


def test_count_tokens_edges(spark, library):
    rows = [(1, None, "x", 7), (2, "", "x", 7), (2, "", "x", 7), (None, "some <|endoftext|> words", None, 7), (4, "many words of a text " * 40_000, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes long")
    out = token_counts.count_tokens(df, BYTES).collect()
    assert out[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens"} and len(out) == 5
    want = by_library(library, [r[1] or "" for r in rows])
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in out) == sorted((len((r[1] or "").encode()), n) for r, n in zip(rows, want, strict=True))
    assert token_counts.count_tokens(df.filter("false"), BYTES).count() == 0


def test_count_query(spark, sf_dir, library):
    out = queries.op11_finite_state_counts(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = by_library(library, [r["text"] or "" for r in docs])
    assert {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in out} == {d["doc_id"]: (n, n > 512) for d, n in zip(docs, want, strict=True)}
