"""Aligned readings against both libraries and a search over all pairs of tokens."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snaptrail.llm import alignment, queries

BYTES, PIECES = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "some plain words, and 12 more", "two  blanks   three", " begins and ends with blanks  ", "line\nbreak\n\n and\ttab \r\n", "é漢字😀 ß ﬁ", "it's <s> and </s> <unk> <|endoftext|> in text",
    "lower▁bar is not a blank", "nul \0 byte", "same text here", "same text here", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<0x41> is text", "\x85\x1c odd\xa0spaces　", "ǅ é ​", "long " * 3000,
]


def brute(texts):
    """Rows of every text, by whole-text readings and all overlapping pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    decode = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}

    def b_bytes(i):
        return bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()

    found = []
    for text in texts:
        full = (" " + (text or "")).encode()
        a = [(i, bytes(decode[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in b_model.encode(text or "")]
        if not text or b"".join(t for _, t in a) != full or b"".join(t for _, t in b) != full:
            found.append(([], [], [], ""))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]] if len(full) < 3000 else list(swept(*spans))
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, x, y in side if start <= x and y <= e) for side in spans) if len(full) < 3000 else None)
            start = e
        if groups[0] is None:
            groups, i, j = [], 0, 0
            for e in ends:
                parts = []
                for side, k in ((spans[0], i), (spans[1], j)):
                    m = k
                    while m < len(side) and side[m][2] <= e:
                        m += 1
                    parts.append((",".join(str(x[0]) for x in side[k:m]), m))
                (x, i), (y, j) = parts
                groups.append(f"{x}|{y}")
        found.append((spans, links, groups, ";".join(groups)))
    counts = collections.Counter(link for _, links, _, _ in found for link in links)
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (len(s[0]) if s else 0, len(s[1]) if s else 0, len(g), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(t.encode()).hexdigest() if s else "")
        for s, links, g, t in found
    ]


def swept(a, b):
    j = 0
    for i, x, y in a:
        while b[j][2] <= x:
            j += 1
        k = j
        while k < len(b) and b[k][1] < y:
            yield i, b[k][0]
            k += 1


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 1])
def test_alignment_equals_brute_force(spark, frequent):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choices(["the ", "of", "ing", " ", "é", "漢", "x", "1", "\n", "'s", ","], k=60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_links string").repartition(3)
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, BYTES, PIECES, frequent=frequent).collect()}
    want = brute(texts)
    for i, t in enumerate(texts):
        assert out[i] == want[i], (t or "")[:60]


def test_alignment_repeats_and_empty(spark):
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (1, "other words"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in alignment.align(df, BYTES, PIECES, frequent=1).collect())
    assert out == sorted((str(i), *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    assert alignment.align(df.filter("false"), BYTES, PIECES).count() == 0
    assert [r["n_links"] for r in alignment.align(df.filter("text IS NULL"), BYTES, PIECES).collect()] == [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_groups_equal_walked_components(a, b):
    total = max(sum(a), sum(b)) + 1
    a_end, b_end = (np.cumsum([*x, total - sum(x)]) for x in (a, b))
    a_group, b_group = alignment.groups_of(a_end, b_end)
    common = sorted(set(a_end.tolist()) & set(b_end.tolist()))
    assert a_group.tolist() == np.searchsorted(common, a_end).tolist() and b_group.tolist() == np.searchsorted(common, b_end).tolist()


def test_alignment_query(spark, sf_dir):
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_pointer_jumping_alignment(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert out == {d["doc_id"]: w for d, w in zip(docs, brute([d["text"] for d in docs]), strict=True)}
