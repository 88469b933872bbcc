"""The training-data operators against brute force, round trips and held-out labels, on small inputs and edge cases."""

import hashlib
import math
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaptrail.llm import chat, contamination, flac, hashes, html_text, language, lines, media, near_dups, packing, queries, substrings, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, h1 string, media string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


EDGE = [None, "", " ", "one", "one two three", "x " * 3000, "same line here\nother", "same line here\nother", "é ß 漢字   😀"]


# FLAC


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=5), st.integers(0, 3))
def test_flac_round_trip(payloads, partition_order):
    for p, x in zip(payloads, flac.decode(flac.encode(payloads, partition_order=partition_order)), strict=True):
        assert (x.astype(np.int32) + 128).astype(np.uint8).tobytes() == p


def test_flac_predicts_and_seeks():
    tone = (np.sin(np.arange(40_000) / 15) * 8000).astype("<i2").tobytes()
    (data,) = flac.encode([tone], bps=16)
    assert len(data) < 0.75 * len(tone)
    meta = flac.metadata(data)
    sample, offset, n = meta["seek"][2]
    assert data[meta["first"] + offset : meta["first"] + offset + 2] == b"\xff\xf8" and sample == 2 * flac.BLOCK * flac.SEEK_FRAMES and n == flac.BLOCK
    assert flac.decode([data])[0].astype("<i2").tobytes() == tone


@pytest.mark.parametrize("at", [90, -3, -1])
def test_flac_damage_is_found(at):
    data = bytearray(flac.encode([bytes(range(250)) * 4])[0])
    data[at] ^= 0x10
    with pytest.raises((flac.BadFlac, IndexError)):
        flac.decode([bytes(data)])


def test_media_columns(spark):
    df = docs_of(spark, EDGE).select("doc_id", F.encode("text", "UTF-8").alias("pcm"), "media")
    out = media.decode_media(media.encode_media(df, "pcm")).withColumn("back", media.pcm_of(F.col("blocks"))).orderBy("doc_id").collect()
    assert [bytes(r["back"]) for r in out] == [(t or "").encode() for t in EDGE]
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id int, media binary")
    assert [(r["problem"] is None, r["blocks"]) for r in media.decode_media(bad).collect()] == [(False, []), (False, [])]
    long = spark.createDataFrame([(bytearray(b"ab" * 20_000),)], "pcm binary")
    block = media.decode_media(media.encode_media(long, "pcm")).select(media.seek(F.col("blocks"), F.lit(30_000)).alias("b")).head()["b"]
    assert block["sample_offset"] <= 30_000 < block["sample_offset"] + block["n_samples"]


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two<br>three", "one\ntwo three"),
        ("<body><nav><a>x</a></nav><article><h1>T</h1><p><b>Bold<br><p>next  line</p></article><footer>f</footer>", "T\nBold\nnext line"),
        ("<body><div class='sidebar'>side</div><div><p>A long enough text of the article itself.</p><p>More text, also long enough.</p></div><div id='comments'><p>A reader's comment that is long as well.</p></div><form>q</form></body>", "A long enough text of the article itself.\nMore text, also long enough."),
        ("<body><div class='layout has-sidebar ad-free'><p>Kept text of some length.</p><div class='notices'>We use cookies.</div><section class='reader-comments'><p>Nice.</p></section></div></body>", "Kept text of some length."),
        ("<body><script>if (a<b) x()</script><style>p{}</style><!-- c --><p>text&nbsp;here</p>", "text here"),
    ],
)
def test_html_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("name", ["layout sidebar-right", "post comments-open", "entry share-enabled", "popular-science", "legal-news"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>", "<div class='entry share-enabled'>{}</div>"])
@pytest.mark.parametrize("outer", ["{}", "<main>{}</main>", "<article><div>{}</div></article>"])
def test_html_wrappers_with_clutter_names(name, inner, outer):
    text = "<p>The first paragraph of the text itself, of some length.</p><p>A second one, which is long enough as well.</p>"
    side = "<div class='sidebar'>Side text.</div>"
    page = f"<body><nav>menu</nav>{outer.format(f'<div class={name!r}>{inner.format(text)}{side}</div>')}<div id='comments'>Nice.</div></body>"
    assert html_text.main_text(page) == "The first paragraph of the text itself, of some length.\nA second one, which is long enough as well."


def test_html_clutter_names_still_drop_clutter():
    text = "<p>The text itself, with a length that is not small.</p>"
    card = "<article><p>Another story in short.</p></article>"
    assert html_text.main_text(f"<body><div>{text}</div><div class='related'>{card}</div></body>") == "The text itself, with a length that is not small."
    thread = "<div id='comments'>" + "<p>A comment that goes on for a while.</p>" * 4 + "</div>"
    assert html_text.main_text(f"<body><article>{text}</article>{thread}</body>") == "The text itself, with a length that is not small."
    # nothing but flagged nodes
    assert html_text.main_text("<body><div class='popular'><p>one</p></div><div class='legal'><p>two</p></div></body>") != ""


def brute_best(node, linked):
    """The block of maximum density sum, each count taken anew from the subtree."""

    def count(parts):
        chars = tags = link_chars = link_tags = 0
        for c in parts:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
            else:
                inner = count(c.children)
                chars, tags = chars + inner[0], tags + inner[1] + 1
                link_chars, link_tags = (link_chars + inner[0], link_tags + inner[1] + 1) if c.tag == "a" else (link_chars + inner[2], link_tags + inner[3])
        return chars, tags, link_chars, link_tags

    def in_link(c):
        return c is not None and (c.tag == "a" or in_link(c.parent))

    def is_block(c):
        return not isinstance(c, str) and (c.tag in html_text.BLOCK or any(is_block(x) for x in c.children))

    def density(parts):
        c, t, lc, lt = count(parts)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + linked * c + math.e)
        return c / max(1, t) * max(0.0, math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(max(math.e, base)))

    def score(n):
        if in_link(n):
            return 0.0
        total, run = 0.0, []
        for c in n.children:
            if is_block(c):
                total, run = total + density(run) + (0.0 if in_link(c) else density(c.children)), []
            else:
                run.append(c)
        return total + density(run)

    return [(n, score(n)) for n in html_text.in_order(node) if is_block(n)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "<span>", "</span>", "some words of text ", "a much longer piece of text, which goes on for a while. ", "x"]), max_size=40))
@example(["<a href=x>", "<div>", "some words of text "])
@example(["<div>", "some words of text ", "<a href=x>", "<b>", "x", "</b>", "<p>", "x", "</p>", "</a>", "</div>", "<p>", "x"])
def test_html_densities_equal_brute_force(pieces):
    page = "<body>" + "".join(pieces) + "</body>"
    root = html_text.parse(page)
    nodes = html_text.densities(root)
    linked = root.link_chars / root.chars if root.chars else 0.0
    want = brute_best(root, linked)
    assert [n for n in nodes if n.block] == [n for n, _ in want]
    assert [n.score for n, _ in want] == pytest.approx([s for _, s in want])
    body = next(n for n in nodes if n.tag == "body")
    top = max(want[1:], key=lambda x: x[1])[1] if body.chars else 0
    chosen, threshold = html_text.content(html_text.parse(page))
    assert not body.chars or (max(n.score for n in chosen) == pytest.approx(top) and threshold <= body.density)


TEXT = "<p>The first paragraph of the text itself, which has some length.</p><p>A second one, which is long enough as well.</p>"
RAIL = "<div class='rail'><ul>" + "".join(f"<li><a href='/{i}'>Link title {i}</a></li>" for i in range(40)) + "</ul></div>"
CARDS = "".join(f"<a href='/{i}'><div><h3>Another story {i}</h3><p>What that story is about, in a few words {i}.</p></div></a>" for i in range(10))
PLAIN = "The first paragraph of the text itself, which has some length.\nA second one, which is long enough as well."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><div>{t}</div>{r}</main>", PLAIN), ("<div>{t}</div>{r}", PLAIN), ("<div>{t}{r}</div>", PLAIN), ("<main><h1>Title</h1><div>{t}</div>{r}</main>", "Title\n" + PLAIN),
        ("<div class='popular science'>{t}</div>{r}", PLAIN), ("<div class='popular science'><article>{t}</article></div>", PLAIN), ("<div><h2>A</h2>{t}</div><div><h2>B</h2>{t}</div>", f"A\n{PLAIN}\nB\n{PLAIN}"),
        ("<div>One line of loose text, with <i>marks</i>.<br>Another line of it.</div>{r}", "One line of loose text, with marks. Another line of it."), ("{r}", "\n".join(f"Link title {i}" for i in range(40))),
        # links around whole blocks
        ("{t}{c}", PLAIN), ("<div>{t}{c}</div>", PLAIN), ("<div>{t}<section>{c}</section></div>", PLAIN), ("<main>{t}</main><div>{c}</div>", PLAIN), ("<div>{c}</div><div>{t}</div>", PLAIN),
        ("<div><a href='/x'><h2>Title</h2></a>{t}</div>", "Title\n" + PLAIN),
        # the same twice: the first of equal sums, and what reaches the threshold
        ("<div>{t}</div><div>{t}</div>", f"{PLAIN}\n{PLAIN}"),
    ],
)
def test_html_density_decides(page, text):
    assert html_text.main_text("<body>" + page.format(t=TEXT, r=RAIL, c=CARDS) + "</body>") == text


@pytest.mark.parametrize("piece", ["<div>", '<a "', '<a x="', "<!x", "<object><div>", "<table><tr><td>", "<p><b>", "<", "<header>", "</b><div>"])
def test_html_long_hostile_pages(piece):
    began = time.process_time()
    html_text.main_text(piece * (250_000 // len(piece)))
    assert time.process_time() - began < 10


def test_html_empty_and_long(spark):
    df = spark.createDataFrame([(1, "<p>" + "word " * 200_000 + "</p>"), (2, "<p>b</p>"), (2, "<p>b</p>")], "page_id long, html string")
    assert sorted((r["page_id"], r["n_chars"]) for r in html_text.extract_text(df).collect()) == [(1, 999_999), (2, 1), (2, 1)]
    assert html_text.extract_text(df.filter("false")).count() == 0


def test_html_query(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract_text(df).collect())) == [(1, "u", "", 0), (1, "u", "a", 1)]


# packing


def test_tokens_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [t or "" for t in EDGE] + ["<|endoftext|> x<|startoftext|>y 's", "Don't É, ÀÉ. ẞ ΑΣ İ\x1cµ", "a\r\nb\tc  d\n\n", "word.,.. 1234 word"]
    ids, sizes = packing.WordTokenizer(path).encode_many(pa.array(texts))
    mine = np.split(ids, np.cumsum(sizes)[:-1])
    assert [m.tolist() for m in mine] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_and_bound(lengths):
    x = np.array(lengths, np.int64)
    bins, offset, made = packing.best_fit_decreasing(x, 64)
    for b in range(made):
        own = np.flatnonzero(bins == b)
        order = own[np.argsort(offset[own])]
        assert offset[order].tolist() == np.append(0, np.cumsum(x[order])[:-1]).tolist() and x[own].sum() <= 64
    assert -(-int(x.sum()) // 64) <= packing.lower_bound(x, 64) <= made <= len(x)


def test_lower_bound_is_certified():
    assert packing.lower_bound(np.array([33] * 10), 64) == 10 and packing.lower_bound(np.array([22] * 9), 64) == 5


def test_packing_exchanges_and_covers(spark):
    rng = np.random.default_rng(3)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 65, 400))], "row long, length long")
    out = packing.pack(pieces, capacity=64, group=50).toPandas()
    assert sorted(out["row"]) == list(range(400))
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.append(0, np.cumsum(own["length"])[:-1]).tolist() and own["length"].sum() <= 64
    assert out["sequence_id"].nunique() <= 1.1 * packing.lower_bound(out["length"].to_numpy(), 64)


def test_pack_documents(spark):
    out = packing.pack_documents(docs_of(spark, EDGE), queries.tokenizer_path(), capacity=512).toPandas()
    assert sorted(set(out["doc_id"])) == list(range(len(EDGE))) and out[out["doc_id"] == 0]["length"].tolist() == [1]
    assert out[out["doc_id"] == 5].sort_values("piece")["length"].tolist()[:-1] == [512] * (len(out[out["doc_id"] == 5]) - 1)
    assert packing.pack_documents(docs_of(spark, []), queries.tokenizer_path()).count() == 0


# language


def test_language_kernel_is_the_set_overlap():
    bits, letters = language.presence(["abc abd", "ABC!", "123", None])
    assert letters.tolist() == [True, True, False, False]
    k = language.kernel(bits[:2], bits[:2].astype(np.float32))
    assert k[0, 0] == pytest.approx(1) and k[0, 1] == pytest.approx((bits[0] & bits[1]).sum() / np.sqrt(bits[0].sum() * bits[1].sum()), rel=1e-5)


def test_language_ridge_with_all_rows_as_landmarks():
    """With every row a landmark, Nystroem ridge regression is full kernel ridge regression."""
    texts = [w * 3 + f" {i}" for i, w in enumerate(["der die das und ", "the and of to ", "le la les et "] * 6)]
    labels = ["de", "en", "fr"] * 6
    bits, _ = language.presence(texts)
    model = language.Model(bits, labels, n_landmarks=10**6, ridge=1e-3)
    order = [i for lang in ("de", "en", "fr") for i in range(18) if labels[i] == lang]
    k = language.kernel(bits[order], bits[order].astype(np.float32)).astype(np.float64)
    y = np.array([[1.0 if labels[i] == lang else -1.0 for lang in ("de", "en", "fr")] for i in order])
    # weights of 1 / 18 each: (K / 18 + ridge) c = y / 18
    full = np.linalg.solve(k / 18 + 1e-3 * np.eye(18), y / 18)
    new, _ = language.presence(["und das ", "of the ", "xyz", "les la the"])
    got = language.kernel(new, np.unpackbits(model.packed, axis=1).astype(np.float32)) @ model.coefficients
    assert got == pytest.approx(language.kernel(new, bits[order].astype(np.float32)) @ full, abs=1e-3)


def test_language_learns_more_languages_than_a_cap(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300)}{chr(0x5E00 + i % 300)} " * 5, f"l{i % 300:03d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True))
    assert len(model.languages) == 300
    out = language.identify(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), model).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 300:03d}" for r in out) > 880


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = queries.op4_string_kernel_language(spark, sf_dir).join(docs, "doc_id").toPandas()
    own = out[out["held_out"]]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.9 and out["score"].between(0, 1).all()
    assert out["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]


def test_language_edges(spark):
    docs = docs_of(spark, EDGE)
    model = language.learn(docs, F.lit(True))
    out = {r["doc_id"]: r for r in language.identify(docs.withColumn("held_out", F.lit(False)), model).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[2]["lang_pred"] == "und" and out[3]["lang_pred"] == "en"
    assert language.learn(docs_of(spark, []), F.lit(True)) is None


# chat


@settings(max_examples=60, deadline=None)
@given(st.text(), st.text())
def test_chat_turn_reads_back(role, text):
    head = chat.START + chat.escape(role).replace("\n", "\\n") + "\n"
    content = chat.escape(text)
    got = chat.read_turn(f"{head}{content}{chat.END}\n", len(head), len(head) + len(content))
    assert got == (role, text, text) and "<|" not in content


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "image", "audio", "document", "other"]), st.text(st.sampled_from('<|>\\n:0image_end a\n'), max_size=6) | st.sampled_from(["<", "|im_end|>", "|image:0|>", chat.END])), max_size=6))
def test_chat_parts_read_back(parts):
    visitor = chat.PartVisitor()
    for kind, text in parts:
        visitor.visit({"type": kind, "text": text, "ref": text})
    content = "".join(visitor.pieces)
    head = chat.START + "assistant\n"
    want = "".join(text for kind, text in parts if kind in ("text", "other"))
    assert chat.read_turn(f"{head}{content}{chat.END}\n", len(head), len(head) + len(content)) == ("assistant", want, want)
    # every live control string is one of the placeholders, at its place
    live = [m.start() for m in re.finditer(r"<\|", content)]
    assert live == [a["position"] for a in visitor.attachments]


def test_chat_parts(spark):
    image = ("image", None, "a.png", 700, 300, None, None)
    parts = [("text", "see <|image:0|>", None, None, None, None, None), image, ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    row = chat.format_turns(df).orderBy("turn").head()
    assert [(a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 3 * 144), ("audio", "b.wav", 50), ("document", "c.pdf", 1800)]
    assert all(row["formatted"][a["position"] :].startswith(f"<|{a['type']}:{a['number']}|>") for a in row["attachments"])
    back = chat.read_back(chat.ordered(chat.format_turns(df))).head()
    assert back["n_turns"] == 2 and back["n_attachments"] == 3 and back["turns_sha256"] == hashlib.sha256(b"user\nsee <|image:0|>\n\n\n").hexdigest()


# near duplicates


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(20):
        h = rng.integers(1, 1 << 62, 50).astype(np.uint64)
        a, b = rng.integers(0, 7, 50), rng.integers(0, 7, 50)
        i, j = np.flatnonzero(a), np.flatnonzero(b)
        sig = near_dups.signatures(np.repeat([0, 1], [len(i), len(j)]), np.concatenate([h[i], h[j]]), np.concatenate([a[i], b[j]]), 2, places=512)
        off.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015


def brute_classes(texts):
    bags = []
    for t in texts:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        runs = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        bags.append(pd.Series(runs, dtype=object).value_counts().to_dict())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum(min(n, bags[j].get(k, 0)) for k, n in bags[i].items())
            union = sum(bags[i].values()) + sum(bags[j].values()) - both
            if (texts[i] or "") == (texts[j] or "") or (union and both / union >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    texts = list(EDGE)
    for _ in range(6):
        base = list(rng.choice(words, 80))
        for k in range(12):
            own = list(base)
            for at in rng.integers(0, 80, k % 5):
                own[at] = str(rng.choice(words))
            texts.append(" ".join(own))
    out = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs_of(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_classes(texts)


def test_one_shared_band_is_enough_across_components(spark):
    # nodes 1 and 2 share band 7 only; 3's bag is too small to be like 1 or 2, 4 is in 1's component
    rows = [(7, 1, 1, 100), (8, 1, 1, 100), (7, 2, 2, 80), (9, 2, 2, 80), (7, 3, 3, 63), (7, 4, 1, 100), (9, 4, 1, 100)]
    placed = spark.createDataFrame(rows, "key long, node long, root long, size long")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(1, 5)], "node long, text string")
    assert sorted(map(tuple, near_dups.across(placed, texts, 0.8).collect())) == [(2, 1), (4, 2)]
    sizes = {r["doc_id"]: r["size"] for r in near_dups.banded(docs_of(spark, EDGE)).collect()}
    assert [sizes[i] for i in range(6)] == [0, 0, 0, 1, 1, 2996]


def test_bounds_lose_no_pair_of_busy_nodes(spark):
    # one bucket of many components: the bounds keep exactly the pairs that are alike (no cells collide here)
    rng = np.random.default_rng(17)
    base, texts = [f"b{i}" for i in range(60)], []
    for k in range(90):
        own = list(base)
        for at in rng.integers(0, 60, k % 5):
            own[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(own))
    bags = near_dups.bags_of(pa.array(texts))
    want = {(a, b) for a in range(90) for b in range(a) if near_dups.overlap(bags[a], bags[b]) >= 0.8 - 1e-12}
    placed = spark.createDataFrame([(k, i, i, 56) for i in range(90) for k in (7, 8)], "key long, node long, root long, size long")
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = [tuple(r) for r in near_dups.across(placed, nodes, 0.8).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and len(got) <= 1.1 * len(want)
    assert {tuple(r) for r in near_dups.verified(spark.createDataFrame(got, "a long, b long"), nodes, 0.8).collect()} == want


def test_hot_sides_of_pairs_are_dealt(spark):
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 1200)], "a long, b long")
    values = spark.createDataFrame([(i, f"v{i}") for i in range(1200)], "node long, v string")
    got = sorted(map(tuple, near_dups.with_both(pairs, values, "v").collect()))
    assert got == [(i, 0, f"v{i}", "v0") for i in range(1, 1200)]


def test_a_node_on_the_left_of_many_pairs_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "PAIRS_A_COPY", 20)
    pairs = spark.range(500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    values = spark.range(1001).select(F.col("id").alias("node"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = near_dups.with_both(pairs, values, "text").collect()
    assert sorted((r["a"], r["b"], r["text_a"], r["text_b"]) for r in out) == sorted((1000, i, "t1000", f"t{i}") for i in range(500))
    side = near_dups.with_side(pairs, values, "text", "a", "b", pairs)
    assert side.count() == 500


def test_near_duplicates_empty(spark):
    assert near_dups.near_duplicates(docs_of(spark, [])).count() == 0


# lines


def test_line_dedup(spark):
    texts = ["Boiler plate\nown %d" % i for i in range(12)] + [None, "", "Boiler plate", " Boiler plate\r\nlast"]
    out = lines.dedup_lines(docs_of(spark, texts, [f"s{i % 12}" for i in range(len(texts))]), min_sites=10).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["own %d" % i for i in range(12)] + [None, "", "", "last"]
    assert [r["n_removed"] for r in out] == [1] * 12 + [0, 0, 1, 1]
    kept = lines.dedup_lines(docs_of(spark, texts, [f"s{i % 9}" for i in range(len(texts))]), min_sites=10)
    assert kept.filter("n_removed > 0").count() == 0
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


# contamination


def test_containment_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(500)]
    items = [" ".join(rng.choice(words, n)) for n in (5, 6, 12, 30, 60)] + ["four words are few", "V7 v8", None, ""]
    texts = list(EDGE)
    for item in items[:5]:
        w = item.split()
        for miss in (0, 1, 2, 8):
            own = list(w)
            for at in rng.integers(0, len(own), miss):
                own[at] = "zz"
            texts.append(" ".join([*rng.choice(words, 40), *own, *rng.choice(words, 40)]))
    texts += ["so four words are few indeed", "four words are not few", "v7 v8", "v7", "x, v7! v8 y"]
    grams = lambda t, n: {tuple(w[i : i + n]) for w in ["".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for i in range(len(w) - n + 1)}
    size = lambda item: min(5, len((item or "").split()))
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if size(item) and len(grams(t, size(item)) & grams(item, size(item))) >= 0.8 * len(grams(item, size(item))) - 1e-9}
    assert {(len(texts) - 5, 5), (len(texts) - 3, 6), (len(texts) - 1, 6)} <= want
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contained(docs_of(spark, texts), bench).collect()}
    assert got == want and len(want) > 5
    assert contamination.contained(docs_of(spark, []), bench).count() == 0


# toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(["aa", "bb"])
    words, rows = ["aa", "bb", "abc", ""], rng.integers(0, 4, (5, toxicity.WINDOW))
    mask = np.arange(toxicity.WINDOW) < np.array([24, 3, 10, 1, 24])[:, None]
    y, weight = np.array([1, 0, 1, 0, 1], np.float32), np.ones(5, np.float32)

    def loss():
        z = net.forward(net.project(net.inputs(words)[0]), rows, mask).astype(np.float64)
        return float((np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)).mean())

    for name, g in net.gradients(words, rows, mask, y, weight)[0].items():
        # along the gradient and along a random direction, both sides of the point
        for way in (g, rng.standard_normal(g.shape).astype(np.float32) * (name != "word" or np.arange(len(g))[:, None] > 0)):
            way = way / max(1e-12, float(np.sqrt((way**2).sum())))
            old, step = net.p[name].copy(), 1e-2
            ends = []
            for sign in (1, -1):
                net.p[name] = (old + sign * step * way).astype(np.float32)
                ends.append(loss())
            net.p[name] = old
            assert (ends[0] - ends[1]) / (2 * step) == pytest.approx(float((g * way).sum()), rel=0.02, abs=2e-4), name
    first = loss()
    for _ in range(30):
        net.step(words, rows, mask, y, weight, 0.02)
    assert loss() < 0.7 * first
    scorer = toxicity.Scorer(net)
    at = np.where(mask, scorer.rows_of(words)[rows], 0)
    assert np.allclose(scorer.forward(at), net.forward(net.project(net.inputs(words)[0]), rows, mask), atol=1e-4)


def test_windows_overlap_and_cover():
    for n in (0, 1, 24, 25, 40, 41, 100):
        start, size, text = toxicity.windows(np.array([n]))
        covered = np.zeros(n, int)
        for a, k in zip(start, size, strict=True):
            covered[a : a + k] += 1
        assert (covered > 0).all() and (n == 0) == (len(start) == 0)


def test_toxicity_learns_and_keeps_clean_ones(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(400)]
    for i in range(0, 400, 4):
        own = texts[i].split()
        for at in rng.integers(0, 60, 3):
            own[at] = "zorq" + str(rng.choice(["ul", "am", "ik", "op"]))
        texts[i] = " ".join(own)
    docs = docs_of(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    network = toxicity.learn(docs, labels, F.col("doc_id") < 300)
    out = toxicity.score(docs, network, ["doc_id", "text"]).toPandas().set_index("doc_id")["score"]
    assert out[400] == out[401] == 0
    test = out[(out.index >= 300) & (out.index < 400)]
    called = test >= toxicity.THRESHOLD
    assert called[test.index % 4 == 0].mean() > 0.8 and called[test.index % 4 != 0].mean() < 0.1
    assert toxicity.learn(docs, labels.filter("toxic = 0"), F.lit(True)) is None


# substrings


def brute_cut(rows, window=20):
    seen, out = {}, {}
    words = {i: [w for w in substrings.SEPARATORS.split(t or "") if w] for i, t in rows}
    for i in sorted(words):
        gone = set()
        for a in range(len(words[i]) - window + 1):
            key = tuple(words[i][a : a + window])
            if key in seen:
                gone.update(range(a, a + window))
            else:
                seen[key] = (i, a)
        out[i] = (len(words[i]), len(gone), " ".join(w for p, w in enumerate(words[i]) if p not in gone))
    return out


@pytest.mark.parametrize("blocks", [None, 1, 64])
def test_substrings_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(8)
    words = [f"u{i}" for i in range(200)]
    passages = [" ".join(rng.choice(words, n)) for n in (19, 20, 21, 45)]
    texts = [*EDGE, "a b " * 40, "a b " * 30, "q " * 20, "q " * 20]
    for k in range(40):
        parts = [" ".join(rng.choice(words, rng.integers(0, 30))), passages[k % 4], " ".join(rng.choice(words, 10))]
        texts.append((" ", "\t", "\n ")[k % 3].join(parts))
    texts.append(texts[-1])
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.cut_repeats(docs_of(spark, texts), blocks=blocks).collect()}
    assert out == brute_cut(list(enumerate(texts)))


def test_sketch_filters_alike_at_every_size():
    # the load that one block for BLOCK_CHARS characters has (an anchor for about 38 characters), with one in ten repeated
    rng = np.random.default_rng(6)
    for blocks in (1, 16):
        once = rng.integers(0, 1 << 63, 25_000 * blocks, dtype=np.uint64)
        twice = rng.integers(0, 1 << 63, 1_250 * blocks, dtype=np.uint64)
        block, cells = substrings.cells_of(np.concatenate([once, twice, twice]), blocks)
        passed = np.zeros(len(cells), bool)
        for b in range(blocks):
            passed[block == b] = substrings.counted_twice(cells[block == b])
        assert passed[len(once) :].all() and passed[: len(once)].mean() < 0.15


def test_sketch_marks_every_repeated_anchor(spark):
    rng = np.random.default_rng(9)
    words = [f"y{i}" for i in range(5000)]
    passage = " ".join(rng.choice(words, 40))
    texts = [" ".join(rng.choice(words, 200)) + (" " + passage if i % 9 == 0 else "") for i in range(60)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, variant long, text string").repartition(7)
    got = {r["doc_id"]: len(r["ordinals"]) // 4 for r in substrings.repeated_anchors(df, 4).collect()}
    assert set(got) >= set(range(0, 60, 9)) and len(got) < 20 and all(got[i] >= 2 for i in range(0, 60, 9))


def test_an_anchor_in_every_part(spark, monkeypatch):
    """A passage that all documents share fills one block with rows; it is answered as it comes, and nothing else changes."""
    monkeypatch.setattr(substrings, "TEXT_BYTES", 300)
    passage = " ".join(f"shared{i}" for i in range(30))
    docs = [(i, f"own{i} words{i} " + " ".join(f"{i}w{k}" for k in range(25)) + " " + passage) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    whole = sorted(map(tuple, substrings.cut_repeats(df, blocks=1).collect()))
    assert [r[2] for r in whole] == [0] + [30] * 59
    monkeypatch.setattr(substrings, "WAITING_BYTES", 50)
    assert sorted(map(tuple, substrings.cut_repeats(df, blocks=1).collect())) == whole


def test_substrings_repeated_ids(spark):
    text = " ".join(f"k{i}" for i in range(25))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other " + text), (None, text)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.cut_repeats(df).collect())
    assert out == [(-1, 25, 0), (1, 25, 25), (1, 25, 25), (1, 26, 25)]
    assert substrings.cut_repeats(df.filter("false")).count() == 0


def test_word_hashes():
    h, sizes = hashes.words(pa.array(["a b  c", "", "\tb\n", None, "é c"]))
    assert sizes.tolist() == [3, 0, 1, 0, 2] and h[1] == h[3] and h[2] == h[5] and len(set(h.tolist())) == 4
