"""Empty tables, nulls, repeated rows, ties, long texts and clashing columns; a FLAC stream and packings made by hand."""

import hashlib
import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaptrail.llm import chat, contamination, flac, language, lines, media, near_dups, packing, queries, substrings, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_removed string, media string"
LONG = "many words of a text that goes on " * 30_000


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash", "clash") for i, t, s in rows], DOC)


def crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def by_hand(samples, subframe):
    """A FLAC file of one frame of 8-bit samples, its subframe given as a string of bits."""
    signed = bytes(s & 0xFF for s in samples)
    n = len(samples)
    info = struct.pack(">HH", n, n) + bytes(6) + ((8000 << 44) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0x00, n - 1])
    head += bytes([crc(head, 0x07, 8)])
    subframe += "0" * (-len(subframe) % 8)
    frame = head + int(subframe, 2).to_bytes(len(subframe) // 8, "big")
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + frame + crc(frame, 0x8005, 16).to_bytes(2, "big")


def rice(values, k):
    out = ""
    for v in values:
        u = 2 * v if v >= 0 else -2 * v - 1
        out += "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")
    return out


def bits(v, n):
    return format(v & ((1 << n) - 1), f"0{n}b")


def test_flac_streams_made_by_hand():
    x = [3, 5, 4, -7, 60, -128, 127, 0, 0, 1, 2, 40]
    fixed = bits(9 << 1, 8) + bits(x[0], 8) + "00" + "0000" + bits(3, 4) + rice(np.diff(x).tolist(), 3)
    # linear prediction of order 2 by (3 * a - b) >> 1, the second of two partitions escaped to 9 raw bits
    res = [x[i] - ((3 * x[i - 1] - x[i - 2]) >> 1) for i in range(2, len(x))]
    linear = bits((32 + 1) << 1, 8) + bits(x[0], 8) + bits(x[1], 8) + bits(4 - 1, 4) + bits(1, 5) + bits(3, 4) + bits(-1, 4) + "00" + "0001" + bits(2, 4) + rice(res[:4], 2) + "1111" + bits(10, 5) + "".join(bits(r, 10) for r in res[4:])
    constant, verbatim = bits(0, 8) + bits(-9, 8), bits(1 << 1, 8) + "".join(bits(v, 8) for v in x)
    files = [by_hand(x, fixed), by_hand(x, linear), by_hand([-9] * 12, constant), by_hand(x, verbatim)]
    assert [d.tolist() for d in flac.decode(files)] == [x, x, [-9] * 12, x]
    broken = bytearray(files[1])
    broken[-5] ^= 4
    with pytest.raises(flac.BadFlac):
        flac.decode([bytes(broken)])


def test_flac_wasted_bits():
    x = [8, -16, 24, 0, 120, -128, 64, 8]
    verbatim = "0" + bits(1, 6) + "1" + "001" + "".join(bits(v >> 3, 5) for v in x)
    fixed = "0" + bits(9, 6) + "1" + "001" + bits(x[0] >> 3, 5) + "00" + "0000" + bits(2, 4) + rice((np.diff(x) >> 3).tolist(), 2)
    all_wasted = "0" + bits(1, 6) + "1" + "00000001" + bits(0, 8)
    first, second, third = flac.decode_each([by_hand(x, verbatim), by_hand(x, fixed), by_hand([0] * 8, all_wasted)])
    assert first.tolist() == x and second.tolist() == x
    assert isinstance(third, flac.BadFlac)


#: subframes that can't be read: wasted bits beyond the samples, unknown kind, padding bit, reserved precision, negative
#: shift, unknown coding, uneven partitions
UNREADABLE = [bits(1, 7) + "1" + "0" * 9 + "1", bits(5 << 1, 8), bits(0x90, 8), bits(32 << 1, 8) + bits(0, 8) + "1111", bits(32 << 1, 8) + bits(0, 8) + "0011" + "10000" + "0001" + "00", bits(8 << 1, 8) + "11", bits(8 << 1, 8) + "00" + "1111"]


@pytest.mark.parametrize("subframe", [*UNREADABLE, bits(1 << 1, 8) + bits(77, 24), bits(0, 8)])
def test_flac_frames_inside_frames(subframe):
    """A frame header among the samples of a verbatim frame changes nothing, neither for its file nor for others."""
    rng = np.random.default_rng(5)
    header = bytes([0xFF, 0xF8, 0x14, 0x02, 0x00])
    inside = header + bytes([crc(header, 7, 8)]) + int(subframe.ljust(-(-len(subframe) // 8) * 8, "0"), 2).to_bytes(-(-len(subframe) // 8), "big")
    noise = rng.integers(0, 256, 4 * flac.BLOCK, dtype=np.uint8)
    noise[flac.BLOCK + 20 : flac.BLOCK + 20 + len(inside)] = np.frombuffer(inside, np.uint8) ^ 0x80  # stored signed
    payloads = [b"sound " * 200, noise.tobytes(), b"", b"another" * 100]
    files = flac.encode(payloads)
    assert inside in files[1] and len(flac.find_frames(np.frombuffer(files[1] + bytes(16), np.uint8), len(files[1]))[0]) > 4
    for group in (files, files[1:2], files[::-1]):
        want = [payloads[files.index(f)] for f in group]
        assert [(x.astype(np.int32) + 128).astype(np.uint8).tobytes() for x in flac.decode(group)] == want


def test_flac_damage_stays_with_its_file():
    payloads = [bytes(range(250)) * 4, b"sound " * 400, b"more" * 99]
    files = flac.encode(payloads)
    for at in [*range(0, len(files[1]), 7), len(files[1]) - 1]:
        broken = bytearray(files[1])
        broken[at] ^= 0xFF
        out = flac.decode_each([files[0], bytes(broken), files[2], files[1][:at]])
        assert [isinstance(x, np.ndarray) for x in out[::2]] == [True, True]
        assert isinstance(out[1], flac.BadFlac) or (out[1].astype(np.int32) + 128).astype(np.uint8).tobytes() == payloads[1]  # seek points and unused fields
        assert isinstance(out[3], flac.BadFlac)


def test_media_whole_table(spark):
    """Every payload of a table comes back; one text runs over many blocks."""
    sf_dir = "/root/testdata/sf0.01"
    out = queries.op1_media_columns(spark, sf_dir).select("doc_id", "payload_sha256", "payload_bytes", "problem", "n_blocks").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    padded = {k: v + b" " * (max(192, -(-len(v) // 192) * 192) - len(v)) for k, v in texts.items()}
    assert {r["doc_id"]: r["payload_sha256"] for r in out} == {k: hashlib.sha256(v).hexdigest() for k, v in padded.items()}
    assert len(out) == len(texts) and all(r["problem"] is None and r["payload_bytes"] == len(padded[r["doc_id"]]) for r in out)
    assert max(r["n_blocks"] for r in out) > 1


def test_media_edges(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab")), (1, bytearray(b"ab")), (None, None)], "id int, pcm binary")
    out = media.decode_media(media.encode_media(df, "pcm")).collect()
    assert len(out) == 3 and len({bytes(r["media"]) for r in out if r["id"]}) == 1
    assert media.decode_media(media.encode_media(df.filter("false"), "pcm")).count() == 0


def optimum(lengths, capacity):
    for bins in range(1, len(lengths) + 1):
        for places in itertools.product(range(bins), repeat=len(lengths)):
            if all(sum(n for n, p in zip(lengths, places) if p == b) <= capacity for b in range(bins)):
                return bins
    return 0


def test_packing_against_the_optimum():
    rng = np.random.default_rng(12)
    for _ in range(25):
        x = rng.integers(1, 33, rng.integers(1, 7))
        best = optimum(x.tolist(), 32)
        assert packing.lower_bound(x, 32) <= best <= packing.best_fit_decreasing(x, 32)[2] <= best + 1


def test_packing_pieces_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(None, "One text.", "s"), (2, None, "s"), (3, "same text, twice", "s"), (3, "same text, twice", "s"), (4, LONG[:20_000], "s"), (5, "Zürich's été!!! 12.5 %%% <|x|> café", "s")]
    out = packing.pack_documents(docs_of(spark, rows), queries.tokenizer_path(), capacity=256).collect()
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in out)


def test_language_edges(spark):
    docs = docs_of(spark, [(1, "some english words here", "s"), (1, "some english words here", "s"), (2, LONG, "s"), (None, "words", "s"), (3, None, "s")])
    docs = docs.withColumn("held_out", F.lit(False))
    model = language.learn(docs, F.lit(True))
    out = language.identify(docs, model).collect()
    assert len(out) == 5 and {r["lang_pred"] for r in out} == {"en", "und"}
    # stray values of lang: all are learned; where texts are bounded, those with the most of them
    stray = docs.unionByName(spark.range(100, 140).select(F.col("id").alias("doc_id"), F.lit("nonsense").alias("text"), F.concat(F.lit("x"), "id").alias("lang"), F.lit("s").alias("source"), F.lit(False).alias("held_out")), allowMissingColumns=True)
    assert language.learn(stray, F.lit(True)).languages == ["en", *sorted(f"x{i}" for i in range(100, 140))]
    assert language.learn(stray, F.lit(True), most_texts=2).languages in (["en", "x100"], ["x100"])
    assert language.identify(docs.filter("false"), model).count() == 0 and language.identify(docs, None).filter("lang_pred <> 'und'").count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (None, 0, "assistant", "x"), (2, 5, None, LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = lambda d: chat.read_back(chat.ordered(chat.format_turns(chat.text_parts(d))))
    out = {r["conv_id"]: r for r in read(df).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == hashlib.sha256(b"assistant\nb\nuser\na\nuser\na\n").hexdigest()
    assert out[None]["loss_chars"] == 1 and out[2]["turns_sha256"] == hashlib.sha256(f"\n{LONG}\n".encode()).hexdigest()
    assert read(df.filter("false")).count() == 0


def test_containment_edges(spark):
    item = "one two three four five six"
    docs = docs_of(spark, [(1, LONG + item, "s"), (1, LONG + item, "s"), (None, item, "s"), (2, "one two three four", "s"), (3, None, "s")])
    bench = spark.createDataFrame([(7, item), (7, item), (8, item), (None, item), (9, None)], "item_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in contamination.contained(docs, bench).collect()) == [(0, 7), (0, 8), (1, 7), (1, 8)]
    assert contamination.contained(docs, bench.filter("false")).count() == 0


def test_near_duplicate_edges(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(None, a, "s"), (None, b, "s"), (7, a + " end", "s"), (7, b, "s"), (8, b, "s"), (9, LONG, "s"), (9, LONG, "s")]
    out = sorted(((r["doc_id"] or 0), r["class_id"] or 0, r["class_size"]) for r in near_dups.near_duplicates(docs_of(spark, rows)).collect())
    assert out == [(0, 7, 2), (0, 7, 3), (7, 7, 2), (7, 7, 3), (8, 7, 3), (9, 9, 2), (9, 9, 2)]


def test_line_edges(spark):
    rows = [(i, "shared line\nown " + str(i), f"s{i}" if i else None) for i in range(11)] + [(1, "shared line\nown 1", "s1"), (20, LONG + "\nshared line", "s1")]
    out = lines.dedup_lines(docs_of(spark, rows), min_sites=10).collect()
    assert {r["text"] for r in out} == {f"own {i}" for i in range(11)} | {LONG} and all(r["n_removed"] == 1 for r in out)
    assert lines.dedup_lines(docs_of(spark, rows), min_sites=11).filter("n_removed > 0").count() == 0
    # many lines, shared ones and own ones repeated: places are cut, order and repeats stay
    long = "\n".join(["shared line", "own", "own", " shared line\t", ""] * 20_000)
    row = lines.dedup_lines(docs_of(spark, [*rows, (21, long, "s1")]), min_sites=10).filter("doc_id = 21").head()
    assert row["text"] == "\n".join(["own", "own", ""] * 20_000) and (row["n_lines"], row["n_removed"]) == (100_000, 40_000)


def test_toxicity_edges(spark):
    docs = docs_of(spark, [(i, f"clean words number {i}" if i % 2 else f"foul zorq words {i}", "s") for i in range(40)] + [(1, "clean words number 1", "s"), (50, LONG, "s"), (None, None, "s")])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)] + [(1, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    network = toxicity.learn(docs, labels, F.lit(True))
    out = toxicity.score(docs, network, ["doc_id"]).collect()
    assert len(out) == 43 and all(0 <= r["score"] <= 1 for r in out) and [r["score"] for r in out if r["doc_id"] is None] == [0.0]
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert toxicity.score(docs.filter("false"), network, ["doc_id"]).count() == 0 and toxicity.learn(docs.filter("false"), labels, F.lit(True)) is None


def test_substring_long_text(spark):
    out = substrings.cut_repeats(docs_of(spark, [(1, LONG, "s"), (2, LONG + "end", "s")])).orderBy("doc_id").collect()
    n = len(LONG.split())
    # a text of eight words by turns: the first round of windows stays
    assert [r["n_words"] for r in out] == [n, n + 1] and out[0]["n_removed"] == n - 8 and out[1]["n_removed"] == n


def test_lines_columns_of_any_name(spark):
    clashing = ["__cut", "__whole", "__kept", "__t1", "__t2", "t1", "cut", "whole", "left", "place", "line", "in0", "a.b"]
    df = spark.createDataFrame([(1, "same\nown", f"s{i}", *clashing) for i in range(12)], ["doc_id", "text", "source", *clashing])
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert {tuple(r) for r in out.drop("doc_id", "source").collect()} == {("", *clashing, 2, 2)}


def test_lines_sql_with_null_texts_and_repeated_ids(spark):
    import duckdb

    rows = [(i % 5 if i % 7 else None, f"shared line\nline {i}\n \t" if i % 4 else None, f"s{i % 11}" if i % 6 else None) for i in range(60)]
    rows += [(3, "", "s1"), (3, "shared line", "s2"), (3, "shared line", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    sql = con.sql(queries.OP8_SQL).project("doc_id, n_lines, n_removed, text").fetchall()
    mine = [tuple(r) for r in lines.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "text").collect()]
    assert sorted(map(repr, mine)) == sorted(map(repr, sql)) and len(mine) == 63


def test_toxicity_learns_one_text_of_an_id(spark):
    """Which of an id's texts is learned from doesn't depend on the order of rows."""
    rows = [(i % 40, f"{'bad awful' if i % 2 else 'good fine'} text number {i}", i % 2) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    nets = [toxicity.learn(d, labels, F.lit(True)) for d in (docs.repartition(3), docs.orderBy(F.desc("text")).coalesce(1))]
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)
