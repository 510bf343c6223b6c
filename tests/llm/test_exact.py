"""Operators whose results are exact: against tiktoken, DuckDB, brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from glyphmill.llm import byte_bpe, components, fair_mix, gif_media, graph_dedup, license_scan, minhash_dedup
from glyphmill.llm.common import Scratch
from glyphmill.llm.textscan import chunks

from .helpers import duck, empty_documents, odd_documents, odd_rows, prose, same_rows, write


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_boundaries_are_those_of_the_pattern(reference_encoding):
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "\u0085", "\x1c", "\U0001f643", "漢", "..", "’"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + ["a" * 3000, "ab" * 2000 + " " * 40]
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    memo = byte_bpe.Memo(byte_bpe.load_ranks(path), byte_bpe._pairs(path), entries=500)
    at = 0
    for lo, hi, raw, off in chunks(pa.array(texts), 4096):
        start, data = byte_bpe.boundaries(raw, off), raw.tobytes()
        cut = [*start.tolist(), len(raw)]
        first = np.searchsorted(start, off).tolist()
        pieces = [data[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        memo.learn(pieces)
        for d in range(hi - lo):
            ids = np.frombuffer(b"".join(memo[p] for p in pieces[first[d] : first[d + 1]]), "<u4").tolist()
            assert ids == reference_encoding.encode_ordinary(texts[at])
            assert byte_bpe.decode_ids(np.array(ids, "<u4"), path) == texts[at].encode()
            at += 1


def test_op2(spark, tmp_path, reference_encoding):
    where = write(spark, tmp_path, documents=odd_documents(spark))
    got = byte_bpe.op2_byte_bpe(spark, where).collect()
    assert len(got) == odd_documents(spark).count()
    texts = {r[0]: r[1] for r in odd_rows()} | {None: "no id here at all today"}
    for r in got:
        text = texts[r.doc_id] or ""
        ids = reference_encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def documents(spark, texts, **more):
    """Documents with ids from 0 on; ``more`` has other ids, sources."""
    n = len(texts)
    ids, sources = more.get("ids", range(n)), more.get("sources", ["a"] * n)
    return spark.createDataFrame([(i, t, "en", s, 1, *[None] * 10) for i, t, s in zip(ids, texts, sources, strict=True)], odd_documents(spark).schema)


def test_op9_op10_against_sql(spark, tmp_path):
    where = write(spark, tmp_path, documents=odd_documents(spark))
    same_rows(license_scan.op9_license_scan(spark, where), *duck(where, license_scan.ORACLE, "documents"))
    same_rows(fair_mix.op10_fair_mix(spark, where), *duck(where, fair_mix.ORACLE, "documents"))


def test_op9_wrapped_notices(spark, tmp_path):
    """Notices wrapped at any width, among prose, with a word or two missing; and a letter that only Unicode lower-cases to k."""
    rng = random.Random(11)
    texts = ["wor\u212a is licensed under the gnu general public license version 3", "this work is licensed under the gnu\ngeneral public license version 3"]
    for label, t in license_scan.TEMPLATES.items():
        for missing in (0, 1, 30):
            words = [w.upper() if rng.random() < 0.3 else w for w in t.split()]
            for _ in range(min(missing, len(words) // 2)):
                words.pop(rng.randrange(len(words)))
            cut = "".join(w + rng.choice([" ", " ", "\r\n # ", ", "]) for w in words)
            texts.append(prose(rng, rng.randint(0, 300)) + "\n" + cut + "\n" + prose(rng, rng.randint(0, 300)))
    where = write(spark, tmp_path, documents=documents(spark, texts))
    got = license_scan.op9_license_scan(spark, where)
    same_rows(got, *duck(where, license_scan.ORACLE, "documents"))
    labels = {r.doc_id: r.labels.split(",") for r in got.collect()}
    assert "gpl-3.0" not in labels[0] and "gpl-3.0" in labels[1]
    for k, label in enumerate(license_scan.TEMPLATES):
        assert label in labels[2 + 3 * k] and label not in labels[4 + 3 * k]


@pytest.mark.parametrize("edge_rows", [10_000, 3])
def test_op10_ids_sources_and_the_edge(spark, tmp_path, monkeypatch, edge_rows):
    """Null and repeated ids, more sources than are broadcast, and the budget's end found in ever smaller bins."""
    monkeypatch.setattr(fair_mix, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(fair_mix, "BINS", 8)
    monkeypatch.setattr(fair_mix, "BROADCAST_SOURCES", 5)
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(400)]
    where = write(spark, tmp_path, documents=documents(spark, texts, ids=[rng.choice([None, i % 50, i, i, i]) for i in range(400)], sources=[rng.choice([None, *"aaaaaaaabcdefgh"]) for _ in range(400)]))
    same_rows(fair_mix.op10_fair_mix(spark, where), *duck(where, fair_mix.ORACLE, "documents"))


def test_mix_rows_takes_what_the_mix_says(spark):
    """Of rows of one id each is taken by itself; with equal rows, and names that clash."""
    rng = random.Random(7)
    texts = [f"w{i} " + prose(rng, rng.randint(1, 9)) for i in range(12)]
    rows = [(None, texts[0], "a", 1), (None, texts[1], "a", 2), (None, texts[2], "b", 3), (7, texts[3], "a", 4), (7, texts[4], "a", 5), *[(8, texts[5], "a", k) for k in range(9)], *[(20 + k, t, "b", 0) for k, t in enumerate(texts[6:])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long").repartition(3)
    mixed = fair_mix.mix(df).toPandas()
    got = fair_mix.mix_rows(df)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert sum(len(r[1].split()) for r in kept) == mixed.taken.sum() <= 1.5 * sum(len(r[1].split()) for r in rows)
    assert all(kept.count(r) <= 2 for r in rows) and set(kept) <= set(rows)
    assert sorted(kept, key=repr) == sorted(map(tuple, fair_mix.mix_rows(df.repartition(2)).collect()), key=repr)


def test_op5_against_sql(spark, tmp_path):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):  # near copies, some beyond the threshold, some only by way of another
            base = list(base)
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    rows = [(i, t, "en", "a", 1, *[None] * 10) for i, t in enumerate(texts, 100)]
    rows += [(3, texts[0], "en", "a", 1, *[None] * 10), (3, texts[-1], "en", "a", 1, *[None] * 10), (None, texts[0], "en", "a", 1, *[None] * 10)]  # ids of several texts, texts without id
    docs = odd_documents(spark).unionByName(spark.createDataFrame(rows, odd_documents(spark).schema))
    where = write(spark, tmp_path, documents=docs)
    same_rows(minhash_dedup.op5_minhash_dedup(spark, where), *duck(where, minhash_dedup.ORACLE, "documents"))


def test_op5_in_small_blocks(spark, tmp_path, monkeypatch):
    """Many texts that share buckets but do not all link: every block pair is compared."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rng = random.Random(8)
    base = prose(rng, 90).split()
    texts = []
    for _ in range(40):
        other = list(base)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    rows = [(i, t, "en", "a", 1, *[None] * 10) for i, t in enumerate(texts)]
    where = write(spark, tmp_path, documents=spark.createDataFrame(rows, odd_documents(spark).schema))
    same_rows(minhash_dedup.op5_minhash_dedup(spark, where), *duck(where, minhash_dedup.ORACLE, "documents"))


def test_op5_repeated_and_null_ids(spark):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(odd_documents(spark)).collect()}
    assert (None, None, True) in got and (5, 4, False) in got and (6, 4, False) in got and (0, 0, True) in got
    assert minhash_dedup.keep_one(odd_documents(spark)).filter("doc_id = 4").count() == 1


def thue_morse(n, a, b):
    """A word and its complement, which every polynomial hash modulo 2^64 takes for one another from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_op5_words_that_a_polynomial_hash_confuses(spark, tmp_path):
    x, y = thue_morse(2048, "a", "b")
    tail = prose(random.Random(1), 60)
    texts = [f"p q r s {x}", f"p q r s {y}", x, y, f"{x} {tail}", f"{y} {tail}"]
    where = write(spark, tmp_path, documents=spark.createDataFrame([(i, t, "en", "a", 1, *[None] * 10) for i, t in enumerate(texts)], odd_documents(spark).schema))
    same_rows(minhash_dedup.op5_minhash_dedup(spark, where), *duck(where, minhash_dedup.ORACLE, "documents"))
    got = {r.doc_id: r.component_id for r in minhash_dedup.op5_minhash_dedup(spark, where).collect()}
    assert [got[i] for i in range(6)] == [0, 1, 2, 3, 4, 4]


@pytest.mark.parametrize("hot", [1_000, 20])
def test_op5_hot_keys_are_dealt_out(spark, tmp_path, monkeypatch, hot):
    """Many copies of one text and near copies of another, with every hot key split."""
    from glyphmill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(minhash_dedup, "STAR", 8)
    rng = random.Random(9)
    same, base = prose(rng, 50), prose(rng, 80).split()
    texts = [same] * 120 + [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(80)]
    rows = [(i, t, "en", "a", 1, *[None] * 10) for i, t in enumerate(texts)]
    where = write(spark, tmp_path, documents=spark.createDataFrame(rows, odd_documents(spark).schema))
    same_rows(minhash_dedup.op5_minhash_dedup(spark, where), *duck(where, minhash_dedup.ORACLE, "documents"))


def test_keep_one_goes_by_rows(spark):
    """A different text of the same id stays; of equal rows one does; the choice is the same whatever the order."""
    rng = random.Random(3)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (1, b, "y"), (2, a, "x"), (3, c, "x"), (None, a, "x"), (None, None, "x"), (4, None, "x"), (4, None, "x"), (5, " ", "x")]
    want = None
    for order in (rows, rows[::-1]):
        got = sorted(map(tuple, minhash_dedup.keep_one(spark.createDataFrame(order, "doc_id long, text string, t string").repartition(3)).collect()), key=repr)
        assert want is None or got == want
        want = got
    assert [r for r in want if r[1] != b] == sorted([r for r in rows if r[1] != b and r[:2] != (2, a)], key=repr) and len([r for r in want if r[1] == b]) == 1
    assert minhash_dedup.keep_one(empty_documents(spark)).count() == 0


def test_op4_against_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    near = np.repeat(base[:6], 12, axis=0) + rng.normal(scale=0.12, size=(72, 16))
    vectors = [v.tolist() for v in np.concatenate([base, near, near[:5]])] + [None, [], [0.0] * 16, [1.0, float("nan")] * 8, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([*((i, v, i % 3, "x") for i, v in enumerate(vectors)), (3, vectors[3], 1, "again"), (None, vectors[3], 1, "x"), (None, None, 1, "x")], "vec_id long, embedding array<float>, label int, id string")
    where = write(spark, tmp_path, embeddings=df)
    sql = duck(where, graph_dedup.ORACLE, "embeddings")
    same_rows(graph_dedup.op4_graph_dedup(spark, where), *sql)


def test_op4_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c = (rng.normal(size=8).tolist() for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (3, b), (4, b), (4, c), (5, c), (None, a), (None, None), (6, None), (6, None)]
    got = sorted(map(tuple, graph_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 3, False), (None, 0, None, True), (None, 0, None, True), (6, 0, 6, True), (6, 0, 6, True)], key=repr)


def test_op4_parts_shards_that_grow(spark, tmp_path, monkeypatch):
    """Shards of more than CAP vectors are parted, and parted again, and give the rows of SQL."""
    monkeypatch.setattr(graph_dedup, "MOST_SHARDS", 2)
    monkeypatch.setattr(graph_dedup, "CAP", 60)
    monkeypatch.setattr(graph_dedup, "PER_SHARD", 20)
    monkeypatch.setattr(graph_dedup, "PARTS", 4)
    rng = np.random.default_rng(14)
    vectors = np.concatenate([np.repeat(rng.normal(size=(70, 16)), 4, axis=0) + rng.normal(scale=0.08, size=(280, 16)), rng.normal(size=16) + rng.normal(scale=0.05, size=(90, 16))])
    where = write(spark, tmp_path, embeddings=spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int"))
    same_rows(graph_dedup.op4_graph_dedup(spark, where), *duck(where, graph_dedup.ORACLE, "embeddings"))


def test_op4_blocks_of_a_hot_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_dedup, "CAP", 15)
    monkeypatch.setattr(graph_dedup, "PER_SHARD", 20)
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(size=(30, 16)), rng.normal(size=16) + rng.normal(scale=0.1, size=(60, 16))])
    where = write(spark, tmp_path, embeddings=spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int"))
    same_rows(graph_dedup.op4_graph_dedup(spark, where), *duck(where, graph_dedup.ORACLE, "embeddings"))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, 500), (7, None), (60, 0), (3, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("n", [192, 192 * 256, 192 * 700])
def test_gif_round_trip(n):
    rng = random.Random(n)
    for payload in (bytes(rng.randrange(256) for _ in range(n)), b" " * n, bytes(rng.choice(b"ab") for _ in range(n))):
        got = gif_media.read_gif(gif_media.write_gif(payload))
        assert b"".join(f.samples for f in got.frames) == payload
        assert [f.at_ms for f in got.frames] == [100 * i for i in range(len(got.frames))]


def test_gif_frames_palettes_disposal_transparency():
    """Two local palettes, an interlaced frame, a transparent one, restored background and previous canvas; 2-bit codes."""
    import struct

    def image(samples, w, h, left=0, top=0, disposal=0, clear=None, palette=b"", interlaced=False):
        bits = [4]  # a clear code, literals with a clear code before each, so that codes stay 3 bits wide
        for s in samples:
            bits += [s, 4]
        bits = bits[:-1] + [5]
        value = sum(c << (3 * i) for i, c in enumerate(bits))
        data = value.to_bytes(-(-3 * len(bits) // 8), "little")
        flags = (0x81 if palette else 0) | (0x40 if interlaced else 0)
        out = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, clear or 0, 0)
        return out + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + palette + b"\x02" + bytes([len(data)]) + data + b"\0"

    red, blue, green, white = b"\xff\0\0", b"\0\0\xff", b"\0\xff\0", b"\xff\xff\xff"
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 4, 0x81, 1, 0) + red + blue + green + white
    data = head + image([0] * 8, 2, 4) + image([2, 3], 2, 1, 0, 1, disposal=2, clear=3) + image([0, 1, 2, 3], 1, 4, 1, 0, disposal=3, palette=white + white + blue + red, interlaced=True) + image([2], 1, 1) + b";"
    got = gif_media.read_gif(data)
    assert [f.samples for f in got.frames] == [b"\0" * 8, b"\x02\x03", b"\x00\x02\x01\x03", b"\x02"]
    reds = [f.histogram[7] for f in got.frames]  # pixels of full red: red and white
    assert reds == [8, 7, 6, 5] and [f.at_ms for f in got.frames] == [0, 50, 100, 150]
    with pytest.raises(ValueError):
        gif_media.read_gif(b"PNG")


def test_op6(spark, tmp_path):
    where = write(spark, tmp_path, documents=odd_documents(spark))
    texts = {r[0]: r[1] for r in odd_rows()} | {None: "no id here at all today"}
    seen = {}
    for r in gif_media.op6_gif_media(spark, where).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert seen.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    broken = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None)], "doc_id long, media binary")
    assert [r.payload for r in gif_media.media_columns(broken).collect()] == [None, None]


def test_gif_features_against_counting():
    """The histogram of each frame's canvas, counted grey level by grey level."""
    rng = random.Random(5)
    w, rows = gif_media.WIDTH, gif_media.ROWS
    payload = bytes(rng.randrange(256) for _ in range(w * (2 * rows + 7)))
    got, canvas = gif_media.read_gif(gif_media.write_gif(payload)), [0] * (w * rows)
    for i, f in enumerate(got.frames):
        part = payload[i * w * rows : (i + 1) * w * rows]
        canvas[: len(part)] = part
        levels = [sum(x >> 5 == b for x in canvas) for b in range(8)]
        assert f.histogram == levels * 3
    assert len(got.frames) == 3


def test_gif_that_asks_for_any_memory(spark):
    import struct

    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    image = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 65535, 65535, 0) + b"\x08\x00;"
    df = spark.createDataFrame([(1, bytearray(bomb)), (2, bytearray(image)), (3, bytearray(gif_media.write_gif(b" " * 192)))], "doc_id long, media binary")
    assert [r.width for r in gif_media.media_columns(df).orderBy("doc_id").collect()] == [None, None, 192]


def test_slices_decode_by_themselves(spark, reference_encoding):
    import regex

    docs = odd_documents(spark, null_id=False, repeated=False)
    texts = {r[0]: (r[1] or "") for r in odd_rows()}
    pattern = regex.compile(public_tokenizers.PATTERN)
    for r in byte_bpe.encode(docs, slices_col="slices").collect():
        want = [m.encode() for m in pattern.findall(texts[r.doc_id])]
        assert len(r.slices) // 8 == len(want)
        at = 0
        for k, piece in enumerate(want):
            if k < 40:
                assert byte_bpe.decode_slices(bytes(r.ids), bytes(r.slices), k, k + 1) == (at, piece)
            at += len(piece)
        if want:
            assert byte_bpe.decode_slices(bytes(r.ids), bytes(r.slices), 0, len(want)) == (0, texts[r.doc_id].encode())


def test_empty_tables(spark, tmp_path):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    where = write(spark, tmp_path, documents=empty_documents(spark), embeddings=vectors)
    for run in (byte_bpe.op2_byte_bpe, graph_dedup.op4_graph_dedup, minhash_dedup.op5_minhash_dedup, gif_media.op6_gif_media, license_scan.op9_license_scan, fair_mix.op10_fair_mix):
        assert run(spark, where).count() == 0


def test_odd_rows_do_not_crash(spark):
    docs = odd_documents(spark)
    n = docs.count()
    assert license_scan.scan(docs).count() == fair_mix.mix(docs).count() == n
    rows = fair_mix.mix_rows(docs)
    assert rows.columns == docs.columns and rows.count() > 0


def test_mix_comes_near_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 40)), rng.choice("aaaaaaabcd")) for i in range(1500)]
    got = fair_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["source"] = got.doc_id.map({r[0]: r[2] for r in rows})
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 200
    assert (got.taken <= 2 * got["size"]).all() and got.taken.sum() <= 1.5 * got["size"].sum()


def test_op2_decoding_beside_encoding(spark):
    """Bytes decoded in the encoding worker are those of ``decode`` and of the text."""
    docs = odd_documents(spark)
    beside = sorted(map(tuple, byte_bpe.encode(docs, decoded_col="decoded").collect()), key=repr)
    assert beside == sorted(map(tuple, byte_bpe.decode(byte_bpe.encode(docs)).collect()), key=repr)
    assert sorted(bytes(r[2]) for r in beside) == sorted((r["text"] or "").encode() for r in docs.collect())
