"""Token files, packing, BPE, media, licenses and quality rules against plain Python."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from psephos.llm import byte_bpe, license_scan, matroska, packing, pieces, quality_ledger, token_blocks
from psephos.llm.queries import BYTE_BPE, BYTE_BPE_MULTI

WORDS = "the a and läuft idiot l'été señor 123 ... don't 漢字 x y <|endoftext|> %%% \U0001f600".split(" ")


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "  ", "\n", " \n ", ",  ", ""]) for _ in range(n))


ROWS = [(i, text(i, i % 40)) for i in range(30)] + [(30, None), (31, ""), (32, "word " * 60_000), (7, text(7, 7)), (None, "no id"), (33, " \t\n "), (34, "a\0b  c")]
CLASHES = ("start", "score", "length", "media", "ids", "node", "words", "kept")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def order(row):
    return (row[0] is not None, row[0], row[1] is not None, row[1])


def test_empty_tables(none):
    assert token_blocks.token_file_query(none, BYTE_BPE).count() == 0
    assert packing.pack_documents(none, BYTE_BPE).count() == 0
    assert byte_bpe.round_trip_digests(none, BYTE_BPE_MULTI).count() == 0
    assert matroska.media_digests(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert quality_ledger.judged(none).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é.,'\n\t 1% 　漢\0")) | st.characters(max_codepoint=0x9000), max_size=40))
def test_pieces_equal_the_library(x):
    from tokenizers import Tokenizer

    if not hasattr(test_pieces_equal_the_library, "t"):
        test_pieces_equal_the_library.t = Tokenizer.from_file(BYTE_BPE)
    ids = np.frombuffer(pieces.library_encoder(BYTE_BPE).encode(x), "<u4").tolist()
    assert ids == test_pieces_equal_the_library.t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("x", ["Hello , world", "end . Next", "end .\nNext", "a\n\n, x", "a\n\n. x", "a\n\n.\nx", "\n, x", "\t. x", "a\x1c, b", "a, b , c. d . e", " , ", " . ", " .\n", "\n\n, "])
def test_signs_after_white_space(x, library, tiktoken_encoding):
    assert np.frombuffer(pieces.library_encoder(BYTE_BPE).encode(x), "<u4").tolist() == library(x)
    assert np.frombuffer(byte_bpe.codec(BYTE_BPE_MULTI)[1].encode(x), "<u4").tolist() == tiktoken_encoding.encode_ordinary(x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
def test_pfor_round_trip(ids):
    reader = token_blocks.PforReader(token_blocks.pfor_encode(np.array(ids, np.uint32)))
    assert reader.read().tolist() == ids
    for b in range(reader.blocks):
        assert reader.read(b, b + 1).tolist() == ids[b * 128 : (b + 1) * 128]


def test_token_file(docs, library):
    got = token_blocks.token_file_query(docs, BYTE_BPE).collect()
    start, expected = 0, []
    for doc, t in sorted(ROWS, key=order):
        ids = library(t) + [2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == expected


def test_packing(docs, library):
    rows = packing.pack_documents(docs, BYTE_BPE, chunk=6000).collect()
    whole = {}
    for doc, t in ROWS:
        whole.setdefault(doc, []).append(library(t) + [1])
    covered, sequences = Counter(), {}
    for r in rows:
        ids = next(i for i in whole[r.doc_id] if len(i) == r.doc_tokens)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.length > 0
        covered[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {d: sum(map(len, i)) for d, i in whole.items()}
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
        short += at < 2048
    assert short <= 3 * 11


def test_short_remainders_are_planned():
    """A histogram of short remainders goes into combinations of many pieces, not into the run."""
    r = np.random.default_rng(1)
    histogram = np.bincount(np.clip(r.geometric(1 / 8, 20_000), 1, 63), minlength=64)[1:]
    planned = sum(sum(classes) * times for classes, times in packing.plan(histogram, 64))
    assert planned > 0.95 * (histogram * np.arange(1, 64)).sum()
    table = packing.combinations(64, 3)
    assert (table @ np.arange(1, 64) == 64).all() and len({tuple(x) for x in table.tolist()}) == len(table)
    assert all((x > 0).sum() <= 2 or x.sum() <= 3 for x in table)


def test_long_units_are_not_cached(library):
    encoder = pieces.library_encoder(BYTE_BPE)
    x = "漢字" * 5000 + " " + "Zq9" * 4000
    assert np.frombuffer(encoder.encode(x), "<u4").tolist() == library(x)
    assert max(map(len, encoder.ids)) <= pieces.MOST_CHARS


def test_nnls_and_plan():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([3.0, 1.0])), [3, 1])
    assert (packing.nnls(np.eye(2), np.array([1.0, -1.0])) >= 0).all()
    histogram = np.zeros(63, np.int64)
    histogram[31], histogram[15], histogram[47] = 11, 40, 40
    plan = packing.plan(histogram, 64)
    used = Counter(k for classes, n in plan for k in classes for _ in range(n))
    assert all(sum(classes) == 64 for classes, _ in plan) and all(used[k] <= histogram[k - 1] for k in used)
    assert used[16] == used[48] == 40 and used[32] == 10


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE_MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, tiktoken_encoding):
    expected = []
    for doc, t in ROWS:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        expected.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0], r[2])
    assert sorted(map(tuple, byte_bpe.round_trip_digests(docs, BYTE_BPE_MULTI).collect()), key=key) == sorted(expected, key=key)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefgh étheing", max_size=30), st.text(alphabet="the éing", max_size=8), st.integers(0, 30), st.integers(0, 6))
def test_prefix_table(x, more, at, cut):
    bpe = byte_bpe.codec(BYTE_BPE_MULTI)[0]
    plain = lambda data: [bpe.ranks[p] for p in bpe.merges(data)]
    data = x.encode()
    table = byte_bpe.PrefixTable(bpe, data)
    assert all(table.tokens(i) == plain(data[:i]) for i in range(len(data) + 1))
    table.append(more.encode())
    assert table.tokens() == plain(data + more.encode())
    data += more.encode()
    start, stop = min(at, len(data)), min(at + cut, len(data))
    table.edit(start, stop, b"ing")
    changed = data[:start] + b"ing" + data[stop:]
    assert table.data == changed and table.last == byte_bpe.PrefixTable(bpe, changed).last


def test_media(docs):
    got = {(r.doc_id, r.payload_sha256): r for r in matroska.media_digests(docs).collect()}
    for doc, t in ROWS:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[doc, hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert hashlib.sha256(matroska.mux_payload(payload)).hexdigest() == r.media_sha256


def test_packet_table(docs):
    packets = matroska.packet_table(matroska.mux_documents(docs.filter("doc_id = 32"))).orderBy("offset").collect()
    assert [p.timestamp_ns for p in packets] == [i * 32_000_000 for i in range(len(packets))]
    assert sum(p.size for p in packets) == 300_032 and all(p.track == 1 and p.keyframe for p in packets)


def test_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 255, b"c", b"d" * 20]
    xiph = bytes([3, 255, 45, 255, 0, 1]) + b"".join(frames)
    flag, ebml = matroska._laced(frames)
    blocks = [matroska._element(matroska.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([f << 1]) + d) for f, d in ((1, xiph), (flag, ebml), (0, b"zz"))]
    group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, b"\x81\xff\xff\x00yy"))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska._uint(matroska.TIMESTAMP, 100) + b"".join(blocks) + group
    data = matroska._HEAD + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska._TRACKS + cluster + cluster
    media = matroska.parse(data)
    assert media.error is None and media.clusters == 2 and len(media.packets) == 20 and media.tracks == [(1, 2, "A_PCM/INT/LIT")]
    assert [data[p.offset : p.offset + p.size] for p in media.packets[:8]] == frames * 2
    assert media.packets[8].timestamp_ns == 105_000_000 and media.packets[9].timestamp_ns == 99_000_000
    broken = matroska.parse(data[:-3])
    assert broken.error and len(broken.packets) == 19
    assert matroska.parse(None).packets == [] and matroska.parse(b"\0junk").error


def test_block_groups():
    m, e, u = matroska, matroska._element, matroska._uint
    track = lambda n, *more: e(m.TRACK_ENTRY, u(m.TRACK_NUMBER, n) + u(m.TRACK_TYPE, 1) + e(m.CODEC_ID, b"V_X") + b"".join(more))
    xiph = bytes([2, 2, 1]) + b"aabcc"
    group = lambda n, *more: e(m.BLOCK_GROUP, b"".join([*more[:1], e(m.BLOCK, bytes([0x80 | n]) + b"\x00\x07\x02" + xiph), *more[1:]]))
    cluster = e(m.CLUSTER, u(m.TIMESTAMP, 1000) + group(1) + group(1, e(m.REFERENCE_BLOCK, b"\xff")) + group(2, b"", u(m.BLOCK_DURATION, 30)) + group(3, u(m.BLOCK_DURATION, 30), e(m.REFERENCE_BLOCK, b"\x01")))
    data = m._HEAD + e(m.SEGMENT, m._INFO + e(m.TRACKS, track(1) + track(2) + track(3, u(m.DEFAULT_DURATION, 40_000_000))) + cluster)
    media = m.parse(data)
    assert media.error is None and [p.keyframe for p in media.packets] == [True] * 3 + [False] * 3 + [True] * 3 + [False] * 3
    ms = [p.timestamp_ns // 1_000_000 - 1007 for p in media.packets]
    assert ms == [0] * 6 + [0, 10, 20] + [0, 40, 80]
    assert [data[p.offset : p.offset + p.size] for p in media.packets[:3]] == [b"aa", b"b", b"cc"]


def walked(data):
    """The payload and the cues of a file, by its element sizes alone."""
    payload, cues, clusters, segment = [], [], [], 0

    def number(at, keep=False):
        width = 9 - data[at].bit_length()
        value = int.from_bytes(data[at : at + width], "big")
        return (value if keep else value & (1 << 7 * width) - 1), at + width

    def level(at, end):
        nonlocal segment
        while at < end:
            start = at
            tag, at = number(at, keep=True)
            size, at = number(at)
            if tag == 0x18538067:
                segment = at
            if tag == 0x1F43B675:
                clusters.append(start - segment)
            if tag in (0x18538067, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7):
                level(at, at + size)
            elif tag == 0xF1:
                cues.append(int.from_bytes(data[at : at + size], "big"))
            elif tag == 0xA3:
                body = at + 4
                lacing = data[at + 3] >> 1 & 3
                if lacing:
                    frames, body = data[body] + 1, body + 1
                    for _ in range(frames - 1 if lacing == 3 else 0):  # sizes, of no matter for the payload
                        _, body = number(body)
                payload.append(data[body : at + size])
            at += size

    level(0, len(data))
    return b"".join(payload), cues, clusters


def test_media_by_another_reader(docs):
    media = {(r.doc_id, r.n_bytes): bytes(r.media) for r in matroska.mux_documents(docs).collect()}
    for doc, t in ROWS:
        data = (t or "").encode()
        payload, cues, clusters = walked(media[doc, len(data)])
        assert payload == data + bytes(-len(data) % 64 or (0 if data else 64)) and cues == clusters


def test_media_features(docs):
    """The feature of every document, from its bytes alone."""
    for r in matroska.media_digests(docs).collect():
        t = next(t or "" for d, t in ROWS if d == r.doc_id)
        payload = t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))
        n, high = len(payload), [b >= 128 for b in payload]
        blocks, clusters = -(-n // 2048), -(-n // 32768)
        last = (n - 1) // 256 * 256
        expected = {
            "clusters": clusters, "blocks": blocks, "packets": -(-n // 256), "cues": clusters, "ms": last * 1000 // 8000 + (n - last) * 1000 // 8000,
            "sum": sum(payload), "energy": sum(b * b for b in payload), "crossings": sum(a != b for a, b in zip(high, high[1:], strict=False)), "largest": min(n, 256),
        }
        assert r.feature == ";".join(f"{k}={v}" for k, v in expected.items()) and r.payload_bytes == n


def test_licenses(spark, docs):
    rows = [(1, "Released under the MIT License."), (2, "x " * 300 + "Licensed, under the apache-license VERSION 2.0 mit license " + "y " * 300), (3, "clean words"), (4, None), (5, "Licensed under CC BY-NC 4.0."), (6, "permission is granted free of charge to any person obtaining a copy of this software and documentation files the software to deal in the software without restriction")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word) == ("mit", "mit", 1, 3)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 303, 308, "apache,mit")
    assert (got[3].labels, got[3].score, got[3].first_word, got[4].n_words) == ("", 0.0, None, 0)
    assert got[5].labels == "cc-by-nc" and got[5].base_labels == "" and got[6].labels == "mit"
    assert license_scan.scan(docs).count() == len(ROWS)


def test_license_join_is_exact(spark):
    """Every window against every template, without filters."""
    r = random.Random(3)
    vocabulary = sorted({w.decode() for _, t, *_ in license_scan.TEMPLATES.values() for w in license_scan.words_of(t)}) + ["foo", "bar", "baz"] * 9
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(150))]
        own = license_scan.words_of(r.choice(list(license_scan.TEMPLATES.values()))[1])
        at = r.randrange(len(words) + 1)
        words[at:at] = [w.decode() if r.random() > 0.12 else "foo" for w in own]
        rows.append((i, " ".join(words)))
    got = {(b.doc_id, b.template, b.first_word) for b in license_scan.matching_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = set()
    for i, t in rows:
        words = license_scan.words_of(t)
        for name, (_, template, *_) in license_scan.TEMPLATES.items():
            own = license_scan.words_of(template)
            c = next(c for c in (8, 16, 32, 64) if len(own) <= c)
            for first in range(0, max(1, len(words)), c):
                if len(set(own) & set(words[first : first + 2 * c])) >= 0.8 * len(set(own)) - 1e-9:
                    expected.add((i, name, first))
    assert got == expected


@pytest.mark.parametrize("name", [n for n, t in license_scan.TEMPLATES.items() if len(t) > 2])
def test_licenses_need_their_naming_words(name):
    label, template, naming = license_scan.TEMPLATES[name]
    scanner = license_scan.Scanner({})
    words = license_scan.words_of(template)
    assert any(b[0] == name and b[5] for b in scanner.blocks(words))
    for word in license_scan.words_of(naming):
        other = [b"other" if w == word else w for w in words]
        assert not any(b[1] == label and b[5] for b in scanner.blocks(other))


def test_licenses_that_look_alike(spark):
    rows = list(enumerate(["Licensed under CC BY 4.0", "Released under the Apache License", "Released under the BSD License", "Licensed under CC BY-NC 4.0", "Released under the MIT License"]))
    got = {r.doc_id: (r.labels, r.n_blocks) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(5)] == ["", "apache", "", "cc-by-nc", "mit"] and all(n for _, n in got.values())


def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs):
    more = [(100, "a b c a b c a"), (101, "x\nx\n\n \nx\ny"), (102, "# * $%&|<>"), (103, "a b c d a b c e a b c"), (104, "word " * 49), (105, " ".join(f"w{i}" for i in range(60)))]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r.doc_id), *(r[n] for n in names), r.base_failed) for r in quality_ledger.judged(d).collect())
    expected = []
    for doc, t in ROWS + more:
        p = plain_quality(t)
        expected.append((str(doc), *p, p[0] < 50 or 100 * p[4] > 50 * p[0]))
    assert got == sorted(expected)


def test_repeated_windows_whatever_the_hash(spark):
    """With a hash of three values nearly all windows collide, and the words decide."""
    r = random.Random(4)
    rows = [(i, [r.choice("abc") for _ in range(r.randrange(40))]) for i in range(60)] + [(100, []), (101, ["a"]), (102, ["a", "b", "c"]), (103, ["a"] * 9)]
    d = spark.createDataFrame(rows, "doc_id long, words array<string>")
    got = {x.doc_id: (x.weak, x.strong) for x in d.select("doc_id", F.expr(quality_ledger.repeats("pmod(xxhash64({0}), 3)")).alias("weak"), F.expr(quality_ledger.repeats()).alias("strong")).collect()}
    assert got == {i: (plain_quality(" ".join(w))[4],) * 2 for i, w in rows}


def test_quality_policies(spark, docs):
    rows = quality_ledger.ledger(docs)
    kept = rows.filter(quality_ledger.passes("v2")).count()
    for r in quality_ledger.ablations(rows).collect():
        assert r.kept_without == kept + r.alone and r.failed >= r.alone
    passing = quality_ledger.passing(docs)
    assert passing.columns == docs.columns and passing.count() == kept
