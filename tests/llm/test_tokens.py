import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm import bpe, packing, simple8b, tokenization

TEXTS = [None, "", "a", " a  b\n\nc ", "The cat's mat, the end.\n", "日本語 テキスト ١٢ é ü.", "x\x1cy \x85 z", "word " * 900, "q" * 3000, "a <|endoftext|> b", "ends in space \n", "don't. No, no. ÀÉ, ß."]
SCHEMA = "doc_id long, text string, start string, n_tokens int"


def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "y", 2), (None, "no id", "z", 3)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    want, own = library(name), tokenization.words_of(P.path(name))
    for _ in range(2):  # once learning, once remembering
        got = [np.frombuffer(x, np.uint16).tolist() for x in own.encode(TEXTS)]
        assert got == [want(t) for t in TEXTS]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_words_with_marks(name):
    want, own = library(name), tokenization.words_of(P.path(name))
    r = np.random.default_rng(3)
    stems = ["end", "Maß", "é", "e\u0301", "日本", "ǅ", "ʰx", "ª", "don't", "a1", "x_y", "ſ", "İ", "\u0958", "\ufb2a", "ﬁ", "𝒜b", "ـ", ""]
    marks = [".", ",", "!!", "***", ".%%%", "'", "'s", "...'", "\u0338", "=\u0338", "\x01", "\x1c", "…", "</w>", "<|endoftext|>", "_", "~}", "-b", "²", ""]
    words = [a + b for a in stems for b in marks] + [b + a for a in stems for b in marks]
    texts = [r.choice([" ", " ", "  ", "\n"]).join(r.choice(words, 40)) for _ in range(300)] + words
    for _ in range(2):
        assert [np.frombuffer(x, np.uint16).tolist() for x in own.encode(texts)] == [want(t) for t in texts]


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, df = docs(spark)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, path, P.PATTERN, digests=True).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    e = bpe.encoder(path, P.PATTERN)
    assert sorted(map(e.hash.slot, e.tokens)) == list(range(len(e.tokens)))


def test_packing_places_every_id_once(spark):
    rows, df = docs(spark)
    want = library("byte_bpe_50k.json")
    pieces = packing.pack(df, P.path("byte_bpe_50k.json"), with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for i, t, *_ in rows:
        if i == 4:
            continue  # twice
        found = sorted(by_doc[i], key=lambda r: r.start)
        ids = [x for r in found for x in r.ids]
        assert ids == [*want(t), 1] and found[0].start == 0 and all(r.doc_tokens == len(ids) for r in found)
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        total = sum(r.length for r in found)
        assert total == found[0].tier <= 2048 and total & (total - 1) == 0
        assert [r.offset for r in found] == np.cumsum([0, *(r.length for r in found)])[:-1].tolist()
    assert packing.pack(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).count() == 0


def test_simple8b_words():
    r = np.random.default_rng(0)
    for n in (0, 1, 59, 61, 4095, 4097, 9000):
        for most in (1, 2, 50_000, 1 << 31, 1 << 59, 1 << 63):
            v = r.integers(0, most, n, dtype=np.uint64)
            if n > 5:
                v[r.integers(0, n, 3)] = np.uint64(2**64 - 1)
                v[n // 2 :] %= np.uint64(3)
            w, f, e = simple8b.encode_words(v)
            assert (simple8b.decode_words(w, f, e, n) == v).all()
    with pytest.raises(ValueError, match="checksum"):
        simple8b.read_file(simple8b.write_file([1], [np.arange(9)])[:-1] + b"\x00")


def test_files_hold_all_documents_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simple8b, "RANGE_DOCS", 3)
    monkeypatch.setattr(simple8b, "FILE_IDS", 64)
    rows, df = docs(spark)
    want = library("word_bpe_49k.json")
    simple8b.write(df, P.path("word_bpe_49k.json"), str(tmp_path / "ids"))
    got = sorted(simple8b.read(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == sorted((x[0] for x in rows), key=lambda i: (i is not None, i))
    for r in got:
        ids = [*want("no id" if r.doc_id is None else TEXTS[r.doc_id]), 1]
        assert (r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    simple8b.write(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert simple8b.read(spark, str(tmp_path / "none")).count() == 0


def test_files_split_a_hot_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simple8b, "RANGE_DOCS", 3)
    rows = [(7 if i % 3 else (None if i % 2 else i), f"text {i} of many", "x") for i in range(60)]
    path = str(tmp_path / "ids")
    simple8b.write(spark.createDataFrame(rows, "doc_id long, text string, range string"), P.path("word_bpe_49k.json"), path)
    got = sorted(simple8b.read(spark, path).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(-1 if i is None else i for i, *_ in rows)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    plain = tokenization.encode([t for _, t, _ in rows], P.path("word_bpe_49k.json"))
    assert sorted(tuple(r.ids) for r in got) == sorted((*x.tolist(), 1) for x in plain)
    files = spark.read.format("binaryFile").load(path)
    assert files.select("range").distinct().count() > 8
    one = files.select("content", "n_ids").first()
    assert sum(map(len, simple8b.read_file(one["content"])[1])) == one["n_ids"]


def test_step_groups_are_balanced():
    r = np.random.default_rng(4)
    packer = packing.Packer()
    lengths = [*r.integers(1, 300, 3000).tolist(), *r.integers(1, 3000, 300).tolist(), 70_000]
    packed = packer.pack(lengths)
    step, n = packer.steps(packed)
    tiers, tokens, load = {}, [0] * n, [0] * n
    for (length, pieces), j in zip(packed, step, strict=True):
        tiers.setdefault(j, set()).add(max(length, 256))
        tokens[j] += length
        load[j] += sum(k * k for _, _, k in pieces)
    assert len(tiers) == n and all(len(t) == 1 for t in tiers.values()) and sum(tokens) == sum(lengths)
    for tier in {t for x in tiers.values() for t in x}:
        mine = [j for j in range(n) if tiers[j] == {tier}]
        if len(mine) > 1:
            assert max(tokens[j] for j in mine) <= 1.1 * min(tokens[j] for j in mine)
            heaviest = max(sum(k * k for _, _, k in p) for length, p in packed if max(length, 256) == tier)
            assert max(load[j] for j in mine) - min(load[j] for j in mine) <= 2 * heaviest
    assert packer.steps([]) == ([], 0) and packer.steps([(2, [(0, 0, 2)])]) == ([0], 1)
