"""Shards (1) and packing (6) against the tokenizer library itself."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import common, packing, sstable, tokens

HARD = ["", " ", "a  b", "a \n b", "\tx\u00a0y\u2003z", "don't  we'll I'M", "x1y2 3.14% ab12", "é😀 \u4e2d\u6587 عربى", "a" * 300, "--==!! ok", "İstanbul ǅ ß ſ K", "\r\n\r\n x", "e\u0301 o\u0308!", "<|endoftext|> <|startoftext|>", "x²½ a\u200bb", "l'été d’été l'a 'S 's", "\x85 a\x1cb \x00", "foo_bar __init__ $5,000.00", "ÀB Ça ñandú", "a.b.c ...d", "say <|endoftext|>now", "3\u00d74, a\u00d7, b\u00f7c.", "x\u00a0 y", "x \u00a0y", "x\u00a0\n\n y", "x  \u2009y", "end \u00a0", "end\u00a0 ", " lead", "\n lead", "two\n\nlines", "tail \n", "w" * 70 + " " + "v" * 200 + "!", "\u00a0", "\u3000 \u3000x", "a\u00aa,b \u00ba."]


def _library(name):
    return Tokenizer.from_file(tokens.tokenizer_path(name))


@pytest.mark.parametrize(("name", "end", "drops"), [("byte_bpe_50k.json", 0, False), ("word_bpe_49k.json", 1, True)])
def test_chunks_give_the_ids_of_the_whole_text(spark, sf_dir, name, end, drops):
    lib, enc = _library(name), tokens.Encoder(tokens.tokenizer_path(name), end, drops)
    texts = HARD + [r.text for r in common.table(spark, sf_dir, "documents").collect()]
    for text, got in zip(texts, enc.encode_many(texts)):
        assert got.tolist() == [*lib.encode(text or "", add_special_tokens=False).ids, end], text[:80]


def test_random_texts_in_chunks(spark):
    rng = np.random.default_rng(3)
    letters = list("aZé9 \n\t.,'!-_ßœ中😀\u00a0\u2028İ´²×÷\u0301ª")
    texts = ["".join(rng.choice(letters, 30)) for _ in range(3000)]
    for name, end, drops in (("byte_bpe_50k.json", 0, False), ("word_bpe_49k.json", 1, True)):
        lib, enc = _library(name), tokens.Encoder(tokens.tokenizer_path(name), end, drops)
        for text, got in zip(texts, enc.encode_many(texts)):
            assert got.tolist() == [*lib.encode(text, add_special_tokens=False).ids, end], repr(text)


def test_op1_returns_what_the_files_hold(spark, sf_dir):
    lib = _library("byte_bpe_50k.json")
    want, at = {}, 0
    for r in common.table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.op1_sstable(spark, sf_dir).collect()}
    assert got == want


def test_shards_of_odd_documents_and_lookup(spark, odd, none):
    manifest = sstable.write_shards(odd, common.scratch(spark, "t"), tokens.tokenizer_path("byte_bpe_50k.json"), 0)
    rows = sstable.read_shards(manifest).collect()
    assert len(rows) == odd.count()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(rows, key=lambda r: r.start)]
    assert keys == sorted(keys)
    assert [len(x) for x in sstable.lookup(manifest, 5)] == [1]
    assert len(sstable.lookup(manifest, 9)) == 2
    assert sstable.lookup(manifest, 123) == []
    empty = sstable.write_shards(none, common.scratch(spark, "t"), tokens.tokenizer_path("byte_bpe_50k.json"), 0)
    assert sstable.read_shards(empty).count() == 0


def _check_packing(pieces, docs, capacity):
    """docs: {(doc_id, number of ids): how many such documents}."""
    room = defaultdict(list)
    for r in pieces:
        room[r.sequence_id].append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sum(r.length for r in pieces) == sum(n * k for (_, n), k in docs.items())
    return sum(r.length for r in pieces) / (len(room) * capacity) if room else 1


def test_op6_packs_every_id_once_with_little_padding(spark, sf_dir):
    lib = _library("word_bpe_49k.json")
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in common.table(spark, sf_dir, "documents").collect()}
    pieces = packing.op6_harmonic_packing(spark, sf_dir).collect()
    spans = defaultdict(list)
    for r in pieces:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(ids, "<u4").tobytes()))
        spans[r.doc_id].append((r.start, r.start + r.length))
    for doc, parts in spans.items():
        parts.sort()
        assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == len(want[doc])
    assert spans.keys() == want.keys()
    assert _check_packing(pieces, {(k, len(v)): 1 for k, v in want.items()}, 2048) > 0.9


def test_packing_of_odd_and_no_documents(spark, odd, none):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(odd, path, 1, True, with_ids=True)
    lib = _library("word_bpe_49k.json")
    total = sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    pieces = rows.collect()
    assert sum(r.length for r in pieces) == total
    _check_packing(pieces, {(0, total): 1}, 2048)
    assert sum(len(r.ids) for r in packing.sequences(rows).collect()) == 4 * total
    assert packing.pack(none, path, 1, True).count() == 0


def test_harmonic_classes_hold_a_fixed_number_of_pieces(spark):
    df = spark.range(10_000).selectExpr("id doc_id", "0L start", "cast(300 + id % 40 as long) length", "id ids_crc32", "300L doc_tokens")
    rows = packing.place(common.written(df, "t"), bucket_rows=500).groupBy("sequence_id").count().collect()
    assert sum(r["count"] for r in rows) == 10_000
    assert sum(r["count"] != 6 for r in rows) <= 2


def test_cuts_cover_the_length():
    for n in [*range(1, 3000), 100_003]:
        parts = packing.cuts(n)
        assert sum(parts) == n and max(parts) <= 2048
