"""Tokenised output and packing against the tokenizers library's whole texts."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import jobs, orc_tokens, packing, tokens

TEXTS = ["", "a", " a", "a ", "a  b", "a\n b\n\nc\t d", "don't stop  me now  x", "é è ñ 123 4567", "<|endoftext|> hi <|startoftext|>",
         "Ω≈ç√ ́x \r\n y", "x" * 500, "\x1c a\x1fb \x85c", "中文 字符 日本語", "A  B   C    D", "'s 're it's\n\n\n  end "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_whole_text_ids(name):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokens.public_path(name))
    tok.encode_special_tokens = True
    rng = random.Random(3)
    more = ["".join(rng.choice("ab é\n\t .,'s0  ñ!\r") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    enc = tokens.PieceEncoder(tokens.public_path(name))
    for t in TEXTS + more:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def ids_of(text, name, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokens.public_path(name))
    tok.encode_special_tokens = True
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_orc_round_trip(spark, odd_docs, tmp_path):
    path = str(tmp_path / "orc")
    orc_tokens.write_tokens(odd_docs, path)
    rows = sorted(orc_tokens.digests(orc_tokens.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in rows] == sorted(r["doc_id"] is not None for r in rows)
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known)
    want = Counter()
    for d in odd_docs.collect():
        ids = ids_of(d["text"], "word_bpe_49k.json", 2)
        want[(d["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    one = orc_tokens.read_tokens(spark, path).where("doc_id = 15")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,15)]" in one._jdf.queryExecution().toString()
    assert one.collect()[0]["ids"] == ids_of(odd_docs.where("doc_id = 15").collect()[0]["text"], "word_bpe_49k.json", 2).tolist()


def test_orc_files_hold_bloom_filters(spark, odd_docs, tmp_path):
    path = str(tmp_path / "orc")
    orc_tokens.write_tokens(odd_docs, path)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".orc")]
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == orc_tokens.ROW_INDEX_STRIDE


def check_packing(rows, docs, capacity=2048):
    want = {}
    for d in docs:
        want[d["doc_id"]] = ids_of(d["text"], "byte_bpe_50k.json", 0)
    bins = defaultdict(list)
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= capacity
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for doc, pieces in by_doc.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert sum(p[2] for p in pieces) == len(want[doc]) and all(p[2] == capacity for p in pieces[1:])
        assert len(want[doc]) > capacity or len(pieces) == 1
    return bins


def test_packing_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    bins = check_packing(rows, docs.collect())
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) * 1.03 + 1


def test_packing_odd_documents(odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null and doc_id <> 8")
    check_packing(packing.pack_documents(docs).collect(), docs.collect())
    assert packing.pack_documents(odd_docs).count() >= odd_docs.count()
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), (1.0, 1.0, 1.0)])
def test_plan_respects_every_capacity(rule, weights):
    rng = random.Random(4)
    hist = Counter(min(100, int(rng.expovariate(1 / 25)) + 1) for _ in range(3000))
    cap = packing.Capacity(100, 5, 6000, weights, rule) if weights[1] else packing.Capacity(100, 100, 10_000, weights, rule)
    hist = {k: v for k, v in hist.items() if k * k <= cap.attention}
    p = packing.plan(hist, cap)
    bins, seen = defaultdict(list), Counter()
    for length, first, count, base, offset in zip(*(p[c] for c in ("length", "first", "count", "base", "offset"))):
        assert first == seen[length]
        seen[length] += count
        for i in range(count):
            bins[base + i].append((offset, length))
    assert seen == hist
    for items in bins.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= cap.tokens and len(items) <= cap.documents and sum(n * n for _, n in items) <= cap.attention


def test_extra_columns_and_nulls_keep_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "x", 6)], "doc_id long, text string, length long")
    assert packing.pack_documents(docs).count() == 3
    assert jobs.partitions(spark) > 0


def test_encoders_forget_whole_generations_and_give_the_same_ids():
    enc = tokens.PieceEncoder(tokens.public_path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]
    want = enc.encode_all(texts)
    small = tokens.encoder(tokens.public_path("byte_bpe_50k.json"), cache_pieces=100)
    got = []
    for t in texts:
        got.append(small.encode(t))
        assert len(small.pieces) + len(small.pieces.old) <= 2 * (100 + 80)
    assert got == want
