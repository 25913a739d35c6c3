"""Token ids, packing and token files against the tokenizers library and brute force."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from fleetlens.llm.packing import BestFit, pack
from fleetlens.llm.token_files import TokenFile, read_token_files, write_token_files
from fleetlens.llm.tokens import token_ids, tokenizer_path
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
BYTE, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = [None, "", "A word.", "a\n\nb \n c\t\td  ", "x<|endoftext|>y 🎉", "l'été ½ 3² ß İ", "日本語", "it's " * 5000, "A word.", "A word."]


def docs(spark, texts):
    rows = [(i, t, "en", i) for i, t in enumerate(texts)] + [(3, TEXTS[3], "en", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, start long")


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_equal_the_library(path):
    random.seed(3)
    tok, library, plain, ordinary = token_ids(path), Tokenizer.from_file(path), token_ids(path, plain=True), Tokenizer.from_file(path)
    ordinary.encode_special_tokens = True
    parts = [*"aB'z 19½\n\t.,!éß<>|ſ´\x1c\x85\xa0Σ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>"]
    weights = [6] * (len(parts) - 5) + [1] * 5
    for text in [t or "" for t in TEXTS] + ["".join(random.choices(parts, weights, k=40)) for _ in range(10_000)]:
        assert np.frombuffer(tok.encode(text), tok.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(plain.encode(text), plain.dtype).tolist() == ordinary.encode(text, add_special_tokens=False).ids


def expected(path, texts):
    tok, out, at = Tokenizer.from_file(path), [], 0
    for doc_id, t in sorted([*enumerate(texts), (3, TEXTS[3])], key=lambda x: x[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, tmp_path):
    out = f"file://{tmp_path}/tokens"
    write_token_files(docs(spark, TEXTS), out, BYTE, seq_len=64)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, out).collect())
    assert got == expected(BYTE, TEXTS)
    shard = sorted(p.stem for p in (tmp_path / "tokens").glob("shard-??????.arrow"))[-1]
    file = TokenFile(out, shard)
    assert len(file.sequence(0)) == 64 and len(file.mask(0)) == 64


def test_token_files_empty(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    write_token_files(docs(spark, TEXTS).limit(0), out, BYTE)
    assert read_token_files(spark, out).count() == 0


def test_pack_holds_all_ids_without_gaps(spark):
    rows = pack(docs(spark, TEXTS), WORDS, seq_len=128, open_bins=4).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.doc_id, r.piece] += r.length
    want = defaultdict(int)
    for doc_id, _, n, _ in expected(WORDS, TEXTS):
        want[doc_id] += n
    got = defaultdict(int)
    for (doc_id, _), n in size.items():
        got[doc_id] += n
    assert got == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    tok = Tokenizer.from_file(WORDS)
    for r in rows:
        ids = np.array([*tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.length == 128 or r.start + r.length == len(ids))


def test_pack_empty(spark):
    assert pack(docs(spark, TEXTS).limit(0), WORDS).count() == 0


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    fit = BestFit(10, 2)
    assert fit.put(6) == (0, 0) and fit.put(7) == (1, 0)
    assert fit.put(3) == (1, 7)  # 3 left fits exactly
    assert fit.put(8) == (2, 0) and fit.put(9) == (3, 0)  # a third open bin: the one with 1 left closes
    assert fit.put(1) == (2, 8) and fit.put(4) == (0, 6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_few_sequences(spark):
    """Of the given documents, no more than a few thousandths above the least number that their ids could take."""
    rows = pack(spark.read.parquet(f"{SF}/documents.parquet"), WORDS).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    least = -(-sum(used.values()) // 2048)
    assert max(used.values()) <= 2048 and len(used) <= 1.002 * least + 1
