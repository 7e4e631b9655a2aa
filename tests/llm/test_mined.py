"""Phrases, token files and whitening: brute-force twins, exact round trips and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from attestry.llm import phrases, token_files as T, whitening
from attestry.llm.queries import ORACLES, QUERIES

from ..oracle import differences
from .test_operators import ODD, frame

SMALL = "/root/testdata/sf0.001"
TOKENIZERS = pytest.importorskip("public_tokenizers")
VOCABULARY = TOKENIZERS.path("word_bpe_49k.json")


def mined(rows, least, longest, top):
    """Plain collocations of rows (lang, text)."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    out = {}
    found = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    inside = {}
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(a, inside.get((lang, p[i:j]), 0))
    for (lang, p), a in found.items():
        if inside.get((lang, p), 0) < a:
            cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], total[lang]))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, rows in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top])
    }


def test_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 300)  # several shards, several rounds of an AND
    monkeypatch.setattr(phrases, "ROWS", 64)
    rng = random.Random(5)
    stock = ["Alpha", "beta", "GAMMA", "ünï", "d", "e\x00f", "beta", "beta"]
    rows = [(None, None), ("en", ""), ("", "beta beta beta beta beta beta beta beta"), ("en", " \t . ! beta")]
    for _ in range(120):
        text = "".join(rng.choice(stock) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "; x "]) for _ in range(rng.randint(1, 60)))
        rows.append((rng.choice(["en", "de", None]), text))
    df = spark.createDataFrame([(x, t, 1, 2) for x, t in rows], "lang string, text string, n long, id long").repartition(3)
    for least, longest, top in ((5, 5, 30), (3, 4, 1000), (4, 2, 7), (9, 3, 50)):
        got = {tuple(r) for r in phrases.collocations(df, least=least, longest=longest, top=top).collect()}
        assert got and got == mined(rows, least, longest, top)


def test_phrases_against_sql(spark):
    assert differences(QUERIES["op11_collocations"](spark, SMALL), ORACLES["op11_collocations"], SMALL) == ""


@pytest.mark.parametrize("seed", range(8))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 59, 511, 512, 513, 5000):
        width = [rng.integers(0, 65, n), rng.integers(0, 3, n), np.full(n, seed * 8), np.where(rng.random(n) < 0.01, 64, 1)][seed % 4]
        ids = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        ids = np.where(width > 0, ids >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.uint64)
        words, size = T.encode(ids)
        assert (T.decode(words, size, np.minimum(T.BLOCK, n - np.arange(len(size)) * T.BLOCK)) == ids).all()


def test_runs_of_zeros_share_words():
    assert len(T.encode(np.zeros(512, np.uint64))[0]) == 4  # 240, 240, 30, 2: 32 zeros are no run of 120


def test_token_file_reads_any_stretch(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    out, every = T.TokenWriter(f"{tmp_path}/a.s8b"), []
    for _ in range(5):
        counts = rng.integers(0, 700, 4)
        ids = rng.integers(0, 50_000, int(counts.sum()))
        every.append(ids)
        out.add(pa.array(["x"] * 4), counts, ids)
    out.close()
    every, file = np.concatenate(every), T.TokenFile(f"{tmp_path}/a.s8b")
    assert file.ids == len(every)
    for a, n in ((0, len(every)), (511, 2), (512, 512), (len(every) - 1, 1), (700, 0)):
        assert (file.read(a, n) == every[a : a + n]).all()
    with open(f"{tmp_path}/b.s8b", "wb") as cut:
        cut.write(open(f"{tmp_path}/a.s8b", "rb").read()[:-9])
    with pytest.raises(ValueError):
        T.TokenFile(f"{tmp_path}/b.s8b")


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_digests(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert sorted(tuple(r) for r in QUERIES["op12_token_ids"](spark, SMALL).collect()) == plain_tokens(rows)


def test_token_digests_of_odd_texts(spark):
    odd = [
        None, "", "  ", "a\x0bb\x0cc\x1cd\x85e f g", "café ́x é", "<|endoftext|> a<|startoftext|>b", "A'S it's ' s I'LL", "x" * 5000,
        "😀😀 日本語 テスト 1234 १२३", "Σίσυφος ΣΊΣΥΦΟΣ İstanbul ǅ", "﻿start ​zero", "a\r\n\n b",
    ]
    rows = [(i, t, "s") for i, t in enumerate(odd)]
    df = frame(spark, rows).repartition(3)
    assert sorted(tuple(r) for r in T.token_digests(df, VOCABULARY).collect()) == plain_tokens([r[:2] for r in rows])


def test_token_files_of_repeated_ids(spark):
    got = T.token_digests(frame(spark), VOCABULARY).collect()
    assert len(got) == len(ODD)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:2] == [None, None]
    assert T.token_digests(frame(spark, []), VOCABULARY).collect() == []


def test_documents_of_token_files(spark):
    from attestry.llm.shared import new_path

    docs = frame(spark, [(2, "b c", "s"), (1, "a", "s"), (3, None, "s")])
    files = T.write_tokens(docs, VOCABULARY, new_path(spark, "tokens"))
    got = {r["doc_id"]: r["ids"] for r in T.read_documents(files, "bigint").collect()}
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in ((1, "a"), (2, "b c"), (3, ""))}


def test_whitening(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    x = np.array([np.floor(64 * np.array(v)) + 1_000_000 for _, v in rows])
    n, total = len(x), x.sum(axis=0)
    centred = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:32]
    want = centred @ basis[:, order] / np.sqrt(values[order])
    found = QUERIES["op13_whitening"](spark, SMALL).collect()
    assert len(found) == n * 32
    place = {v: i for i, (v, _) in enumerate(rows)}
    got = np.zeros((n, 32))
    for r in found:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == int(((n * x[place[r["vec_id"]]] - total) ** 2).sum()) and r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (values[order][r["component"] - 1] / values.sum()) - 1) < 1e-9
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8


@pytest.mark.parametrize("rank", [0, 1, 3, 12])
def test_lanczos_restarts_on_breakdown(rank):
    """Equal eigenvalues, and blocks that bring nothing new."""
    rng = np.random.default_rng(rank)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    matrix = (q[:, :rank] * 3.0) @ q[:, :rank].T
    values, vectors = whitening.lanczos(lambda b: matrix @ b, 40, 12, 4)
    assert np.abs(values - np.array([3.0] * min(rank, 12) + [0.0] * (12 - min(rank, 12)))).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-12 and np.abs(matrix @ vectors - vectors * values).max() < 1e-12


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n long")


def test_whitening_of_odd_rows(spark):
    good = [(i, [i % 5 / 7, i % 3 / 2, -1.0]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    got = whitening.whitened(vectors(spark, good + odd + good[:1])).collect()
    assert {r["vec_id"] for r in got} == set(range(30)) and {r["component"] for r in got} == {1, 2}  # the third dimension is constant
    assert len(got) == 62 and got[0]["n"] == 31
    for rows in ([], odd, [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9):
        assert whitening.whitened(vectors(spark, rows)).collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert got and all(r["deviation"] is None for r in got if r["vec_id"] < 3)
    assert whitening._deviations(np.array([[2**40, -5], [7, 8]]), 3, [2**41, 9]) == [(3 * 2**40 - 2**41) ** 2 + 24**2, (21 - 2**41) ** 2 + 15**2]


def test_pieces_are_the_tokenizers_own():
    """Whole texts of awkward signs, against the tokenizer itself."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, coder, rng = Tokenizer.from_file(VOCABULARY), T.PieceCoder(VOCABULARY), random.Random(2)
    signs = "aAbzZ019''||<>,.!?-_ \t\n\x0b\x1c\x85  éÉßİıǅΣσς̸́क़क़日한하Å१²½Ⅷª_‍😀´’"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += [rng.choice(["<|endoftext|>", "x<|startoftext|>y", "a'sb'S'", "'tis 'll'd"]) + rng.choice(texts) for _ in range(200)]
    ids, counts = coder.encode(pa.array(texts), None)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        at += n
