"""Files of token ids, links of two tokenizers and whitening, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from test_operators import AWKWARD, SCHEMA, SMALL, rows_of
from tracklight.llm import queries, token_files, token_links, tokens, whitening
from tracklight.llm.common import table
from tracklight.session import shared_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "a \n b", "\n\na", "a\t", "x <|endoftext|> y z", "a　b c",
    "don't 've  it's \r\n  x", "é ü\xa0 x \xa0y", "\x1c a\x1f b", "x▁y z", "▁", "<0x41> <s> </s>", "\x00 a\x00b",
    "1a2 3.4% ab\n\nCD ef\n", "漢字 漢", "\U0001f514 \U0001f514\U0001f514", "a" * 3000, "ab " * 2000, "'s 't x' 'll", "tab\tx \ty\t z", "  a b",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 3, 4, "y") for i, t in enumerate(ODD)]
    rows += [(i, t, "x", 3, 4, "y") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, shard long, n_docs long, docs string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# Token files ----------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_gives_the_ids_of_whole_texts(spark, path):
    texts = [t or "" for t in ODD] + [r.text for r in table(spark, SMALL, "documents").collect()]
    want = [tokenizers.Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    encoder = tokens.Encoder(path)
    for _ in range(2):
        assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.encode(texts)] == want
    encoder.MOST_KNOWN = 10
    assert [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts] == want


@pytest.mark.parametrize("top", [0, 1, 7, 1000, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
def test_elias_fano(top, n):
    rng = random.Random(top + n)
    values = sorted(rng.randint(0, top) for _ in range(n))
    made = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.uint64)))
    assert made.decode().tolist() == values
    assert [made.select(i) for i in range(n)] == values
    if n > 1000:
        # two bits, the low bits, and a sample of 32 bits for 256 values
        assert made.nbytes * 8 <= n * (max(0, (top // n).bit_length() - 1) + 3.2) + 64 * 4


def test_elias_fano_with_gaps_longer_than_a_window():
    values = [0, 1, 1, 90_000, 90_000, 1_000_000]
    made = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.uint64)))
    assert [made.select(i) for i in range(6)] == values


def id_table(rows):
    """(doc_id, start, n_tokens, ids) by encoding one text after the other."""
    tokenizer = tokenizers.Tokenizer.from_file(BYTE_BPE)
    encoded = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    encoded.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for d, ids in encoded:
        out.append((d, at, len(ids), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [40, 1 << 20])
def test_token_files_round_trip(spark, odd, shard_ids):
    unique = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    unique = unique.unionByName(odd.where("doc_id IS NULL").limit(1)).checkpoint()
    path = shared_dir(spark, "ids")
    token_files.write_corpus(unique, path, BYTE_BPE, shard_ids=shard_ids)
    want = id_table(rows_of(unique.select("doc_id", "text")))
    got = sorted(rows_of(token_files.documents(spark, path)), key=lambda r: r[1])
    assert got == want
    crcs = {r.doc_id: r.ids_crc32 for r in token_files.digests(spark, path).collect()}
    assert crcs == {d: zlib.crc32(np.array(ids, "<u4").tobytes()) for d, _, _, ids in want}
    files = sorted(rows_of(token_files.manifest(spark, path).select("first_doc", "first_id", "n_docs", "n_ids")))
    assert (len(files) > 6) == (shard_ids == 40)
    at = (0, 0)
    for first_doc, first_id, n_docs, n_ids in files:
        assert (first_doc, first_id) == at
        at = (first_doc + n_docs, first_id + n_ids)


def test_token_files_of_repeated_ids_and_of_nothing(spark, odd, nothing):
    path = shared_dir(spark, "ids")
    token_files.write_corpus(odd, path, BYTE_BPE)
    got = rows_of(token_files.digests(spark, path))
    want = id_table(rows_of(odd.select("doc_id", "text")))
    assert len(got) == len(want) and sum(r[2] for r in got) == sum(r[2] for r in want)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted(
        (str(d), n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, _, n, ids in want
    )
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.cumsum([0] + [r[2] for r in by_start])[:-1].tolist()
    keys = [r[0] for r in by_start]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    empty = shared_dir(spark, "ids")
    token_files.write_corpus(nothing, empty, BYTE_BPE)
    assert token_files.digests(spark, empty).count() == 0


def test_an_id_that_does_not_fit_is_an_error(spark, odd):
    with pytest.raises(Exception, match="does not fit into 1 bytes"):
        token_files.write_corpus(odd, shared_dir(spark, "ids"), BYTE_BPE, width=1)


def test_op11_against_the_library(spark):
    rows = rows_of(table(spark, SMALL, "documents").select("doc_id", "text"))
    want = [(d, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, n, ids in id_table(rows)]
    assert sorted(rows_of(queries.op11_token_files(spark, SMALL))) == want


# Token links ----------------------------------------------------------------------------------


def linked(rows):
    """Results of op13 by walking through the tokens of one text after the other."""
    a = tokenizers.Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in kept}
    byte_of |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in kept)}
    found, holds = [], Counter()
    for d, t in rows:
        made = a.encode(f" {t or ''}", add_special_tokens=False)
        left = [(i, bytes(byte_of[c] for c in s)) for i, s in zip(made.ids, made.tokens)]
        right = []
        for i in b.encode(t or ""):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
        whole = f" {t}".encode()
        if not t or any(b"".join(s for _, s in side) != whole for side in (left, right)):
            found.append((d, None))
            continue
        groups, here, at = [], ([], []), [0, 0]
        sides = [iter(left), iter(right)]
        while at[0] < len(whole) or at[1] < len(whole):
            side = int(at[1] < at[0])
            i, s = next(sides[side])
            here[side].append(i)
            at[side] += len(s)
            if at[0] == at[1]:
                groups.append(here)
                here = ([], [])
        pairs = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        holds.update(pairs.keys())
        found.append((d, (len(left), len(right), groups, pairs)))
    most = {}
    for (x, _), n in holds.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in pairs.items() if holds[p] == most[p[0]])
        score = sum(n * holds[p] for p, n in pairs.items())
        out.append((d, n_a, n_b, len(groups), sum(pairs.values()), best, score, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_links_against_brute_force(spark, odd, nothing, monkeypatch):
    for df in (odd, table(spark, SMALL, "documents")):
        want = linked(rows_of(df.select("doc_id", "text")))
        got = rows_of(token_links.link_documents(df, BYTE_BPE, PIECE_BPE))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_links.link_documents(nothing, BYTE_BPE, PIECE_BPE).count() == 0


def test_links_over_many_chunks(spark, monkeypatch):
    # Spark's workers get the changed values, since the module travels by value.
    monkeypatch.setattr(token_links, "CHUNK_DOCS", 7)
    monkeypatch.setattr(token_links, "CHUNK_POSTINGS", 500)
    docs = table(spark, SMALL, "documents").repartition(2)
    want = linked(rows_of(docs.select("doc_id", "text")))
    assert sorted(rows_of(token_links.link_documents(docs, BYTE_BPE, PIECE_BPE))) == sorted(want)


@pytest.mark.parametrize("n_docs", [1, 9, 200, 3000])
def test_postings_are_read_as_written(n_docs):
    rng = np.random.default_rng(n_docs)
    keys = np.unique(np.concatenate([
        (np.int64(p) << 16) | rng.choice(n_docs, rng.integers(1, n_docs + 1), replace=False).astype(np.int64)
        for p in (0, 1, 5, 1 << 31)
    ] + [np.array([7 << 16 | 0])]))
    times = np.where(rng.random(len(keys)) < 0.5, 1, rng.integers(1, 300, len(keys)))
    pair, n, links, docs, planes = token_links.postings(keys, times, n_docs)
    row, doc, got = token_links.unpacked(n, docs, planes)
    assert ((pair[row] << 16 | doc) == keys).all() and (got == times).all()
    assert links.tolist() == [int(times[keys >> 16 == p].sum()) for p in pair]
    if n_docs == 3000:
        assert max(len(d) for d in docs.to_pylist()) <= 375


# Whitening ------------------------------------------------------------------------------------


def vectors(spark, x, parts=5):
    rows = [(i, [float(c) for c in v], 1, "m") for i, v in enumerate(x)]
    schema = "vec_id long, embedding array<double>, n long, part string"
    return spark.createDataFrame(rows, schema).repartition(parts)


def whitened(embeddings):
    x = np.floor(1024 * embeddings).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1], turn[:, ::-1]
    turn = turn * np.sign(turn[np.abs(turn).argmax(axis=0), range(len(values))])
    k = min(8, len(values))
    return y @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), ((n * x - s) ** 2).sum(axis=1)


@pytest.mark.parametrize("dims,n", [(1, 30), (3, 50), (12, 400)])
def test_whitening_against_eigh(spark, dims, n):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(n, dims)) * np.linspace(1, 3, dims) + rng.normal(size=dims)
    x[n // 2 :] = x[n // 2]  # half of all rows are the same
    want, explained, deviation = whitened(x)
    got = pd.DataFrame(rows_of(whitening.whiten(vectors(spark, x))), columns=["vec_id", "component", "n", "deviation", "whitened", "explained", "error"])
    got = got.sort_values(["vec_id", "component"])
    k = min(8, dims)
    assert len(got) == n * k and (got.n == n).all() and got.error.nunique() == 1 and got.error.iloc[0] < 1e-9
    assert np.allclose(got.whitened.to_numpy().reshape(n, k), want, atol=1e-7)
    assert np.allclose(got.explained.to_numpy().reshape(n, k), explained, rtol=1e-9)
    assert (got.deviation.to_numpy().reshape(n, k)[:, 0] == deviation).all()


def test_whitening_leaves_out_what_it_must(spark):
    x = np.random.default_rng(1).normal(size=(40, 4))
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.5] * 4), (3, x[3].tolist())]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0]), (93, [1.0, float("nan"), 0.0, 0.0]),
           (94, [1.0, float("inf"), 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e30, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    got = whitening.whiten(spark.createDataFrame(good + bad, schema)).collect()
    assert len(got) == 42 * 4 and {r.n for r in got} == {42} and {r.vec_id for r in got} == {None, *range(40)}
    assert whitening.whiten(spark.createDataFrame(bad[:2], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 5, schema))
    assert same.count() == 0 and same.columns[0] == "vec_id"


def test_whitening_of_a_plane_has_two_components(spark):
    x = np.random.default_rng(2).integers(-5, 5, size=(60, 2)) @ np.array([[1, 0, 1, 2], [0, 1, 1, -1]])
    got = whitening.whiten(vectors(spark, x)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12


def test_whitening_of_large_entries(spark):
    x = np.random.default_rng(3).normal(size=(30, 3)) * 1e11
    got = whitening.whiten(vectors(spark, x)).collect()
    assert {r.deviation for r in got} == {None} and max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("kind", ["spread", "repeated", "flat"])
def test_secular_updates_give_the_scatter(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 10)) * 10.0 ** np.arange(-4, 6) + 1e5
    if kind == "repeated":
        x = np.round(x[rng.integers(0, 6, 300)])
    if kind == "flat":
        x[:, 5:] = x[:, :5]
    spectrum, mean = whitening.Spectrum(10), np.zeros(10)
    for i, row in enumerate(x):
        away = row - mean
        spectrum.update(away, i / (i + 1))
        mean += away / (i + 1)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    scale = np.linalg.eigvalsh(scatter)[-1]
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(10)).max() < 1e-12
    assert np.abs(spectrum.vectors * spectrum.values @ spectrum.vectors.T - scatter).max() < 1e-11 * scale


def test_spectra_combine_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    x = np.random.default_rng(5).normal(size=(90, 5))
    got = sorted(rows_of(whitening.whiten(vectors(spark, x, 9)).select("vec_id", "component", "whitened")))
    want = whitened(x)[0]
    assert np.allclose([r[2] for r in got], want.ravel(), atol=1e-9)


def test_common_parts_are_encoded_once(monkeypatch):
    encoder, asked = tokens.Encoder(BYTE_BPE), Counter()
    encoder.MOST_KNOWN = encoder.MOST_PARTS = 5
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.update(texts) or ids(texts))
    for i in range(20):
        encoder.encode([f"a common{'.,;:!?'[i % 6]} " + " ".join(f"x{chr(97 + i)}{chr(97 + j)}" for j in range(10))])
    assert asked[" common"] == 1


def test_parts_of_latin_texts(spark):
    rng = random.Random(5)
    bits = [*"aZ09 '\t\n\r.é×÷ßÿ\x0b\x0c-", "  ", "'s", "'ll", "'LL", " 've", "don't", "\u00aa", "\x85", "\xa0", "\x1c", "ŀ", "<|endoftext|>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(20_000)]
    want = [e.ids for e in tokenizers.Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(raw, "<u4").tolist() for raw in tokens.Encoder(BYTE_BPE).encode(texts)]
    assert got == want
