import random
import zlib

import numpy as np
import pytest

from driftline.llm import packing, tokens

public = pytest.importorskip("public_tokenizers")
ODD = ["I'll can't we're '' 'r 'l", "  a  b\n\n c\n d \t x", "a<|endoftext|>b <|endoftext|>", "<|endoft", "naïve 漢字 １２ ３", "don't  \n", " \n x'll 've", "\r\n\r\n  hello   123!!! ...", "é̂x ا ١٢", "🙂🙂", "", " ", "a" * 3000]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(name))


def texts():
    rng = random.Random(3)
    letters = [*"ab' \n\tsrelvtdm1!é漢 ", "<|endoftext|>", "'re", "  "]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(400)]


def test_every_prefix_is_exact():
    inner, own = library(tokens.DEFAULT), tokens.counter(tokens.DEFAULT)
    for t in texts():
        t = t[:400]
        want = [len(inner.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.prefixes(t) == want, t
        assert own.count(t) == want[-1]
        assert own.fitting(t, (3, 7)) == [max(i for i, n in enumerate(want) if n <= b) for b in (3, 7)]


def test_prefixes_of_long_runs_are_exact():
    inner, own = library(tokens.DEFAULT), tokens.counter(tokens.DEFAULT)
    for t in ("a" + "\n" * 1500 + "b", " " * 1300 + "x" * 1300, "y" * 1200 + "'re", "\n " * 700 + "z", "-" * 1300 + "\n\n", "\t" * 1100 + " 'll"):
        got = own.prefixes(t)
        for k in [*range(0, len(t), 211), *range(len(t) - 4, len(t) + 1)]:
            assert got[k] == len(inner.encode(t[:k], add_special_tokens=False).ids), (t[:5], k)


def test_kept_columns_with_names_of_results(spark):
    df = spark.createDataFrame([(5, "one two", 1)], "start bigint, text string, `a.b` int")
    assert packing.pack(df, keep=("start", "a.b")).columns[:3] == ["_start", "a.b", "start"]
    assert tokens.token_counts(df, keep=("a.b",)).first()["a.b"] == 1


def test_tokenizers_that_look_at_spaces_are_refused():
    with pytest.raises(ValueError):
        packing.WordTokenizer(public.path(tokens.DEFAULT))


def test_token_counts_of_awkward_rows(awkward, nothing):
    inner = library(tokens.DEFAULT)
    got = tokens.token_counts(awkward).collect()
    want = sorted((len(t.encode()), len(inner.encode(t, add_special_tokens=False).ids)) for t in (r["text"] or "" for r in awkward.collect()))
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert tokens.token_counts(nothing).count() == 0


def test_word_ids_are_the_librarys():
    inner, own = library(packing.DEFAULT), packing.tokenizer(packing.DEFAULT)
    some = [*texts(), "Straße ÜBER Àß, x. ÿ", "THE!! the... µ ª a,b", "ß ẞ ſ İ Σ ς K"]
    for t, ids in zip(some, own.ids(some), strict=True):
        assert ids.tolist() == inner.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("tokens_", "segments", "loss"), [(64, 128, 64), (64, 3, 64), (64, 8, 20)])
def test_packer_keeps_every_id_and_limit(tokens_, segments, loss):
    rng = np.random.default_rng(5)
    packer = packing.Packer(tokens_, segments, loss, window=500)
    docs = {k: rng.integers(0, 1000, rng.integers(1, 200)).astype("<u4") for k in range(80)}
    out = []
    for k, ids in docs.items():
        out += packer.add(packing.Piece((k,), ids, 0, len(ids), rng.random(len(ids)) < 0.3 if loss < tokens_ else None))
    body = len(out)
    out += packer.finish()
    back = {k: np.full(len(ids), -1, dtype=np.int64) for k, ids in docs.items()}
    for sequence in out:
        assert sum(map(len, sequence)) <= tokens_ and len(sequence) <= segments and sum(p.loss_tokens for p in sequence) <= loss
        for p in sequence:
            assert (back[p.key[0]][p.start : p.start + len(p)] == -1).all()
            back[p.key[0]][p.start : p.start + len(p)] = p.ids
    assert all((back[k] == docs[k]).all() for k in docs)
    if segments == 128 and loss == tokens_:
        assert all(sum(map(len, s)) == tokens_ for s in out[:body])
        assert all((n := sum(map(len, s))) == tokens_ or n & (n - 1) == 0 for s in out)


def test_whole_documents_when_cutting_is_off():
    packer = packing.Packer(10, 4, 10, cut=False, window=0)
    out = [s for n in (6, 5, 4, 3, 2) for s in packer.add(packing.Piece((n,), np.zeros(n, "<u4"), 0, n))] + list(packer.finish())
    assert sorted(len(p) for s in out for p in s) == [2, 3, 4, 5, 6] and all(sum(map(len, s)) <= 10 for s in out)
    with pytest.raises(ValueError):
        list(packer.add(packing.Piece((0,), np.zeros(11, "<u4"), 0, 11)))


def test_pack_awkward_rows(awkward, nothing):
    inner = library(packing.DEFAULT)
    rows = packing.pack(awkward, tokens=256).collect()
    want = sorted(len(inner.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in awkward.collect())
    heads = [r["doc_tokens"] for r in rows if r["start"] == 0]
    assert sorted(heads) == want and sum(r["length"] for r in rows) == sum(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    texts_of = {}
    for r in awkward.collect():
        texts_of.setdefault(r["doc_id"], []).append(np.array([*inner.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in rows:  # every piece's ids are those of a document of its key
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in texts_of[r["doc_id"]] if len(ids) == r["doc_tokens"])
    assert packing.pack(nothing).count() == 0
