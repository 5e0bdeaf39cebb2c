import random

import public_tokenizers as public

from driftline.llm import packing, tokens


def made_up(rng, n):
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 14)))
    odd = ["", "don't", "x1", "2024", "漢字", "á", "...", "\t", "Ÿ", "ÜBER", "<|endoftext|>", "y" * 400]
    return [" ".join(rng.choice([word(), word().upper() + rng.choice(["", ",", "?!"]), rng.choice(odd)]) + rng.choice(["", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_word_tables_are_bounded_within_a_batch(monkeypatch):
    """A batch of more new words than the tables hold: ids are the library's (the tables outgrew their bound before)."""
    monkeypatch.setattr(packing, "_KEEP", 50)
    own = packing.WordTokenizer(public.path(packing.DEFAULT))
    texts = made_up(random.Random(41), 60)
    assert [x.tolist() for x in own.ids(texts)] == [e.ids for e in own.inner.encode_batch(texts, add_special_tokens=False)]
    assert len(own.known) <= 50 and len(own.known.runs) <= 50


def test_counts_build_no_tables():
    """Whole counts need no table of prefixes, budgets one a text (each word's was kept before)."""
    from tokenizers import Tokenizer

    own, library = tokens.PrefixCounter(public.path(tokens.DEFAULT)), Tokenizer.from_file(public.path(tokens.DEFAULT))
    texts = [t.replace("<|endoftext|>", "") for t in made_up(random.Random(42), 40)]
    for t in texts:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert own.measured(t, (10**6,)) == (n, [len(t)]) and own.count(t) == n
    assert not own.tables
    for t in texts:
        counts = own.prefixes(t)
        assert own.measured(t, (5, 20)) == (counts[-1], [max(i for i, x in enumerate(counts) if x <= b) for b in (5, 20)])
