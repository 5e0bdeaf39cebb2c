import hashlib
import random
import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from driftline.llm import components, ctph, induced, line_dedup, near_vectors, simhash, suffix_dedup


def reach(n, links):
    """Least index reachable."""
    out = list(range(n))
    while True:
        before = list(out)
        for a, b in links:
            out[a] = out[b] = min(out[a], out[b])
        if out == before:
            return out


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = reach(600, edges)
    assert got == {n: want[n] for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_simhash(text, k):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = low.encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in ("", "a", "A b C d e", "x\x0by\x1cz  w\n\nv u t", "É é É é é", "one two three four five six seven"):
        for k in (4, 5):
            assert simhash.fingerprint(t, k) == plain_simhash(t, k)


def test_ball_links_equal_brute_force(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            v ^= 1 << b
        values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for radius, fold in ((4, 12), (2, 8)):
        links = simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "simhash bigint"), radius, fold).collect()
        at = {v: i for i, v in enumerate(signed)}
        brute = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius]
        assert reach(len(values), [(at[r["a"]], at[r["b"]]) for r in links]) == reach(len(values), brute)


def test_large_bins_in_rounds(monkeypatch):
    rng = np.random.default_rng(3)
    own = np.unique(np.concatenate([x := rng.integers(0, 1 << 63, 50).astype(np.uint64), x ^ np.uint64(5)]))
    whole = simhash.meet(own, 3, 2, 12)
    monkeypatch.setattr(simhash, "_ROUND", 100)
    assert {tuple(p) for p in simhash.meet(own, 3, 2, 12).tolist()} == {tuple(p) for p in whole.tolist()}


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing):
    rows = simhash.near_duplicates(awkward, words=4).collect()
    docs = awkward.collect()
    prints = [plain_simhash(r["text"] or "", 4) for r in docs]
    group = reach(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for r, g in zip(docs, group, strict=True):
        least[g] = min((x for x in (least.get(g), r["doc_id"]) if x is not None), default=None)
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == sorted(((r["doc_id"], least[g]) for r, g in zip(docs, group, strict=True)), key=str)
    kept = simhash.drop_near_duplicates(awkward, words=4)
    assert kept.columns == awkward.columns
    assert kept.count() == len(set(group))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 16))
    rows = [x.tolist() for x in np.concatenate([base, base[:60] + 0.06 * rng.normal(size=(60, 16)), base[:30] * 3])]
    rows += [rows[0]] * 5 + [[0.0] * 16, None, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [], [1.0, 2.0], [2.0, 4.0]]
    keys = [*range(len(rows))]
    df = spark.createDataFrame(list(zip([None if k == 3 else k for k in keys], rows, strict=True)), "vec_id bigint, embedding array<double>")
    ok = [r is not None and len(r) > 0 and None not in r and np.isfinite(r).all() and any(r) for r in rows]
    unit = [np.array(r) / np.linalg.norm(r) if o else None for r, o in zip(rows, ok, strict=True)]
    links = [(i, j) for i in keys for j in range(i) if ok[i] and ok[j] and len(rows[i]) == len(rows[j]) and float(unit[i] @ unit[j]) >= 0.95]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    group = reach(len(rows), links)
    least = {}
    for k, g in zip(keys, group, strict=True):
        if k != 3:
            least[g] = min(least.get(g, k), k)
    for block in (64, 8192):
        got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, block=block).collect()}
        for k in keys:
            r = got[None if k == 3 else k]
            assert r["n_links"] == n[k]
            if k != 3:
                assert r["component_id"] == least[group[k]] and r["kept"] == (k == least[group[k]])
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_count_of_collisions_loses_nothing():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(400, 64))
    a = np.concatenate([a, a + 0.03 * rng.normal(size=a.shape)])
    a /= np.linalg.norm(a, axis=1)[:, None]
    cosines = np.triu(a @ a.T, 1)
    want = set(map(tuple, np.argwhere(cosines >= 0.95).tolist()))
    got = [p for q, y in near_vectors.linked(a, a, 0.95, True) for p in zip(q.tolist(), y.tolist(), strict=True)]
    assert set(got) == want and want and len(got) == len(want)


def test_scaled_copies_of_one_vector(spark):
    """Ties on the first projection, in blocks smaller than the group; vectors of length 1 are one or its opposite."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=8)
    rows = [(x * f).tolist() for f in rng.uniform(0.1, 9, 700)] + [[float(f)] for f in range(1, 400)] + [[-2.0]] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = near_vectors.near_vectors(df, block=64).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(0, 699), (700, 398), (1099, 2)}
    assert sum(r["kept"] for r in got) == 3


def test_memory_of_a_dense_block():
    """All pairs of two blocks link; they are added up by tile, not listed."""
    import tracemalloc

    rng = np.random.default_rng(14)
    a = np.ones((4096, 16)) + 0.01 * rng.normal(size=(4096, 16))
    a /= np.linalg.norm(a, axis=1)[:, None]
    tracemalloc.start()
    n, trees = 0, near_vectors.Trees(2 * len(a))
    for q, y in near_vectors.linked(a, a, 0.95, False):
        n += len(q)
        trees.join(q, y + len(a))
    assert n == len(a) ** 2 and not trees.roots(np.arange(2 * len(a))).any()
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def in_order(text, cap, scratch):
    """Checks order and common prefixes of the suffixes against plain comparison."""
    vectors = list(induced.suffixes(text, cap, scratch))
    places, common = np.concatenate([p for p, _ in vectors]), np.concatenate([c for _, c in vectors])
    assert sorted(places.tolist()) == list(range(len(text)))
    for k in range(1, len(places)):
        a, b = bytes(text[places[k - 1] : places[k - 1] + cap]), bytes(text[places[k] : places[k] + cap])
        assert a >= b and common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


@pytest.mark.parametrize("budget", [1 << 20, 1000, 0])
def test_induced_sorting(budget, monkeypatch):
    rng = random.Random(8)
    for _ in range(200):
        monkeypatch.setattr(induced, "CHUNK", rng.choice([16, 64, 1024]))
        monkeypatch.setattr(induced, "_DIRECT", rng.choice([0, 0.2, 2]))
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", b"a"])
        s = bytes(rng.choice(letters) for _ in range(rng.randint(0, 80))) * rng.choice([1, 1, 3])
        in_order(np.append(np.frombuffer(s, np.uint8) + 1, 0).astype(np.uint8), rng.choice([1, 5, 50]), induced.Scratch(budget))


def test_induced_sorting_beyond_its_budget(monkeypatch):
    """A text of some times the budget: the queue's blocks and the arrays go to files, through several recursions."""
    monkeypatch.setattr(induced, "CHUNK", 4096)
    monkeypatch.setattr(induced, "_DIRECT", 0.1)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    s = " ".join(rng.choice(words) for _ in range(9000)) + "=" * 3000 + "ab" * 2000
    levels, scratch = [], induced.Scratch(20_000)
    whole = induced.Level.__post_init__
    monkeypatch.setattr(induced.Level, "__post_init__", lambda self: (levels.append(self.depth), whole(self))[1])
    in_order(np.append(np.frombuffer(s.encode(), np.uint8), 0).astype(np.uint8), 50, scratch)
    assert scratch.spilled > 100 and max(levels) >= 2


@pytest.mark.parametrize(("shard", "hot", "chunk"), [(2000, 100_000, 4 << 20), (1 << 20, 3, 1000)])
def test_repeats_equal_brute_force(spark, awkward, nothing, shard, hot, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 4000)
    rng = random.Random(9)
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    docs += [(100 + i, docs[i % 40][1] and docs[i % 40][1][:200] + passage[i * 7 : i * 7 + 150] + "é" * i) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = suffix_dedup.drop_repeats(df, keep=("doc_id", "text"), shard=shard, budget=1000, hot=hot).collect()
    data = sorted(((k if k is not None else 1 << 63, (t or "").encode()) for k, t in docs), key=lambda x: x[0])
    first = {}
    for k, b in data:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    assert len(got) == len(docs)
    for r in got:
        k, b = r["doc_id"] if r["doc_id"] is not None else 1 << 63, (r["text"] or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
        assert bytes(r["kept"]) == kept
    assert suffix_dedup.drop_repeats(nothing).count() == 0


def test_lines(spark, awkward, nothing):
    common, rows = "All rights are reserved here.", []
    for i in range(24):
        rows.append((i, f"own line number {i} of it\n {common}\t\nmore of {i}, longer than the rest of it all\nshort", f"s{i % 12}" if i % 12 else None, "x"))
    rows += [(30, common, "s1", "x"), (31, None, "s2", "x"), (32, "", "s3", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, id_ string")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df, min_sites=12).collect()}
    assert got[0]["text"] == "own line number 0 of it\nmore of 0, longer than the rest of it all\nshort" and (got[0]["n_lines"], got[0]["n_removed"]) == (4, 1)
    assert got[30]["text"] == "" and got[30]["n_removed"] == 1
    assert got[31]["text"] is None and got[31]["n_lines"] == 0 and got[32]["text"] == ""
    assert all(r["n_removed"] == 0 for r in line_dedup.drop_boilerplate(df, min_sites=13).collect())
    assert line_dedup.drop_boilerplate(awkward).count() == awkward.count() and line_dedup.drop_boilerplate(nothing).count() == 0


def test_edit_distance():
    rng = random.Random(10)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 64))) for _ in range(2))
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
            line = new
        assert ctph.distance(a, b) == line[-1]


def test_piecewise_hashes(monkeypatch):
    rng = random.Random(11)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "mu"]) + str(rng.randint(0, 99)) for _ in range(800))
    whole = ctph.fingerprint(text)
    assert whole == ctph.fingerprint(text) and all(len(s) <= 64 for s in whole.split(":")[1:])
    assert ctph.likeness(whole, whole) == 1.0
    assert ctph.likeness(whole, ctph.fingerprint(text[:3000] + "changed" + text[3010:])) > 0.8
    other = " ".join(rng.choice(["omega", "sigma", "theta"]) + str(rng.randint(0, 99)) for _ in range(800))
    assert 0.3 < ctph.likeness(whole, ctph.fingerprint(text[: len(text) // 2] + other[: len(text) // 2])) < 0.75
    assert ctph.likeness(whole, ctph.fingerprint(other)) < 0.2
    assert ctph.likeness(ctph.fingerprint(""), ctph.fingerprint(None)) == 1.0
    monkeypatch.setattr(ctph, "_BLOCK", 64)
    assert ctph.fingerprint(text) == whole


def plain_fingerprint(text):
    """The definition, byte by byte."""
    data = text.encode()
    marks = []
    for i in range(len(data)):
        h = 0
        for k in range(min(7, i + 1)):
            h += data[i - k] * pow(0x01000193, k, 1 << 32)
        h %= 1 << 32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % (1 << 32)
        h ^= h >> 13
        marks.append(h | 1 << 31)
    level = max(2, (len(data) // 64).bit_length() - 3)
    ends = lambda k: [i + 1 for i, h in enumerate(marks) if h % (1 << k) == 0]
    while len(ends(level)) >= 64:
        level += 1
    out = [str(1 << level)]
    for k in (level, level + 1):
        cuts = sorted({0, *ends(k), len(data)})
        out.append("".join(ctph.LETTERS[zlib.crc32(data[a:b]) % 64] for a, b in zip(cuts, cuts[1:], strict=False)))
    return ":".join(out)


def test_fingerprints_equal_their_definition():
    rng = random.Random(15)
    for n in (0, 1, 6, 7, 40, 300, 3000, 9000):
        text = "".join(rng.choice("abcdé 🙂\n") for _ in range(n))
        assert ctph.fingerprint(text) == plain_fingerprint(text)


def test_keys_that_are_no_integers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (suffix_dedup.drop_repeats, ctph.edited):
        with pytest.raises(TypeError):
            f(df)


def test_edited(spark, awkward, nothing):
    got = ctph.edited(awkward).collect()
    docs = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in awkward.collect()))
    want = []
    for (none, k, t), (_, _, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        a, b = ctph.fingerprint(t), ctph.fingerprint(changed)
        want.append((None if none else k, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, ctph.likeness(a, b), ctph.likeness(a, ctph.fingerprint(after))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ctph.edited(nothing).count() == 0
    one = ctph.edited(awkward.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
