import corpus_pipeline as p
from pyspark.sql import functions as F

from driftline.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage on what the one before kept; the whole equals the stages one by one."""
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, []
    for k, (_, stage) in enumerate(p.STAGES):
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        counts.append((before, docs.count()))
        if k + 1 < len(p.STAGES):
            assert docs.columns == columns
    assert 0.7 * counts[0][0] < counts[0][1] < counts[0][0]  # junk goes
    assert counts[1][0] == counts[1][1]  # lines go, documents stay
    assert counts[2][1] < counts[2][0]  # copies go
    whole = p.run(spark, SF)
    def total(df):
        """Tokens by document."""
        return {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}

    assert total(whole) == total(docs)
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None


def test_awkward_rows(spark, awkward, nothing):
    """The stages after the classifier on awkward rows, each against a plain version of its rule."""
    df = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in df.collect()]
    cut = p.without_boilerplate(spark, df, SF)
    assert sorted(map(tuple, cut.select("doc_id", "text").collect()), key=str) == sorted((r[:2] for r in rows), key=str)  # no line on ten sites
    kept = p.without_near_copies(spark, cut, SF)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(one_of_each(rows), key=str)
    mix = p.mixed_sources(spark, kept, SF)
    assert set(map(tuple, mix.collect())) <= set(map(tuple, kept.collect())) and mix.count() >= 1
    pieces = p.packed(spark, mix, SF).collect()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    for name, stage in p.STAGES[1:]:
        nothing_left = stage(spark, nothing.select("doc_id", "text", "lang", "source", "n_chars"), SF)
        assert nothing_left.count() == 0, name


def one_of_each(rows):
    """Of rows linked by five-word Jaccard of 0.8 the one of the smallest key, by plain comparison of all pairs."""

    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(r[1]) for r in rows]
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if like(sets[i], sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = {}
    for g, r in zip(group, rows, strict=True):
        best = out.get(g)
        if best is None or (r[0] is None, r[0] or 0) < (best[0] is None, best[0] or 0):
            out[g] = r
    return list(out.values())


def test_stages_equal_plain_versions(spark):
    """Boilerplate, near copies and the sizes of the mix on made-up documents, stage by stage."""
    import random

    rng = random.Random(31)
    common = "Every page of every site says this."
    texts = [" ".join(rng.choice("river stone light winter cloud gate field lamp road".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 80))) for _ in range(60)]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[:25]] + texts[:10]
    rows = [(i, f"{t}\n{common}" if i % 3 else t, "en", f"s{i % 14}", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cut = p.without_boilerplate(spark, docs, SF)
    plain = [(i, t.removesuffix(f"\n{common}"), la, s, len(t.removesuffix(f"\n{common}"))) for i, t, la, s, _ in rows]
    assert sorted(map(tuple, cut.collect())) == sorted(plain)
    kept = p.without_near_copies(spark, cut, SF)
    want = one_of_each(plain)
    assert sorted(map(tuple, kept.collect())) == sorted(want)
    words = {}
    for r in want:
        words[r[3]] = words.get(r[3], 0) + len(r[1].split())
    mix = p.mixed_sources(spark, kept, SF).groupBy("source").agg(F.sum(F.size(F.split("text", "[ \n]+"))).alias("n")).collect()
    total, weights = sum(words.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(words))}
    targets, open_ = {}, dict(weights)
    while over := [s for s in open_ if (total - sum(targets.values())) * open_[s] / sum(open_.values()) > 3 * words[s]]:
        left = total - sum(targets.values())
        for s in over:
            targets[s] = 3 * words[s]
        open_ = {s: w for s, w in open_.items() if s not in over}
        del left
    left = total - sum(targets.values())
    targets |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    got = {r["source"]: r["n"] for r in mix}
    longest = {s: max(len(r[1].split()) for r in want if r[3] == s) for s in words}
    assert all(abs(got.get(s, 0) - targets[s]) <= longest[s] for s in words)
