import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stage_cuts_short_pages(spark):
    """Boilerplate goes from a page of which it is most; only exact copies without a line of their own stay whole."""
    common, other = "All rights are reserved here.", "Share this page with your friends."
    rows = [(i, f"own line number {i}, longer than the common one\n{common}\n{other}", f"s{i}") for i in range(12)]
    rows += [(20, f"Im sich.\n{common}\n{other}", "s1"), (21, f"{common}\n{other}", "s1"), (22, f"{common}\n{other}", "s2"), (23, f"{other}\n\n{common}", "s3"), (24, None, "s4"), (25, "", "s5")]
    df = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert len(got) == len(rows)
    assert got[0][0] == "own line number 0, longer than the common one"
    assert got[20] == ("Im sich.", 8)
    assert got[21][0] == got[22][0] == f"{common}\n{other}"
    assert got[23][0].strip() == "" and got[24][0] is None and got[25][0] == ""
