import corpus_pipeline
from sieveline.llm import decontaminate, mixing, pii, quality

AT = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def alone(texts):
    """The smallest id of each group of texts alike in 0.8 of their shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in sets})


def test_each_stage_decides_for_the_next(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    benchmark = spark.read.parquet(f"{AT}/benchmark.parquet")
    columns = docs.columns
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, AT)
        stages[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out.cache()
    given, out = stages["quality"]
    assert ids(out) == ids(quality.quality(given).where("kept"))
    given, out = stages["near_duplicates"]
    texts = {r.doc_id: r.text for r in given.collect()}
    assert ids(out) == alone(texts)
    given, out = stages["decontamination"]
    assert ids(out) == ids(decontaminate.decontaminate(given, benchmark).where("not contaminated"))
    given, out = stages["pii"]
    assert ids(out) == ids(given)
    assert pii.pii(out).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    given, out = stages["mixing"]
    assert ids(out) == ids(mixing.mix(given).where("copies > 0"))
    assert {r.doc_id: r.taken for r in out.collect()} == {r.doc_id: r.taken for r in mixing.mix(given).where("copies > 0").collect()}


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, AT)
    assert set(found.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "taken"}
    assert 0 < found.count() < 200


def test_stages_on_nulls_long_texts_clashing_names_and_nothing(spark):
    """No stage fails on such tables, and what it keeps, it keeps as it is."""
    long = " ".join(f"w{i}" for i in range(60_000))
    schema = "doc_id bigint, text string, lang string, source string, _key string, size string, whole string, key string"
    rows = [(1, long, "en", "s"), (2, None, None, None), (None, "a few words only", "en", None), (3, "", "de", "s"), (4, long, "en", "s"), (4, long, "en", "s"), (5, " ".join(f"x{i}" for i in range(40)), "en", "s")]
    docs = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, AT)
        kept = done.collect()
        want = [f"{c}_before" if c == "size" and name == "mixing" else c for c in docs.columns]
        assert done.columns[: len(want)] == want, name
        assert all(r["_key"] == r["whole"] == r["key"] == "own" and r["size_before" if name == "mixing" else "size"] == "own" for r in kept), name
        assert {r.text for r in kept} >= {long}, name
        assert stage(spark, docs.limit(0), AT).count() == 0, name
