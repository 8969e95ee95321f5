import corpus_pipeline as P
from pyspark.sql import functions as F

from quaylight.llm import decontaminate, nearsets, toxicity
from quaylight.llm.common import table


def test_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, tiny)
        assert name
        assert out.columns == docs.columns + (["shard", "slot"] if i == len(P.STAGES) - 1 else [])
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.doc_id for r in docs.collect()}
    assert kept
    assert decontaminate.contaminated(docs, table(spark, tiny, "benchmark")).count() == 0
    assert nearsets.similar_components(docs.dropDuplicates(["doc_id"])).count() == 0


def test_clean_documents_stay(spark, tiny):
    docs = table(spark, tiny, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, tiny, "labels").collect()}
    left = {r.doc_id for r in P.toxicity_stage(spark, docs, tiny).collect()}
    assert sum(d in left for d, t in labels.items() if not t) >= 0.99 * sum(not t for t in labels.values())
    groups = {r.doc_id: r.component_id for r in nearsets.similar_components(docs).collect()}
    left = {r.doc_id for r in P.neardup_stage(spark, docs, tiny).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, c in groups.items() if d != c}


def test_run_counts(spark, tiny):
    out = P.run(spark, tiny)
    assert out.groupBy("shard").agg(F.max("slot") + 1 == F.count("*")).collect()
    assert out.count() > 0
    assert toxicity.held_out() is not None


CLASHES = "part pool at start grp size shard slot score _text copies target _row _key _n _range _size _shard label doc component_id member key".split()


def test_empty_and_odd_input(spark, tiny, odd_docs):
    wide = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    for df in (wide, wide.limit(0)):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, df, tiny)
            rows = out.collect()
            if i < len(P.STAGES) - 1:
                assert out.columns == df.columns
                assert {tuple(r) for r in rows} <= {tuple(r) for r in df.collect()}
            else:
                assert out.columns == [c for c in df.columns if c not in ("shard", "slot")] + ["shard", "slot"]
                assert len(rows) == df.count()
            assert all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in ("shard", "slot"))


def grouped_by_brute_force(docs):
    """Documents that go: all but the smallest id of each group, by plain sets."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else {t} for d, t in docs.items()}
    seen, gone = set(), set()
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    ids = sorted(docs)
    linked = {d: set() for d in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n, m = sorted((len(sets[a]), len(sets[b])))
            if n >= 0.8 * m - 1e-9 and similar(a, b):
                linked[a].add(b)
                linked[b].add(a)
    for d in ids:
        if d in seen:
            continue
        stack, own = [d], set()
        while stack:
            e = stack.pop()
            if e not in own:
                own.add(e)
                stack += linked[e]
        seen |= own
        gone |= own - {d}
    return gone


def test_near_duplicates_against_brute_force(spark, tiny):
    docs = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    assert set(docs) - {r.doc_id for r in P.neardup_stage(spark, table(spark, tiny, "documents"), tiny).collect()} == grouped_by_brute_force(docs)
