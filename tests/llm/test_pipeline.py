import duckdb
import pytest

import corpus_pipeline
from hostmill.llm import decontaminate, ngram_join, quality_ledger, queries, substring_dedup, zstd_lang
from hostmill.llm.common import written


def test_stages_against_what_they_say(spark, data):
    """Each stage judged on its own input, with the operators' reports."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, data)
        if name != "packing":
            assert out.columns == names
        if name == "language":
            want = {r.doc_id for r in zstd_lang.identify(seen).filter("NOT rejected").collect()}
        elif name == "near_duplicates":
            want = {r.component_id for r in ngram_join.join(seen).collect()}
        elif name == "substrings":
            want = {r.doc_id for r in substring_dedup.digests(seen, substring_dedup.removed_spans(seen)).filter("n_removed < n_words OR n_words = 0").collect()}
        elif name == "decontamination":
            bench = spark.read.parquet(f"{data}/benchmark.parquet")
            want = {r.doc_id for r in decontaminate.report(seen, bench).filter("NOT contaminated").collect()}
        else:
            want = {r.doc_id for r in seen.select("doc_id").collect()}
        seen = out.cache()
        assert {r.doc_id for r in seen.collect()} == want
    assert len(corpus_pipeline.STAGES) == 5
    whole = corpus_pipeline.run(spark, data)
    assert {(r.doc_id, r.piece, r.length) for r in whole.collect()} == {(r.doc_id, r.piece, r.length) for r in seen.collect()}


def test_stages_against_plain_models(spark, docs, texts, no_docs, same_columns, tmp_path):
    """Brute force for each stage on its own input: odd texts, clashing columns, ties and copies."""
    import sentencepiece
    from test_operators import bench_words, by_id, model_components, model_removed, space_words

    from hostmill.llm import bpe_count

    passage = texts[-21].split()[20:60]
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, None), (3, "never said before by anyone here at all")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = docs
    out = written(stages["language"](spark, seen, str(tmp_path)), "test")
    judge = zstd_lang.Compressors(zstd_lang.dictionaries(zstd_lang.training_words(seen)))
    assert set(by_id(out)) == {i for i, t in by_id(seen).items() if not judge(t)[2]}
    same_columns(seen, out)
    seen, texts_of = out, by_id(out)
    out = written(stages["near_duplicates"](spark, seen, str(tmp_path)), "test")
    assert set(by_id(out)) == {c for _, c in model_components(texts_of).values()}
    same_columns(seen, out)
    seen, texts_of = out, by_id(out)
    out = written(stages["substrings"](spark, seen, str(tmp_path)), "test")
    gone = model_removed(texts_of)
    kept = {i: [w for k, w in enumerate(space_words(t)) if k not in gone[i]] for i, t in texts_of.items()}
    assert {i: space_words(t) for i, t in by_id(out).items()} == {i: w for i, w in kept.items() if w or not gone[i]}
    assert all(r.n_chars == len(r.text) for r in out.collect())
    same_columns(seen, out)
    seen, texts_of = out, by_id(out)
    out = written(stages["decontamination"](spark, seen, str(tmp_path)), "test")
    grams = {tuple(w[k : k + 10]) for w in map(bench_words, [" ".join(passage), "never said before by anyone here at all"]) for k in range(max(1, len(w) - 9))}
    holds = lambda w: any(tuple(w[k : k + n]) in grams for n in (8, 10) for k in range(len(w) - n + 1))
    assert set(by_id(out)) == {i for i, t in texts_of.items() if not holds(bench_words(t))}
    assert len(by_id(out)) < len(texts_of)
    same_columns(seen, out)
    sp = sentencepiece.SentencePieceProcessor(model_file=bpe_count.model_path())
    packed = stages["packing"](spark, out, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(sp.encode(t)) + 1 for i, t in by_id(out).items()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name


def test_stages_with_nulls_and_repeats(spark, tmp_path):
    """Rows without an id, texts under one id and repeated rows, stage by stage."""
    say = lambda name, n: " ".join(f"{name}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    bench = spark.createDataFrame([(None, say("bench", 12))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two, bad = say("alpha", 60), say("beta", 60), say("gamma", 20) + " " + say("bench", 12)
    d = spark.createDataFrame([(None, one, "en"), (None, one, "en"), (7, two, "en"), (7, one + " " + say("tail", 40), None), (8, bad, "en"), (8, two, "en"), (9, None, None), (9, "", "en")], "doc_id long, text string, lang string")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:6]) for r in df.collect())
    kept = written(stages["near_duplicates"](spark, d, str(tmp_path)), "test")
    assert ids(kept) == sorted([(False, 7, one[:6]), (False, 7, two[:6]), (False, 8, bad[:6]), (False, 9, ""), (False, 9, ""), (True, 0, one[:6])])
    cut = written(stages["substrings"](spark, kept, str(tmp_path)), "test")
    assert {r.text for r in cut.filter("doc_id = 7").collect()} == {two, say("tail", 40)}
    clean = stages["decontamination"](spark, cut, str(tmp_path))
    assert clean.filter("doc_id = 8").count() == 0 and clean.count() == 5
    assert stages["packing"](spark, clean, str(tmp_path)).count() == 5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = queries.queries()[name](spark, data)
    names = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_good_documents_are_kept(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = quality_ledger.op1_quality_ledger(spark, data).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in kept}
    assert n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)) > 0.9


def test_every_query_runs(spark, data):
    for name, query in queries.queries().items():
        assert query(spark, data).count() > 0, name
