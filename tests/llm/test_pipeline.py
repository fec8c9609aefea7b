from pyspark.sql import functions as F

import corpus_pipeline
from urlloom.llm import decontaminate, mixing, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_plain_python_does(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outputs = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outputs[-1], SF).write.parquet(str(tmp_path / str(i)))
        outputs.append(spark.read.parquet(str(tmp_path / str(i))))
        assert outputs[-1].columns[: len(columns)] == columns
    raw, good, cut, single, clean, mixed = ({r.doc_id: r for r in d.collect()} for d in outputs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(i) != 1 for i in raw.keys() - good.keys()) and raw.keys() > good.keys()
    lines, hosts = {}, {}
    for r in good.values():
        hosts[r.source] = hosts.get(r.source, 0) + 1
        for x in {x.strip(" \t\r") for x in r.text.split("\n")} - {""}:
            lines[r.source, x] = lines.get((r.source, x), 0) + 1
    for i, r in good.items():
        gone = lambda x, s=r.source: lines.get((s, x.strip(" \t\r")), 0) > 1 and lines[s, x.strip(" \t\r")] > 0.1 * hosts[s]
        assert cut[i].text == "\n".join(x for x in r.text.split("\n") if not gone(x)) and cut[i].n_chars == len(cut[i].text)
    sets = {i: set(ngram_join.shingle_set(r.text.encode(), 5).tolist()) for i, r in cut.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert set(single) == {i for i in root if root[i] == i}
    pairs = decontaminate.contaminated_pairs(outputs[3], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert set(clean) == set(single) - {r.doc_id for r in pairs.collect()}
    rates = mixing.tempered_rates(outputs[4])
    drawn = outputs[4].join(rates, "source").select("doc_id", mixing.poisson_count(mixing.hashed_unit(F.lit(mixing.SEED), F.col("doc_id")), F.col("rate")).alias("k"))
    want = {r.doc_id: r.k for r in drawn.collect() if r.k}
    got = {r.doc_id: r["count"] for r in outputs[5].groupBy("doc_id").count().collect()}
    assert got == want and set(mixed) == set(want)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, th string, label int"


def _odd(spark):
    good = " ".join(f"Sentence {i} tells of river number {i * 7}, and of its banks." for i in range(20))
    rows = [(1, good, "en", "a", 9, "r", "t", 1), (1, good, "en", "a", 9, "r", "t", 1), (1, good + " Another end.", "en", "a", 9, "r", "t", 1), (2, None, None, None, None, None, None, None)]
    rows += [(2, "", "en", "a", 0, "r", "t", 0), (None, "Plain words of a row without an id.", "en", None, 1, "r", "t", 0), (3, "word " * 40_000, "en", "b", 1, "r", "t", 0)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    docs = _odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name)).collect()
        assert all(r.lang == "en" for r in kept if r.text), name
        if name == "n-gram Jaccard join":
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept) == [(0, 35), (1, min(len(r.text) for r in docs.filter("doc_id = 1").collect())), (2, 0), (2, 0), (3, 200_000)] or len(kept) == 5
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [*docs.columns, "copy_no"] and last.count() >= 0


def test_stages_take_empty_tables(spark):
    docs = _odd(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rejection_is_by_text_not_by_id(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, f"before {bench} after", "en", "a", 1), (1, "nothing to see in here", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in corpus_pipeline.decontamination_stage(spark, docs, SF).collect()] == ["nothing to see in here"]
