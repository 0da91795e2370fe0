import corpus_pipeline
from loomrank.llm import near_dedup, packing, scratch, suffix_dedup, toxicity
from loomrank.llm.queries import QUERIES, table, tokenizer


def test_stages_apply_one_after_another(spark, data_dir, tmp_path):
    docs = table(spark, data_dir, "documents")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    frames = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data_dir).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        frames.append(docs)
    first, second, third, last = frames
    assert all(f.columns == columns for f in frames[:3])
    labels = table(spark, data_dir, "labels")
    bad = {r[0] for r in toxicity.scored(table(spark, data_dir, "documents"), labels).where("predicted = 1").collect()}
    kept = {r[0] for r in first.select("doc_id").collect()}
    assert kept == ids - bad
    groups = near_dedup.classes(first).collect()
    assert {r[0] for r in second.select("doc_id").collect()} == {r["doc_id"] for r in groups if r["kept"]}
    removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.report(second).collect()}
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in third.collect()}
    assert sizes.keys() == removed.keys()
    assert all(n - gone <= sizes[i] <= n - gone + 12 for i, (n, gone) in removed.items())
    pieces = last.groupBy("doc_id").sum("length").count()
    assert pieces == len(sizes)
    again = packing.packed(third, tokenizer("byte_bpe_50k.json"))
    assert {tuple(r) for r in again.select("doc_id", "piece", "length", "ids_crc32").collect()} == {tuple(r) for r in last.select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_queries_and_scratch(spark, data_dir):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    df = scratch.saved(spark.range(5), "x")
    assert df.count() == 5
    scratch.drop(df)
    assert corpus_pipeline.run(spark, data_dir).count() > 0
