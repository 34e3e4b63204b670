"""The pipeline's stages one after the other, each held against brute force on what its predecessor kept."""

from collections import defaultdict

import corpus_pipeline
from corpus import SCHEMA, rows, table
from test_copies import components_by_hand, lines_by_hand
from test_search_and_pack import contamination_by_hand, words

from glyphflow.llm import packing, quality_classifier

JUNK = [(1000 + k, "BUY!! NOW!! CHEAP!! PILLS!! HERE!! FAST!! " * 8 + f"n{k}") for k in range(20)]


def folder(spark, path, given, items):
    table(spark, given).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in given[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, tmp_path):
    given = rows() + JUNK
    items = [(k, " ".join(words(t)[5:45])) for k, (_, t) in enumerate(given[:10])] + [(90, None), (91, "")]
    sf_dir = folder(spark, tmp_path / "sf", given, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs, stages = [texts(docs)], dict(corpus_pipeline.STAGES)
    for number, name in enumerate(list(stages)[:-1]):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        judged, docs = docs, spark.read.schema(SCHEMA).parquet(str(tmp_path / str(number)))
        inputs.append(texts(docs))
        if name == "quality_classifier":
            kept = sorted(r.doc_id for r in quality_classifier.classify(judged, labels=spark.read.parquet(f"{sf_dir}/labels.parquet")).where("accepted").collect())
            assert [i for i, _ in inputs[-1]] == kept
            assert not {i for i, _ in JUNK} & set(kept)
            assert {i for i, t in rows() if t and 40 < len(t.split()) < 1000} <= set(kept)
        elif name == "line_dedup":
            by_hand, before = lines_by_hand(inputs[-2]), dict(inputs[-2])
            cut = {i for i in before if by_hand[i][0] + by_hand[i][1]}
            assert inputs[-1] == [(i, by_hand[i][2] if i in cut else before[i]) for i in sorted(before) if i not in cut or by_hand[i][2].strip()]
        elif name == "ngram_jaccard":
            groups = components_by_hand(inputs[-2])
            assert [i for i, _ in inputs[-1]] == sorted({c for _, c in groups.values()})
        else:
            hits = contamination_by_hand(inputs[-2], items)
            assert [i for i, _ in inputs[-1]] == sorted(i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n))
            assert len(inputs[-1]) < len(inputs[-2])
    encode = packing.encoder(packing.default_tokenizer()).ids
    lengths = defaultdict(int)
    for r in stages["packing"](spark, docs, sf_dir).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(encode(t or "")) + 1 for i, t in inputs[-1]}
    whole = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        whole[r.doc_id] += r.length
    assert whole == lengths


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "sf", [], [(1, "a b c")])).count() == 0
