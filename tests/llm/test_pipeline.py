import re

import corpus_pipeline
from cases import awkward, documents
from test_packing import check
from test_simhash import slow_components, slow_distinct, slow_print, stays
from test_templates import brute

from pagemill.llm import langid, mix, simhash

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(mix.WORD, text or ""))


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on all that its predecessor kept, as the driver runs them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, rows, before = docs.schema, {}, docs.collect()
    net = langid.train(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == [f.name for f in schema] and [f.dataType for f in out.schema] == [f.dataType for f in schema]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = docs.collect()
    assert list(rows) == ["language_id", "line_dedup", "near_duplicates", "mixing", "packing"]

    # language ID: each text on its own, window by window
    want = set()
    for r in before:
        if langid.has_letter(r.text):
            windows, _, used = langid._windows([r.text.encode()], 256)
            p = (net.probabilities(windows) * used[:, None]).sum(axis=0)
            if p.max() / p.sum() >= 0.5:
                want.add(r.doc_id)
    assert {r.doc_id for r in rows["language_id"]} == want and len(want) > 0.95 * len(before)

    # line dedup
    given = [(r.doc_id, r.text) for r in rows["language_id"]]
    want = {d: t for d, n, lost, t in brute(given) if not lost or lost < n}
    assert {r.doc_id: r.text for r in rows["line_dedup"]} == want

    # near-duplicates: the least id of each group of texts that are similar by shingles
    given = [(r.doc_id, r.text) for r in rows["line_dedup"]]
    assert stays(spark.createDataFrame(rows["near_duplicates"], schema)) == slow_distinct(given)
    # and what the operator keeps by the bits of its contract: the least id of each component
    given = [(r.doc_id, slow_print(r.text)) for r in rows["line_dedup"]]
    kept = simhash.representatives(spark.createDataFrame(rows["line_dedup"], schema))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in slow_components(given) if d == c)

    # mixing: targets by source, texts cut from their documents
    texts = {r.doc_id: r for r in rows["near_duplicates"]}
    sizes, taken, each = {}, {}, {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in rows["mixing"]:
        assert r.text in texts[r.doc_id].text and r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        each[r.doc_id] = each.get(r.doc_id, 0) + words(r.text)
    order = sorted(sizes)
    for s, target in zip(order, mix.targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2), strict=True):
        assert abs(taken.get(s, 0) - target) <= 64
    assert all(n <= 2 * words(texts[d].text) for d, n in each.items())

    # packing
    check(rows["packing"], [(r.doc_id, r.text) for r in rows["mixing"]], 2048)

    again = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows["packing"])


def test_awkward_and_empty(spark):
    for given in (awkward(), []):
        docs = documents(spark, given)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_columns_of_any_type(spark):
    """Nested columns, columns without a type and names with odd characters pass through all stages but the last."""
    from pyspark.sql import functions as F

    docs = documents(spark, [(k, f"some own words of number {'abcdefghij'[k]} stand here for it alone " * 9, "en", "ab"[k % 2]) for k in range(10)])
    odd = docs.withColumns({"none": F.lit(None), "a.b c": F.array(F.struct(F.lit(1).alias("x"))), "at": F.create_map(F.lit("k"), F.lit(2)), "when": F.to_date(F.lit("2020-01-02"))})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.dtypes == odd.dtypes
        rows = out.collect()
        assert rows and all(r["a.b c"][0].x == 1 and r["at"] == {"k": 2} and r["none"] is None and str(r["when"]) == "2020-01-02" for r in rows)
    kept = simhash.representatives(odd)
    assert kept.count() == 10 and kept.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() >= 10
