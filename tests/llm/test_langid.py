import numpy as np
from cases import awkward, documents
from oracle import SF

from pagemill.llm import langid, queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 250 and right / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_tables_equal_the_network():
    conf = langid.Conf(window=32, filters=4)
    net = langid.ByteNet(["a", "b"], conf)
    x = np.random.default_rng(1).integers(0, 256, (70, 32)).astype(np.uint8)
    act = []
    for w, k, b in zip(conf.widths, net.kernels, net.biases, strict=True):
        cols = np.concatenate([net.embed[x][:, i : 32 - w + 1 + i] for i in range(w)], axis=2)
        act.append((cols @ k + b).max(axis=1))
    want = langid._softmax(np.maximum(np.concatenate(act, axis=1), 0) @ net.out + net.shift)
    assert np.abs(net.probabilities(x) - want).max() < 1e-3


def test_windows_cover_whole_texts():
    texts = [b"", b"x" * 256, b"y" * 257, b"z" * 1000]
    windows, owner, used = langid._windows(texts, 256)
    assert [used[owner == k].sum() for k in range(4)] == [1, 256, 257, 1000]
    assert b"".join(windows[owner == 3].tobytes().split(b"\0")) == texts[3]


def test_awkward(spark):
    docs = documents(spark, awkward())
    got = {r.doc_id: r for r in langid.identify(docs, conf=langid.Conf(epochs=1)).collect()}
    for k in (2, 3, 4, 9):
        assert got[k].lang_pred == "und" and got[k].score == 0
    assert got[5].lang_pred in ("en", "fr", "de")
    assert not got[None].held_out
    assert langid.accepted(docs, conf=langid.Conf(epochs=1)).columns == docs.columns
    # nothing to learn from
    none = documents(spark, [(1, "Some text.", None, "a")])
    assert langid.identify(none).first().lang_pred == "und"
    assert langid.identify(documents(spark, [])).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    conf = langid.Conf(epochs=2)
    assert sorted(langid.identify(docs, conf=conf).collect()) == sorted(langid.identify(other, conf=conf).collect())


def test_filter_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = langid.accepted(docs)
    assert kept.count() > 0.98 * docs.count() and kept.schema == docs.schema


def test_gradients_are_those_of_the_loss():
    conf = langid.Conf(window=12, filters=3, vector=2, widths=(2, 3))
    net = langid.ByteNet(["a", "b", "c"], conf)
    params = [net.embed, *net.kernels, *net.biases, net.out, net.shift]
    r = np.random.default_rng(4)
    wide = [r.normal(0, 0.5, p.shape) for p in params]  # doubles, so that differences are exact enough
    wide[0][0] = 0

    def use(values):
        net.embed, net.kernels, net.biases, net.out, net.shift = values[0], values[1:3], values[3:5], values[5], values[6]

    use(wide)
    x, y, weight = r.integers(0, 9, (7, 12)).astype(np.uint8), r.integers(0, 3, 7), r.random(7) + 0.5

    def loss():
        act = []
        for w, k, b in zip(conf.widths, net.kernels, net.biases, strict=True):
            cols = np.concatenate([net.embed[x][:, i : 12 - w + 1 + i] for i in range(w)], axis=2)
            act.append(np.maximum((cols @ k + b).max(axis=1), 0))
        p = langid._softmax(np.concatenate(act, axis=1) @ net.out + net.shift)
        return float((-np.log(p[np.arange(7), y]) * weight).mean())

    for which, (p, g) in enumerate(zip(wide, net._gradients(x, y, weight), strict=True)):
        for at in np.ndindex(p.shape):
            if which == 0 and (at[0] == 0 or at[0] > 8):
                assert g[at] == 0
                continue
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_rows_without_an_id_are_learned(spark):
    words = {"aa": "alpha omega gamma delta", "bb": "zwölf böhmische märkte", "cc": "ιδεα χρονος λογος"}
    rows = [(None, f"{w} {k} {w[::-1]}", g, "s") for g, w in words.items() for k in range(40)]
    got = langid.identify(documents(spark, rows), conf=langid.Conf(epochs=6)).collect()
    assert {r.lang_pred for r in got} == set(words)


def test_every_label_is_learned_and_the_sample_is_bounded(spark):
    """Hundreds of labels, one of which has most rows, and most of these are copies of one row."""
    rows = [(k, f"label{k % 300} text {k}", f"l{k % 300:03}", "s") for k in range(1800)] + [(5000, "the same row", "l000", "s")] * 3000
    rows += [(6000 + k, f"own row {k}", "l000", "s") for k in range(600)]
    docs = documents(spark, rows)
    sample = langid.sampled(docs, langid.Conf(sample_rows=900))
    by = {}
    for lang, cuts in sample:
        by.setdefault(lang, []).append(cuts)
    assert len(by) == 300 and all(1 <= len(x) <= 3 for x in by.values())
    many = [cuts[0] for lang, cuts in langid.sampled(docs, langid.Conf(sample_rows=10**6)) if lang == "l000"]
    assert len(many) == len(set(many)) > 350  # of about 400 that aren't held out
    assert len(langid.train(docs, langid.Conf(epochs=0)).langs) == 300


def test_query_against_brute_force(spark):
    """Every text on its own, window by window, filter by filter, with the network that the query learns."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.train(docs)
    got = {r.doc_id: r for r in queries.op2_langid(spark, sf).collect()}
    for r in docs.collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        data, total = text.encode(), np.zeros(len(net.langs))
        for at in range(0, len(data), 256):
            x = np.frombuffer(data[at : at + 256].ljust(256, b"\0"), np.uint8)
            act = [(np.concatenate([net.embed[x][i : 257 - w + i] for i in range(w)], axis=1) @ k + b).max(axis=0) for w, k, b in zip(net.conf.widths, net.kernels, net.biases, strict=True)]
            total += langid._softmax((np.maximum(np.concatenate(act), 0) @ net.out + net.shift)[None])[0] * len(data[at : at + 256])
        total /= total.sum()
        assert got[r.doc_id].held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1)
        assert total[net.langs.index(got[r.doc_id].lang_pred)] > total.max() - 0.01 and abs(got[r.doc_id].score - total.max()) < 0.01


def test_scores_do_not_depend_on_the_batch():
    net = langid.ByteNet([f"l{k}" for k in range(7)])
    x = np.random.default_rng(2).integers(0, 256, (333, 256)).astype(np.uint8)
    whole = net.probabilities(x)
    for size in (1, 5, 64, 100):
        assert (np.concatenate([net.probabilities(x[at : at + size]) for at in range(0, 333, size)]) == whole).all()
