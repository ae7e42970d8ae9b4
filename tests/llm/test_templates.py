from collections import defaultdict

from cases import awkward, documents
from oracle import SF, compare

from pagemill.llm import queries, templates


def brute(rows, conf=templates.Conf()):
    docs, first = defaultdict(int), {}
    place = lambda d: (1 << 63) - 1 if d is None else d
    for d, t, *_ in rows:
        for key in {p for line in (t or "").split("\n") for p in templates.paths(line.encode(), conf)} if t is not None else ():
            docs[key] += 1
            first[key] = min(first.get(key, place(d)), place(d))
    out = []
    for d, t, *_ in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not any(docs[p] >= conf.least_docs and first[p] != place(d) for p in templates.paths(x.encode(), conf))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.001"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        got = found(queries.op7_templates(spark, sf))
        assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_paths():
    a = "Posted by user 12 on the main board at noon today"
    b = "Posted by user 99 on the main board at noon today"
    c = "Posted by nobody else on the main board at noon today"
    d = "Sent by user 12 on the main board at noon today"
    assert templates.paths(a.encode())[0] == templates.paths(b.encode())[0] != templates.paths(c.encode())[0]
    assert set(templates.paths(a.encode())) & set(templates.paths(c.encode()))
    assert not set(templates.paths(a.encode())) & set(templates.paths(d.encode()))
    assert templates.paths(b"two words") == [] and templates.paths(b"") == []
    assert len(templates.paths(b"one two three")) == 1


def test_recurring_lines_stay_in_the_first_document(spark):
    shared = "This notice stands under every page of this site and is long enough " + " ".join(f"w{chr(97 + k % 26)}x" for k in range(50))
    rows = [(k, f"Own line of {chr(97 + k) * 5} alone\n{shared}\nend {chr(97 + k) * 3}", "en", "a") for k in range(6)]
    rows += [(20 + k, f"Order number {k} was shipped to you today by our staff\n\nown{chr(97 + k)} text", "en", "a") for k in range(4)]
    rows += [(30, "pair of lines only seen twice in all documents", "en", "a"), (31, "pair of lines only seen twice in all documents", "en", "a")]
    rows += [(40, shared, "en", "a")]
    docs = documents(spark, rows)
    got = {r.doc_id: r.text for r in templates.cleaned(docs).collect()}
    assert shared in got[0] and all(shared not in got[k] for k in range(1, 6))
    assert "Order" in got[20] and all(got[20 + k] == f"\nown{chr(97 + k)} text" for k in range(1, 4))
    assert got[30] == got[31] and 40 not in got
    assert templates.cleaned(docs).schema == docs.schema


def test_awkward(spark):
    rows = awkward() + [(k, "A line that very many documents have\nA line that very many documents have\r\n\n", None, None) for k in (50, 51, None, 52)]
    docs = documents(spark, rows)
    got = templates.deduplicated(docs).select("row.doc_id", "n_lines", "n_dropped", "text")
    assert found(got) == brute(rows)
    assert templates.deduplicated(documents(spark, [])).count() == 0
    for r in templates.cleaned(docs).collect():
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_query_equals_sql(spark):
    assert compare(queries.op7_templates(spark, SF), queries.ORACLE_SQL["op7_templates"]) == 1000


def test_time_is_linear_in_the_lines(spark):
    """One document has 200,000 lines, half of which recur in others, and one template very many."""
    import time

    lines = [f"shared line of the one kind with word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)} here" for k in range(3000)]
    long = "\n".join(x for k in range(100_000) for x in (lines[k % 3000], f"own{'x' * (k % 7)} {k}"))
    rows = [(k, "\n".join(lines), "en", "a") for k in range(3)] + [(9, long, "en", "a")]
    began = time.time()
    got = {r.doc_id: r for r in templates.deduplicated(documents(spark, rows)).select("row.doc_id", "n_lines", "n_dropped", "text").collect()}
    assert time.time() - began < 60
    assert got[9].n_lines == 200_000 and got[9].n_dropped == 100_000 and got[9].text == "\n".join(long.split("\n")[1::2])
    assert got[0].n_dropped == 0 and got[1].text == ""


def test_copies_of_a_text_are_split(spark):
    """Copies of one text meet its hits in a join that Spark may split: neither side is an aggregate of the join's own stage."""
    rows = [(k, "one two three four\nfive six seven" if k % 3 else f"own {k} text\nfive six seven", "en", "a") for k in range(60)]
    plan = templates.deduplicated(documents(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Aggregate" not in plan.split("Join LeftOuter")[1]
