import json

import pytest

from pagemill.functions import text
from pagemill.settings import Settings

CASES = r'''
"exam-\nple" | h | "example"
"exam- \nple" | hw | "exam-\nple"
"a--\nb" | h | "a-b"
"  a \n\tb　\n" | w | "a\nb\n"
"a\n \n\nb" | e | "a\n \n\nb"
"a\n \n\nb" | we | "a\n\nb"
"a\n\nb" | e | "a\n\nb"
"\n\n\n\na" | e | "\n\na"
"a\n\n b \n\t\nc" | m | "a b c"
"-\n\n\nx" | he | "\n\nx"
"\n \n" | m | ""
"" | hwem | ""
"a-\nb\n\n\n c" | hwem | "ab c"
'''.strip().splitlines()


@pytest.mark.parametrize("case", CASES)
def test_golden(spark, case):
    given, flags, want = (x.strip() for x in case.split(" | "))
    s = Settings(trim_whitespace="w" in flags, remove_hyphen_breaks="h" in flags, remove_empty_lines="e" in flags, merge_line_breaks="m" in flags)
    df = spark.createDataFrame([(json.loads(given),)], "t string")
    assert df.select(text.clean(df.t, s).alias("t")).first()[0] == json.loads(want)


def model(t, h, w, e, m):
    import re

    edge = " \t 　"
    if h:
        t = t.replace("-\n", "")
    if w:
        t = "\n".join(x.strip(edge) for x in t.split("\n"))
    if e:
        t = re.sub("\n{3,}", "\n\n", t)
    if m:
        t = " ".join(y for x in t.split("\n") if (y := x.strip(edge)))
    return t


def test_random_against_model(spark):
    import random
    from itertools import product

    r = random.Random(1)
    given = ["".join(r.choice("ab-\n\n\n \t　  ") for _ in range(r.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").coalesce(1)
    flags = list(product((False, True), repeat=4))
    out = df.select("k", *(text.clean(df.t, Settings(remove_hyphen_breaks=h, trim_whitespace=w, remove_empty_lines=e, merge_line_breaks=m)).alias(str(i)) for i, (h, w, e, m) in enumerate(flags)))
    for row in out.collect():
        for i, f in enumerate(flags):
            assert row[str(i)] == model(given[row.k], *f)


CR_CASES = r'''
"  a \r\n b " | w | "a \r\n b"
"a \r\n b \n c " | w | "a \r\n b\nc"
"a\r\n\n\n\nb" | e | "a\r\n\nb"
"a\r\n\r\n\r\nb" | e | "a\r\n\r\n\r\nb"
"a\r\nb\n \nc" | m | "a\r\nb c"
"a-\r\nb-\nc" | h | "a-\r\nbc"
" \r" | w | "\r"
'''.strip().splitlines()


@pytest.mark.parametrize("case", CR_CASES)
def test_carriage_returns(spark, case):
    """CR LF is one character, so no line ends there; a CR isn't trimmed."""
    test_golden(spark, case)


def test_random_with_carriage_returns(spark):
    import random
    import re
    from itertools import product

    def cr_model(t, h, w, e, m):
        edge = " \t\u00a0\u3000"
        if h:
            t = t.replace("-\n", "")
        if w:
            t = "\n".join(x.strip(edge) for x in re.split(r"(?<!\r)\n", t))
        if e:
            t = re.sub("\n{3,}", "\n\n", t)
        if m:
            t = " ".join(y for x in re.split(r"(?<!\r)\n", t) if (y := x.strip(edge)))
        return t

    r = random.Random(2)
    given = ["".join(r.choice(["a", "-", "\n", "\n", "\r\n", "\r", " ", "\t"]) for _ in range(r.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").coalesce(1)
    flags = list(product((False, True), repeat=4))
    out = df.select("k", *(text.clean(df.t, Settings(remove_hyphen_breaks=h, trim_whitespace=w, remove_empty_lines=e, merge_line_breaks=m)).alias(str(i)) for i, (h, w, e, m) in enumerate(flags)))
    for row in out.collect():
        for i, f in enumerate(flags):
            assert row[str(i)] == cr_model(given[row.k], *f)
