import random

import numpy as np

from pagemill.llm import chroma, queries

CONF = chroma.Conf()


def audio(words, lead=0, noise=0.0, seed=0):
    notes = chroma._notes()
    import zlib

    x = notes[[zlib.crc32(w.encode()) % 576 for w in words]].ravel() if words else np.empty(0, np.uint8)
    x = np.concatenate([np.full(lead, 128, np.uint8), x])
    if noise:
        x = (x + np.random.default_rng(seed).normal(0, noise, len(x))).clip(0, 255).astype(np.uint8)
    return chroma.wav(x, chroma.RATE)


def words(seed, n=80):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def test_wav():
    got, rate = chroma.samples(audio(words(1, 3)))
    assert rate == chroma.RATE and len(got) == 3 * chroma.NOTE
    two = b"RIFF\0\0\0\0WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\2\0\x40\x1f\0\0\0\0\0\0\4\0\x10\0data" + (8).to_bytes(4, "little") + b"\0\x40\0\x40\0\xc0\0\xc0"
    got, rate = chroma.samples(two)
    assert rate == 8000 and got.tolist() == [0.5, -0.5]
    for bad in (None, b"", b"RIFF", b"not audio at all, no", two[:30], two.replace(b"\1\0\2\0", b"\3\0\2\0")):
        assert chroma.samples(bad) is None


def test_areas_equal_plain_sums():
    maker = chroma.Fingerprinter()
    x, rate = chroma.samples(audio(words(2, 12)))
    picture = maker.chroma(x, rate)
    got = maker.integers(x, rate)
    for at in (0, 1, len(got) - 1):
        want = 0
        for k, f in enumerate(maker.filters):
            part = picture[at : at + f.width, f.pitch : f.pitch + f.height].astype(float)
            h, w = f.height, f.width
            a = [part[:, h // 2 :].sum(), part[w // 2 :].sum(), part[: w // 2, : h // 2].sum() + part[w // 2 :, h // 2 :].sum(), part[:, h // 3 : h - h // 3].sum(), part[w // 3 : w - w // 3].sum()][f.kind]
            answer = round(float(np.log1p(a) - np.log1p(part.sum() - a)), 6)
            want |= [0, 1, 3, 2][sum(answer > t for t in (-f.step, 0.0, f.step))] << (2 * k)
        assert bin(want ^ int(got[at])).count("1") <= 1


def table(spark, rows):
    return spark.createDataFrame([(k, a, "x", 1) for k, a in rows], "rec long, audio binary, cid string, chunk int").repartition(3)


def test_alignment(spark):
    song = words(3, 120)
    rows = [(0, audio(song)), (1, audio(words(9, 30) + song[20:100])), (2, audio(song, noise=3.0)), (3, audio(words(4, 120))), (5, audio(song)), (20, audio(song[10:90])), (40, audio(words(5, 60))), (60, None), (80, b"junk"), (100, audio([])), (120, audio(["a"]))]
    prints = chroma.fingerprints(table(spark, rows))
    from pyspark.sql import functions as F

    for conf in (CONF, chroma.Conf(chunk=600, block=300)):
        got = {r.rec: r for r in chroma.matches(prints, ["rec"], F.col("rec") % 20 == 0, conf).collect()}
        assert sorted(got) == [0, 20, 40, 60, 80, 100, 120]
        assert got[0].copies == 2 and got[0].match.rec in (1, 2, 20) and got[0].bit_errors < 0.35
        assert got[20].match.rec == 0 and got[20].offset == 20 and got[20].bit_errors < 0.05  # ten words are 20 frames
        assert got[40].match is None and got[40].copies == 1
        assert [got[k].copies for k in (60, 80, 100)] == [0, 0, 0] and got[120].copies == 1


def slow_align(a, b):
    votes = {}
    for i in chroma._starts(a):
        for j in chroma._starts(b):
            if a[i] == b[j]:
                votes[int(j - i)] = votes.get(int(j - i), 0) + 1
    if not votes:
        return None
    offset = min(votes, key=lambda o: (-votes[o], o))
    return offset, votes[offset]


def test_align_against_brute_force():
    r = np.random.default_rng(7)
    queries_ = [r.integers(0, 6, n).astype(np.uint32) for n in (5, 40, 80)]
    others = [r.integers(0, 6, n).astype(np.uint32) for n in (1, 30, 90)]
    conf = chroma.Conf(least_votes=1, most_errors=1.0)
    for most in (1 << 22, 20):
        got = {(q, o): (offset, votes) for q, o, offset, votes, *_ in chroma.align(queries_, others, conf, most)}
        for q, a in enumerate(queries_):
            for o, b in enumerate(others):
                assert got.get((q, o)) == slow_align(a, b)


def test_query(spark):
    got = queries.op4_chroma(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id % 20 = 0").count()
    assert got.count() == n and got.where("copies < 1").count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, text string")
    from pyspark.sql import functions as F

    assert chroma.matches(chroma.fingerprints(chroma.sonified(empty, ["conv_id", "turn"])), ["conv_id", "turn"], F.lit(True)).count() == 0


def test_all_matches_short_recordings_and_passages(spark):
    from pyspark.sql import functions as F

    song, other, third = words(3, 60), words(4, 60), words(6, 40)
    rows = [(0, audio(song + other)), (1, audio(song)), (2, audio(other)), (3, audio(other)), (4, audio(words(5, 60)))]
    rows += [(20, audio(song[10:20])), (60, audio(words(12, 5)))]  # two integers, one
    rows += [(40, audio(words(7, 150) + third + words(8, 150))), (41, audio(words(9, 200) + third + words(10, 200)))]
    prints = chroma.fingerprints(table(spark, rows))
    for conf in (CONF, chroma.Conf(chunk=300, block=150)):
        got = {r.rec: r for r in chroma.matches(prints, ["rec"], F.col("rec") % 20 == 0, conf).collect()}
        assert sorted((m.match.rec, m.copies) for m in got[0].matches) == [(1, 1), (2, 2), (20, 1)] and got[0].n_matches == 3
        first = got[0].matches[0]
        assert (got[0].match, got[0].offset, got[0].votes, got[0].bit_errors, got[0].overlap) == (first.match, first.offset, first.votes, first.bit_errors, first.overlap)
        assert sorted((m.match.rec, m.offset, m.votes) for m in got[20].matches) == [(0, 20, 2), (1, 20, 2)] and got[60].n_matches == 0
        assert [m.match.rec for m in got[40].matches] == [41] and got[40].offset == 100 and 40 <= got[40].overlap <= 120


def test_short_recordings_align():
    a, b = np.array([7, 9], np.uint32), np.array([1, 2, 3, 7, 9, 4, 5], np.uint32)
    assert list(chroma.align([a], [b], CONF)) == list(chroma.align([a], [b], chroma.Conf(most_errors=0.0))) == [(0, 0, 3, 2, 0.0, 2)]
    assert list(chroma.align([np.array([7, 1 << 31], np.uint32)], [b[:3]], CONF)) == []


def test_stretch():
    r = np.random.default_rng(11)
    a, b = (r.integers(0, 1 << 32, 300).astype(np.uint32) for _ in range(2))
    b[150:180] = a[120:150]
    assert chroma.errors(a, b, 30)[0] > 0.35
    share, n = chroma.stretch(a, b, 30, 4, CONF)
    assert share <= 0.05 and 30 <= n <= 36
    b[150:180:2] ^= np.uint32(1)
    assert chroma.stretch(a, b, 30, 4, CONF)[1] >= 30 and chroma.stretch(a, b, 30, 40, CONF) is None
    scattered = b.copy()
    scattered[150:180] = r.integers(0, 1 << 32, 30)
    scattered[[40, 100, 190, 280]] = a[[10, 70, 160, 250]]
    assert chroma.stretch(a, scattered, 30, 4, CONF) is None


def test_query_against_brute_force(spark):
    """Every query turn against every other turn, one pair at a time, with turns that share passages added to the table."""
    import zlib

    sf = "/root/testdata/sf0.001"
    real = [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    r = random.Random(4)
    own = [" ".join(words(100 + k, 60)) for k in range(4)]
    rows = real + [(2000 + 10 * k, 0, " ".join(words(200 + k, r.randrange(5, 30))) + " " + " ".join(own[k % 4].split()[k : k + 40])) for k in range(24)]
    rows += [(1100, 0, own[0]), (1101, 0, own[0]), (1120, 0, None), (1140, 0, ""), (1160, 1, real[5][2])]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4).write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/turns-{r.random()}/conversations.parquet")
    got = {(x.conv_id, x.turn): x for x in queries.op4_chroma(spark, path.rsplit("/", 1)[0]).collect()}
    maker, notes, prints = chroma.Fingerprinter(), chroma._notes(), {}
    for c, t, text in rows:
        codes = [zlib.crc32(w.encode()) % 576 for w in (text or "").lower().split()]
        if codes:
            prints[c, t] = maker.integers(*chroma.samples(chroma.wav(notes[codes].ravel(), chroma.RATE)))
    assert got.keys() == {(c, t) for c, t, _ in rows if c % 20 == 0}
    different = {p.tobytes(): min(k for k, q in prints.items() if q.tobytes() == p.tobytes()) for p in prints.values()}
    linked = 0
    for key, x in got.items():
        a = prints.get(key)
        if a is None:
            assert (x.copies, x.n_matches, x.match_conv_id) == (0, 0, None)
            continue
        assert x.copies == sum(q.tobytes() == a.tobytes() for q in prints.values())
        found = []
        for data, name in different.items():
            b = np.frombuffer(data, "<u4")
            if data == a.tobytes():
                continue
            need = min(chroma._least(a, chroma._starts(a), CONF), chroma._least(b, chroma._starts(b), CONF))
            votes = {}
            for i in chroma._starts(a):
                for j in chroma._starts(b)[b[chroma._starts(b)] == a[i]]:
                    votes[int(j - i)] = votes.get(int(j - i), 0) + 1
            for offset in sorted((o for o, n in votes.items() if n >= need), key=lambda o: (-votes[o], o)):
                agreed = chroma.stretch(a, b, offset, need, CONF)
                if agreed:
                    found.append((-votes[offset], agreed[0], name, offset, agreed[1]))
                    break
        assert x.n_matches == len(found)
        if found:
            linked += 1
            best = [f for f in found if f[:2] == min(found)[:2]]
            assert (-x.votes, x.bit_errors, (x.match_conv_id, x.match_turn), x.offset, x.overlap) in best
    assert linked >= 5
