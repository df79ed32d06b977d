import hashlib
import random
import re
import zlib

import pytest

from touchflow.llm import queries, runs

SCHEMA = "doc_id long, text string, runs string, collapsed string, words string"


def brute(words, least=12):
    """Every stretch that keeps a period as long as it goes, if no smaller period does."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if j > i and len(part) >= max(least, 2 * q) and not any(
                    all(part[k] == part[k + d] for k in range(len(part) - d)) for d in range(1, q)):
                found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def drawn(seed, count):
    draw = random.Random(seed)
    for _ in range(count):
        n, letters = draw.randrange(0, 60), draw.choice([1, 2, 2, 3, 5, 40])
        words = [b"w%d" % draw.randrange(letters) for _ in range(n)]
        if n and draw.random() < 0.6:
            a = draw.randrange(n)
            p = max(1, (n - a) // draw.randint(2, 6))
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        yield words


def test_equals_brute_force():
    for words in drawn(1, 600):
        assert runs.runs_of_words(words) == brute(words)
        assert runs.runs_of_codes([int(w[1:]) for w in words], 2) == brute(words, 2)


def test_fibonacci_words_have_overlapping_runs():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):
        a, b = b, b + a
    assert runs.runs_of_words(b) == brute(b)


def test_access_returns_the_segments_it_replaces():
    link, length, states = runs._automaton([0, 1, 0, 1])
    paths = runs.Paths(link, length)
    assert [paths.access(s, i) for i, s in enumerate(states)] == [
        [], [(0, 0)], [(0, 1), (1, 0)], [(1, 2), (2, 0)]]


def test_only_covered_stretches_are_searched():
    words = [b"u%d" % i for i in range(1000)] + [b"a", b"b", b"c"] * 5 + [b"v%d" % i for i in range(9)]
    codes = runs.np.array([hash(w) & 0xFFFF for w in words])
    assert runs._stretches(codes) == [(1000, 1015)]
    assert runs._stretches(codes[:1000]) == []


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *((best[1], -best[0], best[2], -1000 * best[0] // best[2])
                                  if best else (None,) * 4),
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, " \t".join(w.decode() for w in words)) for i, words in enumerate(drawn(4, 150))]
    rows += [(1000, None), (1001, ""), (1002, " \n\x0b "), (None, "a b " * 9), (5, "é é x  " * 20),
             (5, "é é x  " * 20), (1003, "\x1c\x1d a\x85 " * 12)]
    rows += [(2000 + i, "\r\n".join(draw.choice("ab") for _ in range(draw.randrange(80))))
             for i in range(150)]
    rows += [(3000, "one two three " * 400 + "end"), (3001, "x" * 100_000 + " y" * 40)]
    spark.createDataFrame([(*r, "r", "c", "w") for r in rows], SCHEMA) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_suffix_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_operator_and_empty_table(spark):
    table = spark.createDataFrame([(1, "go on " * 8 + "stop", "r", "c", "w"), (2, "stop", "r", "c", "w")],
                                  SCHEMA)
    got = {r["doc_id"]: r for r in runs.periodic_runs(table).collect()}
    assert got[1]["collapsed"] == "go on stop"
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 16, 2)] and got[2]["runs"] == []
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("period", [1, 7, 3000])
def test_long_texts(period):
    words = [b"w%d" % (i % period) for i in range(60_000)]
    assert runs.runs_of_words(words) == [(0, 60_000, period)]
