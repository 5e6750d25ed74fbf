import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from regolith.llm import periodic, queries

DOCS = "doc_id bigint, text string, runs string, STRONGEST string, h int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(ws, least=24, times=3):
    """(start, length, period) by trying every period at every word."""
    found = {}
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plant(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def brute(doc_id, text):
    ws = plant(doc_id, words_of(text))
    runs = brute_runs(ws)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def repeating(g, n, size):
    ws = [str(g.randrange(size)) for _ in range(n)]
    for _ in range(g.randrange(4)):
        if n > 3:
            a = g.randrange(n)
            p = g.randrange(1, 2 + (n - a) // 3)
            for i in range(a, g.randrange(a, n + 1)):
                ws[i] = ws[a + (i - a) % p]
    return ws


def test_runs_against_every_period(spark):
    g = random.Random(5)
    for _ in range(150):
        texts = [repeating(g, g.choice([0, 1, 23, 24, 25, 60, 300]), g.choice([1, 2, 3, 40])) for _ in range(5)]
        names = {w: k for k, w in enumerate({w for ws in texts for w in ws})}
        codes, at = np.array([names[w] for ws in texts for w in ws], np.int64), np.cumsum([0, *map(len, texts)])
        row, *found = periodic.found_runs(codes, at)
        for k, ws in enumerate(texts):
            assert [tuple(map(int, r)) for r in zip(*(x[row == k] for x in found))] == brute_runs(ws)


def test_deceiving_hashes_are_found_out(monkeypatch):
    """With hashes that are all alike every stretch seems to go on; the words decide."""
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0))
    ws = np.array([*range(40), *([1, 2, 3, 4, 5] * 8), *range(50, 80), *([7] * 30), 3])
    _, *found = periodic.found_runs(ws, np.array([0, len(ws)]))
    assert [tuple(map(int, r)) for r in zip(*found)] == brute_runs(ws.tolist())


def test_query_against_brute_force(spark):
    """Nulls, blanks of all kinds, repeated rows and ids, texts of one word many times over, a text of 30,000 words, clashing names."""
    g = random.Random(1)
    rows = [(i, g.choice([" ", "\n", "\x0b\t"]).join(repeating(g, g.choice([0, 3, 24, 90, 400]), g.choice([2, 30, 900])))) for i in range(250)]
    rows += [(None, "a " * 30), (900, None), (901, ""), (902, " \t\n"), (903, "é b " * 40), (903, "é b " * 40), (904, "x" * 100_000), (10, None)]
    long = [str(k) for k in np.random.default_rng(0).zipf(1.4, 30_000) % 400]
    long[20_000:21_500] = long[20_000:20_500] * 3
    df = spark.createDataFrame([(*r, "r", "s", 0) for r in rows], DOCS)
    got = [tuple(r) for r in queries.run_digest(queries.planted(df)).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    one = periodic.collapsed(spark.createDataFrame([(1, " ".join(long), "", "", 0)], DOCS)).first()
    assert any(r["period"] == 500 and r["start"] <= 20_000 and r["length"] >= 1500 for r in one.runs) and one.n_words == 30_000
    assert [tuple(r) for r in one.runs] == brute_runs(long)
    assert periodic.collapsed(df.where("false")).collect() == []


def test_columns_and_defined_results(spark):
    df = spark.createDataFrame([(1, "a b " * 20, "r", "s", 7), (2, None, "r", "s", 8), (3, "", "r", "s", 9)], DOCS)
    got = {r.doc_id: r for r in periodic.collapsed(df).collect()}
    assert periodic.collapsed(df).columns == ["doc_id", "text", "h", "n_words", "runs", "strongest", "collapsed_text"]
    assert got[1].collapsed_text == "a b" and got[1].h == 7 and tuple(got[1].strongest) == (0, 40, 2)
    assert (got[2].n_words, got[2].runs, got[2].strongest, got[2].collapsed_text) == (0, [], None, None)
    assert (got[3].n_words, got[3].runs, got[3].collapsed_text) == (0, [], "")
