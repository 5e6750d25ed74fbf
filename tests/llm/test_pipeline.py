"""The pipeline against a brute-force version, stage by stage as dictionaries and sets of word tuples."""

import hashlib
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from regolith.llm import quality

BLANK = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(n, seed):
    g = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in g.integers(0, 26, 6)) for _ in range(n)]


def corpus():
    """Documents with exact and near copies, shared passages, benchmark passages, junk, bad hosts, nulls, repeats and a long text."""
    g = np.random.default_rng(12)
    passage, bench = words(80, 1), words(60, 2)
    docs = []
    add = lambda text, source: docs.append((len(docs), text, "en", source, len(text) if text is not None else None))
    for k in range(60):
        add(" ".join(words(int(g.integers(60, 200)), 100 + k)), f"host{k % 4}")
    for k in range(10):
        base = docs[k][1].split()
        add(" ".join(base), "host1")
        base[30] = "changed"
        add(" ".join(base), "host2")
    for k in range(8):
        add(" ".join(words(70, 300 + k) + passage[: 50 + 3 * k] + words(40, 400 + k)), "host3")
    for k in range(6):
        at = int(g.integers(0, 40))
        add(" ".join(words(90, 500 + k) + [w.upper() for w in bench[at : at + 10 + k - 1]] + words(20, 600 + k)), "host0")
    for k in range(30):
        add("buy now " * 60 if k % 10 else " ".join(words(90, 700 + k)), "spam")
    add(None, "host0")
    add("", None)
    add("short text", None)
    add(" ".join(words(20_000, 800)), None)
    docs.append(docs[5])
    docs += [(None, " ".join(words(80, 801)), "en", "host1", 1), (None, None, None, None, None)]
    return docs, [(1, " ".join(bench)), (2, None), (3, ""), (4, docs[40][1].split()[3])]


def kept_by_rules(docs):
    out, hosts = [], {}
    for d in docs:
        ws = re.findall(BLANK, d[1] or "")
        three = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        often = {x for x in three if three.count(x) > 1} if len(ws) < 5000 else set()
        n_repeat = len({i + j for i, x in enumerate(three) if x in often for j in range(3)})
        base = len(ws) < 50 or 100 * n_repeat > 50 * len(ws)
        lines = [x for x in (d[1] or "").split("\n") if re.search(BLANK, x)]
        chars, symbols = sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", d[1] or ""))
        bad = base or 10 * symbols > len(ws) or 10 * (len(lines) - len(set(lines))) > len(ws) or not 2 * len(ws) <= chars <= 15 * len(ws)
        h = hosts.setdefault(d[3], [0, 0])
        h[0] += 1
        h[1] += bad
        out.append((d, base))
    n, f = np.array(list(hosts.values()), float).T
    mean, alone = f.sum() / n.sum(), f.sum() / n.sum() * (1 - f.sum() / n.sum())
    between = (n * (f / n - mean) ** 2).sum() - alone * (len(n) - 1)
    weight = min(max(1 / (between / (alone * ((n * (1 - n / n.sum())).sum() - (len(n) - 1)))) - 1, 2), 200)
    x = (np.arange(1000) + 0.5) / 1000
    p = x ** (mean * weight - 1) * (1 - x) ** ((1 - mean) * weight - 1)
    limit = max(0.5, x[np.argmax(np.cumsum(p) / p.sum() >= 0.95)] + 0.0005)
    rejected = {h for h, (a, b) in hosts.items() if (b + mean * weight) / (a + weight) > limit}
    return [d for d, base in out if not base and d[3] not in rejected], rejected


def one_of_each(docs):
    docs = list(dict.fromkeys(d for d in docs if d[0] is not None)) + [d for d in docs if d[0] is None]
    named = [k for k, d in enumerate(docs) if d[0] is not None]
    shingles = {}
    for k in named:
        ws = re.findall(BLANK, lowered(docs[k][1]))
        shingles[k] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}
    root = {k: k for k in named}
    for i, a in enumerate(named):
        for b in named[i + 1 :]:
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                low, high = sorted((root[a], root[b]), key=lambda k: docs[k][0])
                root = {k: low if r == high else r for k, r in root.items()}
    return [d for k, d in enumerate(docs) if d[0] is None or root[k] == k]


def cut(docs):
    first, out = {}, []
    lists = [re.findall(BLANK, d[1] or "") for d in docs]
    for d, ws in zip(docs, lists):
        for i in range(len(ws) - 49):
            if d[0] is not None:
                first[tuple(ws[i : i + 50])] = min(d[0], first.get(tuple(ws[i : i + 50]), d[0]))
    for d, ws in zip(docs, lists):
        gone = {i + j for i in range(len(ws) - 49) if d[0] is not None and first.get(tuple(ws[i : i + 50]), d[0]) < d[0] for j in range(50)}
        if not gone or len(gone) < len(ws):
            out.append((d[0], tuple(w for i, w in enumerate(ws) if i not in gone), *d[2:4]))
    return out


def clean(docs, bench):
    windows = set()
    for _, text in bench:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))} if ws else set()
    sizes = {len(w) for w in windows}
    own = lambda ws: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(" ".join(ws)))
    words = [own(d[1]) for d in docs]
    return [d for d, ws in zip(docs, words) if not any(tuple(ws[i : i + n]) in windows for n in sizes for i in range(len(ws) - n + 1))]


def copies(docs):
    n = {}
    for d in docs:
        n[d[3]] = n.get(d[3], 0) + 1
    out = {}
    for d in docs:
        rate = len(docs) * n[d[3]] ** 0.5 / sum(x**0.5 for x in n.values()) / n[d[3]]
        u = int(hashlib.md5(f"7|{'' if d[0] is None else d[0]}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p, upto = 0, math.exp(-rate), math.exp(-rate)
        while upto <= u:
            k += 1
            p *= rate / k
            upto += p
        if k:
            out[d] = out.get(d, 0) + k
    return out


def plain(row):
    return (row.doc_id, tuple(re.findall(BLANK, row.text or "")), row.lang, row.source)


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ruled, rejected = kept_by_rules(docs)
    assert rejected == {"spam"} and len(ruled) < len(docs) - 25
    single = one_of_each(ruled)
    trimmed = cut(single)
    left = clean(trimmed, bench)
    assert len(ruled) - 20 >= len(single) and trimmed != [(d[0], tuple((d[1] or "").split()), *d[2:4]) for d in single] and len(left) < len(trimmed)
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[plain(r)] = got.get(plain(r), 0) + 1
    assert got == copies(left)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_bear_odd_rows_and_clashing_columns(spark, k):
    docs, bench = corpus()
    odd = spark.createDataFrame([(*d, 1, "x", 2, "y", 3) for d in docs], SCHEMA + ", Component int, in0 string, N_WORDS int, `Copy` string, row_mark int")
    out = corpus_pipeline.STAGES[k][1](spark, odd, "/root/testdata/sf0.001")
    assert out.count() > 30 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == [c for c in odd.columns])


def test_hosts_are_judged_by_their_rates_and_sizes(spark):
    """Forty fair hosts, one bad and large, one bad but tiny, one bad in half: only the large bad one goes."""
    rows = [(h, n, f) for h, n, f in [*((f"h{k}", 50, 5 + k % 3) for k in range(40)), ("bad", 200, 190), ("tiny", 2, 2), ("half", 40, 18)]]
    measures = spark.createDataFrame([(h, i < f) for h, n, f in rows for i in range(n)], "source string, base_failed boolean").selectExpr("source", "base_failed", "100 AS n_words", "0 AS n_symbols", "0 AS n_dup_lines", "500 AS word_chars")
    got = {r.host: r.host_rejected for r in quality.host_verdicts(measures, "source", quality.HostRule()).collect()}
    assert [h for h, bad in got.items() if bad] == ["bad"] and len(got) == 43
    assert quality.prior_of(0, 0, 0, 0.0, 0.0, quality.HostRule())[2] == 1.0
