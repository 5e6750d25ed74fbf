import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regolith.llm import languages, queries

DOCS = "doc_id bigint, text string, lang string, score string, LANG_PRED string, in0 int"
ROOT = "/root/testdata"


class Plain:
    """Prediction by partial matching a byte at a time, with exclusion, on dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            t = b" " * order + t.encode()
            for i in range(order, len(t)):
                for n in range(order + 1):
                    self.seen[t[i - n : i]][t[i]] += 1

    def share(self, context, byte):
        """The byte's probability after `order` bytes."""
        p, out = 1.0, set()
        for n in range(self.order, -1, -1):
            counts = {b: c for b, c in self.seen.get(context[len(context) - n :], {}).items() if b not in out}
            if not counts:
                continue
            whole = sum(counts.values()) + len(counts)
            if byte in counts:
                return p * counts[byte] / whole
            p, out = p * len(counts) / whole, out | counts.keys()
        return p / (256 - len(out))

    def bits(self, text):
        t = b" " * self.order + text.encode()
        return -sum(math.log2(self.share(t[i - self.order : i], t[i])) for i in range(self.order, len(t)))


def some_texts(g, letters, n):
    return ["".join(g.choice(letters) for _ in range(g.randrange(1, 60))) for _ in range(n)]


def tree_of(texts, order):
    rows = [c for b in languages._counts(order)(iter([pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], names=["lang", "text"])])) for c in b.to_pylist()]
    sums = Counter()
    for r in rows:
        sums[r["n"], r["packed"]] += r["count"]
    return languages.Tree([tuple(np.array(x, t) for x, t in zip(zip(*sorted((p, c) for (m, p), c in sums.items() if m == n)), (np.uint64, np.int64))) for n in range(order + 1)])


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_against_plain_prediction(order):
    g = random.Random(order)
    learned = some_texts(g, "aab é", 30)
    plain, tree = Plain(learned, order), tree_of(learned, order)
    asked = [*some_texts(g, "abc éß", 20), "", "a", "ab" * 300]
    data, at = languages.bytes_of(pa.array(asked))
    units = tree.lengths(languages.windows(data, at, order, 0, len(data)))
    for k, t in enumerate(asked):
        assert sum(units[at[k] : at[k + 1]]) / languages.UNIT == pytest.approx(plain.bits(t), abs=1e-5 * (len(t) + 1))


def test_bytes_after_a_context_share_one():
    g = random.Random(9)
    tree = tree_of(some_texts(g, "ab c", 40), 3)
    for context in (b"ab ", b"zzz", b"aba", b"  a"):
        packed = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp2(-tree.lengths(packed) / languages.UNIT).sum() == pytest.approx(1, abs=1e-4)


def test_pieces_and_the_table_change_nothing(monkeypatch):
    g = random.Random(2)
    trees = [tree_of(some_texts(g, x, 40), 4) for x in ("abc ", "cde é")]
    data, at = languages.bytes_of(pa.array([*some_texts(g, "abcde é", 200), None, "", "x"]))
    whole = languages.windows(data, at, 4, 0, len(data))
    pieces = np.concatenate([languages.windows(data, at, 4, k, min(len(data), k + 7)) for k in range(0, len(data), 7)])
    assert (whole == pieces).all()
    small = languages.Lengths(trees, 32)
    plain = np.stack([t.lengths(whole) for t in trees], 1)
    assert all((small(whole) == plain).all() for _ in range(3))


def test_predictions_against_plain_prediction(spark):
    """Odd rows: nulls, no letters, repeated rows, a long text, capitals, clashing names."""
    g = random.Random(4)
    learned = [(k, t, lang) for lang, x in (("aa", "abcd "), ("bb", "bcde "), ("é", "fgé ")) for k, t in enumerate(some_texts(g, x, 40))]
    odd = [(1, None, "aa"), (2, "", "bb"), (3, "12 -!", "bb"), (None, "abab abba", None), (5, "FGÉ fg", "aa"), (5, "FGÉ fg", "aa"), (6, "bcde " * 100_000, None)]
    frame = lambda rows: spark.createDataFrame([(*r, "s", "l", 1) for r in rows], DOCS)
    settings = languages.Settings(order=3)
    model = languages.trained(frame(learned + odd[:4]), settings)
    assert sorted(model) == ["aa", "bb", "é"]
    got = languages.identified(frame(odd), model, settings)
    assert got.columns == ["doc_id", "text", "lang", "in0", "lang_pred", "score"]
    plain = {lang: Plain(sorted({t: collapse(t) for _, t, x in learned if x == lang and t.strip()}.values()), 3) for lang in model}
    for r in got.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            bits = {k: p.bits(collapse(r.text.lower())[:3000]) for k, p in plain.items()}
            assert r.lang_pred == min(bits, key=lambda k: (bits[k], k)) and 0 < r.score <= 1
    assert languages.identified(frame([]), model, settings).collect() == []
    empty = languages.trained(frame([]), settings)
    assert empty == {} and {(r.lang_pred, r.score) for r in languages.identified(frame(odd), empty, settings).collect()} == {("und", 0.0)}


def collapse(t):
    """One space for each stretch of anything but letters, as letters() has it."""
    out = []
    for c in t:
        if c.isalpha():
            out.append(c)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def test_a_small_sample_bounds_the_model(spark):
    docs = spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet")
    whole, part = (languages.trained(docs, languages.Settings(sample_bytes=n)) for n in (1 << 30, 200_000))
    size = lambda m: {k: int(v[0][1].sum()) for k, v in m.items()}
    assert all(20_000 < size(part)[k] < 90_000 < size(whole)[k] for k in whole)


def test_held_out_accuracy(spark):
    got = queries.op13_languages(spark, f"{ROOT}/sf0.01").join(spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.n > 200 and r.right >= 0.98 and 0 <= r.low <= r.high <= 1
