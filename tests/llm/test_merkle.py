import hashlib
import random
import zlib

import pytest

from regolith.llm import merkle, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, PATH string, pos int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return digest(*map(field, (r[0], r[3], r[2], r[4], r[1])))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
        out.append((run[: i % 2], run[i % 2 + 1 :]))
        i //= 2
    return out


def brute(rows):
    """The query's rows by plain Python, one tree at a time."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels_of([leaf(r) for r in groups[g]]) for g in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = path_of(trees[k], i) + path_of(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4] + 1)) if changed else trees[k][0][i]
            for before, after in path:
                h = digest(*before, h, *after)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], digest(*(x for b, a in path for x in b + a)), h, h == top[-1][0]))
    return out


def odd_rows():
    g = random.Random(3)
    langs = [None, "en", "", "de", "ß", "z" * 3000]
    rows = [(i - 50, g.choice([None, "", "é" * i, "x y\n"]), g.choices(langs, [1, 300, 3, 9, 1, 1])[0], g.choice([None, "s"]), g.choice([None, i, -i])) for i in range(900)]
    rows += [(None, "a", "alone", None, None), (None, "b", "en", None, 3), (None, "a", "en", None, 3), (2000, "w " * 400_000, "en", "s", 800_000)]
    return rows + [(5, "t", "en", "s", 3)] * 40  # rows that repeat, and share their id with another


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(2, 2)])
def test_manifest_against_brute_force(spark, shape):
    """Nulls in every column, one hot group, a group of one, repeated rows and ids, a text of 800,000 signs, clashing names."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "l", "p", 1) for r in rows], DOCS).repartition(7)
    got = queries.manifest_digest(df, shape).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_one_row_is_its_own_root_and_none_is_none(spark):
    one = spark.createDataFrame([(1, "t", None, None, None, "", "", 0)], DOCS)
    (r,) = merkle.manifest(one, keep=("doc_id",)).collect()
    assert r.leaf == r.subroot == r.root == leaf((1, "t", None, None, None)) and r.path == []
    assert merkle.manifest(one.where("false"), keep=("doc_id",)).collect() == []


def test_wider_nodes_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, str(i), "ab"[i % 9 == 0], "s", i) for i in range(500)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = merkle.manifest(df, keep=("doc_id",), shape=merkle.Shape(5, 2))
    assert found.count() == 500
    assert found.where(merkle.folded(found["leaf"], found["path"]) != found["root"]).isEmpty()
    assert found.where(merkle.folded(merkle.digest(found["doc_id"]), found["path"]) == found["root"]).isEmpty()
