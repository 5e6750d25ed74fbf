"""Odd rows and clashing names for every operator, and what SQL can't check: proximity, blocks of a benchmark, pages of planted parts."""

import numpy as np
import pytest

import corpus_pipeline
from regolith.llm import chat, decontam, html, languages, lm, merkle, mixing, periodic, quality, simhash, substring, urls, warc


def words(n, seed=0):
    g = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in g.integers(0, 26, 6)) for _ in range(n))


CLASH = "id int, ID2 int, FP string, Component string, N_words string, HOST string, Rule string, `Copy` int, RATE int, Kept string, in0 string, c0 string, mark int, row_id int, n_chars bigint, Text2 string"
OPERATORS = {
    "mixing": lambda d, b: mixing.mixed(d, 0.5), "html": lambda d, b: html.extracted(d, "text"), "quality": lambda d, b: quality.judged(d), "substring": lambda d, b: substring.cut_repeats(d), "lm": lambda d, b: lm.scored(d),
    "urls": lambda d, b: urls.judged(d, urls.PLACES + urls.WORDS, "text"), "decontam": lambda d, b: decontam.searched(d, b, ("doc_id", "HOST")), "simhash": lambda d, b: simhash.grouped(d, simhash.CLOSE, keep=("FP", "HOST")), "near": lambda d, b: simhash.keep_one(d, corpus_pipeline.NEAR),
    "warc": lambda d, b: warc.round_trip(d.withColumnsRenamed({"doc_id": "page_id", "source": "url", "text": "html"})), "chat": lambda d, b: chat.messages(d.withColumnsRenamed({"doc_id": "conv_id", "source": "role"}).selectExpr("*", "1 AS turn")),
    "periodic": lambda d, b: periodic.collapsed(d), "languages": lambda d, b: languages.identified(d, languages.trained(d, lang_col="source")), "merkle": lambda d, b: merkle.manifest(d, "source", "doc_id", ("doc_id", "text", "N_words"), ("doc_id", "FP", "ID2", "mark", "Text2")),
}
EXPECTED = {"mixing": None, "near": 3}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_nulls_ties_and_repeats(spark, name):
    base = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "one two", None), (3, words(300), None), (4, words(300), "b"), (4, words(300), "b")]
    row = (1, 2, "f", "c", "n", "h", "r", 3, 4, "k", "x", "y", 5, 6, 7, "t")
    docs = spark.createDataFrame([(*b, *row) for b in base], f"doc_id bigint, text string, source string, {CLASH}")
    bench = spark.createDataFrame([(7, words(300)[70:200]), (7, "again"), (None, "one"), (9, None)], "item_id bigint, text string")
    out = OPERATORS[name](docs, bench)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == EXPECTED.get(name, len(base)) or name == "mixing"
    # What an operator hands on has the caller's values, whatever it calls its own columns.
    given = {"ID2": 2, "mark": 5, "c0": "y", "in0": "x", "Text2": "t", "FP": "f"}
    for c in {"ID2", "mark", "c0", "in0", "Text2"} & set(out.columns):
        assert {r[c] for r in rows} == {given[c]}
    assert OPERATORS[name](docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_benchmark_proximity_and_blocks_against_brute_force(spark, block_words):
    g = np.random.default_rng(5)
    items = [(k, words(int(g.integers(3, 16)), 40 + k).split()) for k in range(12)]
    docs = []
    for i in range(30):
        out = words(int(g.integers(5, 40)), 900 + i).split()
        for k in g.integers(0, 12, 3):
            part = list(items[k][1])
            if g.random() < 0.6:  # words pushed apart or swapped: near, not exact
                a = int(g.integers(0, len(part) - 1))
                part = part[:a] + ["between"] + part[a:] if g.random() < 0.5 else part[:a] + part[a : a + 2][::-1] + part[a + 2 :]
            out += [*part, "end"]
        docs.append((i, out))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in items], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.searched(table, bench, slack=2, block_words=block_words).collect()}
    often = {}
    for _, w in docs:
        for x in w:
            often[x] = often.get(x, 0) + 1
    n_near = 0
    for i, w in docs:
        exact, near, hit = set(), set(), set()
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        for k, item in items:
            for s in range(max(1, len(item) - 9)):
                win = item[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        exact.add(k)
                        hit |= set(range(p, p + len(win)))
                rarest = min(often.get(x, 0) for x in win)
                for o in [o for o, x in enumerate(win) if often.get(x, 0) == rarest]:
                    for p in at.get(win[o], []):
                        if all(any(abs(q - (p - o + j)) <= 2 for q in at.get(x, [])) for j, x in enumerate(win)):
                            near.add((k, o == min(j for j, x in enumerate(win) if often.get(x, 0) == rarest)))
        assert set(got[i].items) == exact and got[i].n_hit == len(hit) == sum(x.end - x.begin for x in got[i].spans)
        # Of equally rare words any may be the one from which places are counted.
        found = set(got[i].near_items)
        assert {k for k, first in near if first} <= found | exact and exact <= found <= {k for k, _ in near}
        n_near += len(found - exact)
    assert n_near > 5


def test_pages_of_planted_parts():
    """Random pages: articles in whatever container, between menus, notices, adverts, forms and comments, some of which only their text's sparseness gives away."""
    g = np.random.default_rng(3)
    line = lambda n: " ".join(words(int(n), int(g.integers(1 << 30))).split())
    for k in range(60):
        paragraphs = [line(g.integers(12, 60)) for _ in range(int(g.integers(2, 7)))]
        title = line(4)
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}" + ("<span class=ad>buy</span>" if g.random() < 0.3 else "") + "</p>" + ("<aside>see also</aside><div class='share-buttons'>share</div>" if g.random() < 0.3 else "") for p in paragraphs)
        box = str(g.choice(["article", "main", "div", "section class='related-work'", "div id=content-sidebar-wrap"]))
        links = "".join(f"<li><a href=/{x}>{line(2)}</a></li>" for x in range(int(g.integers(4, 9))))
        parts = [f"<nav><ul>{links}</ul></nav>", f"<{box}>{body}</{box.split()[0]}>", f"<ul>{links}</ul>", f"<div class='comment-list'><p>{line(40)}</p></div>", f"<form><p>{line(30)}</p><input></form>", f"<footer><p>{line(30)}</p></footer>", f"<div id=cookie-notice>{line(30)}</div>"]
        page = "<html><head><title>t</title></head><body>" + parts[0] + parts[6] + "".join(parts[1:6]) + "</body></html>"
        assert html.main_text(page) == "\n\n".join([title, *paragraphs]), (k, box)
        assert html.main_text(page.replace("article", "div")) == html.main_text(page)
    teaser = "<article>teaser</article>"
    long = "<div>" + "".join(f"<p>{line(20)}</p>" for _ in range(4)) + "</div>"
    assert "teaser" not in html.main_text(long + teaser) and html.main_text(long + teaser) == html.main_text(long)


def test_time_follows_the_length_of_nested_pages():
    import time

    began = time.time()
    html.main_text("<div>" * 40_000 + "x" + "</b>" * 40_000)
    html.main_text("<div class=ad>" * 40_000 + "<article>" * 40_000 + "x")
    assert time.time() - began < 20


def test_mixing_against_brute_force_with_repeats(spark):
    import hashlib

    rows = [(k % 50 if k % 7 else None, "s" if k % 3 else None) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    n = {s: sum(r[1] == s for r in rows) for s in ("s", None)}
    want = {}
    for i, s in rows:
        rate = 120 * n[s] ** 0.5 / (n["s"] ** 0.5 + n[None] ** 0.5) / n[s]
        u = int(hashlib.md5(f"7|{'' if i is None else i}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-rate)
        upto = p
        while upto <= u:
            k, p = k + 1, p * rate / (k + 1)
            upto += p
        want[i, s] = want.get((i, s), 0) + k
    got = {}
    for r in mixing.mixed(docs, 0.5).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_only_the_letters_a_to_z_are_lowered_in_urls(spark):
    """A Kelvin sign before a word is no letter of a word, for the rules' tokens as for their patterns; URLs of 100,000 signs."""
    hosts = ["Kcasino.com", "CASINO.com", "kcasino.com", "casinoİ.net", "a." * 30_000 + "porn.org", "x.org"]
    rows = [(k, f"http://{h}/{'p' * 50_000 if k == 5 else ''}", None) for k, h in enumerate(hosts)]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string"), urls.WORDS).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}
