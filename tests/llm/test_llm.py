import hashlib
import itertools
import json
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from regolith.llm import chat, decontam, html, lm, mixing, quality, simhash, substring, urls, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, packed string, fp string, host string, component string"


def frame(spark, rows):
    """Documents with null ids and texts where given, and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, "p", "f", "h", "c") for i, t, s in rows], DOCS)


def words(n, seed=0):
    g = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in g.integers(0, 26, 6)) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "one two", None), (3, words(300), None), (4, words(300), "b"), (5, "x", "b")]


def test_warc_round_trip(spark):
    page = "<p>é" + "x" * 200
    rows = [(1, "http://a/\r\nX: y", page), (2, None, page), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", page), (6, "u", words(200_000))]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == 7
    for i, _, body in rows:
        body = (body or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert [(i, r.refers_to) for i, r in got.items() if r.record_type == "revisit"] in ([(2, 1), (None, 1)], [(None, 1), (2, 1)])
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_ranges_own_each_record_once(tmp_path):
    at = tmp_path / "a.warc.gz"
    with at.open("wb") as f:
        for i in range(60):
            f.write(warc.record_bytes("response", i, "u", words(20, i).encode(), str(i), None, "2024-01-01T00:00:00Z"))
            if i == 30:
                f.write(b"\x1f\x8b\x08 damaged")
    size = at.stat().st_size
    for split in (97, 1000, size):
        found = [f["x-page-id"] for b in range(0, size, split) for _, f, _ in warc.records_in(str(at), b, b + split)]
        assert sorted(map(int, found)) == list(range(60))


def test_html_on_written_cases():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a>x</a></nav>") == ""
    page = "<title>t</title><nav><ul><li><a>m</a></ul></nav><div class=ad>buy</div><article><h1>T &amp; x</h1><p>a <span class='ad'>zz</span> b<br>c<p>d<aside>no</aside><p>e&nbsp;f<script>if(a<b){'</p>'}</script><div id=comments>no</div></article><footer>f</footer>"
    assert html.main_text(page) == "T & x\n\na b c\n\nd\n\ne f"
    assert html.main_text("<div id=menu><p>x</div><div><p>" + "word " * 30 + "<p>short</div><div class='comment-list'>" + "c " * 99 + "</div>") == ("word " * 30).strip() + "\n\nshort"
    assert html.main_text("<article><p>cut <b hre") == "cut"


def test_html_against_a_plain_reading(spark):
    """The given pages have one article each: its text, block by block, by a pattern instead of a parser."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        body = re.sub(r"<[^>]*$", "", body[1]) if body else ""
        import html as std

        blocks = [" ".join(std.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<b>", "").replace("</b>", ""))]
        assert html.main_text(r.html) == "\n\n".join(b for b in blocks if b)


def brute_prints(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    base = words(120, 3).split()
    rows = [(i, " ".join(base[: 118 + i % 3] + [f"w{i}"] * (i % 2)), "s") for i in range(40)] + [(100 + i, t, "s") for i, (_, t, _) in enumerate(ODD)]
    got = {r.id: r for r in simhash.grouped(frame(spark, rows), simhash.CLOSE).collect()}
    prints = {i: brute_prints(t) for i, t, _ in rows}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    for i in prints:
        assert got[i].fp[0] & (2**64 - 1) == prints[i] and got[i].component == root(i)


def test_large_blocks_lose_no_link(spark):
    g = np.random.default_rng(1)
    f = [int(x) for x in {int(0b1011 << 32 | x & 0xFFFF) for x in g.integers(0, 1 << 16, 500)}]
    nodes = simhash.written(spark.createDataFrame([(i, [x]) for i, x in enumerate(f)], "node bigint, fp array<bigint>"))
    from regolith.llm.graph import components

    groups = lambda small: {(r.node, r.component) for r in components(simhash.links(nodes, simhash.CLOSE, small)).collect()}
    assert groups(10) == groups(1000)


def test_decontamination_quality_and_substrings_on_odd_rows(spark):
    bench = spark.createDataFrame([(7, " ".join(words(300).split()[100:115])), (8, "X"), (9, None), (10, "")], "item_id bigint, text string")
    found = {(r.doc_id, r.n_words): r for r in decontam.searched(frame(spark, ODD), bench).collect()}
    assert found[(3, 300)].n_hit == 15 and found[(3, 300)].items == [7] and found[(5, 1)].items == [8] and found[(1, 0)].n_hit == 0
    judged = quality.judged(frame(spark, ODD)).collect()
    assert len(judged) == 7 and {r.doc_id for r in judged if r.kept} == {3, 4}
    cut = {(r.doc_id, r.n_words): r for r in substring.cut_repeats(frame(spark, ODD)).collect()}
    assert cut[(3, 300)].n_removed == 0 and cut[(4, 300)].n_removed == 300 and cut[(4, 300)].kept_text.strip() == ""
    empty = frame(spark, ODD).limit(0)
    assert decontam.searched(empty, bench).count() == quality.judged(empty).count() == substring.cut_repeats(empty).count() == 0


def test_substrings_against_brute_force(spark):
    g = np.random.default_rng(2)
    shared = words(70, 9).split()
    rows = [(i, " ".join(words(int(g.integers(0, 90)), 50 + i).split() + shared[int(g.integers(0, 20)) :] + words(30, 90 + i).split()), "s") for i in range(12)]
    first = {}
    lists = {i: t.split() for i, t, _ in rows}
    for i, ws in lists.items():
        for s in range(len(ws) - 49):
            first.setdefault(tuple(ws[s : s + 50]), i)
    for r in substring.cut_repeats(frame(spark, rows)).collect():
        ws = lists[r.doc_id]
        gone = {p for s in range(len(ws) - 49) if first[tuple(ws[s : s + 50])] < r.doc_id for p in range(s, s + 50)}
        assert r.kept_text.split() == [w for p, w in enumerate(ws) if p not in gone] and r.n_removed == len(gone)


def test_mixing_is_repeatable_and_meets_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 10 = 0 THEN NULL ELSE 'big' END AS source", "1 AS copy", "'p' AS packed")
    weights = spark.createDataFrame([(None, 1.0), ("big", 1.0), ("none", 5.0)], "source string, weight double")
    a, b = (mixing.mixed(d, weights) for d in (docs, docs.repartition(7)))
    n = {r.source: r["count"] for r in a.groupBy("source").count().collect()}
    assert 1700 < n[None] < 2300 and 1700 < n["big"] < 2300
    assert a.exceptAll(b).count() == 0 and mixing.mixed(docs.limit(0), weights).count() == 0


def test_urls(spark):
    cases = [("http://x.net/a", "net/", "block"), ("http://Example.NET/en/q?x", "example.net/en/", "allow"), ("https://a.example.com/de/", "example.com/de/", "block"), ("http://b.org/fr/1", "org/fr/", "allow"),
             ("http://notnet/", None, "allow"), ("no url", None, "allow"), (None, None, "allow"), ("http://x.net", None, "allow"), ("http://casino.io/", "casino", "block")]
    df = spark.createDataFrame([(i, u, "h", "r") for i, (u, _, _) in enumerate(cases)], "page_id bigint, url string, host string, rule string")
    for r in urls.judged(df, urls.PLACES + urls.WORDS).collect():
        assert (r.rule, r.verdict) == cases[r.page_id][1:]


def test_many_url_rules_against_brute_force(spark):
    """30,000 rules of all sorts over random URLs, with repeated and null ones."""
    g = np.random.default_rng(8)
    word = lambda n: "".join("abcdefghij"[c] for c in g.integers(0, 10, n))
    rules = [urls.place_rule(str(g.choice(["block", "allow"])), f"{word(2)}.{word(1)}/" + "/".join(word(1) for _ in range(int(g.integers(0, 3))))) for _ in range(20_000)]
    rules += [urls.word_rule(word(int(g.integers(2, 5)))) for _ in range(10_000)] + [urls.Rule("odd", "block", r"/[ab]+\z", ())]
    links = [f"http://{word(2)}.{word(2)}.{word(1)}/{word(1)}/{word(1)}?q" for _ in range(150)] + [f"http://{word(3)}.{word(1)}/{word(1)}" for _ in range(50)] + [None, "no url", ""]
    links += links[:20]
    compiled = [re.compile(r.pattern.replace(r"\z", r"\Z")) for r in rules]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(links)], "page_id bigint, url string, HOST string, Rule string")
    got = {r.page_id: r for r in urls.judged(pages, tuple(rules)).collect()}
    n = 0
    for i, u in enumerate(links):
        m = re.match("(?s)(.*?)://([^/?#]*)([^?#]*)", u or "")
        subject = m[2].lower() + m[3] if m else ""
        fits = [k for k, c in enumerate(compiled) if c.search(subject)]
        best = max(fits, key=lambda k: (rules[k].rank, -k), default=None)
        n += len(fits) > 1
        assert (got[i].rule, got[i].verdict) == ((rules[best].name, rules[best].verdict) if fits else (None, "allow"))
    assert len(got) == len(links) and n > 20
    assert urls.judged(pages.limit(0), tuple(rules[:9])).count() == 0 and urls.judged(pages, ()).where("verdict <> 'allow'").count() == 0


def test_chat_links_orders_and_validates(spark):
    call = '<tool_call>{"name":"search","id":"a","arguments":{"query":"x","limit":"3"}}</tool_call>'
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"a","content":{"z":1,"b":[1, 2]}}'), (1, 2, "assistant", "Let me look. " + call), (1, 3, "tool", '{"tool_call_id":"zz","content":"c"}'), (None, 0, None, None), (2, 0, "assistant", "<tool_call>{bad</tool_call>")]
    got = {(r.conv_id, r.turn): r for r in chat.messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert (got[1, 1].anchor_turn, got[1, 1].step, got[1, 1].linked) == (2, 1, True) and got[1, 3].linked is False
    assert got[1, 2].message == '{"content":"Let me look.","role":"assistant","tool_calls":[{"arguments":{"limit":"3","query":"x"},"id":"a","name":"search"}]}'
    assert got[1, 2].n_invalid == 1 and got[2, 0].n_malformed == 1 and got[None, 0].message == "{}"


def test_chat_validates_nested_schemas(spark):
    call = lambda **a: "<tool_call>" + json.dumps({"id": "a", "name": a.pop("tool", "search"), "arguments": a}) + "</tool_call>"
    cases = [
        (call(query="x", limit=2, kinds=["page", "table"]), []), (call(query="", limit=0, kinds=["page", "map"]), ["arguments.query breaks minLength", "arguments.limit breaks minimum", "arguments.kinds[1] is not listed"]),
        (call(limit=1.5), ["arguments.query is missing", "arguments.limit is not integer"]), (call(query="x", limit=2.0, more=1), ["arguments.more is unexpected"]),
        (call(tool="look_up", key="k", options={"depth": "1", "a": "s", "b": True}), ["arguments.options.depth is not integer"]),
        (call(tool="look_up", key="k", options={"depth": -1, "a": [1]}, fields=["u", 2]), ["arguments.fields[1] is not string", "arguments.options.depth breaks minimum", "arguments.options.a is not string or boolean"]),
        (call(tool="none"), ["unknown tool none"]), ('<tool_call>{"name":"search","arguments":[1]}</tool_call>', ["arguments are no object"]), ('<tool_call>{"name":"search","arguments":"{\\"query\\":\\"x\\"}"}</tool_call>', []),
    ]
    rows = [(1, k, "assistant", t) for k, (t, _) in enumerate(cases)]
    got = {r.turn: r.errors for r in chat.links(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [got[k] for k in range(len(cases))] == [e for _, e in cases]


def test_chat_orders_chains_as_brute_force_does(spark):
    """Random conversations with chains of calls, late and early results, repeated ids and circles."""
    g, rows = np.random.default_rng(5), []
    for conv in [*range(12), None]:
        for turn in range(14):
            kind, ids = g.integers(0, 3), [f"c{x}" for x in g.integers(0, 8, 3)]
            if kind == 0:
                text = f"say {turn}"
            elif kind == 1:
                text = "<tool_call>" + json.dumps({"id": ids[0], "name": "search", "arguments": {"query": "q"}, "depends_on": ids[1 : 1 + int(g.integers(0, 3))]}) + "</tool_call>"
            else:
                text = json.dumps({"tool_call_id": ids[0], "content": "r"})
            rows.append((conv, turn, "tool" if kind == 2 else "assistant", text))
    want = {}
    for conv in [*range(12), None]:
        own = [(t, role, x) for c, t, role, x in rows if c == conv]
        called, answered, needs = {}, {}, {}
        reads = [(t, role, json.loads(re.sub("</?tool_call>", "", x))) for t, role, x in own if not x.startswith("say")]
        for t, role, x in reads:
            (answered if role == "tool" else called).setdefault(x["tool_call_id"] if role == "tool" else x["id"], t)
        for t, role, x in reads:
            wanted = [called.get(x["tool_call_id"])] if role == "tool" else [answered.get(i, called[i]) for i in x["depends_on"] if i in called]
            needs[t] = {s for s in wanted if s is not None and s != t}
        place = {t: (t, 0) for t, _, _ in own if not needs.get(t)}
        while ready := [t for t in needs if t not in place and needs[t] <= set(place)]:
            place |= {t: max((t, 0), *((place[s][0], place[s][1] + 1) for s in needs[t])) for t in ready}
        want |= {(conv, t): place.get(t, (t, 0)) for t, _, _ in own}
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (r.anchor_turn, r.step) for r in chat.messages(turns).collect()}
    assert got == want and sum(s > 1 for _, s in want.values()) > 3
    assert chat.messages(turns.limit(0)).count() == 0 and chat.messages(turns.union(turns)).count() == 2 * len(rows)


def test_lm_prefers_order_on_held_out_texts(spark):
    """Words in a cycle, entered anywhere: the neighbours tell the word, and a shuffled text is less likely."""
    g = np.random.default_rng(0)
    text = lambda k: " ".join(f"w{(k + i) % 30}" for i in range(120))
    ring = spark.createDataFrame([(i, text(int(g.integers(30)))) for i in range(400)], "doc_id bigint, text string").repartition(2)
    s = lm.Settings(batch=512, rounds=3)
    model = lm.trained(ring, s)
    held = [(0, text(7)), (1, " ".join(g.permutation(text(7).split())))]
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(held, "doc_id bigint, text string"), settings=s, model=model).collect()}
    assert got[0].per_word > got[1].per_word + 2 and got[0].per_word > -0.5 and got[0].n_words == 120
    begin = lm.scored(spark.createDataFrame(held, "doc_id bigint, text string"), settings=s, model=(model[0], lm.start(model[0], s))).where("doc_id = 0").first()
    assert got[0].per_word > begin.per_word + 1


def test_lm_tells_rare_words_apart_by_context_whatever_the_partitions(spark):
    """Production settings on held-out texts: each of 300 words follows its own word only. The model doesn't depend on the table's partitions."""
    g = np.random.default_rng(4)
    text = lambda n: " ".join(f"a{k} b{k}" for k in g.integers(0, 300, n))
    docs = spark.createDataFrame([(i, text(100)) for i in range(1500)], "doc_id bigint, text string")
    odd = docs.union(spark.createDataFrame([(9000, None), (9001, ""), (9002, "")], docs.schema))
    models = [lm.trained(docs.repartition(n)) for n in (1, 7)]
    for a, b in zip(models[0][1], models[1][1]):
        assert np.allclose(a, b, atol=1e-5)
    own = text(200)
    wrong = " ".join(w if w[0] == "a" else f"b{g.integers(300)}" for w in own.split())
    held = spark.createDataFrame([(0, own), (1, wrong)], docs.schema)
    score = [{r.doc_id: r.per_word for r in lm.scored(held, model=m).collect()} for m in models]
    assert score[0][0] > score[0][1] + 0.5 and abs(score[0][0] - score[1][0]) < 1e-4
    got = {r.doc_id: r for r in lm.scored(odd, model=models[0]).collect()}
    assert len(got) == 1503 and all((r.per_word is None) == (r.n_words == 0) for r in got.values()) and got[9000].log_likelihood == 0


def test_lm_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, words(30, i % 7)) for i in range(40)], "doc_id bigint, text string")
    s = lm.Settings(rare=4, fine=16, least=0.0045)
    vocabulary, weights = lm.trained(docs, s)
    assert 0 < len(vocabulary.own) < 210
    fine = np.array([(b << 20) | 1 << 63 for b in range(s.fine)], np.uint64)
    for left in vocabulary.own[:3]:
        total = 0.0
        for h in [*vocabulary.own, *fine]:
            total += np.exp(lm.log_probabilities(vocabulary, weights, np.array([left, h, left], np.uint64), np.zeros(3, np.int64), s)[1])
        assert abs(total - 1) < 1e-3
    assert lm.scored(docs.limit(0)).count() == 0


def test_near_copies_leave_one_document(spark):
    base = words(200, 4).split()
    near = [(i, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "s") for i, k in enumerate(range(20, 180, 10))]
    rows = near + [(100 + i, words(200, 60 + i), "s") for i in range(20)] + [(None, "", "s"), (None, "", "s")]
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, rows), corpus_pipeline.NEAR).collect()]
    assert sorted(x for x in kept if x is not None) == [0, *range(100, 120)] and kept.count(None) == 2


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_and_bear_empty_tables(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), "/root/testdata/sf0.001")
    assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)


@pytest.mark.parametrize("small,piece", [(512, 4096), (5, 4096), (5, 16)])
def test_wide_blocks_lose_no_link(spark, monkeypatch, small, piece):
    """Fingerprints that all share a block, in groups around centres: links as brute force has them, whether blocks are listed or dealt out in pieces."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    g, rows = np.random.default_rng(3), []
    for c in range(6):
        centre = g.integers(0, 2, 512)
        centre[:64] = 1
        for k in range(25):
            bits = centre.copy()
            bits[g.choice(np.arange(64, 512), int(g.choice([20, 60, 90, 140])), replace=False)] ^= 1
            rows.append((len(rows), np.packbits(bits).view(">i8").astype(int).tolist()))
    f = np.array([x for _, x in rows]).view(np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(-1) <= corpus_pipeline.NEAR.distance
    name = np.arange(len(rows))
    while not np.array_equal(now := np.where(near, name[None], len(rows)).min(1), name):
        name = now
    from regolith.llm.graph import components

    nodes = simhash.written(spark.createDataFrame(rows, "node bigint, fp array<bigint>"))
    got = {r.node: r.component for r in components(simhash.links(nodes, corpus_pipeline.NEAR, small)).collect()}
    assert got == {i: n for i, n in enumerate(name.tolist()) if i != n} and len(set(name.tolist())) > 5


@pytest.mark.parametrize("n_others", [0, 3000])
def test_recall_at_the_limit_does_not_depend_on_size(spark, n_others):
    """Pairs with similarities from 0.8 on, of short and long texts, alone and among many others: at least 98 of 100 are found, and no pair below."""
    g, rows = np.random.default_rng(21), []
    for k in range(200):
        n = int(g.choice([30, 120, 700]))
        base = words(n, 10_000 + k).split()
        m = int(n * g.uniform(0.06, 0.14))
        rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(base[: n - m] + words(m, 20_000 + k).split()), "s")]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t, _ in rows}
    alike = {k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(200)}
    rows += [(1000 + k, words(40, 50_000 + k), "s") for k in range(n_others)]
    got = {r.id: r.component for r in simhash.grouped(frame(spark, rows), corpus_pipeline.NEAR).collect()}
    wanted = [k for k, s in alike.items() if s >= 0.8]
    assert len(wanted) > 80 and len(wanted) < 190
    assert sum(got[2 * k + 1] == 2 * k for k in wanted) >= 0.98 * len(wanted)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in alike if alike[k] < 0.8)


@pytest.mark.parametrize("family", [simhash.FAMILY, 600])
def test_near_copies_are_judged_by_their_sets_of_shingles(spark, monkeypatch, family):
    """Families of pages from one template with different bodies, around the limit, against a brute-force reading; whole and dealt out in pieces."""
    monkeypatch.setattr(simhash, "FAMILY", family)
    g, rows = np.random.default_rng(11), []
    for c in range(6):
        base = words(200, 300 + c).split()
        for k in range(12):
            cut = int(g.choice([8, 18, 26, 30, 40]))
            rows.append((len(rows), " ".join(base[: 200 - cut] + words(cut, 1000 + len(rows)).split()), "s"))
        ring = base[100:] + words(100, 400 + c).split()
        for k in range(8):  # a chain: neighbours are near copies, its ends are not
            rows.append((len(rows), " ".join(ring[k * 10 : k * 10 + 120]), "s"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, _ in rows]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(len(rows)), 2)}
    name = list(range(len(rows)))
    for (a, b), s in alike.items():
        if s >= 0.8:
            low, high = sorted((name[a], name[b]))
            name = [low if x == high else x for x in name]
    assert sum(0.65 < s < 0.8 for s in alike.values()) > 100 and len(set(name)) < len(rows) - 30
    got = {r.id: r.component for r in simhash.grouped(frame(spark, rows), corpus_pipeline.NEAR).collect()}
    # No link is false; of 1000 pairs at the limit, blocks miss 3.
    assert len(got) == len(rows) and all(name[i] == name[c] for i, c in got.items())
    assert sum(got[i] != n for i, n in enumerate(name)) <= 0.03 * len(rows)


def test_warc_reads_headers_of_any_length_and_misses_no_record(spark, monkeypatch):
    g = np.random.default_rng(6)
    url = "data:text/html;base64," + "".join(map(chr, g.integers(65, 91, 300_000)))
    pages = spark.createDataFrame([(1, url, "x" * 200), (2, "u", "x" * 200), (3, "v", "short")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert sorted(got) == [1, 2, 3] and got[1].target_uri == url and got[2].refers_to == 1 and got[1].payload_bytes == got[2].payload_bytes == 200
    all_of = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: all_of(*a, **k).where("page_id <> 3"))
    with pytest.raises(RuntimeError, match="3 records were written and 2 read"):
        warc.round_trip(pages)
