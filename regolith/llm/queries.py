"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, languages, lm, merkle, mixing, periodic, quality, simhash, substring, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, 0.5).select("doc_id", "text", "lang", "source", "n_chars", F.col("copy").cast("bigint").alias("copy"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=2)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"), simhash.CLOSE)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judged(table(spark, sf_dir, "pages"), urls.PLACES + urls.WORDS)
    named = F.when(F.col("rule").isin(*(r.name for r in urls.PLACES)), F.col("rule"))
    return found.select("page_id", "host", "path", named.alias("rule"), "verdict")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.messages(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "anchor_turn", "step", "n_calls", "n_invalid", "n_malformed", "linked", "message")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return substring.cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def manifest_digest(docs: DataFrame, shape: merkle.Shape = merkle.Shape()) -> DataFrame:
    """Of op11_merkle: the manifest of docs, and for every row the root that its path gives, where 7 divides the id's crc32 after n_chars has been raised by one."""
    marks = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = docs.withColumn("raised", F.when(marks, merkle.digest(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields))))
    found = merkle.manifest(changed, fields=fields, keep=("doc_id", "raised"), shape=shape)
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("raised", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: of op12_periodic, where 10 divides the id's crc32 the words from one on repeat a stretch of theirs; such texts are written anew with one space between words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = docs.select("doc_id", "text", (h % 10).alias("turn"), F.floor(h / 10).alias("g"))
    some = at.withColumn("ws", F.when(F.col("turn") == 0, words)).withColumn("n", F.size("ws"))
    some = some.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    moved = F.expr("array_join(transform(ws, (w, i) -> if(i < a, w, get(ws, cast(a + (i - a) % p AS int)))), ' ')")
    return some.select("doc_id", F.when(F.col("n") > 0, moved).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))


def run_digest(docs: DataFrame) -> DataFrame:
    found = periodic.collapsed(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = {c: F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")}
    milli = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *best.values(), milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed_text", F.lit("")), 256).alias("collapsed_sha256"))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = languages.trained(docs.where(~held_out))
    return languages.identified(docs, model, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_mixing, op3_html, op4_decontamination, op5_simhash, op6_quality, op7_urls, op8_chat, op9_substring, op10_lm, op11_merkle, op12_periodic, op13_languages)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _url_sql() -> str:
    """Rules written anew: places by the host's end and the path's beginning, longest first; words between signs that aren't letters or digits."""
    places = (("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block"))
    split = [(name, *name.split("/", 1), verdict) for name, verdict in places]
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{name}'" for name, h, p, _ in split)
    verdicts = " ".join(f"WHEN rule = '{name}' THEN '{verdict}'" for name, *_, verdict in split)
    words = "casino|casino-win|cheap-pills|free-bets|ads-track|porn|viagra|payday-loans|replica-watches|click-bait"
    host = _LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    return rf"""
WITH split AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {cases} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN regexp_matches(host, '(^|[^a-z0-9])({words})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


#: CRC-32 of a whole number's digits, with its table made from the polynomial by the bit.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"


def _tree_sql(name: str, source: str) -> str:
    """A recursive table of a tree's nodes (g, level, pos, hash) above source (g, pos, hash)."""
    return f"""{name} AS (SELECT g, 0 AS level, pos, hash FROM {source} UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 GROUP BY g, level, pos // 2)"""


def _fold_sql(name: str, tree: str, start: str, key: str) -> str:
    """A recursive table that climbs a tree from start (key, g, pos, h, changed, proof), level by level."""
    both = "CASE WHEN s.hash IS NULL THEN {0} WHEN f.pos % 2 = 0 THEN {0} || s.hash ELSE s.hash || {0} END"
    return f"""{name} AS (SELECT {key}, g, 0 AS level, pos, h, changed, proof FROM {start} UNION ALL
  SELECT {key}, f.g, f.level + 1, f.pos // 2, sha256({both.format("f.h")}), sha256({both.format("f.changed")}), f.proof || coalesce(s.hash, '')
  FROM {name} f JOIN {tree}_height t ON f.g = t.g AND f.level < t.height LEFT JOIN {tree} s ON s.g = f.g AND s.level = f.level AND s.pos = xor(f.pos, 1))"""


ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)""",
    "op2_mixing": """
WITH counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * weight / (SELECT sum(weight) FROM counts) / n AS rate FROM counts),
parted AS (SELECT source, greatest(CAST(ceil(rate / 16) AS BIGINT), 1) AS parts, rate / greatest(ceil(rate / 16), 1) AS mean FROM rates),
steps AS (SELECT source, parts, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto FROM parted, range(100) r(k)),
lists AS (SELECT source, parts, list(upto) AS steps FROM steps GROUP BY source, parts),
draws AS (SELECT d.doc_id, d.source, l.steps, unnest(range(1, l.parts + 1)) AS j FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT doc_id, source, sum(len(list_filter(steps, lambda c: c <= CAST('0x' || substr(md5('7|' || doc_id || '|' || j), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE))) AS n
           FROM draws GROUP BY ALL)
SELECT doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy FROM documents d JOIN copies c USING (doc_id)""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
iw AS (SELECT item_id, least(len(ws), 10) AS size, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda s: array_to_string(ws[s:s + 9], ' '))) AS k FROM i WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS s, unnest(list_transform(range(1, len(ws) - size + 2), lambda s: array_to_string(ws[s:s + size - 1], ' '))) AS k FROM d, sizes),
m AS (SELECT doc_id, s, iw.size, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.size = iw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id),
occ AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
tf AS (SELECT w, count(*) AS n FROM occ GROUP BY w),
win AS (SELECT item_id, k, size, row_number() OVER () AS win_id FROM (SELECT DISTINCT item_id, k, size FROM iw)),
parts AS (SELECT win_id, item_id, size, unnest(string_split(k, ' ')) AS w, unnest(range(size)) AS o FROM win),
anchor AS (SELECT parts.* FROM parts JOIN tf USING (w) QUALIFY row_number() OVER (PARTITION BY win_id ORDER BY n, o) = 1 AND count(*) OVER (PARTITION BY win_id) = size),
base AS (SELECT win_id, item_id, doc_id, occ.p - a.o AS z FROM anchor a JOIN occ USING (w)),
close AS (SELECT DISTINCT b.win_id, b.item_id, b.doc_id, b.z, parts.o, parts.size FROM base b JOIN parts ON parts.win_id = b.win_id JOIN occ q ON q.doc_id = b.doc_id AND q.w = parts.w AND q.p BETWEEN b.z + parts.o - 2 AND b.z + parts.o + 2),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT win_id, item_id, doc_id, z FROM close GROUP BY win_id, item_id, doc_id, z, size HAVING count(*) = size) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)""",
    "op6_quality": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format('text')} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS s, unnest(list_transform(range(1, len(ws) - 1), lambda s: array_to_string(ws[s:s + 2], ' '))) AS k FROM d),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest([s, s + 1, s + 2]) AS p FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.k = twice.k) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS any_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (any_failed) AS f FROM a GROUP BY source),
s AS (SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(f::DOUBLE * f / n) AS ff, sum(n::DOUBLE * n) AS nn FROM h),
v AS (SELECT f / n AS mean, (ff - f * f / n - f / n * (1 - f / n) * (h - 1)) / nullif(f / n * (1 - f / n) * (n - nn / n - (h - 1)), 0) AS spread FROM s),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(1 / spread - 1, 2.0), 200.0) ELSE 200.0 END AS w FROM v),
g AS (SELECT k, exp((mean * w - 1) * ln((k + 0.5) / 1000) + ((1 - mean) * w - 1) * ln(1 - (k + 0.5) / 1000)) AS d FROM p, range(1000) r(k)),
q AS (SELECT greatest(0.5, (min(k) + 1) / 1000.0) AS lim FROM (SELECT k, sum(d) OVER (ORDER BY k) / sum(d) OVER () AS upto FROM g) WHERE upto >= 0.95),
bad AS (SELECT source FROM h, p, q WHERE (f + mean * w) / (n + w) > lim)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM a.source) AS kept
FROM a""",
    "op7_urls": _url_sql(),
    "op8_chat": """
SELECT conv_id, turn, turn AS anchor_turn, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_malformed,
       CAST(NULL AS BOOLEAN) AS linked, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS message
FROM conversations""",
    "op9_substring": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s, unnest(list_transform(range(1, len(ws) - 48), lambda s: md5(array_to_string(ws[s:s + 49], ' ')))) AS k FROM d),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
k AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op11_merkle": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, {_LEAF.format("n_chars")} AS hash,
             {_LEAF.format(f"(n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END)")} AS changed FROM documents, crc),
{_tree_sql("tree", "d")}, tree_height AS (SELECT g, max(level) AS height FROM tree GROUP BY g),
subs AS (SELECT 0 AS g, row_number() OVER (ORDER BY tree.g) - 1 AS pos, hash, tree.g AS own FROM tree JOIN tree_height h ON tree.g = h.g AND level = height),
{_tree_sql("upper", "subs")}, upper_height AS (SELECT g, max(level) AS height FROM upper GROUP BY g),
first AS (SELECT doc_id, g, pos, hash AS h, changed, '' AS proof FROM d), {_fold_sql("low", "tree", "first", "doc_id")},
second AS (SELECT low.doc_id, 0 AS g, subs.pos, h, changed, proof FROM low JOIN tree_height t ON low.g = t.g AND low.level = height JOIN subs ON subs.own = low.g), {_fold_sql("high", "upper", "second", "doc_id")}
SELECT d.doc_id, d.hash AS leaf, s.h AS subroot, high.h AS root, sha256(high.proof) AS proof_sha256, high.changed AS folded_root, high.changed = high.h AS verified
FROM d JOIN second s USING (doc_id) JOIN high USING (doc_id) JOIN upper_height u ON high.level = u.height""",
    "op12_periodic": rf"""
WITH {_CRC_TABLE},
raw AS (SELECT doc_id, {_CRC} AS h, {_WORDS.format("text")} AS ws FROM documents, crc),
drawn AS (SELECT doc_id, ws, h % 10 = 0 AND len(ws) > 0 AS turned, (h // 10) % greatest(len(ws), 1) AS a, 1 + (len(ws) - (h // 10) % greatest(len(ws), 1)) // (3 + (h // 10) % 8) AS p FROM raw),
d AS (SELECT doc_id, CASE WHEN turned THEN list_transform(range(len(ws)), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws FROM drawn),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 14)) - 1 AS s, unnest(list_transform(range(1, len(ws) - 14), lambda s: md5(array_to_string(ws[s:s + 15], ' ')))) AS k FROM d),
pairs AS (SELECT x.doc_id, x.s, y.s - x.s AS q FROM win x JOIN win y ON x.doc_id = y.doc_id AND x.k = y.k AND x.s < y.s),
parts AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, q ORDER BY s) AS island FROM pairs),
long AS (SELECT doc_id, min(s) AS start, count(*) + 15 + q AS length, q FROM parts GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM long GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS start, first(length ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS length,
                first(period ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
