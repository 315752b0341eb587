"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from motility.llm import quality
from motility.llm.sharding import _P, _Q, round_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op2() -> str:
    words = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id, {words("text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op8() -> str:
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""


def op4(n_shards: int = 8, seed: int = 11, steps: int = 6) -> str:
    """``steps`` only has to be large enough at the sizes where this runs; rows still walking would have a null shard."""
    sql = """
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c FROM (SELECT unnest(range(0, 256)) AS b))),
sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INT) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws(',', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR)))[1:3], doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM sized),
total AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS a, count(*) AS n FROM documents),
s0 AS (SELECT row_number, row_number AS x, CAST(NULL AS BIGINT) AS place FROM numbered)"""
    for k in range(1, steps + 1):
        inner = f"(SELECT row_number, x, place, x // a AS l, x % a AS r, a, n FROM s{k - 1}, total)"
        for m, c in round_keys(seed):
            t = f"((r * {m} + {c}) % {_P})"
            inner = f"(SELECT row_number, x, place, r AS l, (l + (((({t} * {t}) % {_Q}) * {c} + {m}) % {_P})) % a AS r, a, n FROM {inner})"
        sql += f",\ns{k} AS (SELECT row_number, l * a + r AS x, coalesce(place, CASE WHEN l * a + r < n THEN l * a + r END) AS place FROM {inner})"
    return f"""WITH {sql}
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {n_shards} AS INT) AS shard, place // {n_shards} AS slot, CAST(NULL AS INT) AS grown_shard, row_number
FROM numbered JOIN s{steps} USING (row_number)"""


def op10() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 80 * (na.n + nb.n - inter)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS x, b AS y FROM link UNION SELECT x, b FROM reach JOIN link ON y = a),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = d.doc_id
"""


def op3() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    lists = "CASE lang " + " ".join(f"WHEN '{k}' THEN {quoted(ws)}" for k, ws in quality.COMMON_WORDS.items()) + f" ELSE {quoted(quality.ALL_COMMON)} END"
    without = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln, {lists} AS cw FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY doc_id),
c AS (SELECT doc_id, lang, cw, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {without("[#*$%&|<>]")} AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(text) AS n_chars, {without("[A-Z]")} AS upper, {without("[0-9]")} AS digits, {without(r"[.,;:!?''" + '"' + r"()\-]")} AS points, strlen(text) - length(text) AS accents, w FROM w LEFT JOIN again USING (doc_id)),
cc AS (SELECT doc_id, lang, i AS pos, greatest(0, [word_chars - upper - digits - points - n_symbols - accents, upper, digits, points, n_symbols, accents, n_chars - word_chars][i])::DOUBLE AS n FROM (SELECT *, unnest(range(1, 8)) AS i FROM c)),
own AS (SELECT doc_id, lower(x) AS x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM c) GROUP BY ALL),
cw AS (SELECT doc_id, lang, i AS pos, coalesce(own.n, 0)::DOUBLE AS n FROM (SELECT doc_id, lang, unnest(cw) AS cword, unnest(range(0, len(cw))) AS i FROM c) k LEFT JOIN own USING (doc_id) WHERE own.x = cword OR own.doc_id IS NULL
  UNION ALL SELECT doc_id, lang, i, 0.0 FROM (SELECT doc_id, lang, unnest(cw) AS cword, unnest(range(0, len(cw))) AS i FROM c) k ANTI JOIN own ON own.doc_id = k.doc_id AND own.x = cword),
cx AS (SELECT doc_id, lang, pos, max(n) AS n FROM cw GROUP BY ALL),
co AS (SELECT doc_id, lang, pos, n FROM cx UNION ALL SELECT doc_id, any_value(cx.lang), -1, any_value(n_words) - sum(n) FROM cx JOIN c USING (doc_id) GROUP BY doc_id),
h AS (SELECT 'chars' AS kind, * FROM cc UNION ALL SELECT 'common', * FROM co),
r AS (SELECT kind, lang, pos, sum(n) AS q FROM h GROUP BY ALL),
j AS (SELECT kind, doc_id, n, q, sum(n) OVER (PARTITION BY kind, doc_id) AS sn, sum(q) OVER (PARTITION BY kind, doc_id) AS sq FROM h JOIN r USING (kind, lang, pos)),
m AS (SELECT kind, doc_id, CASE WHEN sn > 0 AND sq > 0 THEN n / sn END AS p, CASE WHEN sn > 0 AND sq > 0 THEN q / sq END AS q FROM j),
dist AS (SELECT kind, doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d FROM m GROUP BY ALL),
z AS (SELECT c.*, round(x.d, 6) AS char_distance, round(y.d, 6) AS common_distance, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c JOIN dist x ON x.doc_id = c.doc_id AND x.kind = 'chars' JOIN dist y ON y.doc_id = c.doc_id AND y.kind = 'common')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {quality.MIN_CHAR_WORDS} OR char_distance <= {quality.MAX_CHAR_DISTANCE}) AND (n_words < {quality.MIN_COMMON_WORDS} OR common_distance <= {quality.MAX_COMMON_DISTANCE}) AS kept, char_distance, common_distance FROM z
"""


def op11() -> str:
    return rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
),
g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(m) WHERE len(w) >= m) GROUP BY ALL
),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(g, ' ') AS w FROM g WHERE m > 1 AND f >= 10),
cut AS (SELECT lang, g, m, f, w, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT cut.lang, cut.g, cut.f AS a, k, gx.f AS l, gy.f AS r, CAST(1000000::HUGEINT * cut.f * cut.f // (gx.f::HUGEINT * gy.f) AS BIGINT) AS score
  FROM cut JOIN g gx ON gx.lang = cut.lang AND gx.g = x JOIN g gy ON gy.lang = cut.lang AND gy.g = y
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY score, k) = 1
),
t AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, f, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE m = 3)) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.g)) AS rank, s.g AS phrase, a, l, r, n, score
FROM s JOIN n USING (lang) LEFT JOIN t ON t.lang = s.lang AND t.g = s.g WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""


def op13(levels: int = 6, top_levels: int = 3) -> str:
    """``levels`` and ``top_levels`` only have to be large enough for the leaves of a source and for the sources where this runs."""
    told = ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    leaf = lambda text: f"sha256(concat({told}, coalesce(strlen({text}) || ':' || {text}, '-')))"
    sql = f"""
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c FROM (SELECT unnest(range(0, 256)) AS b))),
d AS (
  SELECT *, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INT) + 1]), 4294967295), 4294967295) % 5 = 0 AS tampered
  FROM documents, crc_table),
h AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN tampered THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS seen FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS place FROM h),
s0 AS (SELECT source, place, leaf AS h, count(*) OVER (PARTITION BY source) > 1 AS more FROM leaves)"""
    sides = "coalesce(string_agg(h, '') OVER (PARTITION BY {g}, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY {g}, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    above = "SELECT {g}, place // 16 AS place, CASE WHEN any_value(more) THEN sha256(string_agg(h, '' ORDER BY place)) ELSE any_value(h) END AS h FROM {t} GROUP BY {g}, place // 16"
    for k in range(levels):
        sql += f",\nsides{k} AS (SELECT source, place, more, {sides.format(g='source')} FROM s{k}),\ns{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY source) > 1 AS more FROM ({above.format(g='source', t=f's{k}')}))"
    sql += f",\nt0 AS (SELECT source, 0 AS g, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, h, count(*) OVER () > 1 AS more FROM s{levels})"
    for k in range(top_levels):
        sql += f",\ntop{k} AS (SELECT place, more, {sides.format(g='g')} FROM t{k}),\nt{k + 1} AS (SELECT *, count(*) OVER () > 1 AS more FROM ({above.format(g='g', t=f't{k}')}))"
    joins = "".join(f" JOIN sides{k} ON sides{k}.source IS NOT DISTINCT FROM leaves.source AND sides{k}.place = leaves.place // {16**k}" for k in range(levels))
    joins += " JOIN t0 ON t0.source IS NOT DISTINCT FROM leaves.source" + "".join(f" JOIN top{k} ON top{k}.place = t0.place // {16**k}" for k in range(top_levels))
    steps = [f"sides{k}" for k in range(levels)] + [f"top{k}" for k in range(top_levels)]
    ways = ", ".join(f"{t}.more AS {t}_more, {t}.l AS {t}_l, {t}.r AS {t}_r" for t in steps)
    for k, t in enumerate(steps):  # one step at a time, so that no expression stands twice
        before = f"f{k - 1}" if k else f"(SELECT doc_id, leaf, seen AS x, t0.h AS subroot, {ways} FROM leaves{joins})"
        sql += f",\nf{k} AS (SELECT * REPLACE (CASE WHEN {t}_more THEN sha256({t}_l || x || {t}_r) ELSE x END AS x) FROM {before})"
    siblings = " || ".join(f"{t}_l || {t}_r" for t in steps)
    return f"""WITH {sql}
SELECT doc_id, leaf, subroot, h AS root, sha256({siblings}) AS proof_sha256, x AS folded_root, x = h AS verified FROM f{len(steps) - 1}, t{top_levels}"""


def all_sql() -> dict[str, str]:
    return {"op2_decontaminate": op2(), "op3_quality": op3(), "op4_shard": op4(), "op8_url_rules": op8(), "op10_near_dedup": op10(), "op11_collocations": op11(), "op13_manifest": op13()}
