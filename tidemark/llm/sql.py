"""DuckDB SQL for the queries that it can express, over the same whole tables."""

from __future__ import annotations

from tidemark.llm import decontaminate, licenses, middle, quality, ranking, sharding, suffixes
from tidemark.llm.shared import LOWER, UPPER

_PLAIN = rf"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_WORDS = f"""d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS ws FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d)"""


def _chain(n: int) -> str:
    """`n` words in a row from each place, joined by spaces; null where there are fewer."""
    return " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, n)]])


def op1() -> str:
    n = decontaminate.WINDOW
    return f"""WITH {_WORDS},
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS ws FROM benchmark),
bw AS (SELECT item, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM b WHERE len(ws) >= {n}),
bk AS (SELECT DISTINCT item, key FROM (SELECT item, {_chain(n)} AS key FROM bw
  WINDOW o AS (PARTITION BY item ORDER BY i)) WHERE key IS NOT NULL),
dk AS (SELECT doc_id, i, {_chain(n)} AS key FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, i, {n} AS n, item FROM dk JOIN bk ON dk.key = bk.key
  UNION ALL
  SELECT p.doc_id, p.i, len(b.ws) AS n, item FROM p JOIN d ON d.doc_id = p.doc_id
  JOIN b ON len(b.ws) BETWEEN 1 AND {n - 1} AND p.w = b.ws[1]
  WHERE d.ws[p.i + 1 : p.i + len(b.ws)] = b.ws),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range({n}) t(j) WHERE j < n
  GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""


def op2() -> str:
    k, rows = licenses.K, []
    for number, (phrase, label) in enumerate([*licenses.BASE, *licenses.NOTICES]):
        words = phrase.split()
        for place in range(len(words) - k + 1):
            gram, base = " ".join(words[place : place + k]), number < len(licenses.BASE)
            rows.append(f"({number}, '{label}', {base}, {len(words)}, {place}, '{gram}')")
    return f"""WITH {_WORDS},
m(template, label, base, length, place, gram) AS (VALUES {", ".join(rows)}),
g AS (SELECT doc_id, i, {_chain(k)} AS gram FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dia AS (SELECT doc_id, template, label, base, length, i - place AS diagonal,
    list(DISTINCT place) AS places
  FROM g JOIN m ON m.gram = g.gram
  GROUP BY doc_id, template, label, base, length, i - place),
bands AS (SELECT doc_id, label, base, length, diagonal, len(list_distinct(flatten(list(places) OVER o))) AS votes
  FROM dia WHERE length > 8 WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal
    RANGE BETWEEN CURRENT ROW AND {licenses.DRIFT} FOLLOWING)),
spans AS (SELECT doc_id, label, base, diagonal AS begins, CAST(1 AS DOUBLE) AS cover FROM dia
    WHERE length <= 8 AND len(places) = length - {k - 1}
  UNION ALL SELECT doc_id, label, base, diagonal, CAST(votes AS DOUBLE) / (length - {k - 1}) AS cover
    FROM bands WHERE CAST(votes AS DOUBLE) / (length - {k - 1}) >= {licenses.COVER}),
per AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base,
    min(begins) FILTER (WHERE base) AS first_word, max(begins) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""


def op7() -> str:
    table = ", ".join(map(str, sharding.fill()))
    names = ", ".join(f"'{s}'" for s in sharding.SHARDS)
    return f"""WITH t AS MATERIALIZED (SELECT [{table}] AS slots, [{names}] AS names)
SELECT doc_id, n_bytes, slot, names[slots[slot + 1] + 1] AS shard FROM (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
      % {sharding.SLOTS} AS slot
  FROM documents), t"""


def op8() -> str:
    of = {
        "n_words": "n_words",
        "mean_word_chars": "word_chars / CAST(greatest(n_words, 1) AS DOUBLE)",
        "symbol_ratio": "n_symbols / CAST(greatest(n_words, 1) AS DOUBLE)",
        "dup_line_ratio": "n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE)",
        "stop_ratio": "n_stop / CAST(greatest(n_words, 1) AS DOUBLE)",
    }
    fails = ["100 * n_repeat_words > 20 * n_words"]
    for rule in quality.RULES:
        if rule.measure == "repeat_ratio":
            continue
        for bound, sign in ((rule.low, "<"), (rule.high, ">")):
            if bound is not None:
                fails.append(f"(n_words >= {rule.from_words} AND {of[rule.measure]} {sign} {bound})")
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    n, word = quality.WINDOW, r"[^\x20\x09-\x0D]"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{word}+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
k AS (SELECT doc_id, i, {_chain(n)} AS key FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM k WHERE key IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range({n}) t(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
m AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop
  FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT ({" OR ".join(fails)}) AS kept FROM m"""


def op10() -> str:
    n = suffixes.SIZE
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i + 1, i + {n}) AS k FROM
  (SELECT doc_id, b, unnest(range(octet_length(b) - {n - 1})) AS i FROM d WHERE octet_length(b) >= {n})),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM w)
  WHERE least < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + {n} THEN 0 ELSE 1 END AS new FROM gone
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {n} AS e FROM
  (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked) GROUP BY doc_id, r),
gaps AS (SELECT r.doc_id, a, e, hex(array_slice(b, coalesce(lag(e) OVER o, 0) + 1, a)) AS before
  FROM runs r JOIN d ON d.doc_id = r.doc_id WINDOW o AS (PARTITION BY r.doc_id ORDER BY a)),
per AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS e,
    string_agg(before, '' ORDER BY a) AS before FROM gaps GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(before, '') || hex(array_slice(b, coalesce(e, 0) + 1, octet_length(b)))))
    AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""


def op12() -> str:
    a, b, c = middle.PREFIX, middle.SUFFIX, middle.MIDDLE
    draws = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('{middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, {draws} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
  CASE WHEN n = 0 OR contains(t, '{a}') OR contains(t, '{b}') OR contains(t, '{c}')
    OR h3 % 100 >= {middle.PLAIN_FROM} THEN 'plain'
    WHEN h4 % 100 < {middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '{a}' || substr(t, 1, p) || '{b}' || substr(t, q + 1) || '{c}' || substr(t, p + 1, q - p)
    ELSE '{b}' || substr(t, q + 1) || '{a}' || substr(t, 1, p) || '{c}' || substr(t, p + 1, q - p)
    END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f"""


def op11() -> str:
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{word}'))"
    return f"""WITH p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM
    (SELECT doc_id, {words} AS term FROM documents) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {words} AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM m),
s AS (SELECT doc_id, {ranking.SHORTEST} + ({ranking.SLOPE} * n * docs) // words AS m FROM m, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, c GROUP BY term, docs),
r AS (SELECT item_id, doc_id, CAST(sum(qtf * w *
    (({ranking.SCALE} * tf) // (1000 * tf + {ranking.HALF} * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN s USING (doc_id) GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r
  WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {ranking.TOP}"""
