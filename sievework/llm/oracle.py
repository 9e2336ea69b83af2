"""SQL of the operators that SQL can express, over whole tables: substrings are known by hashes of their halves, doubled in window passes."""

from __future__ import annotations


def _doubled(steps: list[tuple[str, str, str, int]], by: str) -> str:
    """CTEs that add one column each: name = hash of a column and of another one `ahead` rows on."""
    parts, source = [], "unit"
    for k, (name, left, right, ahead) in enumerate(steps):
        parts.append(f"h{k} AS (SELECT *, md5({left} || lead({right}, {ahead}) OVER (PARTITION BY doc_id ORDER BY {by})) AS {name} FROM {source})")
        source = f"h{k}"
    return ",\n ".join(parts)


# 20 words: 1, 2, 4, 8, 16, and 16 + 4
OP1_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
 unit AS (SELECT doc_id, n, j, word, md5(word) AS k1 FROM (SELECT doc_id, len(l) AS n, unnest(range(len(l))) AS j, unnest(l) AS word FROM d)),
 {_doubled([("k2", "k1", "k1", 1), ("k4", "k2", "k2", 2), ("k8", "k4", "k4", 4), ("k16", "k8", "k8", 8), ("k20", "k16", "k4", 16)], "j")},
 again AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY k20 ORDER BY doc_id, j) AS r FROM h4 WHERE j + 20 <= n) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, j + o AS j FROM again, range(20) t(o)),
 kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS text, count(*) AS n FROM unit u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.j = g.j GROUP BY 1)
 SELECT d.doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

# 50 bytes: 1, 2, 4, 8, 16, 32, 32 + 16, and 48 + 2
OP9_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 unit AS (SELECT doc_id, n, p, substr(x, 2 * p + 1, 2) AS b, substr(x, 2 * p + 1, 2) AS k1 FROM (SELECT doc_id, x, length(x) // 2 AS n, unnest(range(length(x) // 2)) AS p FROM d)),
 {_doubled([("k2", "k1", "k1", 1), ("k4", "k2", "k2", 2), ("k8", "k4", "k4", 4), ("k16", "k8", "k8", 8), ("k32", "k16", "k16", 16), ("k48", "k32", "k16", 32), ("k50", "k48", "k2", 48)], "p")},
 later AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k50) AS least FROM h6 WHERE p + 50 <= n) WHERE least < doc_id),
 gone AS (SELECT DISTINCT doc_id, p + o AS p FROM later, range(50) t(o)),
 runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first) AS spans FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) < p - 1, true) AS first FROM gone) GROUP BY 1),
 kept AS (SELECT u.doc_id, string_agg(b, '' ORDER BY u.p) AS x FROM unit u ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY 1)
 SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.x, ''))) AS kept_sha256 FROM d LEFT JOIN runs r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""

_RATIOS = (("word_length", "word_chars", 0.5), ("symbols", "n_symbols", 0.02), ("dup_lines", "n_dup_lines", 0.01), ("repeats", "n_repeat_words", 0.05))
_SAME = "{a}.lang IS NOT DISTINCT FROM {b}.lang AND {a}.source IS NOT DISTINCT FROM {b}.source"


def _quartiles(name: str, keys: str) -> str:
    """The sketch's quartiles by keys: the middle of the first log bucket that reaches a quarter, and three quarters, of the documents."""
    by = f"{keys}, ratio" if keys else "ratio"
    value = "CASE WHEN bucket = -1000000 THEN 0.0 ELSE 2 * pow(1.02::DOUBLE, bucket) / 2.02::DOUBLE END"
    at = lambda q: f"min(CASE WHEN upto >= {q} * total THEN {value} END)"
    return f"""{name}_n AS (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
 {name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {name}_n),
 {name} AS (SELECT {by}, {at(0.25)} AS q1, {at(0.75)} AS q3, max(total) AS docs FROM {name}_c GROUP BY ALL)"""


def _pick(c: str) -> str:
    return f"CASE WHEN o.docs >= 200 THEN o.{c} WHEN g.docs >= 200 THEN g.{c} ELSE a.{c} END"


_LEAST = " ".join(f"WHEN '{k}' THEN {x}" for k, _, x in _RATIOS)
_FITS = " AND ".join(f"coalesce({of} / nullif(n_words, 0)::DOUBLE <= max(CASE WHEN ratio = '{k}' THEN high END), true)" for k, of, _ in _RATIOS)

OP5_SQL = rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
 w AS (SELECT doc_id, unnest(range(len(l) - 2)) AS j, unnest(list_transform(range(len(l) - 2), lambda i: l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3])) AS x FROM t WHERE len(l) > 2),
 r AS (SELECT doc_id, count(DISTINCT j + o) AS n FROM (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, x) AS k FROM w) v, range(3) s(o) WHERE k > 1 GROUP BY 1),
 lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS y FROM t),
 base AS (SELECT t.doc_id, lang, source, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(y) - len(list_distinct(y)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM t JOIN lines USING (doc_id) LEFT JOIN r ON r.doc_id = t.doc_id),
 each AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {of} / n_words::DOUBLE AS x FROM base WHERE n_words > 0" for k, of, _ in _RATIOS)}),
 sketch AS (SELECT lang, source, ratio, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.02::DOUBLE))::INT ELSE -1000000 END AS bucket, count(*) AS n FROM each GROUP BY ALL),
 {_quartiles("own", "lang, source")},
 {_quartiles("by_lang", "lang")},
 {_quartiles("overall", "")},
 q AS (SELECT o.lang, o.source, o.ratio, {_pick("q1")} AS q1, {_pick("q3")} AS q3 FROM own o JOIN by_lang g ON o.lang IS NOT DISTINCT FROM g.lang AND o.ratio = g.ratio JOIN overall a ON a.ratio = o.ratio),
 fences AS (SELECT *, q1 - spread AS low, q3 + spread AS high FROM (SELECT *, 6 * greatest(q3 - q1, CASE ratio {_LEAST} END) AS spread FROM q)),
 judged AS (SELECT b.doc_id, {_FITS} AND coalesce(word_chars / nullif(n_words, 0)::DOUBLE >= max(CASE WHEN ratio = 'word_length' THEN low END), true) AS fits
  FROM base b LEFT JOIN fences f ON {_SAME.format(a="b", b="f")} GROUP BY b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND fits AS kept FROM base JOIN judged USING (doc_id)"""
