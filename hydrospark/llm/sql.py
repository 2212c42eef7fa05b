"""DuckDB SQL that gives the rows of the registered queries, where SQL can."""

SQL = {}

SQL["op8_host_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), host AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS k FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT least(greatest(sum(k) / sum(n), 1e-4), 1 - 1e-4) AS m, sum(n) AS n, count(*) AS hosts, sum(k * k / n) AS kk FROM host
), prior AS (
  SELECT m, greatest(kk - n * m * m, 0) / n - m * (1 - m) * hosts / n AS spread FROM moments
), strength AS (
  SELECT m, CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 2), 1e4) ELSE 1e4 END AS s FROM prior
), verdict AS (
  SELECT source, (k + m * s) / (n + s) > 0.6 AS failed FROM host, strength
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(failed, false) AS kept
FROM judged LEFT JOIN verdict USING (source)
"""

SQL["op10_prefix_target"] = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), t AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(17 + length(replace(replace(replace(replace(role, '~', '~0'), '[INST]', '~1'), '[/INST]', '~2'), '</s>', '~3'))
           + length(replace(replace(replace(replace(text, '~', '~0'), '[INST]', '~1'), '[/INST]', '~2'), '</s>', '~3'))) OVER o AS upto
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR i = n), 0) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

_MATCHES = r"""
SELECT r, doc_id, source, {kind} AS kind, {rank} AS rank, i,
       CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
       hits[i] AS hit, vals[i] AS v
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT r, doc_id, source, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {group}) AS vals FROM d))
"""
_KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]{14,}", 0),
    "hex": (r"[0-9a-f]{16,}", 0),
    "pem": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x20\t\r\n]*", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    "vendor": (r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}", 0),
    "random": (r"[A-Za-z0-9+/_-]{20,}={0,2}", 0),
}
_FOUND = " UNION ALL ".join(_MATCHES.format(kind=f"'{k}'", rank=n, pattern=f"'{p}'", group=g) for n, (k, (p, g)) in enumerate(_KINDS.items()))
_KEPT = "base AS (SELECT * FROM f WHERE rank < 3)"
for _n, _kind in enumerate(list(_KINDS)[3:]):
    _before = f"kept{_n - 1}" if _n else "base"
    _mixed = "AND odd AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if _kind == "random" else ""
    _KEPT += f""", kept{_n} AS (
  SELECT * FROM {_before} UNION ALL
  SELECT * FROM f WHERE kind = '{_kind}' {_mixed} AND NOT EXISTS (SELECT 1 FROM {_before} b WHERE b.r = f.r AND b.s < f.e AND b.e > f.s))"""

SQL["op11_ownership_secrets"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), m AS MATERIALIZED (
  {_FOUND}
), bits AS (
  SELECT v, -sum(c / n * log2(c / n)) AS h
  FROM (SELECT v, ch, count(*) AS c, any_value(n) AS n FROM (SELECT v, length(v) AS n, unnest(string_split(v, '')) AS ch FROM (SELECT DISTINCT v FROM m)) GROUP BY v, ch)
  GROUP BY v
), f AS MATERIALIZED (
  SELECT r, doc_id, source, kind, rank, s, s + length(hit) AS e, v,
         h >= 2.8 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
         AND NOT regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|your_?|xxxx|test|1234567|abcdef') AS odd
  FROM m JOIN bits USING (v) WHERE kind <> 'assign' OR length(v) >= 12
), {_KEPT}, uses AS (
  SELECT v, count(DISTINCT source) + max(CAST(source IS NULL AS INT)) AS owners FROM kept3 GROUP BY v
), judged AS (
  SELECT k.*, odd AND owners <= 1 AS live, odd AND owners > 1 AS copied, concat_ws(':', kind, s, e) AS span FROM kept3 k JOIN uses USING (v)
), by_doc AS (
  SELECT r,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base_spans,
    string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3 OR live) AS spans,
    string_agg(span, ',' ORDER BY s, rank) FILTER (live) AS live,
    count(*) FILTER (copied) AS n_copied
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, '') AS live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN by_doc USING (r)
"""

_BEFORE = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
_RATE = "CASE WHEN {n} < 1 THEN {p} ELSE (1000000 * {s} + 50 * {p}) // ({n} + 50) END"


def _history(name: str, keys: str) -> str:
    """Lines and returned lines of other folds at earlier times: all of the value less those of the own fold."""
    of = lambda x, k: f"coalesce(sum({x}) OVER (PARTITION BY {k} ORDER BY sold_at {_BEFORE}), 0)"
    return ", ".join(f"CAST({of(x, keys)} - {of(x, f'{keys}, fold')} AS BIGINT) AS {name}_{x}" for x in "ns")


SQL["op13_time_encoding"] = rf"""
WITH ids AS (
  SELECT DISTINCT sale_id, CAST(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS BIGINT) AS crc
  FROM sales WHERE sale_id IS NOT NULL
), c AS (
  SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, s.sold_at,
         xor(ids.crc, 4294967295) % 5 AS fold, count(*) AS n, count(*) FILTER (l.flag = 'returned') AS s
  FROM sale_lines l JOIN sales s USING (sale_id) JOIN ids USING (sale_id) WHERE s.sold_at IS NOT NULL
  GROUP BY ALL
), k AS (
  SELECT c.*, kind, v.nation_id, segment
  FROM c LEFT JOIN items i USING (item_id) LEFT JOIN vendors v ON v.vendor_id = c.vendor_id LEFT JOIN clients p ON p.client_id = c.client_id
), h AS (
  SELECT *, {_history("a", "1")}, {_history("k", "kind")}, {_history("i", "item_id")}, {_history("o", "nation_id")}, {_history("v", "vendor_id")},
         {_history("g", "segment")}, {_history("c", "client_id")}
  FROM k
), r AS (
  SELECT *, {_RATE.format(n="a_n", s="a_s", p="500000")} AS a_r FROM h
), q AS (
  SELECT *, {", ".join(_RATE.format(n=f"{x}_n", s=f"{x}_s", p="a_r") + f" AS {x}_r" for x in "kog")} FROM r
)
SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned,
       {", ".join(f"{x}_n AS {name}_n, CAST({_RATE.format(n=f'{x}_n', s=f'{x}_s', p=f'{y}_r')} AS BIGINT) AS {name}_rate" for x, y, name in (("i", "k", "item"), ("v", "o", "vendor"), ("c", "g", "client")))}
FROM q
"""

SQL["op12_hard_negatives"] = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN positive USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
