"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from marlstone.llm import alignment, bpe, decontaminate, divergence, html_text, language, license, near_dup, quality, sentence_piece, substring_dedup, token_rollup, warc


def queries() -> dict:
    return {
        "op1_token_rollup": token_rollup.op1_token_rollup,
        "op2_bpe_transducer": bpe.op2_bpe_transducer,
        "op3_layout_html_text": html_text.op3_layout_html_text,
        "op4_mixture_language_id": language.op4_mixture_language_id,
        "op5_bottom_k_near_dup": near_dup.op5_bottom_k_near_dup,
        "op6_license_set_join": license.op6_license_set_join,
        "op7_warc_salvage": warc.op7_warc_salvage,
        "op8_count_min_substrings": substring_dedup.op8_count_min_substrings,
        "op9_rule_bitmask_ledger": quality.op9_rule_bitmask_ledger,
        "op10_qgram_decontamination": decontaminate.op10_qgram_decontamination,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_piece_backtracking": sentence_piece.op12_piece_backtracking,
        "op13_label_spans": alignment.op13_label_spans,
    }


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.sh
"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT p.doc_id, p.i, array_to_string(w.ws[p.i : p.i + 34], ' ') AS x FROM p JOIN w USING (doc_id)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY x) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM rep),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5),
rep AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i : i + 4], ' ')) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS BIGINT) AS n_alpha_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, CAST((n_words < 10) AS BIGINT) + 2 * CAST((100 * n_repeat_words > 20 * n_words) AS BIGINT)
    + 4 * CAST((word_chars > 30 * n_words OR word_chars < n_words * 2) AS BIGINT) + 8 * CAST((2 * n_symbols > n_words) AS BIGINT)
    + 16 * CAST((2 * n_dup_lines > n_lines) AS BIGINT) + 32 * CAST((2 * n_alpha_words < n_words) AS BIGINT)
    + 64 * CAST((n_words > 1000000) AS BIGINT) AS fail_bits FROM m),
o AS (
  SELECT *, CASE fail_bits & 63 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'mean_word_length' WHEN 8 THEN 'symbols'
    WHEN 16 THEN 'repeated_lines' WHEN 32 THEN 'not_alphabetic' END AS only_rule FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept, fail_bits,
  fail_bits & 3 = 0 AS kept_base_1, fail_bits & 15 = 0 AS kept_web_1, only_rule,
  CASE WHEN only_rule IS NOT NULL THEN count(*) OVER (PARTITION BY only_rule) END AS n_only_rule
FROM o
"""

#: The templates as SQL values, made from the operator's own list.
_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', '{text}', '{must}')" for i, (label, text, must) in enumerate(license.TEMPLATES))
_NORMAL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
# Blocks are compared from every word of a template on, in documents that have its listed words.
OP6_SQL = f"""
WITH t(i, label, text, must) AS (VALUES {_TEMPLATE_ROWS}),
ts AS (
  SELECT i, label, list_distinct(tw) AS tw, string_split(must, ' ') AS must, len(tw) + len(tw) // 2 AS block
  FROM (SELECT *, {_NORMAL.format("text")} AS tw FROM t)),
d AS (SELECT doc_id, {_NORMAL.format("coalesce(text, '')")} AS ws FROM documents),
ph(phrase, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
places AS (
  SELECT doc_id, label, k FROM (SELECT doc_id, ws, label, phrase, unnest(range(1, len(ws) + 1)) AS k FROM d, ph) WHERE ws[k : k + len(phrase) - 1] = phrase),
base AS (SELECT doc_id, count(*) AS n, min(k) - 1 AS first_word, max(k) - 1 AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
c AS (SELECT doc_id, i, label, tw, must, block, ws FROM d, ts WHERE list_has_all(ws, must) AND 100 * len(list_intersect(ws, tw)) >= 80 * len(tw)),
b AS (
  SELECT doc_id, label, tw, must, ws[k : k + block - 1] AS bw
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM c) WHERE list_contains(tw, ws[k])),
hit AS (
  SELECT doc_id, label, len(list_intersect(bw, tw)) / len(tw) AS c FROM b WHERE list_has_all(bw, must) AND 100 * len(list_intersect(bw, tw)) >= 80 * len(tw)),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS score FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.first_word, base.last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1 ELSE coalesce(method.score, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(t)) AS n, h, max(page_id) OVER (PARTITION BY h) AS original FROM p),
c AS (SELECT *, list_transform([1, 11, 21, 31], lambda a: CAST('0x' || substr(h, a, 10) AS BIGINT)) AS parts FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM c
"""


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
c AS (
  SELECT source, lang, CASE WHEN good THEN 'words@2' ELSE 'words@1' END AS tokenizer,
    len(CASE WHEN good THEN regexp_extract_all(t, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]') ELSE regexp_extract_all(t, '[^\x20\x09-\x0D]+') END) AS n
  FROM d UNION ALL SELECT source, lang, 'bytes4@1', (octet_length(encode(t)) + 3) // 4 FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""


# By the definition: every kept term for every group and pair.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
langs AS (SELECT lang, sum(n) AS total, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gn.total + langs.v) AS p,
    1 + (1000000000 * (kept.n + 1)) // (langs.total + langs.v) AS q
  FROM gn JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_token_rollup": OP1_SQL,
        "op11_source_divergence": OP11_SQL,
        "op5_bottom_k_near_dup": OP5_SQL,
        "op6_license_set_join": OP6_SQL,
        "op7_warc_salvage": OP7_SQL,
        "op8_count_min_substrings": OP8_SQL,
        "op9_rule_bitmask_ledger": OP9_SQL,
    }
