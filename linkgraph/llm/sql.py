"""The queries' SQL checks, for DuckDB."""

from __future__ import annotations

from linkgraph.llm.license_scan import PHRASES, SEPARATORS, _split, needed, template_words
from linkgraph.llm.license_texts import TEMPLATES
from linkgraph.llm.quality_rules import MAX_REPEATED, MIN_WORDS, SMALL, SPREAD

def quality_sql(source: str = "documents") -> str:
    """WITH-list that ends in ``judged``: (rid, the columns of op1)."""
    return rf"""
base AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM {source}),
parts AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
grams AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i,
         unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
  FROM parts WHERE len(ws) >= 3),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
repeated AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
counts AS (
  SELECT parts.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_marks,
         length(regexp_replace(t, '[^.,;:!?]', '', 'g')) AS n_points, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         len(list_distinct(ws)) AS n_distinct
  FROM parts LEFT JOIN repeated USING (rid)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM counts),
rates AS (
  SELECT lang, source, rid, base_failed, unnest(['marks', 'length', 'points', 'capitals', 'distinct']) AS rate,
         unnest([n_marks * 1000 // greatest(word_chars, 1), word_chars * 100 // greatest(n_words, 1), n_points * 1000 // greatest(n_words, 1),
                 n_capitals * 1000 // greatest(n_words, 1), n_distinct * 1000 // greatest(n_words, 1)]) AS v FROM based),
sized AS (SELECT lang, source, count(*) AS docs FROM based WHERE NOT base_failed GROUP BY lang, source),
pooled AS (
  SELECT *, CASE WHEN docs >= {SMALL} THEN 'own' WHEN sum(CASE WHEN docs < {SMALL} THEN docs END) OVER (PARTITION BY lang) >= {SMALL}
                 THEN 'language' ELSE 'all' END AS level FROM sized),
passing AS (
  SELECT rate, r.lang, level, CASE level WHEN 'own' THEN r.source END AS pool, (v >> s) << s AS bin
  FROM (SELECT *, greatest(length(bin(v)) - 8, 0)::INTEGER AS s FROM rates WHERE NOT base_failed) r
  JOIN pooled p ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source),
edges AS (
  SELECT rate, lang, level, pool, quantile_disc(bin, 0.25) AS low, quantile_disc(bin, 0.75) AS high FROM passing GROUP BY ALL),
widths AS (SELECT rate, lang, quantile_disc(bin, 0.75) - quantile_disc(bin, 0.25) AS width FROM passing GROUP BY ALL),
totals AS (SELECT rate, quantile_disc(bin, 0.25) AS low, quantile_disc(bin, 0.75) AS high FROM passing GROUP BY ALL),
limits AS (
  SELECT lang, source, rate, low - reach AS least, high + reach AS most
  FROM (
    SELECT p.lang, p.source, w.rate, coalesce(e.low, t.low) AS low, coalesce(e.high, t.high) AS high,
           {SPREAD} * greatest(coalesce(e.high, t.high) - coalesce(e.low, t.low), width) + greatest(1, coalesce(e.high, t.high) >> 7) AS reach
    FROM pooled p JOIN widths w ON p.lang IS NOT DISTINCT FROM w.lang JOIN totals t ON w.rate = t.rate
    LEFT JOIN edges e ON p.level <> 'all' AND p.level = e.level AND p.lang IS NOT DISTINCT FROM e.lang AND w.rate = e.rate
      AND e.pool IS NOT DISTINCT FROM CASE p.level WHEN 'own' THEN p.source END)),
failed AS (
  SELECT rid, list(r.rate ORDER BY list_position(['marks', 'length', 'points', 'capitals', 'distinct'], r.rate)) AS failed_rates
  FROM rates r JOIN limits l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
    AND r.rate = l.rate AND (r.v > l.most OR r.v < l.least) GROUP BY rid),
judged AS (SELECT based.*, coalesce(failed_rates, []) AS failed_rates FROM based LEFT JOIN failed USING (rid))"""


def line_sql(source: str = "documents") -> str:
    """WITH-list that ends in ``cleaned``: (rid, doc_id, n_lines, n_dropped, kept)."""
    return rf"""
line_docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
split_lines AS (
  SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM line_docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split_lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k)),
cleaned AS (
  SELECT rid, doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY rid, doc_id)"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SETS = [(label, template_words(text), len(_split(text))) for label, text in TEMPLATES]
_TEMPLATE_ROWS = ", ".join(
    f"({i}, '{label}', {_list(ws)}, {len(ws)}, {needed(len(ws))}, {length})" for i, (label, ws, length) in enumerate(_SETS)
)
_PHRASE_ROWS = ", ".join(f"('{label}', {_list(phrase.split())})" for label, phrase in PHRASES.items())
_LICENSES = rf"""
WITH templates(template, label, ws, n, least, length) AS (VALUES {_TEMPLATE_ROWS}),
phrases(label, ps) AS (VALUES {_PHRASE_ROWS}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
worded AS (SELECT *, list_filter(string_split_regex(t, '{SEPARATORS}'), lambda x: x <> '') AS ws FROM docs),
placed AS (
  SELECT rid, label, unnest(range(0, len(ws))) AS i, unnest(list_transform(range(0, len(ws)),
         lambda i: list_slice(ws, i + 1, i + len(ps)) = ps)) AS fits FROM worded, phrases),
base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS ls
  FROM placed WHERE fits GROUP BY rid),
template_words AS (SELECT template, label, n, least, length, unnest(ws) AS word FROM templates),
text_words AS (SELECT rid, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM worded),
likely AS (
  SELECT rid, template FROM (SELECT DISTINCT rid, word FROM text_words) JOIN template_words USING (word)
  GROUP BY rid, template, least HAVING count(*) >= least),
hits AS (
  SELECT rid, template, label, n, least, length, word, i
  FROM likely JOIN text_words USING (rid) JOIN template_words USING (template, word)),
runs AS (
  SELECT rid, label, n, least, count(DISTINCT b.word) AS shared
  FROM hits a JOIN hits b USING (rid, template, label, n, least, length)
  WHERE b.i BETWEEN a.i AND a.i + length - 1 GROUP BY rid, template, label, n, least, a.i),
met AS (SELECT rid, label, shared::DOUBLE / n AS score FROM runs WHERE shared >= least),
found AS (SELECT rid, list(DISTINCT label) AS fs, max(score) AS score FROM met GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(ls, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(fs, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII string, one bit after the other."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda i: (ascii(({text})[(i // 8 + 1)::INTEGER]) >> (i % 8)::INTEGER) & 1)"
    start = "[4294967295::BIGINT]"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat({start}, {bits}), {step}), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_leaf_sql('text')} AS leaf,
         {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other FROM documents),
placed AS (
  SELECT *, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN other ELSE leaf END AS claimed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
levels AS (
  SELECT 0 AS level, source, list(leaf ORDER BY pos) AS run FROM placed GROUP BY source
  UNION ALL
  SELECT level + 1, source, list_transform(range(0, len(run), 16), lambda i: sha256(array_to_string(list_slice(run, i + 1, i + 16), '')))
  FROM levels WHERE len(run) > 1),
subroots AS (SELECT source, run[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM levels WHERE len(run) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS run FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(run), 16), lambda i: sha256(array_to_string(list_slice(run, i + 1, i + 16), '')))
  FROM tops WHERE len(run) > 1),
inner_walk AS (
  SELECT rid, source, 0 AS level, pos, claimed AS node, '' AS proof FROM placed
  UNION ALL
  SELECT rid, w.source, w.level + 1, pos // 16,
         sha256(array_to_string(list_concat(list_slice(run, pos - pos % 16 + 1, pos), [node], list_slice(run, pos + 2, pos - pos % 16 + 16)), '')),
         proof || array_to_string(list_concat(list_slice(run, pos - pos % 16 + 1, pos), list_slice(run, pos + 2, pos - pos % 16 + 16)), '')
  FROM inner_walk w JOIN levels l ON w.source IS NOT DISTINCT FROM l.source AND w.level = l.level AND len(run) > 1),
inner_end AS (SELECT rid, source, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM inner_walk GROUP BY rid, source),
outer_walk AS (
  SELECT rid, 0 AS level, s.pos, node, proof FROM inner_end e JOIN subroots s ON e.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT rid, w.level + 1, pos // 16,
         sha256(array_to_string(list_concat(list_slice(run, pos - pos % 16 + 1, pos), [node], list_slice(run, pos + 2, pos - pos % 16 + 16)), '')),
         proof || array_to_string(list_concat(list_slice(run, pos - pos % 16 + 1, pos), list_slice(run, pos + 2, pos - pos % 16 + 16)), '')
  FROM outer_walk w JOIN tops t ON w.level = t.level AND len(run) > 1),
outer_end AS (SELECT rid, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM outer_walk GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT run[1] FROM tops WHERE len(run) = 1) AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = (SELECT run[1] FROM tops WHERE len(run) = 1) AS verified
FROM placed p JOIN outer_end USING (rid) JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source"""

_KEY = "coalesce(conv_id::VARCHAR, ' ')"
_CRC_OF_TURN = crc32_sql(f"({_KEY} || ':' || coalesce(turn::VARCHAR, ' '))")


def _least(choices: list[str]) -> str:
    return f"least({', '.join(choices)})"


# Costs from turn n on, by phase (0 nothing yet, 1 after s, 2 after u, 3 after a): w without, v with turns added first.
_FAR = 1_000_000_000
_KEPT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def _step(phase: int) -> str:
    ways = [f"v{phase} + 4"]
    for letter, to in _KEPT[phase].items():
        ways.append(f"CASE WHEN NOT gone AND letter = '{letter}' THEN v{to} + extra ELSE {_FAR} END")
        if letter != "s":
            ways.append(f"CASE WHEN NOT gone AND letter <> '{letter}' THEN v{to} + extra + 3 ELSE {_FAR} END")
    return _least(ways)


_ADDED = {0: 2, 1: 2, 2: 3, 3: 2}


def _closed(phase: int) -> str:
    to = _ADDED[phase]
    return _least([f"w{phase}", f"w{to} + 3", f"w{_ADDED[to]} + 6"])


def _of(name: str, phase: str) -> str:
    return f"CASE {phase} " + " ".join(f"WHEN {p} THEN {name}{p}" for p in range(4)) + " END"


_V = ", ".join(f"{_closed(p)} AS v{p}" for p in range(4))
_TO = "CASE phase WHEN 2 THEN 3 ELSE 2 END"
_WANTED = "CASE phase WHEN 2 THEN 'a' ELSE 'u' END"
_REPAIRS = f"""
WITH RECURSIVE numbered AS (
  SELECT {_KEY} AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_OF_TURN} % 20 AS kind FROM conversations),
broken AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM numbered WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
         count(*) OVER (PARTITION BY conv) AS total FROM broken),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         left(role, 1) AS letter, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) || left(role, 1), 'su') AS pair FROM ordered),
judged AS (
  SELECT *, NOT blank AND again AS duplicate, blank OR again AS gone,
         NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated FROM seen),
turns AS (SELECT *, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM judged),
costs AS (
  SELECT conv, total + 1 AS n, 0 AS w0, {_FAR} AS w1, {_FAR} AS w2, 0 AS w3, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3
  FROM (SELECT DISTINCT conv, total FROM turns)
  UNION ALL
  SELECT conv, n, w0, w1, w2, w3, {_V}
  FROM (SELECT t.conv, t.n, {", ".join(f"{_step(p)} AS w{p}" for p in range(4))} FROM costs c JOIN turns t ON c.conv = t.conv AND c.n = t.n + 1)),
walked AS (
  SELECT conv, 1::BIGINT AS n, 0 AS phase, '' AS audit, []::VARCHAR[] AS said FROM costs WHERE n = 1
  UNION ALL
  SELECT conv, CASE letter WHEN 'I' THEN n ELSE n + 1 END,
         CASE letter WHEN 'D' THEN phase WHEN 'K' THEN CASE own WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE {_TO} END,
         audit || letter,
         CASE letter WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
                     ELSE list_append(said, CASE phase WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, t.role, t.text, t.letter AS own,
           CASE WHEN t.n IS NOT NULL AND {_of("c.v", "phase")} = {_of("d.v", "phase")} + 4 THEN 'D'
                WHEN {_of("c.v", "phase")} = {_of("c.v", _TO)} + 3 THEN 'I'
                WHEN t.letter = {_WANTED} OR (phase = 0 AND t.letter = 's' AND {_of("c.v", "phase")} = d.v1 + extra) THEN 'K' ELSE 'R' END AS letter
    FROM walked w JOIN costs c ON w.conv = c.conv AND w.n = c.n
    LEFT JOIN turns t ON w.conv = t.conv AND w.n = t.n LEFT JOIN costs d ON w.conv = d.conv AND w.n + 1 = d.n
    WHERE t.n IS NOT NULL OR phase IN (1, 2))),
ends AS (SELECT conv, arg_max(audit, length(audit)) AS audit, array_to_string(arg_max(said, length(audit)), chr(10)) AS said FROM walked GROUP BY conv),
told AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, {_KEY} AS conv FROM conversations) a LEFT JOIN told USING (conv) LEFT JOIN ends USING (conv)
LEFT JOIN (SELECT conv, v0 FROM costs WHERE n = 1) USING (conv)"""

ORACLES = {
    "op11_conversation_repair": _REPAIRS,
    "op13_merkle_manifest": _MANIFEST,
    "op1_quality_rules": f"""WITH {quality_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(failed_rates) = 0 AS kept, array_to_string(failed_rates, ',') AS failed_rates FROM judged""",
    "op3_license_scan": _LICENSES,
    "op4_line_dedup": f"""WITH {line_sql()}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM cleaned""",
    "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_url_filters": f"""
WITH rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
urls AS (SELECT row_number() OVER () AS rid, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
fit AS (
  SELECT urls.*, rule, rule_verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC NULLS LAST) AS n
  FROM urls LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fit WHERE n = 1""",
}
