"""DuckDB SQL for the queries that SQL can express, on the given tables."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

# Smallest node reachable over pairs (a, b) in both directions, for nodes that have any.
REACH = """reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)"""

EMBEDDINGS = f"""WITH RECURSIVE link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y
  ON x.vec_id <> y.vec_id
  AND list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.9),
{REACH},
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
URLS = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END
    AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE WHEN {_FITS.format(h='example.net', p='en/')} THEN 'example.net/en/'
  WHEN {_FITS.format(h='example.com', p='de/')} THEN 'example.com/de/'
  WHEN {_FITS.format(h='org', p='fr/')} THEN 'org/fr/' WHEN {_FITS.format(h='net', p='')} THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


def _grams(n: int, source: str = "w") -> str:
    """The n words from each one on, NULL where a text ends before."""
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, n)]])


def quality(covered: dict[int, int], lines: int, symbols: int) -> str:
    lengths = sorted(covered)
    grams = "".join(f"""
g{n} AS (SELECT doc_id, i, word, {_grams(n)} AS gram FROM w),
d{n} AS (SELECT doc_id, i, word, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1
  THEN 1 ELSE 0 END AS twice FROM g{n}),
e{n} AS (SELECT doc_id, word, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING
  AND CURRENT ROW) AS inside FROM d{n}),
c{n} AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS words, CAST(sum(inside * length(word)) AS BIGINT) AS chars
  FROM e{n} GROUP BY doc_id),""" for n in lengths)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM texts),
w AS MATERIALIZED (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed),{grams}
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
m AS (SELECT doc_id, line, length(regexp_replace(line, '{SPACES}', '', 'g')) AS chars,
  count(*) OVER (PARTITION BY doc_id, line) AS times FROM l WHERE regexp_matches(line, '{WORD}')),
n AS (SELECT doc_id, count(*) - count(DISTINCT line) AS again, CAST(sum(chars) FILTER (times > 1) AS BIGINT) AS chars
  FROM m GROUP BY doc_id),
a AS (SELECT t.doc_id, len(listed.words) AS n_words, length(regexp_replace(text, '{SPACES}', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again, 0) AS n_dup_lines,
  coalesce(c8.words, 0) AS n_repeat_words, {", ".join(f"coalesce(c{n}.chars, 0) AS covered_{n}" for n in lengths)},
  coalesce(n.chars, 0) AS covered_lines
  FROM texts t JOIN listed USING (doc_id) LEFT JOIN n USING (doc_id)
  {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = t.doc_id" for n in lengths)}),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * n_symbols <= {symbols} * n_words
  AND {" AND ".join(f"100 * covered_{n} <= {most} * word_chars" for n, most in sorted(covered.items()))}
  AND 100 * covered_lines <= {lines} * word_chars AS kept FROM b"""


def _filled(name: str, nodes: str) -> str:
    """Shares of siblings (parent, path, weight, cap, budget) by water-filling."""
    order = "PARTITION BY parent ORDER BY cap / weight, path ROWS BETWEEN"
    return f"""{name}_nodes AS ({nodes}),
{name}_levels AS (SELECT *, cap / weight AS full_at, (budget - coalesce(sum(cap) OVER ({order} UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_nodes),
{name}_level AS (SELECT *, max(CASE WHEN full_at > level THEN level END) OVER (PARTITION BY parent) AS l FROM {name}_levels),
{name} AS (SELECT path, least(cap, coalesce(l * weight, cap)) AS share FROM {name}_level)"""


def mix(share: float, epochs: int, seed: int) -> str:
    cap = f"sum(have)::DOUBLE * {epochs} AS cap"
    domains = ("SELECT '' AS parent, domain AS path, CASE domain WHEN 'web' THEN 5.0 WHEN 'books' THEN 3.0 ELSE 2.0 END::DOUBLE "
               f"AS weight, {cap}, {share}::DOUBLE * (SELECT sum(have) FROM leaf) AS budget FROM leaf GROUP BY domain")
    languages = ("SELECT domain AS parent, domain || chr(31) || language AS path, CASE language WHEN 'en' THEN 6.0 "
                 "WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, "
                 f"{cap}, any_value(share) AS budget FROM leaf JOIN dom ON dom.path = domain GROUP BY domain, language")
    sources = ("SELECT p AS parent, p || chr(31) || source AS path, 1.0::DOUBLE AS weight, "
               f"{cap}, any_value(share) AS budget FROM leaf JOIN lan ON lan.path = p GROUP BY p, source")
    return f"""WITH t AS (SELECT doc_id, lang, source AS src, coalesce(lang, '(none)') AS language,
  coalesce(source, '(none)') AS source, CASE WHEN n < 8 THEN 'web' WHEN n < 14 THEN 'books' ELSE 'news' END AS domain,
  CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents)),
leaf AS MATERIALIZED (SELECT domain, language, source, domain || chr(31) || language AS p,
  coalesce(sum(tokens), 0)::BIGINT AS have FROM t GROUP BY ALL),
{_filled("dom", domains)},
{_filled("lan", languages)},
{_filled("src", sources)},
goal AS (SELECT domain, language, source, have, CAST(floor(share + 1e-6) AS BIGINT) AS target
  FROM leaf JOIN src ON src.path = p || chr(31) || source),
whole AS (SELECT *, CASE WHEN have > 0 THEN least(target // have, {epochs}) ELSE 0 END AS whole FROM goal),
placed AS (SELECT t.*, whole, target - whole * have AS rest, sum(coalesce(tokens, 0)) OVER (
    PARTITION BY domain, language, source ORDER BY md5('{seed}:' || whole || ':' || doc_id)) AS upto
  FROM t JOIN whole USING (domain, language, source)),
taken AS (SELECT *, whole + CASE WHEN whole < {epochs} AND upto <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang AS language, src AS source, tokens AS n_tokens, CAST(unnest(range(copies)) AS INTEGER) AS epoch
FROM taken"""


JACCARD = f"""WITH RECURSIVE listed AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed WHERE len(words) >= 5),
g AS (SELECT doc_id, {_grams(5)} AS gram FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL UNION ALL
  SELECT doc_id, array_to_string(words, ' ') AS gram FROM listed WHERE len(words) BETWEEN 1 AND 4),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
{REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d
LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id"""


_ENCODED = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_ENCODED.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes of trees from leaves (tree, i, total, h), and what stands beside each in its run."""
    return f"""{name} AS (SELECT tree, 0 AS lv, i, total, h FROM {leaves} UNION ALL
  SELECT tree, lv + 1, i // 3, (any_value(total) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
  WHERE total > 1 GROUP BY tree, lv, i // 3),
{name}_beside AS MATERIALIZED (SELECT a.tree, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name} a LEFT JOIN {name} b
  ON a.tree = b.tree AND a.lv = b.lv AND a.i // 3 = b.i // 3 AND a.i <> b.i WHERE a.total > 1 GROUP BY a.tree, a.lv, a.i)"""


# Unsigned crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

MERKLE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
  {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS given
  FROM documents),
leaves AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY tree) AS total FROM d),
{_tree("inside", "leaves")},
subs AS MATERIALIZED (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS total
  FROM inside WHERE total = 1),
{_tree("above", "subs")},
walk AS (SELECT tree, i AS leaf_i, 0 AS part, 0 AS lv, i AS at, given AS h, '' AS proof FROM leaves UNION ALL
  SELECT w.tree, w.leaf_i, CASE WHEN b.tree IS NULL THEN 1 ELSE w.part END,
    CASE WHEN b.tree IS NULL AND w.part = 0 THEN 0 ELSE w.lv + 1 END,
    CASE WHEN b.tree IS NULL AND w.part = 0 THEN s.i WHEN b.tree IS NULL AND u.tree IS NULL THEN -1 ELSE w.at // 3 END,
    CASE WHEN b.tree IS NOT NULL THEN sha256(b.l || w.h || b.r) WHEN u.tree IS NOT NULL THEN sha256(u.l || w.h || u.r) ELSE w.h END,
    w.proof || CASE WHEN b.tree IS NOT NULL THEN b.l || b.r WHEN u.tree IS NOT NULL THEN u.l || u.r ELSE '' END
  FROM walk w JOIN subs s ON s.name = w.tree
  LEFT JOIN inside_beside b ON w.part = 0 AND b.tree = w.tree AND b.lv = w.lv AND b.i = w.at
  LEFT JOIN above_beside u ON w.part = 1 AND u.lv = w.lv AND u.i = w.at WHERE w.at >= 0)
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM walk w JOIN leaves l ON l.tree = w.tree AND l.i = w.leaf_i JOIN subs s ON s.name = w.tree
JOIN above t ON t.total = 1 WHERE w.at = -1"""


_PHRASE = " UNION ALL ".join(
    f"SELECT lang, concat_ws(' ', {', '.join(['word', 'w2', 'w3', 'w4'][:n])}) AS phrase, count(*) AS a FROM g "
    f"WHERE w{n} IS NOT NULL GROUP BY ALL HAVING count(*) >= 30" for n in (2, 3, 4))
PHRASES = f"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM t),
q AS (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
w AS MATERIALIZED (SELECT d, lang, p, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM q),
g AS MATERIALIZED (SELECT lang, word, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3, lead(word, 3) OVER x AS w4 FROM w
  WINDOW x AS (PARTITION BY d, p ORDER BY i)),
c AS MATERIALIZED ({_PHRASE}),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM c),
known AS MATERIALIZED (SELECT lang, word AS part, count(*) AS f FROM w GROUP BY ALL UNION ALL SELECT lang, phrase, a FROM c),
cut AS (SELECT lang, phrase, a, words, unnest(range(1, len(words))) AS k FROM f),
scored AS (SELECT cut.lang, phrase, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN known x ON x.lang = cut.lang AND x.part = array_to_string(words[1:k], ' ')
  JOIN known y ON y.lang = cut.lang AND y.part = array_to_string(words[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, a, words, unnest(range(2, len(words))) AS m FROM f WHERE len(words) > 2),
s AS (SELECT lang, a, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM m),
inner_ones AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM s GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ones USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang
  ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""
