"""DuckDB SQL for the queries that SQL can express over whole tables.

Not expressible: trained classifiers (op1, op13), wrapper inference (op2), byte-pair merging (op5), greedy tiling (op6) and
token packing and alignment (op9, op12); tests hold these against brute-force versions.
"""

from __future__ import annotations

from heddle.llm.licenses import TEMPLATES

_WORDS = r"list_filter(string_split_regex(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _licenses() -> str:
    rows = []
    for k, t in enumerate(TEMPLATES):
        text, key = t.text.split(), t.keys[0].split()
        start = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
        rows.append(f"({k}, '{t.label}', {str(t.base).lower()}, {_list(text)}, {_list(key)}, {start})")
    low = _LOWER.format(t="coalesce(text, '')")
    return rf"""WITH t(t, label, base, tw, kw, s) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
near AS (SELECT r, w, t.* FROM d, t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(kw, ' ') || ' ')),
found AS (SELECT r, w, label, base, tw, i - s AS o FROM (SELECT *, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(kw)] = kw)) AS i FROM near)),
scored AS (SELECT *, list_sum(list_transform(range(len(tw)), lambda j: CASE WHEN o + j >= 0 AND o + j < len(w) AND w[greatest(o + j, 0) + 1] = tw[j + 1] THEN 1 ELSE 0 END)) / len(tw) AS share FROM found)
SELECT doc_id, len(any_value(d.w)) AS n_words, count(*) FILTER (WHERE base) AS n_base, min(o) FILTER (WHERE base) AS first_word, max(o) FILTER (WHERE base) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::double AS score, count(o) AS n_places
FROM d LEFT JOIN scored f ON d.r = f.r GROUP BY d.r, doc_id"""


_DEDUP = f"""WITH d AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE m < doc_id),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id"""

_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::int AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t=_LOWER.format(t='text'))} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], chr(10))) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT id, b FROM reach JOIN e ON r = a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON d.doc_id = id GROUP BY d.doc_id"""

_EXTRA = "\\### Assistant: </turn> ok"
_CODED = "2 * length({c}) - length(replace(replace(replace({c}, '\\', ''), '<', ''), '#', ''))"
_CHAT = f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{_EXTRA}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(14 + {_CODED.format(c='role')} + length(role) - length(replace(role, ':', '')) + {_CODED.format(c='text')})::bigint AS formatted_chars FROM r GROUP BY conv_id"""

_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.e, c.e)::bigint AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND place <= 5 AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

SQL: dict[str, str] = {
    "op3_license_scan": _licenses(),
    "op4_substring_dedup": _DEDUP,
    "op7_top_k": _TOP_K,
    "op8_jaccard_join": _JACCARD,
    "op10_chat_format": _CHAT,
    "op11_hard_negatives": _NEGATIVES,
}
