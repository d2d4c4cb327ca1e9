"""DuckDB SQL for those operators that SQL can say as a whole. Similarity joins are stated as full self-joins here, which
suits the sizes at which queries are compared; ids are taken to be unique and not null, as they are in the tables."""

from __future__ import annotations

from .chosen_path import LEAST, WORDS
from .divergence_rules import CLASS_FLOOR, CLASS_NOISE, MAX_CLASS_DISTANCE, MIN_CHARS, MIN_DOCS, MIN_WORDS, N_WORDS, WORD_FLOOR, WORD_NOISE
from .reply_trees import CONTROL

BLANK = r"[\x20\x09-\x0D]+"
#: The classes of divergence_rules, each taken from what the ones before left.
_CLASSES = [r"\p{Ll}", r"\p{Lu}", r"[\p{L}\p{M}]", r"\p{Nd}", "[.,]", "[#*$%&|<>]", "[!?:;''\"()\\-]"]


def _words(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{BLANK}'), lambda w: w <> '')"


def _rest(k: int) -> str:
    return "array_to_string(ws, '')" if k == 0 else f"regexp_replace({_rest(k - 1)}, '{_CLASSES[k - 1]}+', '', 'g')"


def _js(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: 0.5 * {part('z[1]')} + 0.5 * {part('z[2]')})), 0))"


OP3 = f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_words()} AS ws FROM documents),
o AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(list_transform(ws, lambda w: lower(w)))) AS word FROM d) GROUP BY 1, 2 HAVING count(*) >= {MIN_DOCS}),
r AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM o), k AS (SELECT lang, list(word ORDER BY r) AS common FROM r WHERE r <= {N_WORDS} GROUP BY lang),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
u AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM t), m AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM u, range(3) g(j) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT d.doc_id, d.lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
 coalesce(m.n, 0) AS n_repeat_words, [{', '.join(f'length({_rest(i)}) - length({_rest(i + 1)})' for i in range(len(_CLASSES)))}, length({_rest(len(_CLASSES))})] AS classes,
 list_transform(common, lambda c: len(list_filter(ws, lambda w: lower(w) = c))) AS counted FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN k ON k.lang IS NOT DISTINCT FROM d.lang),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_transform(classes, lambda c: CASE WHEN word_chars > 0 THEN c / word_chars::DOUBLE ELSE 0 END) AS cs,
 list_transform(list_append(counted, greatest(n_words - list_sum(counted), 0)), lambda c: CASE WHEN n_words > 0 THEN c / n_words::DOUBLE ELSE 0 END) AS wsh FROM f),
g AS (SELECT lang, [{', '.join(f'avg(cs[{i + 1}])' for i in range(len(_CLASSES) + 1))}] AS cref, list_filter([{', '.join(f'avg(wsh[{i + 1}])' for i in range(N_WORDS + 1))}], lambda v: v IS NOT NULL) AS wref
 FROM s WHERE NOT base_failed GROUP BY lang HAVING count(*) >= {MIN_DOCS}),
p AS (SELECT [{', '.join(f'avg(cs[{i + 1}])' for i in range(len(_CLASSES) + 1))}] AS pool FROM s WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed
 AND coalesce(CASE WHEN word_chars >= {MIN_CHARS} THEN {_js('cs', 'coalesce(cref, pool)')} <= least({MAX_CLASS_DISTANCE}, {CLASS_FLOOR} + {CLASS_NOISE} / sqrt(word_chars)) END, true)
 AND coalesce(CASE WHEN n_words >= {MIN_WORDS} AND len(wsh) = len(wref) THEN {_js('wsh', 'wref')} <= {WORD_FLOOR} + {WORD_NOISE} / sqrt(n_words) END, true) AS kept
FROM s LEFT JOIN g ON g.lang IS NOT DISTINCT FROM s.lang CROSS JOIN p"""

_ESCAPED = lambda c: f"regexp_replace(replace({c}, '\\', '\\\\'), '{CONTROL}', '\\1\\\\\\2', 'g')"

OP4 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(24 + length({_ESCAPED('role')}) + length({_ESCAPED('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

_REACH = """c AS (SELECT id, id AS root FROM n UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id AND c.root < l.b), g AS (SELECT id, min(root) AS root FROM c GROUP BY id)"""

OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words()} AS ws FROM documents), n AS (SELECT doc_id AS id FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE p.n >= {LEAST} * (x.n + y.n - p.n) - 1e-9), {_REACH}, k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS doc_id, root AS class_id, coalesce(n, 0) AS n_links, id = root AS kept FROM g LEFT JOIN k ON k.a = g.id"""

OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id AS id FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.95 * sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))),
{_REACH}, k AS (SELECT a, count(*) AS n FROM l GROUP BY a) SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM g LEFT JOIN k ON k.a = g.id"""

ORACLES = {"op3_divergence_rules": OP3, "op4_reply_trees": OP4, "op7_chosen_path": OP7, "op9_cap_filters": OP9}
