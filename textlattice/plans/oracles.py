"""DuckDB SQL for the registered queries.

Classes: full SQL over the tables for most; literal VALUES, worked out by hand, for decoders and parsers on small
inputs. Without SQL (rows only): arc_classifier, arc_top3, arc_parse, tagging_benchmark, segment_dp_merged, editor_token_check,
segment_then_spell, alert_console, editor_live, live_alert_console, live_passages, exported_models, editor_benchmark. Tests hold the
decoders among them against enumeration on small inputs; README names those that have no such test.
"""

from __future__ import annotations

BASE = r"""
en AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
parts AS (SELECT doc_id, lang, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, lang, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM parts),
worded AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(regexp_replace(w, '[^a-zA-Z0-9]', '', 'g'))), lambda w: w <> '') AS w FROM cut),
sall AS (SELECT doc_id, lang, text, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_id FROM worded WHERE len(w) > 0),
s AS (SELECT * FROM sall WHERE lang = 'en'),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, sent_id) <= floor((SELECT count(*) FROM s) * 0.8::DOUBLE) AS train FROM s),
pad AS (SELECT ['<BOS>', '<BOS>'] || w || ['<EOS>'] AS p FROM placed WHERE train),
uni AS (SELECT w, count(*) AS c FROM (SELECT unnest(p) AS w FROM pad) GROUP BY w),
bi AS (SELECT p[i] AS w1, p[i + 1] AS w2, count(*) AS c FROM (SELECT p, unnest(range(1, len(p))) AS i FROM pad) GROUP BY ALL),
tri AS (SELECT p[i] AS w1, p[i + 1] AS w2, p[i + 2] AS w3, count(*) AS c FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM pad) GROUP BY ALL),
st AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM uni WHERE w NOT IN ('<BOS>', '<EOS>')),
test AS (SELECT * FROM placed WHERE NOT train),
t3 AS (SELECT doc_id, sent_id, len(w) AS n_words, p[i] AS w1, p[i + 1] AS w2, p[i + 2] AS w3 FROM (SELECT *, unnest(range(1, len(p) - 1)) AS i FROM (SELECT *, ['<BOS>', '<BOS>'] || w || ['<EOS>'] AS p FROM test))),
t2 AS (SELECT doc_id, sent_id, len(w) AS n_words, p[i] AS w1, p[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(p))) AS i FROM (SELECT *, ['<BOS>'] || w || ['<EOS>'] AS p FROM test))),
q1 AS (
  SELECT x.w1, x.w2, x.w3, CASE WHEN b.c > 0 THEN 'trigram' WHEN u.c > 0 THEN 'bigram' ELSE 'unigram' END AS branch,
    CASE WHEN b.c > 0 THEN ln((coalesce(t.c, 0) + 0.05::DOUBLE) / (b.c + 0.05::DOUBLE * (v + 1))) WHEN u.c > 0 THEN ln((coalesce(b2.c, 0) + 0.05::DOUBLE) / (u.c + 0.05::DOUBLE * (v + 1))) - 1 ELSE ln((coalesce(u3.c, 0) + 0.05::DOUBLE) / (n + 0.05::DOUBLE * (v + 1))) - 2 END AS lp
  FROM (SELECT DISTINCT w1, w2, w3 FROM {ngrams}) x LEFT JOIN bi b ON b.w1 = x.w1 AND b.w2 = x.w2 LEFT JOIN tri t ON t.w1 = x.w1 AND t.w2 = x.w2 AND t.w3 = x.w3
  LEFT JOIN uni u ON u.w = x.w2 LEFT JOIN bi b2 ON b2.w1 = x.w2 AND b2.w2 = x.w3 LEFT JOIN uni u3 ON u3.w = x.w3, st
),
pu AS (SELECT x.w, (coalesce(c, 0) + 0.05::DOUBLE) / (n + 0.05::DOUBLE * (v + 2)) AS p FROM (SELECT DISTINCT w2 AS w FROM t2) x LEFT JOIN uni USING (w), st),
pb AS (SELECT x.w1, x.w2, CASE WHEN u.c > 0 THEN (coalesce(b.c, 0) + 0.05::DOUBLE) / (u.c + 0.05::DOUBLE * (v + 2)) ELSE pu.p END AS p
  FROM (SELECT DISTINCT w1, w2 FROM t2 UNION SELECT DISTINCT w2, w3 FROM t3) x LEFT JOIN uni u ON u.w = x.w1 LEFT JOIN bi b ON b.w1 = x.w1 AND b.w2 = x.w2 LEFT JOIN pu ON pu.w = x.w2, st),
pt AS (SELECT x.w1, x.w2, x.w3, CASE WHEN b.c > 0 THEN (coalesce(t.c, 0) + 0.05::DOUBLE) / (b.c + 0.05::DOUBLE * (v + 2)) ELSE pb.p END AS p
  FROM (SELECT DISTINCT w1, w2, w3 FROM t3) x LEFT JOIN bi b ON b.w1 = x.w1 AND b.w2 = x.w2 LEFT JOIN tri t ON t.w1 = x.w1 AND t.w2 = x.w2 AND t.w3 = x.w3 LEFT JOIN pb ON pb.w1 = x.w2 AND pb.w2 = x.w3, st),
ng2 AS (SELECT doc_id, sent_id, n_words, sum(ln(greatest(p, 1e-30::DOUBLE))) AS lp FROM t2 JOIN pb USING (w1, w2) GROUP BY ALL),
ng3 AS (SELECT doc_id, sent_id, n_words, sum(ln(greatest(p, 1e-30::DOUBLE))) AS lp FROM t3 JOIN pt USING (w1, w2, w3) GROUP BY ALL),
q1s AS (SELECT doc_id, sent_id, n_words, sum(lp) AS total FROM t3 JOIN q1 USING (w1, w2, w3) GROUP BY ALL)
"""
ALPHA = r"""
alpha AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '^\p{L}+$')), lambda w: lower(w)) AS w FROM documents WHERE lang = 'en' AND text IS NOT NULL),
vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM alpha) GROUP BY word),
vs AS (SELECT sum(n)::BIGINT AS total, count(*) AS types FROM vocab),
sb AS (SELECT w[i] AS w1, w[i + 1] AS w2, count(*) AS c FROM (SELECT w, unnest(range(1, len(w))) AS i FROM alpha) GROUP BY ALL),
dels AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS del FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab))
"""
H = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def h(*parts: str) -> str:
    return H.format(" || '|' || ".join(parts))


def _mutation() -> str:
    n, lo = "length(word)", "'abcdefghijklmnopqrstuvwxyz'"
    i, t, e = f"({h(chr(39) + 'q4' + chr(39), chr(39) + 'at' + chr(39), 'word')} % {n})", f"({h(chr(39) + 'q4' + chr(39), chr(39) + 'at' + chr(39), 'word')} % greatest({n} - 1, 1))", f"({h(chr(39) + 'q4' + chr(39), chr(39) + 'at' + chr(39), 'word')} % ({n} + 1))"
    new = h("'q4'", "'letter'", "word")
    op = h("'q4'", "'op'", "word")
    old = f"(unicode(substr(word, {i} + 1, 1)) - 97)"
    pick = f"CASE WHEN {old} BETWEEN 0 AND 25 THEN ({old} + 1 + {new} % 25) % 26 ELSE {new} % 26 END"
    return f"""
mut0 AS (SELECT word, CASE WHEN {n} = 1 THEN ['replace', 'insert'][{op} % 2 + 1] ELSE ['delete', 'transpose', 'replace', 'insert'][{op} % 4 + 1] END AS op FROM vocab),
mut AS (SELECT word, op, CASE op WHEN 'delete' THEN left(word, {i}) || substr(word, {i} + 2)
  WHEN 'transpose' THEN left(word, {t}) || substr(word, {t} + 2, 1) || substr(word, {t} + 1, 1) || substr(word, {t} + 3)
  WHEN 'replace' THEN left(word, {i}) || substr({lo}, ({pick}) + 1, 1) || substr(word, {i} + 2)
  ELSE left(word, {e}) || substr({lo}, {new} % 26 + 1, 1) || substr(word, {e} + 1) END AS mutated FROM mut0),
asked AS (SELECT DISTINCT mutated AS query FROM mut WHERE mutated <> ''),
qdels AS (SELECT DISTINCT query, left(query, i - 1) || substr(query, i + 1) AS del FROM (SELECT query, unnest(range(1, length(query) + 1)) AS i FROM asked)),
candb AS (SELECT query, word AS candidate FROM qdels JOIN dels USING (del) UNION SELECT query, word FROM asked JOIN dels ON dels.del = query)
"""


def _mistake() -> str:
    lo = "'abcdefghijklmnopqrstuvwxyz'"
    i = f"({h(chr(39) + 'q3' + chr(39), chr(39) + 'at' + chr(39), 'word')} % length(word))"
    new = f"substr({lo}, {h(chr(39) + 'q3' + chr(39), chr(39) + 'letter' + chr(39), 'word')} % 26 + 1, 1)"
    op = f"['delete', 'transpose', 'replace', 'insert'][{h(chr(39) + 'q3' + chr(39), chr(39) + 'op' + chr(39), 'word')} % 4 + 1]"
    return f"""
err AS (SELECT word, {op} AS op, CASE WHEN length(word) < 3 THEN word WHEN {op} = 'delete' THEN left(word, {i}) || substr(word, {i} + 2)
  WHEN {op} = 'transpose' AND {i} < length(word) - 1 THEN left(word, {i}) || substr(word, {i} + 2, 1) || substr(word, {i} + 1, 1) || substr(word, {i} + 3)
  WHEN {op} = 'replace' THEN left(word, {i}) || {new} || substr(word, {i} + 2) ELSE left(word, {i}) || {new} || substr(word, {i} + 1) END AS mutated FROM vocab)
"""


#: One edit from a-z: all edits of a query, for the words of the vocabulary.
EDITS = r"""
places AS (SELECT query, unnest(range(0, length(query) + 1)) AS i FROM asked),
letters AS (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS a),
edits AS (
  SELECT query, left(query, i) || substr(query, i + 2) AS candidate FROM places WHERE i < length(query)
  UNION SELECT query, left(query, i) || substr(query, i + 2, 1) || substr(query, i + 1, 1) || substr(query, i + 3) FROM places WHERE i < length(query) - 1
  UNION SELECT query, left(query, i) || a || substr(query, i + 2) FROM places, letters WHERE i < length(query)
  UNION SELECT query, left(query, i) || a || substr(query, i + 1) FROM places, letters
),
canda AS (SELECT query, candidate FROM edits JOIN vocab ON word = candidate)
"""
MERGE = rf"""
cw AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM conversations),
ct AS (SELECT conv_id, turn, w[i] AS w, i - 1 AS i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM cw)),
cg AS (SELECT *, CASE WHEN i = 0 THEN 1 WHEN {h("'merge'", "conv_id", "turn", "i")} < 343597383 THEN 0 ELSE 1 END AS fresh FROM ct),
ci AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS token_id FROM cg),
merged AS (SELECT conv_id, turn, token_id::BIGINT AS token_id, string_agg(w, '' ORDER BY i) AS token, count(*) AS n_words FROM ci GROUP BY ALL),
mends AS (SELECT *, sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY token_id)::BIGINT AS e FROM merged),
gends AS (SELECT conv_id, turn, i::BIGINT AS token_id, w AS token, sum(length(w)) OVER (PARTITION BY conv_id, turn ORDER BY i)::BIGINT AS e FROM ct),
mcuts AS (SELECT c.conv_id, c.turn, coalesce(x.l, []) AS l FROM conversations c LEFT JOIN (SELECT conv_id, turn, list(e ORDER BY e) AS l FROM (SELECT *, max(token_id) OVER (PARTITION BY conv_id, turn) AS m FROM mends) WHERE token_id < m GROUP BY ALL) x USING (conv_id, turn)),
gcuts AS (SELECT c.conv_id, c.turn, coalesce(x.l, []) AS l FROM conversations c LEFT JOIN (SELECT conv_id, turn, list(e ORDER BY e) AS l FROM (SELECT *, max(token_id) OVER (PARTITION BY conv_id, turn) AS m FROM gends) WHERE token_id < m GROUP BY ALL) x USING (conv_id, turn))
"""
LINES = r"""
line AS (SELECT conv_id, turn * 1000000 + token_id AS pos, token, lower(regexp_replace(token, '[^\p{L}\p{N}]', '', 'g')) AS clean FROM merged)
"""
WINDOWS = LINES + r""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k, list(clean) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five FROM line),
windows AS (SELECT conv_id, pos, list_filter(five, lambda w: w <> '') AS w FROM numbered WHERE k % 5 = 0 AND clean <> ''),
fired AS (SELECT * FROM windows WHERE len(w) >= 3)
"""
SEQ = r"""
seq AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, props ->> '$.k' AS word, event_type AS tag FROM events),
tr AS (SELECT prev, cur, count(*) AS c FROM (
  SELECT coalesce(lag(tag) OVER (PARTITION BY user_id ORDER BY pos), '<START>') AS prev, tag AS cur FROM seq
  UNION ALL SELECT tag, '<END>' FROM (SELECT *, max(pos) OVER (PARTITION BY user_id) AS m FROM seq) WHERE pos = m) GROUP BY ALL),
em AS (SELECT tag, word, count(*) AS c FROM seq GROUP BY ALL),
tags AS (SELECT DISTINCT tag FROM seq),
trp AS (SELECT p.tag AS prev, q.tag AS cur, ln((coalesce(c, 0) + 1e-4::DOUBLE) / (coalesce((SELECT sum(c) FROM tr z WHERE z.cur = p.tag), 0) + 1e-4::DOUBLE * (SELECT count(*) FROM tags))) AS lp
  FROM (SELECT tag FROM tags UNION ALL SELECT '<START>') p CROSS JOIN tags q LEFT JOIN tr ON tr.prev = p.tag AND tr.cur = q.tag),
counted AS (SELECT word, tag, count(*) AS c FROM seq WHERE user_id % 5 <> 0 GROUP BY ALL),
mft AS (SELECT word, tag FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY c DESC, tag) AS r FROM counted) WHERE r = 1),
modal AS (SELECT tag AS modal FROM (SELECT tag, sum(c) AS c FROM counted GROUP BY tag) ORDER BY c DESC, tag LIMIT 1),
guess AS (SELECT user_id, pos, s.tag AS gold, coalesce(mft.tag, modal) AS pred FROM seq s LEFT JOIN mft USING (word), modal WHERE user_id % 5 = 0)
"""
REAL = r"""
opts AS (SELECT DISTINCT prev, word, candidate FROM (SELECT DISTINCT prev, word FROM rw) JOIN (SELECT query AS word, candidate FROM rcand UNION SELECT DISTINCT word, word FROM rw) USING (word)),
rp AS (SELECT prev, o.word, candidate, CASE WHEN prev IS NULL THEN coalesce(v0.n, 0)::DOUBLE / total ELSE (coalesce(sb.c, 0) + 1)::DOUBLE / (coalesce(v1.n, 0) + types) END AS p
  FROM opts o LEFT JOIN sb ON sb.w1 = prev AND sb.w2 = candidate LEFT JOIN vocab v1 ON v1.word = prev LEFT JOIN vocab v0 ON v0.word = candidate, vs),
rbest AS (SELECT prev, word, candidate, p, row_number() OVER (PARTITION BY prev, word ORDER BY p DESC, candidate) AS r, max(CASE WHEN candidate = word THEN p END) OVER (PARTITION BY prev, word) AS own FROM rp),
better AS (SELECT prev, word, candidate FROM rbest WHERE r = 1 AND p > own * 1.5)
"""
CONV = r"""
cli AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_'']+|[.,!?;]') AS t FROM conversations),
clit AS (SELECT conv_id, turn, i - 1 AS pos, t[i] AS token, lower(t[i]) AS word, CASE WHEN i > 1 THEN lower(t[i - 1]) END AS prev FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM cli)),
rw AS (SELECT * FROM clit WHERE regexp_matches(word, '^\p{L}+$')),
rq AS (SELECT DISTINCT word AS query FROM rw),
rqd AS (SELECT DISTINCT query, left(query, i - 1) || substr(query, i + 1) AS del FROM (SELECT query, unnest(range(1, length(query) + 1)) AS i FROM rq)),
rcand AS (SELECT query, word AS candidate FROM rqd JOIN dels USING (del) UNION SELECT query, word FROM rq JOIN dels ON dels.del = query)
"""


def base(ngrams: str = "t3") -> str:
    return BASE.replace("{ngrams}", ngrams)


def sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(c.strip() for c in ctes)} {select}" if ctes else select


TABLE = r"""
scored AS (SELECT t.doc_id, t.sent_id, t.text, len(t.w) AS n, round(ng2.lp, 4) AS b, round(total, 4) AS t FROM test t JOIN ng2 USING (doc_id, sent_id) JOIN q1s USING (doc_id, sent_id)),
verdicts AS (SELECT *, CASE WHEN t / n >= -11.0::DOUBLE THEN 'Trigram LM' ELSE 'Bigram LM' END AS m,
  CASE WHEN t / n >= -8.8::DOUBLE THEN 'Grammatical' WHEN t / n >= -11.0::DOUBLE THEN 'Questionable' WHEN b / n >= -8.5::DOUBLE THEN 'Grammatical' ELSE 'Ungrammatical' END AS v FROM scored)
"""


def _correct(cand: str, asked: str = "asked") -> str:
    return f"SELECT query, CASE WHEN k.word IS NOT NULL THEN query ELSE coalesce(b.candidate, query) END AS correction FROM {asked} LEFT JOIN vocab k ON k.word = query LEFT JOIN (SELECT query, candidate FROM (SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY n DESC, candidate) AS r FROM {cand} JOIN vocab ON word = candidate) WHERE r = 1) b USING (query)"


def values(columns: str, rows: list[tuple]) -> str:
    def lit(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)

    cast = [c.split() for c in columns.split(", ")]
    return "SELECT " + ", ".join(f"{n}::{t} AS {n}" for n, t in cast) + " FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({', '.join(n for n, _ in cast)})"


_STEPS = [
    ("SHIFT", "ROOT", "NULL", "DET", "NOUN"), ("SHIFT", "DET", "ROOT", "NOUN", "VERB"), ("LEFT-ARC:det", "NOUN", "DET", "VERB", "ADP"), ("SHIFT", "NOUN", "ROOT", "VERB", "ADP"),
    ("LEFT-ARC:nsubj", "VERB", "NOUN", "ADP", "DET"), ("SHIFT", "VERB", "ROOT", "ADP", "DET"), ("SHIFT", "ADP", "VERB", "DET", "NOUN"), ("SHIFT", "DET", "ADP", "NOUN", "PUNCT"),
    ("LEFT-ARC:det", "NOUN", "DET", "PUNCT", "NULL"), ("LEFT-ARC:case", "NOUN", "ADP", "PUNCT", "NULL"), ("RIGHT-ARC:obl", "NOUN", "VERB", "PUNCT", "NULL"), ("SHIFT", "VERB", "ROOT", "PUNCT", "NULL"),
    ("RIGHT-ARC:punct", "PUNCT", "VERB", "NULL", "NULL"), ("RIGHT-ARC:root", "VERB", "ROOT", "NULL", "NULL"),
]
"""By hand for the crossing tree: all shift until the buffer is empty, save that d has no children and hangs on c."""
_CROSSING = [("SHIFT", "ROOT", "NULL", "X", "X"), ("SHIFT", "X", "ROOT", "X", "X"), ("SHIFT", "X", "X", "X", "X"), ("SHIFT", "X", "X", "X", "NULL")]
_ROWS = [(0, i, *s) for i, s in enumerate(_STEPS, 1)] + [(1, i, *s) for i, s in enumerate(_CROSSING, 1)]
_F = ["stack_top", "stack_second", "buffer_first", "buffer_second"]


def _one_hot() -> list[tuple]:
    found = sorted({(f, r[3 + k]) for r in _ROWS for k, f in enumerate(_F)})
    return [(f, v, i) for i, (f, v) in enumerate(found)]


ORACLES: dict[str, str] = {
    "clean_ascii": sql(r"SELECT word, count(*) AS n FROM (SELECT lower(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '[^a-zA-Z0-9]', '', 'g')) AS word FROM en) WHERE word <> '' GROUP BY word", base()),
    "clean_unicode": r"SELECT lang, count(*) AS n_tokens, count(DISTINCT w) AS n_types FROM (SELECT lang, lower(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '[^\p{L}\p{N}]', '', 'g')) AS w FROM documents) WHERE w <> '' GROUP BY lang",
    "corpus_clean_en": r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents WHERE lang = 'en'",
    "corpus_clean_es": r"SELECT doc_id, len(l)::BIGINT AS n_tokens, length(array_to_string(l, ''))::BIGINT AS n_chars FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(lower(w), '[^a-záéíóúüñ0-9]', '', 'g')), lambda w: w <> '') AS l FROM documents WHERE lang = 'es')",
    "corpus_split_80_20": sql("SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS split, count(*) AS n_sents, sum(len(w))::BIGINT AS n_tokens FROM placed GROUP BY train", base()),
    "sentence_split_text": sql("SELECT doc_id, sent_id, text FROM sall", base()),
    "filter_alnum_tokens": r"SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^[\p{L}\p{N}]+$')))::BIGINT AS n_kept, len(list_filter(w, lambda x: NOT regexp_matches(x, '^[\p{L}\p{N}]+$')))::BIGINT AS n_dropped FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)",
    "cli_tokenize": sql("SELECT conv_id, turn, len(t)::BIGINT AS n_tokens FROM cli", ALPHA, CONV),
    "cli_detokenize": sql(r"SELECT conv_id, turn, regexp_replace(array_to_string(t, ' '), '\s+([.,!?;])', '\1', 'g') AS text FROM cli", ALPHA, CONV),
    "morph_tag_compose": values("sent_id BIGINT, id INTEGER, tag VARCHAR", [(0, 1, "DET-None-None"), (0, 2, "NOUN-Masc-Sing"), (0, 3, "VERB-None-Sing"), (0, 4, "ADP-None-None"), (0, 5, "DET-None-None"), (0, 6, "NOUN-None-Sing"), (1, 1, "X-None-None"), (1, 2, "X-Fem-Plur"), (1, 3, "X-None-None"), (1, 4, "X-None-None")]),
    "conllu_parse": values("sent_id BIGINT, id INTEGER, form VARCHAR, upos VARCHAR, head INTEGER, deprel VARCHAR", [(0, 1, "The", "DET", 2, "det"), (0, 2, "cat", "NOUN", 3, "nsubj"), (0, 3, "sat", "VERB", 0, "root"), (0, 4, "on", "ADP", 6, "case"), (0, 5, "the", "DET", 6, "det"), (0, 6, "mat", "NOUN", 3, "obl"), (0, 7, ".", "PUNCT", 3, "punct"), (1, 1, "a", "X", 3, "dep"), (1, 2, "b", "X", 4, "dep"), (1, 3, "c", "X", 0, "root"), (1, 4, "d", "X", 3, "dep")]),
    "passage_sample": sql(f"SELECT doc_id, replace(replace(replace(replace(replace(array_to_string(t[a + 1:a + m], ' '), ' .', '.'), ' ,', ','), ' !', '!'), ' ?', '?'), ' ''', '''') AS passage FROM (SELECT *, {h(chr(39) + 'passage' + chr(39), chr(39) + 's' + chr(39), 'doc_id')} % (n - m + 1) AS a FROM (SELECT *, least(n, 5 + {h(chr(39) + 'passage' + chr(39), chr(39) + 'n' + chr(39), 'doc_id')} % 4) AS m FROM (SELECT doc_id, list(text ORDER BY sent_id) AS t, count(*) AS n FROM s GROUP BY doc_id)) WHERE n >= 5)", base()),
    "adjacent_pairs": sql('SELECT w[i] AS "left", w[i + 1] AS "right", count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM s) GROUP BY ALL', base()),
    "spell_vocab": sql("SELECT word, n FROM vocab", ALPHA),
    "seg_vocab_filter": sql("SELECT word, n FROM vocab WHERE length(word) >= 3 OR word IN ('a','i','am','an','as','at','be','by','do','go','he','if','in','is','it','me','my','no','of','on','or','so','to','up','us','we')", ALPHA),
    "ngram_unigrams": sql("SELECT w, c FROM uni", base()),
    "ngram_bigrams": sql("SELECT w1, w2, c FROM bi", base()),
    "ngram_trigrams": sql("SELECT w1, w2, w3, c FROM tri", base()),
    "ngram_from_lm": sql("SELECT v + 1 AS v_q1, greatest(v + 2, 1) AS v_q4, n AS n_tokens FROM st", base()),
    "seed_injection": sql("SELECT w, sum(c)::BIGINT AS c FROM (SELECT w, c FROM uni UNION ALL SELECT 'despejado', 10) GROUP BY w", base()),
    "lm_logprob_q1": sql("SELECT w1 AS w_prev2, w2 AS w_prev1, w3 AS w, branch, round(lp, 6) AS logprob FROM q1", base()),
    "ng_unigram_prob": sql("SELECT w, round(p, 12) AS prob FROM pu", base()),
    "ng_bigram_prob": sql("SELECT DISTINCT w1, w2, round(p, 12) AS prob FROM t2 JOIN pb USING (w1, w2)", base()),
    "ng_trigram_prob": sql("SELECT w1, w2, w3, round(p, 12) AS prob FROM pt", base()),
    "ng_score_bigram": sql("SELECT doc_id, sent_id, round(lp, 4) AS logprob, round(-lp / n_words, 4) AS ln_ppl FROM ng2", base()),
    "ng_score_trigram": sql("SELECT doc_id, sent_id, round(lp, 4) AS logprob, round(-lp / n_words, 4) AS ln_ppl FROM ng3", base()),
    "ng_perplexity": sql('SELECT o::BIGINT AS "order", count(*) AS n, round(avg(-lp / n_words), 4) AS mean_ln_ppl FROM (SELECT 2 AS o, lp, n_words FROM ng2 UNION ALL SELECT 3, lp, n_words FROM ng3) GROUP BY o', base()),
    "score_trigram_q1": sql("SELECT doc_id, sent_id, round(total, 4) AS total, round(total / n_words, 4) AS avg FROM q1s", base()),
    "score_bigram_q3": sql("SELECT doc_id, sent_id, round(t, 4) AS total, round(t / n, 4) AS avg FROM (SELECT doc_id, sent_id, max(len(w)) AS n, sum(ln(greatest(CASE WHEN i = 1 THEN coalesce(v0.n, 0)::DOUBLE / total ELSE (coalesce(sb.c, 0) + 1)::DOUBLE / (coalesce(v1.n, 0) + types) END, 1e-30::DOUBLE))) AS t FROM (SELECT doc_id, sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM test) x LEFT JOIN vocab v0 ON v0.word = w[i] LEFT JOIN vocab v1 ON v1.word = w[i - 1] AND i > 1 LEFT JOIN sb ON sb.w1 = w[i - 1] AND sb.w2 = w[i] AND i > 1, vs GROUP BY ALL)", base(), ALPHA),
    "score_fallback": sql("SELECT doc_id, sent_id, round(len(w) * ln(0.05::DOUBLE / (100 + 0.05::DOUBLE * 45000)), 6) AS bigram_total, round(len(w) * ln(0.05::DOUBLE / (50 + 0.05::DOUBLE * 45000)), 6) AS trigram_total FROM test", base()),
    "spell_unigram_prob": sql("SELECT word, round(n / total, 12) AS prob FROM vocab, vs", ALPHA),
    "spell_bigram_prob": sql("SELECT w1, w2, round((c + 1)::DOUBLE / (n + types), 12) AS prob FROM sb JOIN vocab ON word = w1, vs", ALPHA),
    "deletions": sql("SELECT word, del FROM dels", ALPHA),
    "symdelete_index": sql("SELECT del, count(*) AS n_words FROM dels GROUP BY del", ALPHA),
    "mutate_q4": sql("SELECT word, op, mutated FROM mut", ALPHA, _mutation()),
    "mutate_q3": sql("SELECT e.word, op, CASE WHEN v.word IS NULL THEN mutated ELSE e.word END AS mutated FROM err e LEFT JOIN vocab v ON v.word = mutated", ALPHA, _mistake()),
    "corrupt_words": sql(f"SELECT word, CASE WHEN g THEN 'merge' ELSE op END AS op, CASE WHEN g THEN word || r ELSE mutated END AS mutated FROM (SELECT mut.*, r, {h(chr(39) + 'corrupt' + chr(39), 'word')} % 2 = 0 AND r IS NOT NULL AS g FROM mut LEFT JOIN (SELECT w[i] AS l, min(w[i + 1]) AS r FROM (SELECT w, unnest(range(1, len(w))) AS i FROM s) GROUP BY l) ON l = word)", base(), ALPHA, _mutation()),
    "spell_candidates_a": sql("SELECT query, candidate FROM canda", ALPHA, _mutation(), EDITS),
    "spell_candidates_b": sql("SELECT query, candidate FROM candb", ALPHA, _mutation()),
    "spell_correct_nonword": sql(f"SELECT query, 'A' AS method, correction FROM ({_correct('canda')}) UNION ALL SELECT query, 'B', correction FROM ({_correct('candb')})", ALPHA, _mutation(), EDITS),
    "spell_correct_realword": sql("SELECT conv_id, turn, pos, rw.word, coalesce(candidate, rw.word) AS correction FROM rw LEFT JOIN better b ON b.word = rw.word AND b.prev IS NOT DISTINCT FROM rw.prev", ALPHA, CONV, REAL),
    "spell_sentence": sql(rf"SELECT conv_id, turn, regexp_replace(string_agg(CASE WHEN f <> word THEN '**' || f || '**' ELSE token END, ' ' ORDER BY pos), '\s+([.,!?;])', '\1', 'g') AS text, count(*) FILTER (f <> word) AS n_changed FROM (SELECT c.*, CASE WHEN NOT regexp_matches(c.word, '^\p{{L}}+$') THEN c.word WHEN k.word IS NULL THEN n.correction ELSE coalesce(b.candidate, c.word) END AS f FROM clit c LEFT JOIN vocab k ON k.word = c.word LEFT JOIN ({_correct('rcand', 'rq')}) n ON n.query = c.word LEFT JOIN better b ON b.word = c.word AND b.prev IS NOT DISTINCT FROM c.prev) GROUP BY ALL", ALPHA, CONV, REAL),
    "merge_generator": sql("SELECT conv_id, turn, token_id, token, n_words FROM merged", MERGE),
    "seg_boundaries": sql("SELECT conv_id, turn, array_to_string(l, ',') AS cuts FROM mcuts", MERGE),
    "seg_metrics": sql("SELECT conv_id, turn, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, g = q AS exact FROM (SELECT conv_id, turn, g.l AS g, m.l AS q, CASE WHEN len(g.l) = 0 AND len(m.l) = 0 THEN 1.0::DOUBLE WHEN len(g.l) = 0 OR len(m.l) = 0 THEN 0 ELSE len(list_intersect(g.l, m.l))::DOUBLE / len(m.l) END AS p, CASE WHEN len(g.l) = 0 AND len(m.l) = 0 THEN 1.0::DOUBLE WHEN len(g.l) = 0 OR len(m.l) = 0 THEN 0 ELSE len(list_intersect(g.l, m.l))::DOUBLE / len(g.l) END AS r FROM gcuts g JOIN mcuts m USING (conv_id, turn))", MERGE),
    "segment_dp": values("s VARCHAR, tokens VARCHAR, score DOUBLE", [("thecatsat", "the cat sat", -1.65178), ("acatran", "a cat ran", -4.968537), ("thecatsran", "the cats ran", -1.766519), ("thexcat", "the x cat", -21.753549), ("catsat", "cat sat", -5.957029)]),
    "mft_train": sql("SELECT word, tag FROM mft", SEQ),
    "mft_predict": sql("SELECT user_id, pos, pred FROM guess", SEQ),
    "hmm_transitions": sql("SELECT prev, cur, c FROM tr", SEQ),
    "hmm_emissions": sql("SELECT tag, word, c FROM em", SEQ),
    "hmm_transition_logprob": sql("SELECT prev, cur, round(lp, 6) AS logprob FROM trp", SEQ),
    "hmm_emission_logprob": sql("SELECT t.tag, w.word, round(ln((coalesce(c, 0) + 1e-4::DOUBLE) / (n + 1e-4::DOUBLE * ((SELECT count(DISTINCT word) FROM seq) + 1))), 6) AS logprob FROM (SELECT tag, count(*) AS n FROM seq GROUP BY tag) t CROSS JOIN (SELECT DISTINCT word FROM seq) w LEFT JOIN em ON em.tag = t.tag AND em.word = w.word", SEQ),
    "agreement_ratio": sql("SELECT a.prev, a.cur AS cur_a, b.cur AS cur_b, round(exp(a.lp - b.lp), 6) AS ratio FROM trp a JOIN trp b USING (prev) WHERE a.cur <> b.cur AND prev <> '<START>'", SEQ),
    "reconcile_tags": values("pos BIGINT, hmm_tag VARCHAR, pcfg_tag VARCHAR, tag VARCHAR", [(0, "NOUN", "", "NN"), (1, "at", "DT", "DT"), (2, "zz", None, "ZZ"), (3, "(", None, "-LRB-")]),
    "token_spans": sql('SELECT conv_id, turn, token_id AS pos, e - length(token) AS start, e AS "end", token FROM mends', MERGE),
    "error_attribution": sql("SELECT conv_id, turn, n, c AS correct, t AS tag_err, n - c - t AS seg_err, round(c / n, 6) AS correct_rate, round(t / n, 6) AS tag_err_rate, round((n - c - t) / n, 6) AS seg_err_rate FROM (SELECT g.conv_id, g.turn, count(*) AS n, count(*) FILTER (m.e IS NOT NULL AND (length(g.token) > 4) = (length(m.token) > 5)) AS c, count(*) FILTER (m.e IS NOT NULL AND (length(g.token) > 4) <> (length(m.token) > 5)) AS t FROM gends g LEFT JOIN mends m ON m.conv_id = g.conv_id AND m.turn = g.turn AND m.e = g.e AND m.e - length(m.token) = g.e - length(g.token) GROUP BY ALL)", MERGE),
    "arc_oracle": values("sent_id BIGINT, step BIGINT, action VARCHAR", [r[:3] for r in _ROWS]),
    "arc_features": values("sent_id BIGINT, step BIGINT, " + ", ".join(f"{f} VARCHAR" for f in _F), [(r[0], r[1], *r[3:]) for r in _ROWS]),
    "action_distribution": values("action VARCHAR, n BIGINT, pct DOUBLE", [("SHIFT", 11, 61.1111), ("LEFT-ARC:det", 2, 11.1111), ("LEFT-ARC:case", 1, 5.5556), ("LEFT-ARC:nsubj", 1, 5.5556), ("RIGHT-ARC:obl", 1, 5.5556), ("RIGHT-ARC:punct", 1, 5.5556), ("RIGHT-ARC:root", 1, 5.5556)]),
    "arc_onehot": values("feature VARCHAR, value VARCHAR, idx BIGINT", _one_hot()),
    "uas_las": values("n BIGINT, uas DOUBLE, las DOUBLE", [(7, 85.714286, 71.428571)]),
    "pcfg_rules": values("lhs VARCHAR, rhs VARCHAR, c BIGINT, prob DOUBLE", [("S", "NP VP", 3, 1.0), ("NP", "PRP", 2, 0.285714), ("NP", "DT NN", 5, 0.714286), ("VP", "VB NP", 2, 0.666667), ("VP", "VB VP|<NP-PP>", 1, 0.333333), ("VP|<NP-PP>", "NP PP", 1, 1.0), ("PP", "IN NP", 1, 1.0), ("PRP", "she", 1, 0.5), ("PRP", "her", 1, 0.5), ("VB", "saw", 3, 1.0), ("DT", "the", 5, 1.0), ("NN", "dog", 2, 0.4), ("NN", "man", 2, 0.4), ("NN", "telescope", 1, 0.2), ("IN", "with", 1, 1.0)]),
    "pcfg_rule_kinds": values("kind VARCHAR, n BIGINT", [("lexical", 8), ("binary", 6), ("unary", 1)]),
    "cky_parse": values("sent_id BIGINT, parsed BOOLEAN", [(0, True), (1, True), (2, False), (3, False), (4, False)]),
    "cky_tree": values("sent_id BIGINT, tree VARCHAR", [(0, "(S (NP (PRP she)) (VP (VB saw) (NP (DT the) (NN dog))))"), (1, "(S (NP (PRP she)) (VP (VP (VB saw) (NP (DT the) (NN dog))) (PP (IN with) (NP (DT the) (NN telescope)))))"), (2, None), (3, None), (4, None)]),
    "cky_logprob": values("sent_id BIGINT, logprob DOUBLE", [(0, -3.729701), (1, -6.948577), (2, None), (3, None), (4, None)]),
    "pcfg_score": values("sent_id BIGINT, display VARCHAR", [(0, "-3.7297"), (1, "-6.9486"), (2, "Unparseable"), (3, "Unparseable"), (4, "Unparseable")]),
    "decision_rule": sql("SELECT doc_id, sent_id, m AS method, v AS verdict FROM verdicts", base(), TABLE),
    "comparison_table": sql("SELECT doc_id, sent_id, text AS sentence_text, 'Unparseable' AS pcfg_result, b AS bigram_score, t AS trigram_score, m AS chosen_method, v AS final_verdict, 0::BIGINT AS num_merges, 0::BIGINT AS num_spells FROM verdicts", base(), TABLE),
    "passage_analysis": sql("SELECT doc_id, sent_id, b AS bigram_score, t AS trigram_score, m AS chosen_method, v AS final_verdict FROM verdicts", base(), TABLE),
    "verdict_summary": sql("SELECT count(*) AS total, count(*) FILTER (v = 'Grammatical') AS grammatical, count(*) FILTER (v = 'Questionable') AS questionable, count(*) FILTER (v = 'Ungrammatical') AS ungrammatical, 0::BIGINT AS merges, 0::BIGINT AS spells FROM verdicts", base(), TABLE),
    "editor_trigger": sql("SELECT conv_id, pos, array_to_string(w, ' ') AS \"window\", round(lp, 6) AS logprob, nullif(concat_ws('|', CASE WHEN lp < -15 THEN 'implausible' END, 'context:' || candidate), '') AS alert FROM fired JOIN q1 ON w1 = w[-3] AND w2 = w[-2] AND w3 = w[-1] LEFT JOIN better b ON b.word = w[-1] AND b.prev = w[-2]", ALPHA, MERGE, WINDOWS, "ft AS (SELECT w[-3] AS w1, w[-2] AS w2, w[-1] AS w3 FROM fired)", base("ft"), "rw AS (SELECT w[-2] AS prev, w[-1] AS word FROM fired), rq AS (SELECT DISTINCT word AS query FROM rw), rqd AS (SELECT DISTINCT query, left(query, i - 1) || substr(query, i + 1) AS del FROM (SELECT query, unnest(range(1, length(query) + 1)) AS i FROM rq)), rcand AS (SELECT query, word AS candidate FROM rqd JOIN dels USING (del) UNION SELECT query, word FROM rq JOIN dels ON dels.del = query)", REAL),
    "editor_stream": sql("SELECT conv_id, pos, array_to_string(w, ' ') AS \"window\" FROM fired", MERGE, WINDOWS),
    "grammar_trigger_score": sql("SELECT l.conv_id, l.pos, coalesce(round(lp, 6), 0) AS logprob FROM line l LEFT JOIN three t ON t.conv_id = l.conv_id AND t.pos = l.pos LEFT JOIN q1 USING (w1, w2, w3)", MERGE, LINES, "three AS (SELECT conv_id, pos, w1, w2, w3 FROM (SELECT conv_id, pos, lag(clean, 2) OVER o AS w1, lag(clean) OVER o AS w2, clean AS w3 FROM line WHERE clean <> '' WINDOW o AS (PARTITION BY conv_id ORDER BY pos)) WHERE w1 IS NOT NULL)", base("three")),
}
#: The event types of the tables; the query finds its labels itself.
ORACLES["confusion_matrix"] = sql("SELECT gold, " + ", ".join(f"count(*) FILTER (pred = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM guess GROUP BY gold", SEQ)
ORACLES["hmm_viterbi"] = sql(
    "SELECT user_id, pos, tag AS pred_tag, round((SELECT max(score) FROM last l WHERE l.user_id = path.user_id), 4) AS best_score FROM path",
    "RECURSIVE " + SEQ.strip(), r"""
emp AS (SELECT t.tag, w.word, ln((coalesce(c, 0) + 1e-4::DOUBLE) / (n + 1e-4::DOUBLE * ((SELECT count(DISTINCT word) FROM seq) + 1))) AS lp FROM (SELECT tag, count(*) AS n FROM seq GROUP BY tag) t CROSS JOIN (SELECT DISTINCT word FROM seq) w LEFT JOIN em ON em.tag = t.tag AND em.word = w.word),
trellis(user_id, pos, tag, score, back) AS (
  SELECT user_id, pos, e.tag, trp.lp + e.lp, NULL::VARCHAR FROM seq s JOIN emp e USING (word) JOIN trp ON trp.prev = '<START>' AND trp.cur = e.tag WHERE pos = 0
  UNION ALL
  SELECT t.user_id, t.pos + 1, e.tag, max(t.score + trp.lp) + any_value(e.lp), arg_min(t.tag, {'s': -(t.score + trp.lp), 't': t.tag}) FROM trellis t JOIN seq s ON s.user_id = t.user_id AND s.pos = t.pos + 1 JOIN emp e ON e.word = s.word JOIN trp ON trp.prev = t.tag AND trp.cur = e.tag GROUP BY t.user_id, t.pos, e.tag
),
last AS (SELECT user_id, pos, tag, score, back FROM (SELECT *, max(pos) OVER (PARTITION BY user_id) AS m FROM trellis) WHERE pos = m),
path(user_id, pos, tag, back) AS (
  SELECT user_id, pos, tag, back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, tag) AS r FROM last) WHERE r = 1
  UNION ALL
  SELECT p.user_id, p.pos - 1, t.tag, t.back FROM path p JOIN trellis t ON t.user_id = p.user_id AND t.pos = p.pos - 1 AND t.tag = p.back
)""",
)
ORACLES["sentence_split_tokens"] = r"""
WITH words AS (SELECT doc_id + 1 AS doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM documents)),
grouped AS (SELECT *, coalesce(sum(regexp_matches(w, '[.!?]')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM words),
sents AS (SELECT doc_id, g, replace(replace(replace(replace(replace(string_agg(w, ' ' ORDER BY i), ' .', '.'), ' ,', ','), ' !', '!'), ' ?', '?'), ' ''', '''') AS text, count(*) FILTER (regexp_replace(w, '[^a-zA-Z0-9]', '', 'g') <> '') AS n FROM grouped GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sent_id, text, n AS n_tokens, 0::BIGINT AS num_merges, 0::BIGINT AS num_spells FROM sents WHERE n > 0 AND text <> ''
UNION ALL SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'the grand jury commented on the election.', 7::BIGINT, 1::BIGINT, 0::BIGINT), (0, 1, 'The mayor accepted the nomination!', 5, 0, 1), (0, 2, 'colorless green ideas sleep furiously', 5, 0, 0))
"""
ORACLES["segment_greedy"] = sql(
    "SELECT s, array_to_string(l, ' ') AS tokens FROM (SELECT s, l, rest FROM walk WHERE rest = '')",
    "RECURSIVE " + ALPHA.strip(), MERGE, r"""
lex AS (SELECT word FROM vocab WHERE length(word) >= 3 OR word IN ('a','i','am','an','as','at','be','by','do','go','he','if','in','is','it','me','my','no','of','on','or','so','to','up','us','we')),
strings AS (SELECT DISTINCT lower(regexp_replace(token, '[^a-zA-Z0-9]', '', 'g')) AS s FROM merged WHERE n_words > 1),
walk(s, l, rest) AS (
  SELECT s, []::VARCHAR[], s FROM strings WHERE s <> ''
  UNION ALL
  SELECT s, l || [left(rest, n)], substr(rest, n + 1) FROM (SELECT w.s, w.l, w.rest, coalesce(max(length(x.word)), 1) AS n FROM (SELECT s, l, rest FROM walk WHERE rest <> '') w LEFT JOIN LATERAL (SELECT left(w.rest, k) AS word FROM range(2, 21) r(k) WHERE k <= length(w.rest) AND left(w.rest, k) IN (SELECT word FROM lex)) x ON true GROUP BY ALL)
)""",
)
ORACLES["spell_accuracy"] = sql(
    f"""SELECT kind, count(*) AS n, round(avg((word = correction)::INT::DOUBLE), 6) AS accuracy FROM (
      SELECT 'nonword' AS kind, e.word, c.correction FROM err e LEFT JOIN vocab v ON v.word = mutated JOIN ({_correct("candb")}) c ON c.query = mutated WHERE v.word IS NULL AND mutated <> e.word
      UNION ALL SELECT 'realword', e.word, coalesce(b.candidate, e.mutated) FROM err e JOIN vocab v ON v.word = mutated LEFT JOIN better b ON b.word = e.mutated AND b.prev IS NULL WHERE mutated <> e.word) GROUP BY kind""",
    ALPHA, _mistake(), "asked AS (SELECT DISTINCT mutated AS query FROM err WHERE mutated <> '')",
    "qdels AS (SELECT DISTINCT query, left(query, i - 1) || substr(query, i + 1) AS del FROM (SELECT query, unnest(range(1, length(query) + 1)) AS i FROM asked)), candb AS (SELECT query, word AS candidate FROM qdels JOIN dels USING (del) UNION SELECT query, word FROM asked JOIN dels ON dels.del = query)",
    "rw AS (SELECT DISTINCT NULL::VARCHAR AS prev, e.mutated AS word FROM err e JOIN vocab v ON v.word = mutated WHERE mutated <> e.word), rcand AS (SELECT * FROM candb)", REAL,
)
ORACLES["model_roundtrip"] = sql("SELECT 'uni' AS \"table\", count(*) AS rows, sum(c)::BIGINT AS total FROM uni UNION ALL SELECT 'bi', count(*), sum(c)::BIGINT FROM bi UNION ALL SELECT 'tri', count(*), sum(c)::BIGINT FROM tri", base())
ORACLES["score_cascade"] = sql(
    """SELECT t.doc_id, t.sent_id, round(CASE WHEN t.doc_id % 3 = 0 THEN len(w) * ln(0.05::DOUBLE / (100 + 0.05::DOUBLE * 45000)) WHEN t.doc_id % 3 = 1 THEN s.total ELSE ng2.lp END, 4) AS bigram_total,
      round(CASE WHEN t.doc_id % 3 = 0 THEN len(w) * ln(0.05::DOUBLE / (50 + 0.05::DOUBLE * 45000)) WHEN t.doc_id % 3 = 1 THEN q1s.total ELSE ng3.lp END, 4) AS trigram_total
    FROM test t JOIN ng2 USING (doc_id, sent_id) JOIN ng3 USING (doc_id, sent_id) JOIN q1s USING (doc_id, sent_id) JOIN q3 s USING (doc_id, sent_id)""",
    base(), ALPHA, """q3 AS (SELECT doc_id, sent_id, sum(ln(greatest(CASE WHEN i = 1 THEN coalesce(v0.n, 0)::DOUBLE / total ELSE (coalesce(sb.c, 0) + 1)::DOUBLE / (coalesce(v1.n, 0) + types) END, 1e-30::DOUBLE))) AS total
      FROM (SELECT doc_id, sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM test) x LEFT JOIN vocab v0 ON v0.word = w[i] LEFT JOIN vocab v1 ON v1.word = w[i - 1] AND i > 1 LEFT JOIN sb ON sb.w1 = w[i - 1] AND sb.w2 = w[i] AND i > 1, vs GROUP BY ALL)""",
)
ORACLES["parsed_verdicts"] = values("sent_id BIGINT, pcfg_result VARCHAR, chosen_method VARCHAR, final_verdict VARCHAR", [(0, "-3.7297", "PCFG", "Grammatical"), (1, "-6.9486", "PCFG", "Grammatical"), (2, "Unparseable", "Bigram LM", "Ungrammatical"), (3, "Unparseable", "Bigram LM", "Ungrammatical"), (4, "Unparseable", "Bigram LM", "Ungrammatical")])
ORACLES["conllu_files"] = values("sent_id BIGINT, words VARCHAR, tags VARCHAR, files BIGINT", [(0, "the cat sat on the mat", "DET-None-None NOUN-Masc-Sing VERB-None-Sing ADP-None-None DET-None-None NOUN-None-Sing", 2), (1, "a b c d", "X-None-None X-Fem-Plur X-None-None X-None-None", 2)])
ORACLES["pcfg_first_trees"] = values("lhs VARCHAR, rhs VARCHAR, c BIGINT, prob DOUBLE", [("S", "NP VP", 2, 1.0), ("NP", "PRP", 2, 0.5), ("NP", "DT NN", 2, 0.5), ("VP", "VB NP", 2, 1.0), ("PRP", "she", 1, 0.5), ("PRP", "her", 1, 0.5), ("VB", "saw", 2, 1.0), ("DT", "the", 2, 1.0), ("NN", "dog", 1, 0.5), ("NN", "man", 1, 0.5)])
