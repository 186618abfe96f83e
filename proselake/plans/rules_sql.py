"""DuckDB SQL for every detector that needs no parse."""

from __future__ import annotations

from proselake.functions import lexicons as lex
from proselake.functions.text import WORD, phrases
from proselake.operators import detect as d
from proselake.plans.sql import FOLDED, SEEDED, hits, paragraphs, q, sentences, words

_I = "(?i)"


def _lexicon(rule: str, lexicon: list[str], confidence: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule, start_at, end_at, '{confidence}' AS confidence FROM ({hits(_I + chr(92) + 'b(?:' + phrases(lexicon) + ')' + chr(92) + 'b', FOLDED)})"


def _plain(rule: str, pattern: str, confidence: str, x: str = "text") -> str:
    return f"SELECT doc_id, '{rule}' AS rule, start_at, end_at, {confidence} AS confidence FROM ({hits(pattern, x)})"


def _stacked(rule: str, pattern: str) -> str:
    return _plain(rule, _I + pattern, "CASE WHEN count(*) OVER (PARTITION BY doc_id) >= 3 THEN 'medium' ELSE 'low' END")


def _words(rule: str, lexicon: list[str], confidence: str) -> str:
    return _plain(rule, _I + r"\b(?:" + "|".join(lexicon) + r")\b", q(confidence))


def _tokens(x: str) -> str:
    """Syntactic words with a letter or digit."""
    word = r"(?:https?://|www\.)[^\s]+|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|\p{N}+(?:[.,:]\p{N}+)*"
    return f"(len(list_filter(regexp_extract_all({x}, {q(word)}), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) + len(list_filter(regexp_extract_all({x}, {q(word)}), lambda w: regexp_matches(w, '(?i)^(cannot|.+(n[''’]t|[''’](s|re|ve|ll|d|m)))$') AND NOT regexp_matches(w, '^(https?://|www\\.)'))))"


_CONTENT = f"len(list_filter(regexp_extract_all(lower(text), {{}}), lambda w: NOT list_contains([{', '.join(q(w) for w in d.STOP_WORDS)}], w)))"
_VOCAB = f"""vocab AS (SELECT h.doc_id, h.start_at, h.end_at FROM ({hits(_I + chr(92) + 'b(?:' + phrases(lex.AI_WORDS) + ')' + chr(92) + 'b', FOLDED, also="text")}) h LEFT JOIN sents s ON h.doc_id = s.doc_id AND h.start_at >= s.start_at AND h.start_at < s.end_at
    WHERE NOT coalesce(regexp_matches(s.text, {q(_I + d.DISCUSSED)}), FALSE) AND NOT (lower(h.word) = 'harness' AND NOT regexp_matches(substr(h.text, h.end_at + 1), '(?i)^\\s+(?:the|an?|its|their|your|our|this|these|that|those|more|new|both)(?:[^\\p{{L}}\\p{{N}}]|$)'))),
vocab_graded AS (SELECT v.*, CASE WHEN count(*) OVER (PARTITION BY doc_id) >= 4 AND count(*) OVER (PARTITION BY doc_id) * 100 >= 1.5 * greatest(n, 1) THEN 'medium' ELSE 'low' END AS confidence FROM vocab v JOIN (SELECT doc_id, {_CONTENT.format(q(WORD))} AS n FROM seeded SEMI JOIN vocab USING (doc_id)) USING (doc_id))"""
_OPENERS = "|".join(w.replace("’", "'") for w in sorted(dict.fromkeys(lex.OPENERS), key=lambda w: -len(w)))
_OPEN = f"""opening AS (SELECT doc_id, i, ph, start_at + instr(low, ph) - 1 AS start_at FROM (SELECT *, regexp_extract(low, {q("^[" + chr(92) + "s" + chr(34) + "'(" + chr(92) + "[]*(" + _OPENERS + ")(?:[" + chr(92) + "s,.:;]|$)")}, 1) AS ph
    FROM (SELECT doc_id, i, start_at, lower(translate(text, '‘’‛“”', '''''''""')) AS low FROM sents)) WHERE ph <> ''),
open_graded AS (SELECT o.*, CASE WHEN max(same) OVER w >= 3 OR max(near) OVER w >= 3 OR (count(*) OVER w >= 5 AND count(*) OVER w >= 0.15 * k) THEN 'medium' ELSE 'low' END AS confidence FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, ph) AS same, count(*) OVER (PARTITION BY doc_id ORDER BY i RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS near FROM opening) o
    JOIN (SELECT doc_id, count(*) AS k FROM sents GROUP BY doc_id) USING (doc_id) WINDOW w AS (PARTITION BY doc_id))"""
_DASH = """dashes AS (SELECT doc_id, max(w) AS w, count(*) AS k FROM (SELECT doc_id, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w
    FROM (SELECT doc_id, i, length(text) - length(replace(text, '—', '')) AS n FROM sents)) GROUP BY doc_id)"""
_QUOTES = f"""quoted AS (SELECT *, count(*) FILTER (word <> '"') OVER w AS curly, count(*) FILTER (word = '"') OVER w AS plain FROM ({hits('[“”"]')}) WINDOW w AS (PARTITION BY doc_id))"""
_LEAD = "^[\"'“‘(]*\\s*"
_SEESAW = f"""seesaw AS (SELECT doc_id, start_at + length(regexp_extract(text, {q(f"(?i)({_LEAD})(?:{d.CONCESSIVE}|{d.PIVOT})" + chr(92) + "b")}, 1)) AS start_at, wd FROM (
    SELECT *, regexp_extract(text, {q(f"(?i){_LEAD}({d.CONCESSIVE}|{d.PIVOT})" + chr(92) + "b")}, 1) AS wd FROM sents) WHERE wd <> ''), seesaw_words AS (SELECT doc_id, greatest({_tokens("text")}, 1) AS n_tokens FROM seeded)"""
# This dialect has neither lookahead nor lookbehind: the words before and after are tested apart.
_CERTAIN = d.CERTAINTY.replace(r"clearly(?=\s*(?:,|this\b|that\b|the\b|it\b|we\b|you\b|they\b))", "clearly")
_CERTAINTY = f"""certain_raw AS (SELECT h.* FROM ({hits(_I + _CERTAIN, also="text")}) h WHERE NOT regexp_matches(word, '(?i)^clearly$') OR (regexp_matches(substr(text, end_at + 1), '(?i)^\\s*(?:,|this\\b|that\\b|the\\b|it\\b|we\\b|you\\b|they\\b)')
    AND NOT regexp_matches(substr(text, greatest(start_at - 12, 0) + 1, least(start_at, 12)), '(?i)(?:{"|".join(d.CLEARLY_AFTER)})$'))),
certain AS (SELECT c.doc_id, c.start_at, c.end_at, s.i FROM certain_raw c JOIN sents s ON c.doc_id = s.doc_id AND c.start_at >= s.start_at AND c.start_at < s.end_at),
certain_open AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id ORDER BY i RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM certain) WHERE n >= 3)"""
_TAIL = f"""tails AS (SELECT doc_id, CAST(floor(length(text) * 0.65) AS BIGINT) AS pos0, substr(text, CAST(floor(length(text) * 0.65) AS BIGINT) + 1) AS text FROM seeded),
tail_hits AS (SELECT *, 1 AS kind FROM ({hits(_I + d.CHALLENGE, src="tails", also="pos0")}) UNION ALL SELECT *, 2 FROM ({hits(_I + d.FUTURE, src="tails", also="pos0")})),
tail_first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, start_at) AS n, count(DISTINCT kind) OVER (PARTITION BY doc_id) AS kinds FROM tail_hits)"""
_ABSOLUTE = f"""abs_raw AS ({hits(_I + d.ABSOLUTE, src="pars", also="i, text, start_at AS p_start").replace("SELECT doc_id, i, text, start_at AS p_start, CAST(a AS BIGINT)", "SELECT doc_id, i, text, p_start, CAST(a AS BIGINT)")}),
abs_said AS (SELECT a.*, regexp_matches(word, {q(_I + "^" + d.STRONG_ABSOLUTE + "$")}) AND NOT contains(s.text, '?') AND NOT regexp_matches(substr(a.text, greatest(a.start_at - 18, 0) + 1, least(a.start_at, 18)), '(?i)\\b(?:not|isn''t|wasn''t|aren''t|weren''t|hardly)\\s*$')
    AND NOT regexp_matches(s.text, '(?i)^\\s*(?:if|unless|whether)\\b') AS strong FROM abs_raw a JOIN sents s ON a.doc_id = s.doc_id AND a.p_start + a.start_at >= s.start_at AND a.p_start + a.start_at < s.end_at)"""
_NEGATIVE = f"""negative AS (SELECT *, lag(neg, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT *, regexp_matches(text, {q(_I + d.NEGATIVE_OPEN)}) AS neg FROM sents))"""
_ECHO = f"""echo_raw AS (SELECT h.doc_id, h.start_at, h.end_at, lower(h.word) AS word, s.i AS sent FROM ({hits(_I + chr(92) + "b(?:" + "|".join(d.EVALUATIVE) + ")" + chr(92) + "b")}) h JOIN sents s ON h.doc_id = s.doc_id AND h.start_at >= s.start_at AND h.start_at < s.end_at),
echo AS (SELECT *, row_number() OVER w AS n, first_value(sent) OVER w AS first_sent FROM echo_raw WINDOW w AS (PARTITION BY doc_id, word ORDER BY start_at))"""
_HEDGE = f"""hedge AS (SELECT doc_id, s_start + start_at AS start_at, s_start + end_at AS end_at FROM ({hits(chr(92) + "b(?:" + "|".join(h.replace(" ", " +") for h in d.HEDGES) + ")" + chr(92) + "b", "lower(text)", "hedge_src", "s_start")})
    UNION ALL SELECT doc_id, s_start + length(lead), s_start + length(lead) + length(f) FROM (SELECT *, regexp_extract(text, '(?i)^({d.HEDGE_LEAD.replace("'", "''")})(?:{"|".join(d.HEDGES_FIRST)})(?:[^A-Za-z0-9_''’]|$)', 1) AS lead,
    regexp_extract(text, '(?i)^{d.HEDGE_LEAD.replace("'", "''")}({"|".join(d.HEDGES_FIRST)})(?:[^A-Za-z0-9_''’]|$)', 1) AS f FROM hedge_src) WHERE f <> '')"""
_INITIAL = f"""initial AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY start_at) AS n, count(*) OVER (PARTITION BY doc_id, word) AS k FROM ({hits(d.INITIALISM, also="text")})
    WHERE word NOT IN ({", ".join(q(w) for w in d.EXEMPT)}) AND NOT regexp_matches(text, '(?:[A-Za-z][A-Za-z -]{{3,80}})\\s*\\(' || word || '\\)|' || word || '\\s*\\([A-Za-z][A-Za-z -]{{3,80}}\\)'))"""
_LISTS = f"""rows_of AS (SELECT doc_id, n, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos0, NOT regexp_matches(line, '\\S') AS blank
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM seeded)),
blocks AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY doc_id ORDER BY n) AS block, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS earlier, lag(blank, 1, TRUE) OVER (PARTITION BY doc_id ORDER BY n) AS after_blank, regexp_matches(line, {q(d.LIST_MARKER)}) AS mark FROM rows_of),
listed AS (SELECT *, coalesce(count(*) FILTER (mark) OVER (PARTITION BY doc_id, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS marks FROM blocks WHERE NOT blank)"""
_LOAD = f"""heavy AS (SELECT p.doc_id, p.start_at, p.end_at FROM pars p JOIN sents s ON p.doc_id = s.doc_id AND s.end_at > p.start_at AND s.start_at < p.end_at WHERE {words("p.text")} >= 130 GROUP BY ALL HAVING count(*) >= 7)"""

def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


_PILE = f"""pile AS (SELECT doc_id, start_at, end_at, {words("text")} AS n, regexp_replace(text, {q(d.INLINE_CODE)}, ' ', 'g') AS m, coalesce(list_sum(list_transform(regexp_extract_all(text, {q(d.INLINE_CODE)}), lambda c: greatest(1, {_n("c", d.IDENTIFIER)}))), 0) AS inl,
    list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS ls, contains(text, chr(8233)) AS sep FROM pars),
piled AS (SELECT *, inl + {_n("m", d.IDENTIFIER)} AS r, {_n("m", d.QUALIFIER)} AS ql, {_n("m", d.PROCESS_QUALIFIER)} AS pq, {_n("m", d.INTERNAL_LABEL)} AS lb, {_n("m", d.ABSTRACT_PROCESS)} AS ab,
    {_n("m", r"\([^()\n]{1,180}\)")} + {_n("m", "[—;]")} + {_n("m", r":(?:\s|$)")} + {_n("m", ",")} // 2 AS br FROM pile WHERE n >= 28 AND NOT sep AND NOT (len(ls) >= 2 AND len(list_filter(ls, lambda x: regexp_matches(x, {q(d.STRUCTURED_LINE)}))) >= 0.75 * len(ls)))"""
_STEM = "CASE WHEN length(w) > 6 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 5 AND (w LIKE '%ed' OR w LIKE '%es') THEN w[:-3] WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END"
_STEMS = f"""list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(lower(text), {q("[a-z][a-z'-]{2,}")}), lambda w: regexp_replace(w, {q("'(?:s|re|ve|ll|d|m)$")}, '')), lambda w: {_STEM}), lambda w: NOT list_contains([{", ".join(q(w) for w in d.STOP_WORDS)}], w)))"""
_LINES = "list_filter(string_split_regex({}, '\\r?\\n'), lambda x: trim(x) <> '')"
_STEPS = f"(len({{0}}) >= 3 AND len(list_filter({{0}}, lambda x: regexp_matches(x, {q(d.STEP_LINE)}))) >= 0.6 * len({{0}}))"
_MEANT = f"""regexp_matches(text, {q(d.NEGATION)}) AS neg, regexp_matches(text, {q(d.SUPPORT)}) OR regexp_matches(text, '[0-9]') OR regexp_matches(text, {q(d.NUMBER)}) AS sup, regexp_matches(text, {q(d.MECHANISM)}) AS mech"""
_PAIRED = "len(list_intersect(a.ws, b.ws)) AS shared, len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) AS sim, len(a.ws) - len(list_intersect(a.ws, b.ws)) AS novel"
_AGAIN = f"""ps AS (SELECT p.doc_id, p.i AS par, {_LINES.format("p.text")} AS ls, s.start_at, s.end_at, s.text, row_number() OVER (PARTITION BY p.doc_id, p.i ORDER BY s.i) - 1 AS k, count(*) OVER (PARTITION BY p.doc_id, p.i) AS n FROM pars p JOIN sents s ON s.doc_id = p.doc_id AND s.end_at > p.start_at AND s.start_at < p.end_at),
pw AS (SELECT *, {_STEMS} AS ws, {_MEANT} FROM ps WHERE n >= 3 AND NOT {_STEPS.format("ls")}),
pb AS (SELECT * FROM (SELECT a.doc_id, a.start_at, a.end_at, a.neg, a.sup, a.mech, b.neg AS bneg, {_PAIRED}, b.k AS bk FROM pw a JOIN pw b ON a.doc_id = b.doc_id AND a.par = b.par AND b.k BETWEEN a.k - 4 AND a.k - 2 WHERE len(a.ws) >= 5 AND len(b.ws) >= 5)
    WHERE shared >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id, start_at ORDER BY sim DESC, bk) = 1),
qw AS (SELECT doc_id, i, start_at, end_at, {_STEMS} AS ws, {_MEANT}, {_STEPS.format("ls")} AS st FROM (SELECT *, {_LINES.format("text")} AS ls FROM pars)),
qb AS (SELECT * FROM (SELECT a.doc_id, a.start_at, a.end_at, a.neg, a.sup, a.mech, a.st AND b.st AS recipe, b.neg AS bneg, {_PAIRED}, b.i AS bk FROM qw a JOIN qw b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 4 AND a.i - 1 WHERE len(a.ws) >= 6 AND len(b.ws) >= 6)
    WHERE shared >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id, start_at ORDER BY sim DESC, bk) = 1)"""

#: CTEs up to every(doc_id, rule, start_at, end_at, confidence).
EVERY = f"""{SEEDED}, {sentences()}, {paragraphs()}, hedge_src AS (SELECT doc_id, text, start_at AS s_start FROM sents), {_VOCAB}, {_OPEN}, {_DASH}, {_QUOTES}, {_SEESAW}, {_CERTAINTY}, {_TAIL}, {_ABSOLUTE}, {_NEGATIVE}, {_ECHO}, {_HEDGE}, {_INITIAL}, {_LISTS}, {_LOAD}, {_PILE}, {_AGAIN},
every AS ({_lexicon("significance-idioms", lex.SIGNIFICANCE, "medium")} UNION ALL {_lexicon("promo-idioms", lex.PROMOTION, "medium")} UNION ALL {_lexicon("chatbot-idioms", lex.CHATBOT, "high")} UNION ALL {_lexicon("vague-attribution", lex.VAGUE_SOURCES, "low")}
UNION ALL SELECT h.doc_id, 'emerging-slop-phrases', h.start_at, h.end_at, 'low' FROM ({hits(_I + chr(92) + "b(?:" + phrases(lex.EMERGING) + ")" + chr(92) + "b", FOLDED)}) h LEFT JOIN sents s ON h.doc_id = s.doc_id AND h.start_at >= s.start_at AND h.start_at < s.end_at
    WHERE NOT (lower(h.word) LIKE 'load%' AND coalesce(regexp_matches(s.text, {q(_I + d.LITERAL_LOAD)}), FALSE))
UNION ALL {_plain("performed-candor", _I + d.CANDOR, "'medium'")} UNION ALL {_plain("generation-artifacts", d.ARTIFACT, "'high'")} UNION ALL {_plain("emoji", d.EMOJI, "'low'")}
UNION ALL {_plain("unsupported-comparison", _I + d.COMPARISON, f"CASE WHEN regexp_matches(word, {q(_I + d.STRONG_COMPARISON)}) THEN 'medium' ELSE 'low' END")}
UNION ALL {_words("apology-reflex", d.APOLOGY, "medium")} UNION ALL {_words("verdict-word", d.VERDICT, "medium")} UNION ALL {_plain("parenthetical-hedge", _I + d.PAREN_HEDGE, "'medium'")}
UNION ALL SELECT doc_id, 'ai-vocabulary', start_at, end_at, confidence FROM vocab_graded
UNION ALL SELECT doc_id, 'opening-conjunction', start_at, start_at + length(ph), confidence FROM open_graded
UNION ALL SELECT doc_id, 'em-dash-overuse', instr(text, '—') - 1, instr(text, '—'), CASE WHEN w >= 4 OR (n >= 12 AND n * 12 >= k) THEN 'medium' ELSE 'low' END FROM (SELECT *, length(text) - length(replace(text, '—', '')) AS n FROM seeded) JOIN dashes USING (doc_id) WHERE n > 0
UNION ALL SELECT doc_id, 'mixed-quotes', start_at, end_at, 'medium' FROM quoted WHERE curly >= 2 AND plain >= 2 AND (word <> '"') = (curly <= plain)
UNION ALL SELECT doc_id, 'hedging-seesaw', start_at, start_at + length(wd), 'low' FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM seesaw) JOIN seesaw_words USING (doc_id) WHERE n >= 3 AND n * 100 >= 0.8 * n_tokens
UNION ALL {_stacked("rhetorical-scaffolding", d.SCAFFOLD)} UNION ALL {_stacked("vague-declarative", d.DECLARATIVE)} UNION ALL {_stacked("vague-quantifier", d.QUANTIFIER)}
UNION ALL SELECT doc_id, 'unsupported-certainty', start_at, end_at, CASE WHEN EXISTS (SELECT 1 FROM certain_open o WHERE o.doc_id = c.doc_id AND o.i <= c.i AND c.i <= o.i + 7) THEN 'medium' ELSE 'low' END FROM certain c
UNION ALL SELECT doc_id, 'outline-conclusion', pos0 + start_at, pos0 + end_at, CASE WHEN kinds = 2 THEN 'medium' ELSE 'low' END FROM tail_first WHERE n = 1
UNION ALL SELECT doc_id, 'absolute-claim', p_start + start_at, p_start + end_at, CASE WHEN count(*) FILTER (strong) OVER (PARTITION BY doc_id, i) >= 3 THEN 'medium' ELSE 'low' END FROM abs_said
UNION ALL SELECT doc_id, 'modal-redundancy', start_at + lead, start_at + lead + size, 'medium' FROM (SELECT *, length(regexp_extract(word, '(?is)^(.*;\\s*both\\s+)will\\s+[a-z]+$', 1)) AS lead, length(regexp_extract(word, '(?is);\\s*both\\s+(will\\s+)[a-z]+$', 1)) AS size FROM ({hits(_I + d.MODAL)}))
UNION ALL SELECT doc_id, 'negative-list-buildup', start_at, end_at, 'medium' FROM negative WHERE neg AND before
UNION ALL SELECT doc_id, 'verdict-echo', start_at, end_at, 'medium' FROM echo JOIN seesaw_words USING (doc_id) WHERE n > 1 AND (n_tokens <= 80 OR sent = first_sent)
UNION ALL SELECT doc_id, 'hedge-phrase', start_at, end_at, 'medium' FROM hedge UNION ALL SELECT doc_id, 'unexplained-initialism', start_at, end_at, 'medium' FROM initial WHERE n = 1 AND k >= 2
UNION ALL SELECT doc_id, 'list-without-break', pos0 + length(line) - length(regexp_replace(line, '^\\s+', '')), pos0 + length(regexp_replace(line, '\\s+$', '')), 'low' FROM listed WHERE mark AND NOT after_blank AND marks = 0 AND regexp_matches(earlier, {q(d.FINISHED)})
UNION ALL SELECT doc_id, 'paragraph-load', start_at, end_at, 'medium' FROM heavy
UNION ALL SELECT doc_id, 'implementation-detail-pileup', start_at, end_at, 'medium' FROM piled WHERE (br >= 3 AND ((r >= 4 AND ql >= 2) OR (r >= 3 AND ql >= 4))) OR (n >= 55 AND pq >= 7 AND br >= 4 AND (lb BETWEEN 2 AND 8 OR ab >= 2))
UNION ALL SELECT doc_id, 'semantic-redundancy', start_at, end_at, CASE WHEN sim >= 0.68 AND novel <= 3 THEN 'medium' ELSE 'low' END FROM pb WHERE sim >= 0.6 AND neg = bneg AND NOT sup AND NOT (mech AND novel >= 4)
UNION ALL SELECT doc_id, 'semantic-redundancy', start_at, end_at, CASE WHEN sim >= 0.68 AND NOT recipe THEN 'medium' ELSE 'low' END FROM qb WHERE sim >= 0.48 AND neg = bneg AND (recipe OR (NOT sup AND NOT (mech AND novel >= 4))))"""
_OWN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.SEVERITY.items())
#: CTEs up to found: distinct findings with severity.
FOUND = f"""{EVERY}, found AS (SELECT DISTINCT doc_id, rule, CAST(start_at AS BIGINT) AS start_at, CAST(end_at AS BIGINT) AS end_at, confidence, CASE rule {_OWN} ELSE CASE confidence WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warn' ELSE 'info' END END AS severity FROM every)"""
