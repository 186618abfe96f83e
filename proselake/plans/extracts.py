"""Registered queries on sources whose prose is masked out of other text, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselake.functions.text import let, word_count
from proselake.operators import detect, registry
from proselake.plans import sql
from proselake.plans.rules_sql import FOUND
from proselake.plans.seeds import seeded
from proselake.sources import html, masking, offsets
from proselake.sources.readers import spread, table

# Frames that both engines put around a document's text, whose own line ends and marks become spaces.
CODE = [
    ("py", "x = 'no # {}' # yes {}\n# more\ny = \"\"\n"),
    ("sql", "SELECT '-- no' -- yes {}\n/* a {} */ FROM t --"),
    ("vue", "<b>no {}</b><!-- yes {} -->'<!-- no -->'"),
    ("ts", "/**\n * Doc {}\n * more */\nconst a = \"// no\"; // yes {}\nconst t = `one two ${{no}}\nthree four five {}`; `no`"),
    ("c", "char *s = \"a\\\"// no\"; /* open {}"),
]
PAGES = [
    "---\ntitle: no\n---\n# One {}\ntext `code {}` and [link](http://no) ![alt](x)\n## Two\n- item {}\n",
    "Plain {}\n```py\n# no {}\n```\n    indented\n> quoted {}\n### Deep ##\n1. one <b>bold</b>\n# Top\n~~~\nopen",
    "\"Said so\"[^1] and {} [^1]\n## A\n### B\n## C {}\n#### D\n# E\n",
]


def _framed(spark, sf_dir, frames):
    d = spread(table(spark, sf_dir, "documents"))
    n = len(frames)
    head = F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r`'\"{}<>\\[\\]*#]", " ")
    pick = F.element_at(F.array(*(F.lit(f.replace("{{", "\x01").replace("}}", "\x02")) for f in frames)), (F.col("doc_id") % n + 1).cast("int"))
    body = F.replace(F.replace(F.replace(pick, F.lit("{}"), head), F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
    return d.select("doc_id", (F.col("doc_id") % n).cast("int").alias("k"), body.alias("text"))


def comment_prose(spark, sf_dir):
    d = _framed(spark, sf_dir, [f for _, f in CODE])
    ext = F.element_at(F.array(*(F.lit(e) for e, _ in CODE)), F.col("k") + 1)
    c = masking.comments(F.col("text"), ext)
    return d.select("doc_id", c.alias("prose"), (F.length(c) == F.length("text")).alias("aligned"))


def markdown_prose(spark, sf_dir):
    x = let(masking.markdown(F.col("text")), lambda m: F.struct(m.alias("prose"), (F.length(m) == F.length("text")).alias("aligned")))
    return _framed(spark, sf_dir, PAGES).select("doc_id", x.alias("x")).select("doc_id", "x.*")


def markdown_headings(spark, sf_dir):
    h = masking.headings(_framed(spark, sf_dir, PAGES))
    return h.select("doc_id", F.col("start").alias("start_at"), "depth", "title", F.col("end").alias("end_at"), "parent")


def page_prose(spark, sf_dir):
    t = html.html_text(F.concat(F.lit("<p title='a>b'>&#8220;x&#x201D; &amp;c; &hellip;<br/>"), "html", F.lit("<script>open {")))
    return table(spark, sf_dir, "pages").select("page_id", word_count(t).cast("long").alias("n_words"), F.md5(t.cast("binary")).alias("text_md5"))


def configured_findings(spark, sf_dir):
    """Findings of two packs, some rules raised or switched off by a later layer."""
    config = registry.layered(registry.preset("craft", "reader-first"), registry.Config({"verdict-word": "error", "hedge-phrase": "off", "emoji": "warn"}, "warn"))
    f = registry.configured(detect.finding_rows(seeded(spark, sf_dir)), config)
    return f.select("doc_id", "rule", F.col("start").cast("long").alias("start_at"), "severity")


#: Prose that pages lack, in front of them: tags and entities inside of what is found.
PAGE_LEAD = "<p title='a>b'>Sorr&#121;, it is &mdash; we know &mdash; the <b>fast</b>est.<br>Every<i>one</i> al&#x77;ays waits &amp; &hellip; apologies.<script>sorry</script> Full <em>disclosure</em>: it never ends.</p>"


def page_findings(spark, sf_dir):
    """Findings on pages, each with the part of the raw page that it came from."""
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", F.concat(F.lit(PAGE_LEAD), F.coalesce("html", F.lit(""))).alias("html"))
    docs = pages.select(F.col("page_id").alias("doc_id"), "html", offsets.rendered(F.col("html")).alias("r")).select("doc_id", "html", "r.text", "r.pieces")
    f = detect.findings(docs)
    f = f.withColumn("spans", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    # The spans are a column of their own before a Python function takes them.
    f = f.select("doc_id", "html", "text", "found", "pieces", F.explode(F.array("spans")).alias("spans"))
    f = f.select("doc_id", "html", "text", "found", offsets.source_spans(F.col("pieces"), F.length("text"), F.col("spans")).alias("at"))
    f = f.select("doc_id", "html", "text", F.explode(F.arrays_zip("found", "at")).alias("z"))
    cut = lambda t, s: F.substring(t, s["start"] + 1, s["end"] - s["start"])
    return f.select(F.col("doc_id").alias("page_id"), F.col("z.found.rule").alias("rule"), F.col("z.at.start").cast("long").alias("start_at"), F.col("z.at.end").cast("long").alias("end_at"), cut(F.col("text"), F.col("z.found")).alias("match"), cut(F.col("html"), F.col("z.at")).alias("source"))


def rule_catalogue(spark, sf_dir):
    return registry.catalogue(spark)


QUERIES = [comment_prose, markdown_prose, markdown_headings, page_prose, page_findings, configured_findings, rule_catalogue]


def _frames(frames) -> str:
    pick = "CASE doc_id % " + str(len(frames)) + " " + " ".join(f"WHEN {i} THEN {sql.q(f.replace('{{', chr(1)).replace('}}', chr(2)))}" for i, f in enumerate(frames)) + " END"
    head = "regexp_replace(coalesce(text, ''), '[\n\r`''\"{}<>\\[\\]*#]', ' ', 'g')"
    return f"framed AS (SELECT doc_id, doc_id % {len(frames)} AS k, replace(replace(replace({pick}, '{{}}', {head}), chr(1), '{{'), chr(2), '}}') AS text FROM documents)"


def _blank(x: str) -> str:
    return f"regexp_replace({x}, '[^\\n\\r]', ' ', 'g')"


def _rebuilt(x: str, pattern: str, hit: str, gap: str, name: str) -> str:
    """hit and gap are SQL on the lambda's h and g."""
    return f"list_aggregate(list_transform(list_zip(string_split_regex({x}, {sql.q(pattern)}), list_append(regexp_extract_all({x}, {sql.q(pattern)}), '')), lambda {name}: {gap.replace('@', name + '[1]')} || {hit.replace('@', name + '[2]')}), 'string_agg', '')"


def _comment_sql(pattern: str) -> str:
    template = f"replace({_rebuilt('@', chr(92) + '$' + chr(92) + '{[^}]*' + chr(92) + '}', _blank('@'), '@', 'y')}, '`', ' ')".replace("y[2]", "y[2]")
    block = "(CASE WHEN starts_with(@, '<!--') THEN '    ' ELSE '  ' END) || regexp_replace(regexp_replace(regexp_replace(@, '^(?:/\\*|<!--)', ''), '(?:\\*/|-->)\\z', ''), '(\\n[ \\t]*)\\*', '\\1 ', 'g') || (CASE WHEN @ LIKE '%-->' THEN '   ' WHEN @ LIKE '%*/' THEN '  ' ELSE '' END)"
    hit = f"(CASE WHEN @ = '' THEN '' WHEN regexp_matches(@, '^(?:/\\*|<!--)') THEN {block} WHEN regexp_matches(@, '^(?://|#|--)') THEN (CASE WHEN starts_with(@, '#') THEN ' ' ELSE '  ' END) || regexp_replace(@, '^(?://|#|--)', '') WHEN starts_with(@, '`') AND contains(@, chr(10)) AND {sql.words('@')} >= 5 THEN {template} ELSE {_blank('@')} END)"
    return _rebuilt("text", pattern, hit, _blank("@"), "x").replace("string_split_regex(x[2]", "string_split_regex(x[2]")


def oracle_sql() -> dict[str, str]:
    md = "text"
    keep = lambda p: _rebuilt(md, p, _blank("@"), "@", "x")
    steps = ["text0 AS (SELECT doc_id, text, text AS raw FROM framed)"]
    forms = [keep(masking.FRONTMATTER), keep(masking.FENCE), keep(masking.INDENTED), "regexp_replace(text, '(?m)^([ \\t]*(?:[-+*]|\\d+[.)])) ', '\\1' || chr(8233), 'g')", *(keep(p) for p in masking.MARKS[:3])]
    forms.append(_rebuilt(md, masking.LINK, "(CASE WHEN @ = '' THEN '' ELSE ']' || repeat(' ', length(@) - 1) END)", "@", "x"))
    forms += [keep(p) for p in masking.MARKS[3:]]
    for i, f in enumerate(forms):
        steps.append(f"text{i + 1} AS (SELECT doc_id, {f} AS text, raw FROM text{i})")
    page = f"regexp_replace('<p title=''a>b''>&#8220;x&#x201D; &amp;c; &hellip;<br/>' || html || '<script>open {{', {sql.q(html.COMMENT)}, '', 'g')"
    for tag in html.HIDDEN:
        page = f"regexp_replace({page}, {sql.q(html.hidden(tag))}, chr(2), 'g')"
    page = f"regexp_replace({page}, {sql.q('(?i)</?(?:' + '|'.join(html.BLOCKS) + ')' + html.REST)}, chr(3), 'g')"
    page = f"regexp_replace(regexp_replace({page}, {sql.q('(?i)<br' + html.REST)}, chr(10), 'g'), {sql.q(html.TAG)}, chr(2), 'g')"
    page = f"regexp_replace(regexp_replace({page}, '^[\\x02\\x03]+', ''), '(\\n?)\\x02*\\x03[\\x02\\x03]*', '\\1' || chr(10) || chr(10), 'g')"
    page = f"regexp_replace(regexp_replace({page}, '(\\s)\\x02+', '\\1', 'g'), '\\x02+', ' ', 'g')"
    named = "CASE substr(@, 2, length(@) - 2) " + " ".join(f"WHEN '{k}' THEN {sql.q(v)}" for k, v in html.ENTITIES.items()) + " ELSE @ END"
    decoded = f"(CASE WHEN @ = '' THEN '' WHEN @ LIKE '&#x%' OR @ LIKE '&#X%' THEN chr(CAST('0x' || substr(@, 4, length(@) - 4) AS INTEGER)) WHEN @ LIKE '&#%' THEN chr(CAST(substr(@, 3, length(@) - 3) AS INTEGER)) ELSE {named} END)"
    packs = ", ".join(f"('{p}', '{r}', '{detect.CATEGORY[r]}', {float(registry.WEIGHT.get(detect.CATEGORY[r], 1))}::DOUBLE, '{detect.SEVERITY.get(r, 'auto')}')" for p, rules in registry.PACKS.items() for r in rules)
    on = ", ".join(f"'{r}'" for p in ("craft", "reader-first") for r in registry.PACKS[p])
    comments = "CASE k " + " ".join(f"WHEN {i} THEN {_comment_sql({'py': masking.HASH, 'sql': masking.DASH, 'vue': masking.MARKUP}.get(e, masking.C_STYLE))}" for i, (e, _) in enumerate(CODE)) + " END"
    return {
        "comment_prose": f"WITH {_frames([f for _, f in CODE])}, c AS (SELECT doc_id, text, {comments} AS prose FROM framed) SELECT doc_id, prose, length(prose) = length(text) AS aligned FROM c",
        "markdown_prose": f"WITH {_frames(PAGES)}, {', '.join(steps)} SELECT doc_id, text AS prose, length(text) = length(raw) AS aligned FROM text{len(forms)}",
        "markdown_headings": f"""WITH {_frames(PAGES)}, text0 AS (SELECT doc_id, text, length(text) AS size FROM framed), text1 AS (SELECT doc_id, size, {keep(masking.FRONTMATTER)} AS text FROM text0), text2 AS (SELECT doc_id, size, {keep(masking.FENCE)} AS text FROM text1),
            l AS (SELECT doc_id, size, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM text2), o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM l),
            h AS (SELECT doc_id, size, a, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]+\\S', 1)) AS depth, regexp_extract(line, '^ {{0,3}}#{{1,6}}[ \\t]+(.*?)[ \\t]*#*[ \\t\\r]*$', 1) AS title FROM o WHERE regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \\t]+\\S'))
            SELECT h.doc_id, h.a AS start_at, h.depth, h.title, coalesce((SELECT min(x.a) FROM h x WHERE x.doc_id = h.doc_id AND x.a > h.a AND x.depth <= h.depth), h.size) AS end_at, (SELECT max(x.a) FROM h x WHERE x.doc_id = h.doc_id AND x.a < h.a AND x.depth < h.depth) AS parent FROM h""",
        "page_prose": f"SELECT page_id, {sql.words('t')} AS n_words, md5(t) AS text_md5 FROM (SELECT page_id, {_rebuilt('o', html.ENTITY, decoded, '@', 'x')} AS t FROM (SELECT page_id, {page} AS o FROM pages))",
        "configured_findings": f"WITH {FOUND}, c AS (SELECT doc_id, rule, start_at, CASE rule WHEN 'verdict-word' THEN 'error' WHEN 'emoji' THEN 'warn' ELSE severity END AS severity FROM found WHERE rule <> 'hedge-phrase' AND rule IN ('emoji', {on})) SELECT * FROM c WHERE severity IN ('warn', 'error')",
        "rule_catalogue": f"SELECT * FROM (VALUES {packs}) v(pack, rule, category, weight, severity)",
    }
