"""Detectors that need no parse, as array expressions over one document.

One pass over a text finds its sentences, paragraphs and the places that the detectors' patterns match; every
detector then maps these few places to an array of findings.  All arrays of a document are joined,
deduplicated and ordered inside its row, so one scan without any shuffle gives the findings of a corpus.
Places come in order with the ordinals of their sentence and paragraph, so detectors look at neighbours by
index, never at all other places of a text: their cost grows with the text's length.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions import lexicons as lex
from proselake.functions.places import Alike, Patterns, places
from proselake.functions.text import filled, java, let, phrase_tree, straight_quotes, token_count, word_array, word_count

FOUND = "array<struct<rule:string,start:int,end:int,confidence:string>>"
RANK = {"off": 0, "info": 1, "warn": 2, "error": 3}

# Patterns of the detectors.
CANDOR = r"\b(?:to be (?:fully |completely |totally |perfectly )?(?:transparent|candid|blunt|upfront|honest with you)|i (?:want|wanted) to be (?:transparent|honest|candid|direct|upfront)|i(?:'|’)ll be honest|let me be (?:clear|direct|blunt|honest|candid)|full disclosure|in the spirit of (?:transparency|candor|candour|honesty)|put (?:that|this|it|my cards) on the table|i(?: would|(?:'|’)d) rather (?:say|state|name) (?:that|this|it) (?:plainly|directly|outright)|(?:rather )?than have you guess|i want to (?:name|be explicit about)|not going to sugarcoat)\b"
ARTIFACT = r"\boaicite\b|\boai_citation\b|\bcontentReference\b|\bturn\d+(?:search|news|view|file|fetch)\d+\b|\bgrok_card\b|\butm_source=chatgpt\.com\b" + "|[\ue000-\uf8ff]"
COMPARISON = r"\b(?:the (?:best|fastest|easiest|simplest|most reliable|most effective)|far (?:more|less|better|worse|faster|slower)|much (?:more|less|better|worse|faster|slower)|significantly (?:more|less|better|worse|faster|slower|reduces?|improves?)|dramatically (?:more|less|better|worse|faster|slower|reduces?|improves?)|outperforms?|beats? (?:a|the|any|every|larger|smaller|bigger)|a fraction of (?:the )?cost|orders? of magnitude|\d+(?:\.\d+)?\s*(?:x|times) (?:faster|slower|better|worse)|complete(?:ly)? (?:prevents?|eliminates?|removes?)|very high)\b"
STRONG_COMPARISON = r"\b(?:the fastest|outperforms?|beats? (?:a|the|any|every|larger|smaller|bigger)|a fraction of (?:the )?cost|\d+(?:\.\d+)?\s*(?:x|times) (?:faster|slower|better|worse)|complete(?:ly)? (?:prevents?|eliminates?|removes?)|very high)\b"
SCAFFOLD = r"\b(?:here(?:'|’)s (?:what i mean|the thing|how it works|why|the bit|where it gets [a-z]+)|what if i told you|think about it|let that sink in|and that(?:'|’)s okay|the uncomfortable truth is|the idea is simple|let me walk you through|so picture this|quick refresher|the reflex objection|the answer is|the key trick|the key fact|the key is)\b"
CLEARLY_AFTER = ["think ", "write ", "communicate ", "speak ", "see ", "state ", "explain "]
CERTAINTY = r"\b(?:clearly(?=\s*(?:,|this\b|that\b|the\b|it\b|we\b|you\b|they\b))|obviously|undoubtedly|certainly|self-evidently|needless to say|without (?:a )?doubt|there (?:is|can be) no (?:doubt|question)|everyone knows|the (?:truth|reality|fact) is|it is clear that|one thing is (?:clear|certain))\b"
DECLARATIVE = r"\b(?:the (?:key|beauty|reality|truth|lesson|implications?|important (?:part|point|thing)|difference) (?:is|are)|(?:this|that|these) (?:approach|method|strategy|shift|evolution|framework|system|process|pattern|idea) (?:is|are|can|will|allows?|enables?|ensures?|provides?|offers?|demonstrates?|highlights?|underscores?|reflects?))\b"
QUANTIFIER = r"\b(?:almost every|nearly every|every (?:developer|engineer|team|company|provider|user)|most (?:people|developers|engineers|teams|companies|providers|users)|people (?:say|think|believe|assume|expect)|the standard (?:view|account|assumption)|widely (?:used|accepted|known|believed))\b"
CHALLENGE = r"\b(?:despite (?:these|the|its) challenges|faces? (?:several|numerous|significant) challenges|challenges and opportunities)\b"
FUTURE = r"\b(?:looking ahead|moving forward|future (?:prospects?|outlook)|the path forward|remains? to be seen|will continue to (?:evolve|grow|shape|play)|only time will tell|the future is (?:bright|promising)|for generations to come)\b"
ABSOLUTE = r"\b(?:always|never|everyone|everything|nobody|nothing|every single|completely|entirely|impossible|guaranteed|cannot|can't|won't ever|will always|no (?:way|chance|possibility)|under all circumstances)\b"
STRONG_ABSOLUTE = r"\b(?:always|never|everyone|everything|nobody|nothing|every single|impossible|guaranteed|won't ever|will always|under all circumstances)\b"
MODAL = r"\byou can\b[^.;!?]+\bor\b[^.;!?]+;\s*both\s+will\s+(?:give|produce|create|yield|lead|result)\b"
CONCESSIVE = "while|although|though|despite|even though"
PIVOT = "however|on the other hand|that said|that being said|at the same time|to be fair|conversely|nevertheless|nonetheless"
NEGATIVE_OPEN = r"^(?:not\b|it (?:isn(?:'|’)t|wasn(?:'|’)t)\b)"
LITERAL_LOAD = r"\b(?:wall|beam|column|masonry|structure|building|roof|foundation)s?\b"
PAREN_HEDGE = r"\([^)]*\b(?:not that|maybe|probably|i think|sort of|kind of|not sure|more or less|i guess)\b[^)]*\)"
INITIALISM = r"\b[A-Z][A-Z0-9-]{2,9}\b"
EXEMPT = ["AI", "API", "CSS", "HTML", "HTTP", "HTTPS", "ID", "IDs", "JSON", "SQL", "UI", "URL", "URLs", "UX"]
LIST_MARKER = "^[\t ]*(?:[-+*]|\\d+[.)])[\u2029\t ]"
FINISHED = "[.!?][\"')\\]]*[\t ]*$"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+"
INLINE_CODE = "`[^`\n]+`"
IDENTIFIER = r"\b(?:[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*|[A-Z]\d+|[a-z][a-z0-9]*_[a-z0-9_]+)\b"
QUALIFIER = r"(?i)\b(?:otherwise|unless|except|fallback|legacy|rather than|only|never|no|same|above|below|per(?:-criterion)?|exact|capped|at all|most recent|free-form)\b"
PROCESS_QUALIFIER = r"(?i)\b(?:otherwise|unless|except|fallback|rather than|only|never|no|not|nothing|cannot|if|because|instead|before|after|still|already|would|empty|unfiltered|same|worse|better)\b"
INTERNAL_LABEL = r"\b(?:[A-Z]{3,}|[A-Z]{2,}(?:-[A-Z]{2,})+)\b"
ABSTRACT_PROCESS = r"(?i)\b(?:(?:this|the)\s+(?:helper|function|method|plan|process|workflow|step|stage|logic|path|retrieval|ranking|filter)|(?:narrowing|ranking|filtering|matching|retrieval|selection|lookup)\s+(?:is|keeps|returns|uses|narrows|filters))\b"
STRUCTURED_LINE = r"^\s*(?:[-*+]\s+|\d+[.)]\s+|\|)"
STOP_WORDS = "a an and are as at be been but by can could did do does for from had has have he her here him his how i if in into is it its just may might more most my no not of on one only or our out she should so than that the their them there these they this those to too up us was we were what when where which who why will with would you your".split(" ")
NUMBER = r"(?i)\b(?:two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)\b"
SUPPORT = r"(?i)\b(?:according to|appendix|benchmark|case study|dataset|experiment|figure|for example|for instance|log|logs|measured|measurement|sample|source|study|survey|table|test|trial)\b|https?://|\[\^?\d+\]"
MECHANISM = r"(?i)\b(?:because|so that|thereby|which (?:means|shows)|by [a-z]+ing)\b"
NEGATION = r"(?i)\b(?:no|not|never)\b|\bn\s*['’]\s*t\b"
STEP_LINE = r"^\s*(?:[-*+] |\d+[.)] )"
DISCUSSED = r"\b(?:words?|phrases?|vocabulary)\b.*\b(?:such as|including|like)\b|\b(?:ai|llm|model|chatbot)s?\b.*\b(?:produce|output|write|writing|word|phrase|say|sentence|vocabulary)s?\b|\b(?:words?|phrases?|vocabulary)\b.*\b(?:ai|llm|model|chatbot)s?\b"
APOLOGY = ["sorry", "apologies", "apologise", "apologize"]
VERDICT = ["unbiased", "properly", "correctly", "reliably", "effectively", "seamlessly", "robust", "robustly", "accurately", "appropriately", "efficiently", "unacceptable", "suboptimal", "problematic", "meaningful", "meaningfully"]
EVALUATIVE = ["good", "better", "best", "great", "nice", "bad", "worse", "important", "interesting", "powerful", "amazing", "useful", "solid"]
HEDGES = ["honestly", "arguably", "imo", "imho", "i think", "i guess", "i feel like", "in my opinion", "to be honest"]
HEDGES_FIRST = ["maybe", "perhaps", "probably"]
#: Blocks of pictographs; digits, #, *, copyright and trade marks are left out, as they are no decoration.
EMOJI = "[\u231a\u231b\u23e9-\u23f3\u2600-\u27bf\u2934\u2935\u2b05-\u2b07\u2b1b\u2b1c\u2b50\u2b55\U0001f000-\U0001f3fa\U0001f400-\U0001faff](?:\ufe0f|[\U0001f3fb-\U0001f3ff])?"
CATEGORY = {
    "significance-idioms": "significance", "promo-idioms": "promo", "chatbot-idioms": "meta", "emerging-slop-phrases": "ai-vocab", "ai-vocabulary": "ai-vocab", "vague-attribution": "vague", "performed-candor": "performance",
    "opening-conjunction": "conjunctions", "generation-artifacts": "formatting", "emoji": "formatting", "unsupported-comparison": "vague", "em-dash-overuse": "formatting",
    "mixed-quotes": "formatting", "hedging-seesaw": "balance", "rhetorical-scaffolding": "meta", "unsupported-certainty": "vague", "vague-declarative": "vague",
    "vague-quantifier": "vague", "outline-conclusion": "meta", "absolute-claim": "vague", "modal-redundancy": "meta", "negative-list-buildup": "parallelism",
    "apology-reflex": "posture", "verdict-word": "evidence", "verdict-echo": "evidence", "hedge-phrase": "hedging", "parenthetical-hedge": "hedging",
    "implementation-detail-pileup": "meta", "semantic-redundancy": "meta", "unexplained-initialism": "jargon", "list-without-break": "directness", "paragraph-load": "economy", "uniform-rhythm": "rhythm", "evidence-cluster": "evidence",
}
#: Rules with a severity of their own; all others follow the confidence.
SEVERITY = {"apology-reflex": "error", "verdict-word": "warn", "verdict-echo": "error", "hedge-phrase": "warn", "parenthetical-hedge": "error"}
SUPPORT_ONLY = ["absolute-claim", "passive-actor-hiding", "em-dash-overuse"]


#: White space in front of a marker of a list's item, and the end of a finished line before it, if there is one.
MARKED_LINE = r"(?:[.!?][\"')\]]*[\t ]*\n)?(?:^|(?<=\n))[\t ]*(?P<at>(?:[-+*]|\d+[.)])[\u2029\t ][^\n]*)"
HEDGE_LEAD = r"[^A-Za-z0-9_'’]*"


def lexicon_pattern(words: list[str]) -> str:
    """Phrases with any kind of quotes, between signs that are no letters or digits of any script."""
    return r"(?u)(?i)(?<![^\W_])" + phrase_tree(words) + r"(?![^\W_])"


def word_pattern(words: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def rare_words(phrases: list[str]) -> frozenset[str]:
    """Of each phrase the longest run of letters, which a text that holds the phrase holds as well."""
    return frozenset(max(re.findall("[a-z]+", w.lower()), key=len) for w in phrases)


#: What follows a word, up to the next one: tells "harness the wind" from "a harness" where there is no parse.
VERBAL = r"(?P<next>\s+(?:the|an?|its|their|your|our|this|these|that|those|more|new|both)(?![^\W_]))?"
_QUOTES = "[\"'“”‘’‛(\\[\\s]*"
_OPENING = "|".join(w.translate(str.maketrans("’", "'")).replace("'", "['‘’‛]") for w in sorted(dict.fromkeys(lex.OPENERS), key=lambda w: -len(w)))
PLACES = Patterns(
    anywhere={
        "significance": lexicon_pattern(lex.SIGNIFICANCE), "promotion": lexicon_pattern(lex.PROMOTION), "chatbot": lexicon_pattern(lex.CHATBOT), "emerging": lexicon_pattern(lex.EMERGING), "vocabulary": lexicon_pattern(lex.AI_WORDS) + VERBAL,
        "sources": lexicon_pattern(lex.VAGUE_SOURCES), "candor": "(?i)" + CANDOR, "artifact": ARTIFACT, "emoji": EMOJI, "comparison": "(?i)" + COMPARISON, "apology": word_pattern(APOLOGY), "verdict": word_pattern(VERDICT), "paren_hedge": "(?i)" + PAREN_HEDGE,
        "dash": "—", "curly": "[“”]", "straight": '"', "scaffold": "(?i)" + SCAFFOLD, "certainty": "(?i)" + CERTAINTY, "declarative": "(?i)" + DECLARATIVE, "quantifier": "(?i)" + QUANTIFIER,
        "absolute": "(?i)" + ABSOLUTE, "modal": "(?i)" + MODAL, "echo": word_pattern(EVALUATIVE), "hedge": r"(?i)\b(?:" + "|".join(h.replace(" ", " +") for h in HEDGES) + r")\b",
        "initialism": INITIALISM, "spelled_before": r"\((?P<at>[A-Z][A-Z0-9-]{2,9})\)", "spelled_after": r"(?P<at>[A-Z0-9-]+)\s*\([A-Za-z][A-Za-z -]{3,80}\)", "marked_line": MARKED_LINE,
    },
    heads={
        "opening": rf"(?i){_QUOTES}(?P<at>{_OPENING})(?:[\s,.:;]|\Z)", "seesaw": rf"(?i)[\"'“‘(]*\s*(?P<at>{CONCESSIVE}|{PIVOT})(?![A-Za-z0-9_])",
        "negative": "(?i)" + NEGATIVE_OPEN, "hedge_first": rf"(?i){HEDGE_LEAD}(?P<at>{'|'.join(HEDGES_FIRST)})(?![A-Za-z0-9_'’])",
    },
    tails={"challenge": "(?i)" + CHALLENGE, "future": "(?i)" + FUTURE},
    before={"certainty": 12, "absolute": 18, "spelled_before": 120},
    per_paragraph=frozenset({"absolute"}),
    words={n: frozenset(w.split()) if isinstance(w, str) else w for n, w in {
        "significance": rare_words(lex.SIGNIFICANCE), "promotion": rare_words(lex.PROMOTION), "chatbot": rare_words(lex.CHATBOT), "emerging": rare_words(lex.EMERGING), "vocabulary": rare_words(lex.AI_WORDS),
        "sources": rare_words(lex.VAGUE_SOURCES), "opening": rare_words(lex.OPENERS), "apology": rare_words(APOLOGY), "verdict": rare_words(VERDICT), "echo": rare_words(EVALUATIVE), "hedge": rare_words(HEDGES), "hedge_first": rare_words(HEDGES_FIRST),
        "candor": "transparent candid blunt upfront honest direct clear disclosure spirit table rather guess name explicit sugarcoat", "artifact": "oaicite oai contentreference turn grok utm",
        "comparison": "best fastest easiest simplest reliable effective far much significantly dramatically outperform outperforms beat beats fraction magnitude faster slower better worse complete completely high",
        "scaffold": "here told think sink okay uncomfortable idea walk picture refresher reflex answer key", "certainty": "clearly obviously undoubtedly certainly evidently needless doubt question everyone truth reality fact clear certain",
        "declarative": "key beauty reality truth lesson implication implications important difference approach method strategy shift evolution framework system process pattern idea",
        "quantifier": "almost nearly developer engineer team company provider user people developers engineers teams companies providers users standard widely",
        "absolute": "always never everyone everything nobody nothing single completely entirely impossible guaranteed cannot can ever way chance possibility circumstances", "modal": "both",
        "seesaw": "while although though despite however hand said time fair conversely nevertheless nonetheless", "negative": "not isn wasn", "challenge": "challenges", "future": "ahead forward future path remain remains continue tell generations",
        "abstracts": "helper function method plan process workflow step stage logic path retrieval ranking filter narrowing filtering matching selection lookup",
    }.items()},
    signs={"artifact": "[\ue000-\uf8ff]", "marked_line": "\n[\t ]*(?:[-+*]|\\d+[.)])[\u2029\t ]", "spelled_before": r"\(", "spelled_after": r"\(", "identifiers": r"[A-Z0-9_](?:(?<=_)|(?<=[a-z0-9][A-Z])|(?<=[A-Z][0-9]))", "labels": "[A-Z][A-Z]", "initialism": "[A-Z][A-Z0-9-][A-Z0-9-]"},
    counts={"brackets": r"\([^()\n]{1,180}\)", "breaks": "[—;]", "colons": r":(?=\s|\Z)", "commas": ",", "identifiers": IDENTIFIER, "labels": INTERNAL_LABEL, "abstracts": ABSTRACT_PROCESS},
    skip=INLINE_CODE,
    alike=Alike(frozenset(STOP_WORDS), (5, 2, 0.6), (6, 1, 0.48)),
)


def none() -> Column:
    return F.array().cast(FOUND)


def _as(rule: str, hits: Column, confidence) -> Column:
    """Hits with start and end as findings; ``confidence`` is a word, a Column, or a function of the hit."""
    grade = confidence if callable(confidence) and not isinstance(confidence, Column) else lambda h: F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.transform(hits, lambda h: F.struct(F.lit(rule).alias("rule"), h["start"].cast("int").alias("start"), h["end"].cast("int").alias("end"), grade(h).alias("confidence")))


def _medium(condition: Column) -> Column:
    return F.when(condition, "medium").otherwise("low")


def _near(hits: Column, k, more: int, width: int, by: str = "i") -> Column:
    """The hit at place k and the one ``more`` places on lie within ``width`` of each other."""
    return F.coalesce(F.get(hits, k + more)[by] - F.get(hits, k)[by] <= width, F.lit(False)) & (F.lit(0) <= k)


def _crowded(hits: Column, count: int, width: int) -> Column:
    """Some ``count`` hits in a row lie within ``width`` sentences of each other."""
    return F.exists(F.transform(hits, lambda h, k: _near(hits, k, count - 1, width)), lambda x: x)


def lexical(x: Column) -> list[Column]:
    out = [_as("significance-idioms", x["significance"], "medium"), _as("promo-idioms", x["promotion"], "medium"), _as("chatbot-idioms", x["chatbot"], "high")]
    literal = lambda h: F.coalesce(h["match"].rlike("(?i)^load") & F.get(x["sents"], h["i"])["text"].rlike(java("(?i)" + LITERAL_LOAD)), F.lit(False))
    out.append(_as("emerging-slop-phrases", F.filter(x["emerging"], lambda h: ~literal(h)), "low"))
    out += [_as("performed-candor", x["candor"], "medium"), _as("generation-artifacts", x["artifact"], "high"), _as("emoji", x["emoji"], "low"), _as("vague-attribution", x["sources"], "low")]
    out.append(_as("unsupported-comparison", x["comparison"], lambda h: _medium(h["match"].rlike(java("(?i)" + STRONG_COMPARISON)))))
    return [*out, _as("apology-reflex", x["apology"], "medium"), _as("verdict-word", x["verdict"], "medium"), _as("parenthetical-hedge", x["paren_hedge"], "medium")]


def vocabulary(text: Column, x: Column) -> Column:
    """Single words that models overuse, where a sentence does not speak of such words; medium from four on at 1.5 in a
    hundred content words.  "Harness" counts as a verb only, told by what follows it; content words are those
    outside the stop list, as there are no parts of speech here."""
    word = lambda h: F.regexp_extract(h["match"], r"^\S+", 0)
    told = lambda h: F.get(x["sents"], h["i"])["text"].rlike(java("(?i)" + DISCUSSED))
    hit = F.filter(x["vocabulary"], lambda h: ~F.coalesce(told(h), F.lit(False)) & ~((F.lower(word(h)) == "harness") & (word(h) == h["match"])))
    rows = F.transform(hit, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.length(word(h))).alias("end")))
    content = F.size(F.filter(word_array(F.lower(text)), lambda w: ~w.isin(STOP_WORDS)))
    grade = lambda r: F.when(F.size(r) >= 4, _medium(F.size(r) * 100 >= 1.5 * F.greatest(content, F.lit(1)))).otherwise("low")
    return F.when(F.size(x["vocabulary"]) > 0, let(rows, lambda r: let(grade(r), lambda g: _as("ai-vocabulary", r, g)))).otherwise(none())


def openers(x: Column) -> Column:
    """Formulaic first words; medium if one recurs three times, three stand within six sentences, or five make 15 %."""
    hit = x["opening"]
    phrase = lambda h: F.lower(straight_quotes(F.substring(h["match"], F.length(h["match"]) - F.length(F.regexp_replace(h["match"], rf"(?i)^{_QUOTES}", "")) + 1, h["end"] - h["start"])))

    def habit(words):
        many = F.exists(F.transform(words, lambda w, k: F.coalesce(F.get(words, k + 2) == w, F.lit(False))), lambda b: b)
        return many | _crowded(hit, 3, 5) | ((F.size(hit) >= 5) & (F.size(hit) >= 0.15 * F.size(x["sents"])))

    grade = let(F.array_sort(F.transform(hit, phrase)), lambda words: _medium(habit(words)))
    return F.when(F.size(hit) > 0, let(grade, lambda g: _as("opening-conjunction", hit, g))).otherwise(none())


def dashes(x: Column) -> Column:
    """The first dash; medium if eight sentences in a row hold four, or twelve in all at one in twelve sentences."""
    hit = x["dash"]
    medium = _crowded(hit, 4, 7) | ((F.size(hit) >= 12) & (F.size(hit) * 12 >= F.greatest(F.size(x["sents"]), F.lit(1))))
    return F.when(F.size(hit) > 0, _as("em-dash-overuse", F.slice(hit, 1, 1), _medium(medium))).otherwise(none())


def quotes(x: Column) -> Column:
    """Each quote of the rarer kind where straight and curly double quotes are mixed."""
    curly, straight = x["curly"], x["straight"]
    rarer = F.when(F.size(curly) <= F.size(straight), curly).otherwise(straight)
    return F.when((F.size(curly) >= 2) & (F.size(straight) >= 2), _as("mixed-quotes", rarer, "medium")).otherwise(none())


def seesaw(text: Column, x: Column) -> Column:
    """Sentence-opening concessions and pivots, from three on and 0.8 a hundred words."""
    hit = x["seesaw"]
    often = F.when(F.size(hit) >= 3, F.size(hit) * 100 >= 0.8 * F.greatest(token_count(text), F.lit(1))).otherwise(False)
    return F.when(often, _as("hedging-seesaw", hit, "low")).otherwise(none())


def certainty(x: Column) -> Column:
    """Assertions of certainty; medium where three stand within eight sentences."""
    plain = lambda h: ~(h["match"].rlike("(?i)^clearly") & F.lower(h["before"]).rlike("(?:" + "|".join(CLEARLY_AFTER) + r")\z"))

    def graded(hit):
        # Three in a row that are close, this one first, second or third of them.
        rows = F.transform(hit, lambda h, k: F.struct(h["start"].alias("start"), h["end"].alias("end"), (_near(hit, k, 2, 7) | _near(hit, k - 1, 2, 7) | _near(hit, k - 2, 2, 7)).alias("close")))
        return _as("unsupported-certainty", rows, lambda r: _medium(r["close"]))

    return let(F.filter(x["certainty"], plain), graded)


def stacked(rule: str, hit: Column) -> Column:
    """Hits of a pattern; medium from three in a document on."""
    return _as(rule, hit, _medium(F.size(hit) >= 3))


def ending(x: Column) -> Column:
    """A challenge or an outlook in the last 35 % of the text; medium if both."""
    return _as("outline-conclusion", F.slice(F.concat(x["challenge"], x["future"]), 1, 1), _medium((F.size(x["challenge"]) > 0) & (F.size(x["future"]) > 0)))


def absolutes(x: Column) -> Column:
    """Absolute words of each paragraph; medium with three strong ones that are asserted."""

    def asserted(h):
        calm = let(F.get(x["sents"], h["i"])["text"], lambda s: ~F.contains(s, F.lit("?")) & ~s.rlike(r"(?i)^\s*(?:if|unless|whether)(?![A-Za-z0-9_])"))
        return F.coalesce(h["match"].rlike(java("(?i)" + STRONG_ABSOLUTE)) & ~h["before"].rlike(java(r"(?i)\b(?:not|isn't|wasn't|aren't|weren't|hardly)\s*\z")) & calm, F.lit(False))

    one = lambda hits: F.when(F.size(hits) == 0, none()).otherwise(let(_medium(F.size(F.filter(hits, asserted)) >= 3), lambda grade: _as("absolute-claim", hits, grade)))
    return F.flatten(F.transform(x["absolute"], one))


def modal(x: Column) -> Column:
    """The second modal of "you can X or Y; both will give"."""
    lead = lambda h: F.length(F.regexp_extract(h["match"], r"(?is)^(.*;\s*both\s+)will\s+[a-z]+$", 1))
    size = lambda h: F.length(F.regexp_extract(h["match"], r"(?is);\s*both\s+(will\s+)[a-z]+$", 1))
    return _as("modal-redundancy", F.transform(x["modal"], lambda h: F.struct((h["start"] + lead(h)).alias("start"), (h["start"] + lead(h) + size(h)).alias("end"))), "medium")


def negative_lists(x: Column) -> Column:
    """From the second on of consecutive sentences that open with a negation."""
    hit = x["negative"]
    after = F.filter(hit, lambda h, k: F.coalesce(F.get(hit, k - 1)["i"] == h["i"] - 1, F.lit(False)) & (k > 0))
    return _as("negative-list-buildup", F.transform(after, lambda h: F.get(x["sents"], h["i"])), "medium")


def echoes(text: Column, x: Column) -> Column:
    """An evaluative word used again: anywhere in a document of 80 words, else in the sentence of its first use."""

    def again(few):
        def later(word):
            mine = F.filter(x["echo"], lambda h: F.lower(h["match"]) == word)
            return let(mine, lambda m: F.filter(F.slice(m, 2, F.greatest(F.size(m), F.lit(1))), lambda h: few | (h["i"] == F.get(m, F.lit(0))["i"])))

        rows = F.flatten(F.array(*(F.transform(later(F.lit(w)), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))) for w in EVALUATIVE)))
        return _as("verdict-echo", F.sort_array(rows), "medium")

    return F.when(F.size(x["echo"]) > 1, let(token_count(text) <= 80, again)).otherwise(none())


def hedges(x: Column) -> Column:
    """Hedging words and phrases of each sentence, and those that only count as its first word."""
    return _as("hedge-phrase", F.concat(x["hedge_first"], x["hedge"]), "medium")


def initialisms(x: Column) -> Column:
    """The first use of a capital-letter term that is used twice and never spelled out."""
    hit = F.array_sort(F.transform(F.filter(x["initialism"], lambda h: ~h["match"].isin(EXEMPT)), lambda h: F.struct(h["match"].alias("match"), F.lit(1).alias("use"), h["start"].alias("start"), h["end"].alias("end"))))
    # Terms spelled out before or after them; what stands in front of a bracket may end in more than one term.
    before = F.transform(F.filter(x["spelled_before"], lambda h: F.regexp_replace(h["before"], r"\($", "").rlike(r"[A-Za-z][A-Za-z -]{3,80}\s*\z")), lambda h: F.regexp_extract(h["match"], r"\((.*)\)", 1))
    ends = lambda h: let(F.regexp_extract(h["match"], "^[A-Z0-9-]+", 0), lambda w: F.transform(F.sequence(F.lit(3), F.lit(10)), lambda n: F.right(w, n)))
    known = F.transform(F.array_distinct(F.concat(before, F.flatten(F.transform(x["spelled_after"], ends)))), lambda w: F.struct(w.alias("match"), F.lit(0).alias("use"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))

    def undefined(rows):
        # In order of terms, a known one stands before its uses.
        same = lambda k, h: F.coalesce(F.get(rows, k)["match"] == h["match"], F.lit(False)) & (k >= 0)
        first = F.filter(rows, lambda h, k: (h["use"] == 1) & ~same(k - 1, h) & same(k + 1, h))
        return _as("unexplained-initialism", F.array_sort(F.transform(first, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))), "medium")

    return F.when(F.size(hit) > 1, let(F.array_sort(F.concat(hit, known)), undefined)).otherwise(none())


def unbroken_lists(x: Column) -> Column:
    """A list that starts right after a finished sentence of the same block."""
    hit = x["marked_line"]
    first = F.filter(hit, lambda h, k: h["match"].rlike("^[.!?]") & h["p"].isNotNull() & ~(F.coalesce(F.get(hit, k - 1)["p"] == h["p"], F.lit(False)) & (k > 0)))
    return _as("list-without-break", F.transform(first, lambda h: F.struct(h["start"].alias("start"), (h["end"] - F.length(F.regexp_extract(h["match"], r"\s*\z", 0))).alias("end"))), "low")


def loads(x: Column) -> Column:
    """Paragraphs of seven sentences and 130 words."""
    return _as("paragraph-load", F.filter(x["pars"], lambda p: (p["size"] >= 7) & (word_count(p["text"]) >= 130)), "medium")


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(java(pattern)))


def pileups(x: Column) -> Column:
    """Paragraphs of 28 words that pile up identifiers, qualifications and clause breaks."""

    def heavy(p):
        lines = F.filter(F.transform(F.split(p["text"], "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
        listed = F.contains(p["text"], F.lit(" ")) | let(lines, lambda x: (F.size(x) >= 2) & (F.size(F.filter(x, lambda y: y.rlike(STRUCTURED_LINE))) >= 0.75 * F.size(x)))
        inline = F.when(F.contains(p["text"], F.lit("`")), F.aggregate(F.transform(F.regexp_extract_all(p["text"], F.lit(f"({INLINE_CODE})"), 1), lambda c: F.greatest(F.lit(1), _count(c, IDENTIFIER))), F.lit(0), lambda a, x: a + x)).otherwise(0)
        plain = F.regexp_replace(p["text"], INLINE_CODE, " ")
        breaks = p["n_brackets"] + p["n_breaks"] + p["n_colons"] + F.floor(p["n_commas"] / 2)

        def dense(b):
            # Few paragraphs have the names, labels or talk of processes; only these are searched for the rest.
            named = let(inline + p["n_identifiers"], lambda r: (r >= 3) & let(_count(plain, QUALIFIER), lambda q: ((r >= 4) & (q >= 2)) | (q >= 4)))
            vague = (b >= 4) & (p["n_labels"].between(2, 8) | (p["n_abstracts"] >= 2)) & (word_count(p["text"]) >= 55)
            return named | (vague & (_count(plain, PROCESS_QUALIFIER) >= 7))

        return let(breaks, lambda b: (b >= 3) & dense(b)) & (word_count(p["text"]) >= 28) & ~listed

    return _as("implementation-detail-pileup", F.filter(x["pars"], heavy), "medium")


# What is asked only of texts that share most stems with one before them.
def _negates(text: Column) -> Column:
    return text.rlike(java(NEGATION))


def _supported(text: Column) -> Column:
    return text.rlike(java(SUPPORT)) | text.rlike("[0-9]") | text.rlike(java(NUMBER))


def _explained(r: Column) -> Column:
    """Does it add stems and say by what mechanism?"""
    return (r["b"]["novel"] >= 4) & r["text"].rlike(java(MECHANISM))


def steps(text: Column) -> Column:
    """Three lines or more, most of them steps."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    return let(lines, lambda x: (F.size(x) >= 3) & (F.size(F.filter(x, lambda y: y.rlike(STEP_LINE))) >= 0.6 * F.size(x)))


def repetitions(x: Column) -> Column:
    """Sentences that say again what stood two to four sentences before in their paragraph, and paragraphs that say again
    one of the four before: most stems shared, same polarity, no support or number, no mechanism that adds stems.
    Lists of steps may repeat each other's words: they stay low, and their sentences are not compared."""

    def linked(links, pieces):
        side = lambda k: F.get(pieces, k)
        return F.transform(links, lambda h: let(side(h["i"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), h["p"].alias("p"), F.struct(h["sim"].alias("sim"), h["novel"].alias("novel"), side(h["j"])["text"].alias("text")).alias("b"))))

    same = lambda r: _negates(r["b"]["text"]) == _negates(r["text"])
    alone = lambda r: ~_supported(r["text"]) & ~_explained(r)
    recipe = lambda r: steps(r["text"]) & steps(r["b"]["text"])
    again = lambda r: same(r) & alone(r) & ~steps(F.get(x["pars"], r["p"])["text"])
    told = lambda r: same(r) & (recipe(r) | alone(r))
    sents = _as("semantic-redundancy", F.filter(linked(x["same_sents"], x["sents"]), again), lambda r: _medium((r["b"]["sim"] >= 0.68) & (r["b"]["novel"] <= 3)))
    pars = _as("semantic-redundancy", F.filter(linked(x["same_pars"], x["pars"]), told), lambda r: _medium((r["b"]["sim"] >= 0.68) & ~recipe(r)))
    return F.concat(sents, pars)


def located(docs: DataFrame) -> DataFrame:
    """docs with text filled, and the places of ``PLACES`` in it."""
    return docs.withColumn("text", filled(F.col("text"))).withColumn("places", places(PLACES)(F.col("text")))


def all_rules(text: Column, x: Column) -> Column:
    """Findings of every rule in order of emission."""
    return F.concat(
        *lexical(x), vocabulary(text, x), openers(x), dashes(x), quotes(x), seesaw(text, x), stacked("rhetorical-scaffolding", x["scaffold"]), certainty(x),
        stacked("vague-declarative", x["declarative"]), stacked("vague-quantifier", x["quantifier"]), ending(x), absolutes(x), modal(x), negative_lists(x),
        echoes(text, x), hedges(x), initialisms(x), unbroken_lists(x), loads(x), pileups(x), repetitions(x),
    )


@functools.lru_cache(maxsize=1)
def _rules(application: str) -> Column:
    """all_rules on the columns that ``located`` gives, built once an application."""
    return all_rules(F.col("text"), F.col("places"))


def severity(rule: Column, confidence: Column) -> Column:
    own = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.get(F.array(F.element_at(own, rule)), F.lit(0)), F.when(confidence == "high", "error").when(confidence == "medium", "warn").otherwise("info"))


def findings(docs: DataFrame, least: str = "info") -> DataFrame:
    """docs (doc_id, text, ...) -> their columns, sents, pars, found: findings with severity ``least`` or more, the first
    of each (rule, start, end), by start, longer ones first, then in order of emission."""
    whole = lambda f, i: F.struct(f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end"), i.alias("seq"), f["confidence"].alias("confidence"), severity(f["rule"], f["confidence"]).alias("severity"))
    every = located(docs).withColumn("every", F.sort_array(F.transform(_rules(docs.sparkSession.sparkContext.applicationId), whole)))
    strong = [k for k, v in RANK.items() if v >= RANK[least]]
    # By rule and span, equal ones stand side by side with their first emission in front.
    same = lambda f, o: F.coalesce((f["rule"] == o["rule"]) & (f["start"] == o["start"]) & (f["end"] == o["end"]), F.lit(False))
    once = lambda x: F.filter(x, lambda f, i: ~(same(f, F.get(x, i - 1)) & (i > 0)) & f["severity"].isin(strong))
    placed = lambda f: F.struct(f["start"].alias("start"), (-f["end"]).alias("back"), f["seq"].alias("seq"), f["rule"].alias("rule"), f["end"].alias("end"), f["confidence"].alias("confidence"), f["severity"].alias("severity"))
    found = let(F.col("every"), lambda x: F.sort_array(F.transform(once(x), placed)))
    return every.withColumns({"found": found, "sents": F.col("places.sents"), "pars": F.col("places.pars")}).drop("every", "places")


def finding_rows(docs: DataFrame, least: str = "info") -> DataFrame:
    # Outer, so that no filter on the array is moved below, where the whole array would be computed twice.
    f = findings(docs, least).select("doc_id", "text", F.posexplode_outer("found").alias("place", "f")).where("place is not null")
    return f.select("doc_id", "text", "place", "f.rule", "f.start", "f.end", "f.confidence", "f.severity")

