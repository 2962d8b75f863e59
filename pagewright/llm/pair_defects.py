"""Defects of question-answer pairs: empty, truncated, refusal, copied, language (problem 6)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What stands for an answer that is not there.
PLACEHOLDERS = frozenset("n/a|na|tbd|todo|none|null|nil|nan|undefined|empty|no answer|answer|no data|missing|pending|unknown|to be determined|to be added|not available|placeholder|xxx|lorem ipsum|?".split("|"))
INVISIBLE = re.compile("[\\s ­᠎​-‏ -  -⁤⠀　ㅤ﻿￼\x00-\x1f]+")
MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&nbsp;|&#160;|[*_#`~]+", re.S)
WORDS = re.compile(r"[^\W_]+")

# Question words and frequent function words by language, beside the delivered list of common words.
ASKING = {
    "en": "what who whom whose where why how which when does did explain describe is are under conditions say about needed".split(),
    "de": "was wer wen wem wo warum wieso wie welche welcher welches welchen wann zeigt über zwischen erkläre rolle spielt".split(),
    "fr": "que quoi qui où pourquoi comment quel quelle quels quelles quand est entre montre expliquez il elle lien".split(),
    "es": "qué quién dónde cómo cuál cuáles cuándo hay entre muestra explica relación".split(),
    "it": "che cosa chi dove perché come quale quali quando mostra spiega tra fra modo legame unisce".split(),
}

# Refusal grammar. A sentence is parted into clauses; it refuses if its first clause does, or a later one that draws the conclusion ("so I cannot
# answer"). A passage refuses if its first sentence does (or its first two together) and every further one refuses as well or is a COURTESY.
# A clause refuses by who speaks (SELF), or what there is to go by (SOURCE), that this is negated, and that it is about answering (SPEECH).
SPEECH = (
    r"(?:answer|respond|reply|help|assist|provide|give|discuss|comply|fulfil+|process|complete|summari[sz]e|generate|say|tell|comment|write|share|continue|offer|produce|create|explain|describe|engage|support|supply|speak|talk|elaborate|address|"
    r"recommend|advise|opine|speculate|judge|disclose|reveal|weigh in|shed (?:any |much |more )?light|(?:get|go|look|dig|delve) into|touch(?: on)?|take (?:this|that|it|a position|sides)|be of (?:any |much )?(?:help|use|assistance)|do (?:this|that|so|it)|skip|supply|tell|guess|confirm|verify)"
)
# To know or find is about answering only where nothing, a pronoun, a question or the answer itself is what is sought.
SEEK = r"(?:know|find|see|determine|make out|say|locate|recall)(?:\s*$|,| (?:that|this|it|any|anything|enough|what|whether|if|how|why|who|where|when|which|for (?:sure|certain)|in the|from the|the (?:answer|information|details?|reason|exact)|much|more)\b)"
SPEAKING = r"(?:answering|responding|replying|helping|assisting|providing|giving|discussing|commenting|sharing|speaking|talking|elaborating|addressing|advising|speculating|getting into|going into|weighing in|saying|telling|doing (?:this|that|so))"
SELF = r"(?:i|we|(?:this|the|your) (?:[\w-]+ )?(?:assistant|model|system|ai|bot))"
NOT = r"(?:can(?:no|')t|can ?not|could not|couldn't|will not|won't|would not|wouldn't|may not|must not|should not|shouldn't|do not|don't|did not|didn't|am not|'m not|are not|aren't|'re not|is not|isn't|was not|wasn't|were not|weren't|never|have not|haven't)"
UNABLE = rf"(?:{NOT}|(?:am|'m|are|'re|is|was|were|would be|remain) (?:quite |simply |just |currently )?(?:unable|powerless|forbidden|barred|prevented)|lack|lacks|fail|regret|'d rather not|would rather not|(?:'d |would )?prefer not|choose not|opt not|(?:am|'m|are|'re) in no position)"
READY = r"(?:at liberty|able|free|willing|comfortable|prepared|in a position|equipped|qualified|allowed|permitted|authori[sz]ed|inclined|supposed|meant|the right (?:one|person)|ready|happy|going|built|made|trained|designed)"
DECLINE = r"(?:decline|refuse|pass(?: on)?|abstain|refrain|demur|bow out|opt out|say no|sit this (?:one )?out|hold off|beg off|turn (?:this|that|it|you|your request|the request) (?:one )?down|leave (?:it|this|that) (?:unanswered|open|to others)|stay (?:out of|away from|clear of)|keep (?:out of|away from|clear of)|steer clear|(?:keep|remain|stay) silent|disappoint)"
HAVE_TO = r"(?:(?:would rather|'d rather|would sooner|'d sooner|had better|must|have to|need to|want to|wish to|am forced to|are forced to|'m forced to|am obliged to|shall|will|'ll|would|'d|am going to|'m going to|are going to|'re going to|will have to|'ll have to|would have to|am going to have to|'m going to have to|'re going to have to|choose to|prefer to|ask to) (?:like to |have to )?)"
THEME = r"(?:question|request|query|prompt|topic|task|answer|information|details?|reply|response|subject|matter)"
SOURCE = r"(?:(?:the|this|that|my|our|your) (?:[\w-]+ )?(?:text|passage|document|context|section|source|excerpt|page|chunk|material|information|data|notes?|article)s?)(?: (?:at hand|here|above|below|provided|given|available|i have|i was given|that i have|supplied))?"
KNOWLEDGE = r"(?:contexts?|information|data|details?|evidence|material|answers?|knowledge|content|record|mention|opinions?|views?|idea|means|basis|access|clue|grounds|facts?|way of (?:knowing|telling|saying|answering)|way to (?:know|tell|say|answer))"
RULES = r"(?:guidelines?|polic(?:y|ies)|rules?|instructions?|terms|programming|training|principles|remit|scope)"
SORRY = (
    r"(?:(?:i am|i'm|we are|we're) (?:very |really |so |truly |terribly )?(?:sorry|afraid)|(?:so |very )?sorry|(?:my |our |please accept my )?apologies|i apologi[sz]e|unfortunately|regrettably|sadly|alas|(?:i|we) regret(?: to say)?|kindly note|"
    r"as an? (?:[\w-]+ ){0,4}(?:assistant|model|ai|system|program|bot)|at this (?:time|point|moment)|honestly|frankly|thanks?(?: you)?(?: for asking)?|no)"
)
HERE = r"(?:\s+(?:about|on|regarding|concerning|for|to|in|available|here|given|provided|that|which|from|as to|of (?:this|that|it|knowing))\b|\s*$)"
REFUSING = re.compile(
    rf"^(?:{SORRY}\b[,.;:!]*\s+(?:but\s+|that\s+|for\s+|to\s+)?)*(?:"
    # the speaker cannot, may not, will not answer, or is not ready to
    rf"{SELF}\s*{UNABLE}(?: (?:to|be|been|able|really|simply|just|currently|at this time|in good conscience|ever|even|possibly|feel|quite|here|actually|get|have))*? (?:{SPEECH}\b|{SPEAKING}\b|{SEEK}|the (?:one|right one|person) to\b)"
    rf"|{SELF}(?: feel|'m feeling)?\s*{UNABLE}(?: (?:feel|really|quite|at all|currently|exactly|the least))* {READY}(?: (?:to|with|about|enough|for|in|of))*(?:\s*$| {SPEECH}\b| {SPEAKING}\b| (?:this|that|it)\b)"
    rf"|{SELF} (?:am|'m|are|'re|is)? ?(?:hardly|no longer|in no way|nowhere near) {READY}(?: to)?(?:\s*$| {SPEECH}\b)"
    rf"|(?:will|won't|'ll) not be {SPEAKING}|{SELF} won't be {SPEAKING}"
    rf"|{SELF}(?:'m| am|'re| are)? ?{HAVE_TO}?(?:respectfully |politely |kindly |regretfully )?{DECLINE}\b(?! to (?!(?:{SPEECH}|take part|comply|go|be)\b))"
    rf"|{SELF} (?:have|'ve|has|had) been (?:told|asked|instructed|ordered|advised) not to\b|{SELF} {HAVE_TO}skip (?:this|that|it)\b|(?:that|this|it) is (?:something|a [\w]+) (?:i|we) (?:would|'d) rather (?:not|leave)\b"
    rf"|(?:unable|not able|cannot|can't|can not|won't be able|declin(?:e|ing)|refus(?:e|ing)) (?:to )?(?:{SPEECH})\b|(?:respectfully|politely) declin(?:e|ing)\b"
    # the speaker has nothing to go by
    rf"|{SELF}(?: currently| simply| just)? (?:(?:do|did) not|don't|didn't|cannot|can't|could not|couldn't) (?:currently |really |actually |yet )?(?:{SEEK}|(?:have|find|see|hold|possess|get)\b(?! to\b)[^.!?,;]{{0,40}}?\b(?:{KNOWLEDGE}|{THEME}|any|enough|anything)\b)"
    rf"|{SELF}(?:'ve| have| has| had| hold| find| found| see| possess| was given| were given| got)(?: been given| got)? (?:no|insufficient|not enough|too little|little|not sufficient)(?: [\w-]+){{0,2}}? {KNOWLEDGE}\b"
    rf"|{SELF}(?:'ve| have| has| had| find| found| see| know| possess) nothing(?: (?:to|on|about|here|that|of|relevant|useful|in)\b|\s*$)|{SELF} know nothing\b|{SELF} lacks? (?:the |any |enough |sufficient )?(?:[\w-]+ )?{KNOWLEDGE}"
    rf"|{SELF} (?:was|were|wasn't|weren't|have|haven't)(?: not| been)* given enough\b"
    rf"|there (?:is|are|was|were|'s|isn't|aren't) (?:simply |just |currently )?(?:no|not enough|insufficient|not sufficient|too little|not any|any|not)(?: [\w-]+){{0,2}}? {KNOWLEDGE}{HERE}|there (?:is|was|'s) nothing(?: (?:in|on|about|here|that|to go|given|said|known)\b|\s*$)"
    rf"|{SOURCE} (?:simply |just |unfortunately )?(?:(?:does not|doesn't|do not|don't|did not|didn't|never) (?:\w+ly )?(?:say|mention|state|contain|give|provide|cover|address|discuss|specify|tell|include|answer|explain|describe|offer|hold|name|reveal|indicate|support|allow|go into|touch|deal|have|supply|help|let)\b(?![^.!?]*\bbut\b)"
    rf"|(?:contains?|gives?|provides?|has|have|offers?|holds?) (?:no|nothing|too little|not enough|insufficient)\b|says? nothing\b|makes? no mention\b|is silent(?:\s*$| on\b| about\b| as to\b)|lacks?\b|(?:is|are) (?:not enough|insufficient|not sufficient|inadequate|too (?:short|thin|sparse|vague|limited|little))(?:\s*$| to\b))|nothing in {SOURCE} (?:addresses|answers|mentions|says|tells|covers|explains|states|speaks)\b"
    rf"|(?:insufficient|not enough|too little) (?:context|information|detail|data)\b|no (?:answer|reply|response|information|details?)(?: (?:from me|here)\b| (?:is|are|was|can be|could be|will be|has been)(?: \w+)? ?(?:available|possible|given|provided|offered|found|forthcoming)?(?: here| for this| to this| in (?:the|this)[^.!?]*| on this| about this| (?:from|with|by|on|based on)(?: the basis of)? {SOURCE}[^.!?]{{0,30}})?\s*$| (?:for|about|available|possible)\b)"
    # what is asked cannot be answered, or lies beyond the speaker
    rf"|(?:this|the|your|that|such an?|what you ask)(?: (?:kind|sort|type) of)? ?{THEME}?(?: [\w-]+){{0,3}} (?:cannot|can't|can not|could not|couldn't|will not|won't|must not|may not) (?:be )?(?:answered|processed|fulfil+ed|completed|addressed|handled|resolved|determined|given|honou?red|met|discussed|granted|provided|shared|disclosed|served|supported|continue|go ahead|proceed)\b"
    rf"|(?:this|the|your|that|such an?) {THEME}[^.!?]{{0,60}}\b(?:falls outside|is outside|lies outside|is beyond|goes beyond|lies beyond|violates|goes against|(?:is|was)(?: not|n't) (?:something|one|a (?:topic|subject|matter)) (?:i|we)|is off[- ]limits|isn't (?:something|one))\b"
    rf"|(?:the |your |this |that )?{THEME} (?:was |is |has been |had to be |must be |will be )?(?:declined|refused|denied|rejected|withheld|blocked|unavailable|impossible|not available|off[- ]limits)(?:\s*$| (?:as|because|since|due|under|here|at this|for (?:safety|policy|this|that|these|legal|privacy)|on (?:safety|policy|these|legal|those))\b)"
    rf"|(?:that|this|it|these|those)(?: one| {THEME})?(?:'s| is| are| was| falls| lies| goes| sits| remains)? (?:rather |well |far |somewhat |a bit |simply |just )?(?:(?:above|beyond|past|over|outside|out of|outside of) (?:my|our|what (?:i|we|this)|the scope|me\b|us\b)|over my head|off[- ]limits|not (?:my|our) (?:place|call|area|field|department))"
    rf"|(?:that|this|it)(?: one| {THEME})?(?:'s| is| isn't| was| wasn't) (?:not |hardly |never )?(?:something|anything|a (?:matter|question|topic|subject|thing|request)|one)(?: (?:on|about|for|to|with|in))?(?: (?:that|which|whom))? (?:i|we)(?:'m| am|'re| are| can| could| feel| will)?(?: not| never|n't|'t| prefer not| cannot| can't| won't)* ?(?:to )?(?:{READY}|{SPEECH}|{DECLINE}|{NOT})\b"
    rf"|it(?: is|'s| was| would| will| may| might)? ?(?:not|never|hardly|im|un|in)(?: be)? ?(?:possible|appropriate|permitted|allowed|right|safe|advisable|proper|able|acceptable|suitable|wise)(?: for (?:me|us|this \w+))?(?:\s*$| to (?:{SPEECH})\b)"
    rf"|(?:{SPEAKING}|to {SPEECH})(?: [\w-]+){{0,5}} (?:would|will|might|could|may|is|goes) (?:not )?(?:go|be|breach|violate|break|cross|exceed|against|beyond|outside|inappropriate|unwise|wrong)\b"
    rf"|(?:that|this|it) (?:is|remains) (?:strictly |highly )?(?:confidential|classified|privileged|restricted|private)\b(?=\s*$|.*\b(?:{SELF})\b)"
    # the rules of the speaker, no comment, or another subject
    rf"|(?:my|our) {RULES}[^.!?]{{0,30}} (?:do not|don't|does not|doesn't|will not|won't|cannot|can't|never) (?:let|allow|permit)\b|(?:my|our|the) {RULES}[^.!?]{{0,30}} (?:(?:do not|don't|does not|doesn't|will not|won't|cannot|can't|never) (?:let|allow|permit)|forbids?|prevents?|prohibits?|disallows?|bars?|keeps?|stops?) (?:me|us|this|that|it|such|{SPEAKING})\b"
    rf"|no comment\b|(?:my|our) (?:lips are sealed|hands are tied)\b|(?:let's|let us|please|kindly|can we|could we|why don't we|perhaps we (?:can|could|should))(?: \w+)? (?:talk about|move on|speak about|discuss|pick|choose|change|turn to|switch to|try)(?: to)? (?:something|another|a different|other|the (?:subject|topic))\b"
    r"|es tut mir leid|(?:leider )?(?:kann|darf) ich [^.!?]{0,60}nicht|ich (?:kann|darf|habe|weiß) [^.!?]{0,60}(?:nicht|keine)|je (?:ne |n')[^.!?]{0,40}pas|(?:je suis )?désolé|il (?:ne m'est pas|m'est im)possible|lo siento|no (?:puedo|es posible|tengo|dispongo)|mi dispiace|(?:purtroppo )?non (?:posso|è possibile|ho|dispongo|sono in grado)"
    r")"
)
APOLOGY = re.compile(rf"{SORRY}\b")
CLAUSE = re.compile(r"\s*(?:,|;|:| - | – |—)\s*(?:(?:so|and|hence|therefore|thus|which is why|meaning)\s+)?")
CONCLUSION = re.compile(rf"(?:\bso|\band|\bhence|\btherefore|\bthus|[;:—–]) (?:{SELF}\s*{UNABLE}(?: (?:to|be|been|really|simply|just))* (?:{SPEECH}|{READY}|{SPEAKING})\b|{SELF}(?:'m| am|'re| are)? ?{HAVE_TO}?{DECLINE}\b|no (?:answer|reply|response) (?:is|can)|(?:this|that|it)(?: one)? {SELF} {NOT})[^,;]{{0,60}}$|\bbecause {SELF}\s*{UNABLE} {SEEK}$|[;,] this (?:one|topic) {SELF} {NOT}")
COURTESY = re.compile(
    r"^(?:is there (?:something|anything)|let me know|please\b|try\b|this falls|that falls|you (?:may|can|could|might|should|would)\b|feel free|thank|i hope|(?:i am|i'm) (?:sorry|happy|glad)|sorry|apologies|how (?:else|can|may)|what else|"
    r"(?:would|do|could|can|shall|may) (?:you|i|we)\b|if you\b|perhaps\b|maybe\b|instead\b|consult|ask\b|contact|see the|refer|i (?:can|could|would|'d)\b)|\b(?:my|our|the|these|its) (?:guidelines?|polic(?:y|ies)|rules?|scope|instructions?)\b"
)
LEAD_INS = frozenset("answer the question is you asked q a query response here again my your to this was as follows repeat ask asks".split())

OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“", "‹": "›"}
TOKEN = re.compile(r"```|~~~|</?[a-zA-Z][^<>]*>|<[a-zA-Z/][^<>]*$|[()\[\]{}“”«»„‹›\"]|[.!?…。！？]+(?=[\s\"'”’»)\]]|$)")
NOTE = re.compile(r"(?:\s*(?:\[[^\[\]]{1,60}\]|\([^()]{1,80}\)|[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡]+))+\s*$")
NOTE_ENDS = frozenset("])¹²³⁴⁵⁶⁷⁸⁹⁰*†‡")
ENDED = re.compile(r"[.!?…。！？][\"'”’»›)\]}*_]*$")
CLOSED_BLOCK = re.compile(r"(?:```|~~~|</[a-zA-Z]+>|\|)\s*$")
ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]|\(?[a-z][.)])\s+\S")


def is_empty(passage: str | None) -> bool:
    """Nothing, nothing visible, markup without text, or a mere placeholder."""
    if passage is None:
        return True
    if "<" not in passage and "&" not in passage and sum(map(len, WORDS.findall(passage, 0, 200))) > 40:
        return False  # without markup these letters and digits alone are longer than any placeholder
    bare = MARKUP.sub(" ", INVISIBLE.sub(" ", passage)).strip()
    if not WORDS.search(bare):
        return True
    return len(bare) <= 40 and " ".join(re.sub(r"[^\w/ ]+", " ", bare.casefold()).split()) in PLACEHOLDERS


def refuses(sentence: str) -> bool:
    """Whether a sentence declines, by how it begins or by the conclusion it draws."""
    bare = sentence.rstrip(" .!?")
    if REFUSING.match(bare):
        return True
    end = CLAUSE.search(bare)
    return end is not None and bool(REFUSING.match(bare[: end.start()]) or CONCLUSION.search(bare))


def is_refusal(passage: str) -> bool:
    """The passage as a whole declines, by the refusal grammar; one that goes on with an answer does not."""
    text = " ".join(passage.replace("’", "'").casefold().split()).strip(" \"'“”«»*_()[]")
    for mark in ("answer:", "a:", "response:", "assistant:"):
        text = text.removeprefix(mark).lstrip()
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text) if x]
    if not sentences or not refuses(sentences[0]) and not (len(sentences) > 1 and APOLOGY.match(sentences[0]) and refuses(" ".join(sentences[:2]))):
        return False
    return all(COURTESY.search(x) or refuses(x) for x in sentences[1:])


def tiled(passage: list[str], query: list[str], least: int = 3) -> list[bool]:
    """Which passage words are covered by greedy string tiling with the query; the query may be used again, for a copy may repeat it."""
    covered = [False] * len(passage)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(query):
        places.setdefault(w, []).append(j)
    while True:
        size, starts = 0, []
        for i, w in enumerate(passage):
            if covered[i]:
                continue
            for j in places.get(w, ()):
                n = 0
                while i + n < len(passage) and j + n < len(query) and not covered[i + n] and passage[i + n] == query[j + n]:
                    n += 1
                if n > size:
                    size, starts = n, []
                if n == size and n and (not starts or i >= starts[-1] + n):
                    starts.append(i)
        if size < min(least, len(query)) or size == 0:
            return covered
        for start in starts:
            covered[start : start + size] = [True] * size


def plain_words(text: str) -> list[str]:
    return WORDS.findall("".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)))


def is_copy(query: str | None, passage: str) -> bool:
    """Only the query again: the tiles cover all of the passage but lead-in words, and all of the query's words occur."""
    if not query:
        return False
    asked, said = plain_words(query), plain_words(passage)
    if not asked or not said:
        return False
    if not set(said) - set(asked) <= LEAD_INS:
        return False
    missing = Counter(asked) - Counter(said)
    if sum(missing.values()) > 0.15 * len(asked):
        return False
    loose = [w for w, hit in zip(said, tiled(said, asked)) if not hit]
    return len(loose) <= 6 and all(w in LEAD_INS for w in loose)


def script_of(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names."""
    if text.isascii():
        return "LATIN"
    found: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found["LATIN" if c < "ɐ" else unicodedata.name(c, "?").split()[0]] += n
    return found.most_common(1)[0][0] if found else "LATIN"


Evidence = dict[str, tuple[tuple[str, float], ...]]


def evidence(lists: dict[str, frozenset[str]]) -> tuple[Evidence, Evidence]:
    """What each word says about the language, of passages and of questions; a word that several languages share says less for each of them."""
    asked = {lang: known | frozenset(ASKING.get(lang, ())) for lang, known in lists.items()}
    out = []
    for by in (lists, asked):
        holders: dict[str, list[str]] = {}
        for lang, known in by.items():
            for w in known:
                holders.setdefault(w, []).append(lang)
        out.append({w: tuple((lang, 1 / len(langs)) for lang in langs) for w, langs in holders.items()})
    return out[0], out[1]


def language_of(text: str, known: Evidence, question: bool) -> str | None:
    """The language whose words are most frequent; None where the evidence is thin."""
    words = WORDS.findall(text.lower())
    scores: dict[str, float] = {}
    for w in words:
        for lang, n in known.get(w, ()):
            scores[lang] = scores.get(lang, 0.0) + n
    if question and "¿" in text:
        scores["es"] = scores.get("es", 0.0) + 3
    if not scores:
        return None
    order = sorted(scores.items(), key=lambda x: -x[1])
    (lang, most), second = order[0], order[1][1] if len(order) > 1 else 0
    if question:
        return lang if most >= 1 and most > 1.2 * second else None
    return lang if most >= 3 and most >= 0.1 * len(words) and most >= 1.3 * second else None


# Markup that has to be closed; other names in angle brackets are text, and items, rows, cells and paragraphs end with what holds them.
PAIRED = frozenset("a abbr article b blockquote body caption center cite code del details div dl em fieldset figure font form h1 h2 h3 h4 h5 h6 header html i ins kbd label main mark nav ol pre q s samp section small span strike strong sub summary sup table tbody tfoot thead tt u ul var".split())
DANGLING = re.compile(r"(?:[,:;(\-–]|\b(?:and|or|the|of|such as|a|an|to|in|with|for|by|from|is|are))$")
BARE_ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]|\(?[a-z][.)])\s*$")


def list_breaks_off(lines: list[str]) -> bool | None:
    """Whether the list at the end of a passage breaks off; None if it does not end in a list of two items or more.

    Items are pushed by their indent, and what stands deeper ends before an item further out. The last item may go without a full stop if its
    forerunners on its level do.
    """
    levels: list[tuple[int, list[str]]] = []
    for line in lines:
        indent = len(line) - len(line.lstrip())
        if ITEM.match(line) or BARE_ITEM.match(line):
            while levels and levels[-1][0] > indent:
                levels.pop()
            if not levels or levels[-1][0] < indent:
                levels.append((indent, []))
            levels[-1][1].append(line.strip())
        elif levels and indent > levels[-1][0]:
            levels[-1][1][-1] += " " + line.strip()  # an item goes on
        else:
            levels = []
    if not levels or len(levels) == 1 and len(levels[0][1]) < 2:
        return None
    *earlier, last = levels[-1][1]
    if BARE_ITEM.match(last) or DANGLING.search(last):
        return True
    return bool(earlier) and all(ENDED.search(x) for x in earlier) and not ENDED.search(last)


def is_truncated(passage: str) -> bool:
    """A pushdown parse of fences, markup, brackets, quotations and lists: the passage breaks off if it ends inside a fence, a tag or markup that has
    to be closed, if something opened in the last sentence is left open, if its last list breaks off, or if the last sentence has no end."""
    text = passage.strip()
    body = NOTE.sub("", text) if text[-1:] in NOTE_ENDS else text
    if body and ENDED.search(body):
        end = len(body)
    elif CLOSED_BLOCK.search(text):
        end = len(text)
    elif ENDED.search(text) or text.endswith(">") and ENDED.search(re.sub(r"(?:</[a-zA-Z][^<>]*>\s*)+$", "", text).rstrip()):
        end = len(text)
    else:
        broken = list_breaks_off([x for x in text.splitlines() if x.strip()])
        if broken is None or broken:
            return True
        end = len(text)
    stack: list[tuple[str, int]] = []
    sentence_end = 0
    for m in TOKEN.finditer(text, 0, end):
        t = m[0]
        if stack and stack[-1][0] in ("```", "~~~"):
            if t == stack[-1][0]:
                stack.pop()
            continue
        if t in ("```", "~~~"):
            stack.append((t, m.start()))
        elif t == '"':
            if stack and stack[-1][0] == '"':
                stack.pop()
            else:
                stack.append((t, m.start()))
        elif t in OPENERS:
            stack.append((OPENERS[t], m.start()))
        elif stack and t == stack[-1][0]:
            stack.pop()
        elif t[0] in ".!?…。！？" and m.end() < end - 3:
            sentence_end = m.end()
        elif t[0] == "<" and not t.endswith(">"):
            return True
        elif t[0] == "<":
            name = re.match(r"</?([a-zA-Z][\w-]*)", t)[1].lower()
            if name not in PAIRED or t.endswith("/>"):
                continue
            if t[1] != "/":
                stack.append((f"</{name}>", m.start()))
            elif f"</{name}>" in (want for want, _ in stack):
                while stack.pop()[0] != f"</{name}>":
                    pass
    return any(want in ("```", "~~~") or want[0] == "<" or at >= sentence_end > 0 for want, at in stack)


class Judge:
    """Judges pairs; what hangs on the passage alone is remembered, for a passage answers several queries."""

    def __init__(self, lists: dict[str, frozenset[str]]):
        self.known, self.known_asked = evidence(lists)
        self.of_passage = lru_cache(maxsize=2048)(self._of_passage)

    def _of_passage(self, passage: str | None) -> tuple[str | None, str | None, bool]:
        """A defect by the passage alone, its language, and whether it breaks off."""
        if is_empty(passage):
            return "empty", None, False
        if is_refusal(passage):
            return "refusal", None, False
        return None, language_of(passage, self.known, question=False), is_truncated(passage)

    def __call__(self, query: str | None, passage: str | None) -> str | None:
        """The one defect of a pair, or None for a sound one."""
        plain, said, broken = self.of_passage(passage)
        if plain:
            return plain
        if is_copy(query, passage):
            return "copied"
        if query:
            if len(passage) >= 12 and script_of(query) != script_of(passage):
                return "language"
            asked = language_of(query, self.known_asked, question=True) if said else None
            if said and asked and said != asked:
                return "language"
        return "truncated" if broken else None


def find_defects(pairs: DataFrame, common_words: DataFrame, key: str = "pair_id", query: str = "query", passage: str = "passage") -> DataFrame:
    """(key, defect) of every defective pair, once however often it was delivered.

    A null passage is empty; a null query can be neither copied nor answered in another language. The pairs are judged row by row and only the
    defective ones (id and defect) are shuffled to drop repeated deliveries. An empty table gives an empty result; other columns are ignored.
    `common_words` (word, lang) is a fixed list of at most 100,000 words; rows with a null in it are ignored.
    """
    rows = common_words.select("word", "lang").where("word is not null and lang is not null").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words is not a word list")
    lists: dict[str, set[str]] = {}
    for r in rows:
        lists.setdefault(r.lang.lower()[:2], set()).add(r.word.lower())
    frozen = {k: frozenset(v) for k, v in lists.items()}

    @F.pandas_udf("string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        defect_of = Judge(frozen)
        for asked, said in batches:
            yield pd.Series([defect_of(q, p) for q, p in zip(asked, said)], dtype=object)

    judge = judge.asNondeterministic()  # else the filter below runs it a second time
    judged = pairs.select(pairs[key].alias(key), judge(pairs[query], pairs[passage]).alias("defect"))
    return judged.where("defect is not null").dropDuplicates([key])
