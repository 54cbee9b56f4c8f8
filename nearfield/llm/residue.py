"""Template residue, filler, error pages and script notices standing in a text instead of content.

A text is judged section by section. Code, literal and quoted blocks are taken out first, so examples and tutorials show
only their prose; then every sentence is tested by grammars for unfilled placeholders (one per delimiter), by gaps that
variables left, and by expressions for filler, errors and script notices. A section is residue if sentences so marked
make up most of it, or nearly all of one of its paragraphs: density, not mention, decides.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import markup

I = re.I  # noqa: E741

#: Grammar of unfilled variables by delimiter; one is enough to mark a sentence.
PLACEHOLDERS = {
    "triple_brace": re.compile(r"\{\{\{[^{}\n]*\}\}\}"),
    "double_brace": re.compile(r"\{\{\s+[\w.]+(?:\s*\|[^{}]*)?\s*\}\}|\{\{[a-z_]+\.[\w.]+[^{}]*\}\}", I),
    "statement": re.compile(r"\{%.*?%\}|<%.*?%>", re.S),
    "dollar_brace": re.compile(r"[$#]\{[^{}\n]+\}"),
    "brace": re.compile(r"(?<![{$#])\{(?:\d{1,2}|[a-z_][\w.]+(?::[^{}\s]*)?)\}(?!\})", I),
    "merge": re.compile(r"\*\|[A-Z_][A-Z_0-9:]*\|\*|«[^\W\d_]+_\w+»|\[(?:first|last|full|user|company|client|customer|recipient|sender|product|event|city|street|job)[ _-](?:name|address|number|title|date|id)\]", I),
    "printf": re.compile(r"(?<![\w%])(?<!\d )%(?:\d\$)?[sd]\b"),
    "percent": re.compile(r"(?<![\w%])%[A-Z][A-Z_0-9]+%(?!\w)", I),
    "dollar": re.compile(r"(?<![\w$])\$[A-Z][A-Z_]{2,}\b"),
    "at": re.compile(r"@@?[A-Z][A-Z_0-9]+@@?(?!\w)", I),
    "colon": re.compile(r"(?<![\w:])(?::[^\W\d_]{3,}:)(?![\w:])"),
    "underscore": re.compile(r"(?<!\w)__(?!(?:NO|FORCE)?TOC__|NOEDITSECTION__|(?:NO)?INDEX__)[^\W\d_][^\W_]*(?:_[^\W_]+)*__(?!\w)"),
    "angle": re.compile(r"<<[^<>\n]+>>|&lt;&lt;[^&\n]+&gt;&gt;"),
    "instruction": re.compile(r"(?<!\[)\[(?:insert|add|enter|type of|name of|your|describe|write|replace|choose|date|place|region|number|hier|ajouter|insérer|añadir|insertar|вставьте)\b[^\[\]\n]*\](?!\])", I),
    "spreadsheet": re.compile(r"#(?:N/A|REF!|VALUE!|DIV/0!|NAME\?|NULL!)", I),
    "object": re.compile(r"\[object object\]", I),
    "blank": re.compile(r"_{4,}|\.{6,}"),
}
#: Dummies that also are words or initials: two in one sentence, or one where only a value can stand.
DUMMY = re.compile(r"\b(?:XX+|YY+|ZZ+|NNN+|TBD|TBA|TBC|undefined|NaN|null)\b")
DUMMY_UPPER = re.compile(r"\b(?:UNDEFINED|NAN|NULL)\b")
DUMMY_VALUE = re.compile(r"\b(?:had|in the|district of|born|known for|is an?|is in|of the)\s+(?:nan|none|null|undefined)\b", I)
#: Gaps: an article or preposition with nothing behind it.
GAP = re.compile(r"\b(?:is|was|ist|war|est|es|fue)\s+(?:an?|the|eine?|une?|una)\s+(?:in|of|de|du|von|en)\b|\b(?:of|in|by|from|an?|the|im|von|de|du|del|en)\s*[,.;](?=[\s,.;]|\Z)|(?<=\w)  +(?:km|m|ha|inhabitants|einwohner|habitants|habitantes)\b|\bhad inhabitants\b|\(\s*[,;–-]?\s*\)", I)

FILLER = re.compile(
    r"\blorem ipsum\b|\bdolor sit amet\b|\b(?:text,? ){3,}text\b|\b(?:sample|dummy|filler|placeholder|example) (?:paragraph|content|text)\b(?! (?:is|was|are|often|to|for|in|of)\b)|\bthis is (?:placeholder|dummy|sample|filler) text|\bcaption for image \d|"
    r"\byour text (?:goes )?here\b|\b(?:bold|italic|headline) text\b|\blist item\b|\bnumbered entry\b|\binsert (?:formula|non-formatted text) here\b|\btodo\s*:|\bfixme\s*:|\bhier steht (?:später )?(?:ein )?(?:blind|platzhalter)?text\b|\bblindtext\b.*\bersetz|\bplatzhaltertext\b|"
    r"\bsed ut perspiciatis\b|\bat vero eos et\b|\bnemo enim ipsam\b|\b(?:content|copy|description) goes here\b|\b(?:enter|type|add|paste) (?:your |some )?text here\b|\bclick (?:here )?to (?:edit|add) (?:this |your )?text\b|\breplace this text\b|\btexte? (?:provisoire|de remplissage)\b|\bfaux texte\b|\btexto (?:de relleno|provisional|de ejemplo)\b|\bтекст-заполнитель|\bздесь (?:будет|должен быть) текст|\bобразец текста",
    I,
)
ERROR = re.compile(
    r"\b(?:40[0-9]|41[0-9]|42[0-9]|50[0-9])\b[\s:–-]*(?:not found|bad (?:gateway|request)|forbidden|unauthorized|service (?:temporarily )?unavailable|gateway time-?out|internal server error|too many requests|servicio no disponible|gone)|"
    r"\b(?:error|fehler|erreur|ошибка)\s*(?:n[.o°]*\s*)?\d{3,5}\b|\b(?:error|status|http|fehler|código(?: de error)?|code(?: d'erreur)?|код(?: ошибки)?)\W{0,3}(?:code\W{0,3})?[45]\d\d\b|\b(?:query |internal |fatal |server |database |syntax |runtime )error\b.*\b(?:occurred|at line|in)\b|\berror has occurred\b|\ban? (?:unexpected|unknown) error\b|\bbug in the software\b|\btechnical difficulties\b|"
    r"\bcannot access the database\b|\bcould not be (?:rendered|loaded|displayed)\b|\binternal server error\b|\bzeitüberschreitung\b|\bderzeit nicht erreichbar\b|\berreur interne\b|n'a pas pu être affichée?\b|\bno se puede mostrar\b|\bservicio no disponible\b|\bвременно недоступн|\bвнутренняя ошибка\b|"
    r"\baccess denied\b|\bdo not have permission to\b|\btoo many requests\b|\b(?:page|revision|file|article)\b.{0,80}\b(?:does not|doesn't) exist\b|\bmissingtitle\b|\btraceback \(most recent call last\)|^\s*file \".+\", line \d+|^\s*\w*(?:error|exception)\s*:\s*'|\blua error\b|\bexpression error\b|\bunrecognized word\b|"
    r"\bwas not found on this server\b|\b(?:down|offline|closed|unavailable) for (?:\w+ )?maintenance\b|\bERR_[A-Z_]+\b|\bDNS_PROBE_\w+|\bsite can(?:'|no)t be reached\b|\bconnection (?:has )?(?:timed out|was refused|was reset)\b|\bpage (?:cannot|could not|can't) be (?:found|displayed)\b|\bpage not found\b|\bseite (?:wurde )?nicht gefunden\b|\bpágina no encontrada\b|\bpage (?:introuvable|non trouvée)\b|\bстраница не найдена\b|\bundefined (?:index|variable|offset)\b\s*:|\bsegmentation fault\b|\bno valid reply\b|\bbad gateway\b|\"error\"\s*:\s*\{",
    I,
)
_SCRIPT_WORD = r"(?:java\s?scripts?|scripts?|scripting|script blocking|скрипт\w*)"
_SWITCH = r"(?:enabl\w+|activ\w+|actív\w+|aktivier\w+|einschalt\w+|eingeschaltet|turn(?:ed|ing)?|switch\w*|disabled|blocked|blocking|support|requir\w+|requier\w+|need|nécessit\w+|works?|off|включ\w+|отключ\w+)"
SCRIPT = re.compile(rf"\b{_SCRIPT_WORD}\b.*\b{_SWITCH}\b|\b{_SWITCH}\b.*\b{_SCRIPT_WORD}\b|<noscript\b", I)
#: Sentences that go with the above and say nothing alone.
COMPANION = re.compile(
    r"\bloading\b|\bfor a better experience\b|\bproceed to the\b|\bcannot be displayed without\b|\bchange your settings\b|\breload\w*|\btry (?:again|waiting)\b|\bwait and retry\b|\bvuelva a cargar\b|\brequest(?: |_)?id\b|\bquery id\b|\bréférence\b|\bsession has expired\b|\boutdated link\b|\byou have sent \d+ requests\b|\bfollowing reason\b|"
    r"\bwrite at least\b|\bcite a source\b|\breplace it with\b|\bsustituir por\b|\ber füllt den platz\b|\bsera ajouté plus tard\b|\badd (?:sources|picture|one or two)\b|\bwrite this section\b|\bthe page you (?:specified|requested)\b|\bla page demandée\b|\bla página solicitada\b|^\W*sorry\W*$|\bnot found\b|\bat line \d+|\bnil value\b|\bloadrevision\b|\bfunction:",
    I,
)
CODE = re.compile(r"<(pre|nowiki|code|syntaxhighlight|source|blockquote|tt)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | I)
REDIRECT = re.compile(r"\s*#\s*(?:redirect(?:ion|ión)?|weiterleitung|redirección|перенаправление)\b", I)
CATEGORY = re.compile(r"\[\[\s*(?:category|kategorie|categoría|catégorie|категория)\s*:[^\[\]]*\]\]", I)
PLAIN_TEMPLATE = re.compile(r"(?<!\{)\{\{(?![{\s])[^{}\n.]*\}\}(?!\})")
INFOBOX_FIELD = re.compile(r"^\|[ \t]*[\w ]+=[ \t]*(.*?)[ \t]*$", re.M)
INFOBOX = re.compile(r"\{\{\s*infobox\b(?:[^{}]|\{\{\{[^{}]*\}\}\}|\{\{[^{}]*\}\})*\}\}", re.S | I)
BLOCK_TAG = re.compile(r"</?(?:div|span|p|center|small|big|body|html|head|title|h\d|b|i|u|table|tr|td|br)\b[^<>\n]*>", I)
TITLE_LINE = re.compile(r"\A\s*'''[^'\n]+'''[ \t]*(?:\n|\Z)")
BLANK_LINE = re.compile(r"\n[ \t]*\n")
ONE_LINE = re.compile(r"(?<!\s)\n(?![\n*#|{%])")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n(?=[*#|{%])")
QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»|„[^“\n]{1,80}“")
#: Beginnings of the words of lorem ipsum and its imitations.
LATIN_FILLER = re.compile(r"\b(?:lorem|ips|dolor|amet|conse|adip|elit|tempo|tempu|magna|aliq|sodal|matt|phare|just|ornar|nibh|tell|aran|soli|sagit|vest|como|comm|dict|egest|veli|purv|puru|libr|libe|quod|nunc|memr|feror|plic)\w*", I)
#: Characters that are equal to others without case though lower() keeps them apart.
_SAME = {other: min(a, *b) for a, b in re._casefix._EXTRA_CASES.items() for other in (a, *b) if other != min(a, *b)}
_RARE = re.compile("[" + "".join(map(chr, _SAME)) + "]")


def _one_case(text: str) -> str:
    """The text with one character for all that expressions without case take for equal."""
    if text.isascii():
        return text.lower()
    text = text.replace("\u0130", "i").lower()
    return text.translate(_SAME) if _RARE.search(text) else text


def literals(pattern: re.Pattern) -> frozenset[str] | None:
    """Literals, in one case, of which every match holds one, taken from the expression itself; None if it has none of use."""

    def exact(op, value) -> list[str] | None:
        """The few texts that an item can match, if they are known."""
        if op is C.LITERAL:
            return [chr(value)]
        if op is C.IN and all(o is C.LITERAL for o, _ in value) and len(value) <= 4:
            return [chr(v) for _, v in value]
        if op is C.AT:
            return [""]
        if op in (C.ASSERT, C.ASSERT_NOT):
            return [""]
        if op is C.SUBPATTERN:
            return exacts(value[3])
        if op is C.BRANCH:
            each = [exacts(x) for x in value[1]]
            return None if any(e is None for e in each) else [t for e in each for t in e]
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] == 1 and (one := exacts(value[2])) is not None:
            return one + ([""] if value[0] == 0 else [])
        return None

    def exacts(items) -> list[str] | None:
        out = [""]
        for op, value in items:
            e = exact(op, value)
            if e is None or len(e) * len(out) > 64:
                return None
            out = [x + y for x in out for y in e]
        return out

    def worth(x) -> tuple:
        return min(map(len, x)), -len(x)

    def needed(items) -> list[str] | None:
        """Literals one of which stands in every match of the items: the best of their runs of known texts and of their parts."""
        offers, run = [], [""]
        for op, value in items:
            e = exact(op, value)
            if e is not None and len(e) * len(run) <= 64:
                run = [x + y for x in run for y in e]
                continue
            if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1 and (one := exacts(value[2])) is not None and len(one) * len(run) <= 64:
                run = [x + y for x in run for y in one]
            offers.append(run)
            run = e if e is not None and len(e) <= 64 else [""]
            if op is C.SUBPATTERN:
                offers.append(needed(value[3]))
            elif op is C.BRANCH:
                each = [needed(x) for x in value[1]]
                offers.append(None if any(e is None for e in each) else [t for e in each for t in e])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
                offers.append(needed(list(value[2]) * min(value[0], 8)))
        offers.append(run)
        offers = [o for o in offers if o and all(o)]
        return max(offers, key=worth) if offers else None

    C = re._constants
    found = needed(re._parser.parse(pattern.pattern, pattern.flags & ~re.U))
    return frozenset(map(_one_case, found)) if found else None


#: Expressions of kind_of, each with the bit that says a text may hold a match of it.
RULES = {p: 1 << i for i, p in enumerate((*PLACEHOLDERS.values(), DUMMY, DUMMY_UPPER, DUMMY_VALUE, GAP, LATIN_FILLER, FILLER, SCRIPT, ERROR))}
ALL_RULES = (1 << len(RULES)) - 1
_DUMMY, _DUMMY_UPPER, _DUMMY_VALUE, _GAP, _LATIN_FILLER, _FILLER, _SCRIPT, _ERROR = (RULES[p] for p in (DUMMY, DUMMY_UPPER, DUMMY_VALUE, GAP, LATIN_FILLER, FILLER, SCRIPT, ERROR))


@functools.cache
def _automaton() -> tuple[ahocorasick.Automaton, int]:
    """(automaton of the literals of all rules, bits of the rules without literals)."""
    bits: dict[str, int] = {}
    always = 0
    for p, bit in RULES.items():
        words = literals(p)
        if words is None or any(w.isalnum() or w in " ,.;" for w in words if len(w) == 1):  # literals that stand in any text
            always |= bit
        else:
            for w in words:
                bits[w] = bits.get(w, 0) | bit
    a = ahocorasick.Automaton()
    for w, bit in bits.items():
        a.add_word(w, bit)
    a.make_automaton()
    return a, always


def rules_of(text: str) -> int:
    """Bits of the rules that may match in a text or in any part of it: all others can't, for their literals are missing."""
    a, found = _automaton()
    for _, bit in a.iter(_one_case(text)):
        found |= bit
    return found


_ANY_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: GAP without what stands around a gap, for Arrow's faster expressions on texts in one case: it matches wherever GAP does, and more.
_GAP_ROUGH = r"\b(?:is|was|ist|war|est|es|fue)S+(?:an?|the|eine?|une?|una)S+(?:in|of|de|du|von|en)|\b(?:of|in|by|from|an?|the|im|von|de|du|del|en)S*[,.;]|  +(?:km|m|ha|inhabitants|einwohner|habitants|habitantes)|had inhabitants|\(S*[,;–-]?S*\)".replace("S", _ANY_SPACE)


def may_have_gaps(texts: list[str]) -> list[bool]:
    """Of each text whether it may hold two gaps."""
    return [n >= 2 for n in pc.count_substring_regex(pa.array(map(_one_case, texts), pa.string()), _GAP_ROUGH).to_pylist()]


#: Documents judged together.
_DOCUMENTS = 128
#: Share of a section's letters that must stand in marked sentences, or of the letters of one of its paragraphs.
DENSITY, BLOCK_DENSITY = 0.6, 0.85


@functools.cache
def _placeholders(rules: int) -> list[re.Pattern]:
    return [p for p in PLACEHOLDERS.values() if rules & RULES[p]]


def kind_of(sentence: str, rules: int = ALL_RULES) -> str | None:
    """What a sentence is, if it is residue by itself: placeholder, filler, error or script. rules are those that may match, see rules_of."""

    if not rules:
        return None

    if rules == _GAP:
        return "placeholder" if len(GAP.findall(sentence)) >= 2 else None
    if any(p.search(sentence) for p in _placeholders(rules)):
        return "placeholder"
    dummies = (DUMMY.findall(sentence) if rules & _DUMMY else []) + (DUMMY_UPPER.findall(sentence) if rules & _DUMMY_UPPER else [])
    if len(dummies) >= 2 or rules & _DUMMY_VALUE and DUMMY_VALUE.search(sentence) or rules & _GAP and len(GAP.findall(sentence)) >= 2:
        return "placeholder"
    latin = LATIN_FILLER.findall(sentence) if rules & _LATIN_FILLER else []
    if len(latin) >= 6 and len(latin) * 2 >= len(sentence.split()) or (rules & _FILLER and FILLER.search(sentence) and not re.search(r"\b(?:called|known as|such as|printers|typeface|genannt|appelé|llamado)\b", sentence, I)):
        return "filler"
    if rules & _SCRIPT and SCRIPT.search(QUOTED.sub(" ", sentence)):
        return "script"
    if rules & _ERROR and ERROR.search(sentence) and not re.search(r"\b(?:answered|replied|showed|displayed) with\b|\"\s*when\b|\bera\b", sentence, I):
        return "error"
    return None


def _letters(s: str) -> int:
    return sum(map(str.isalnum, s))


def _paragraphs(body: str) -> list[str] | None:
    """The paragraphs of a section that are judged sentence by sentence; None if it is an unfilled form."""
    form = INFOBOX.search(body)
    if form and (values := INFOBOX_FIELD.findall(form.group(0))):
        empty = sum(1 for v in values if any(p.search(v) for p in PLACEHOLDERS.values()))
        if empty >= 2 and empty * 2 > len(values):
            return None
    text = INFOBOX.sub(" ", body)
    text = CODE.sub(" ", text)
    text = BLOCK_TAG.sub(" ", PLAIN_TEMPLATE.sub(" ", CATEGORY.sub(" ", text)))
    rest = TITLE_LINE.sub("", text)
    if rest.strip():
        text = rest
    return [ONE_LINE.sub(" ", b) for b in BLANK_LINE.split(text)]


def _judge_paragraphs(paragraphs: list[str], gaps: list[bool]) -> tuple[str | None, float]:
    """(kind, share of the section that is residue); kind is None if the section has content."""
    # script notices are sought with quotes blanked, which puts no letters together
    tried = [rules_of(b) & (ALL_RULES if g else ~RULES[GAP]) for b, g in zip(paragraphs, gaps)]
    blocks = [[(s, kind_of(s, rules)) for s in SENTENCE.split(b)] for b, rules in zip(paragraphs, tried)] if any(tried) else []
    if not any(k for b in blocks for _, k in b):
        return None, 0.0
    kinds: dict[str, int] = {}
    total = residue = 0
    whole = 0.0
    for b in blocks:
        letters, marked, strong = 0, 0, False
        for s, k in b:
            n = _letters(s)
            letters += n
            if k:
                kinds[k] = kinds.get(k, 0) + max(n, 1)
                strong = True
            if k or COMPANION.search(s):
                marked += n
        total, residue = total + letters, residue + marked
        if strong:
            whole = max(whole, marked / letters if letters else 1.0)
    share = residue / total if total else 1.0
    return (max(kinds, key=kinds.get) if share >= DENSITY or whole >= BLOCK_DENSITY else None), max(share, whole)


def judge_all(texts: list[str | None], namespaces: list[int | None]) -> list[tuple[int, str, float] | None]:
    """(number of the first residue section, kind, share) of each text, or None. Template sources (namespace 10), redirects, empty and null texts are None."""
    sections: list[tuple[int, int, list[str] | None]] = []
    for d, (text, namespace) in enumerate(zip(texts, namespaces)):
        if text and namespace != 10:
            text = markup.plain_spaces(markup.lines(text))
            if not REDIRECT.match(text):
                sections += [(d, i, _paragraphs(body)) for i, body in enumerate(markup.sections(markup.COMMENT.sub("", text)))]
    gaps = iter(may_have_gaps([b for _, _, paragraphs in sections for b in paragraphs or ()]))
    found: list[tuple[int, str, float] | None] = [None] * len(texts)
    for d, i, paragraphs in sections:
        here = [next(gaps) for _ in paragraphs or ()]
        if found[d] is None:
            kind, share = ("placeholder", 1.0) if paragraphs is None else _judge_paragraphs(paragraphs, here)
            if kind:
                found[d] = i, kind, share
    return found


def judge(text: str | None, namespace: int | None) -> tuple[int, str, float] | None:
    """judge_all of one text."""
    return judge_all([text], [namespace])[0]


def find_residue(documents: DataFrame) -> DataFrame:
    """doc_id, section, kind, share: documents whose text, or the body of a section, is residue instead of content.

    One pass without a shuffle over whole texts. Rows that repeat give rows that repeat. A null doc_id is kept. A null namespace_id counts
    as a page. Null, empty and blank texts are no cases; other columns don't matter. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in range(0, b.num_rows, _DOCUMENTS):
                ids, texts, namespaces = (c.to_pylist() for c in b.slice(s, _DOCUMENTS).columns)
                rows += [(d, *r) for d, r in zip(ids, judge_all(texts, namespaces)) if r]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64()))], ["doc_id", "section", "kind", "share"])

    src = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("namespace_id").cast("int").alias("namespace_id"))
    return src.mapInArrow(run, "doc_id long, section int, kind string, share double")


def without_residue(documents: DataFrame) -> DataFrame:
    """Documents that find_residue doesn't name, all columns."""
    return documents.join(find_residue(documents).select("doc_id").distinct(), "doc_id", "left_anti")
