"""Reading wiki markup: what a reader sees of a text, its words, and its sections."""

from __future__ import annotations

import html
import re
import unicodedata

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
REF = re.compile(r"<ref\b[^<>]*?/\s*>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
TAG = re.compile(r"</?[a-z][^<>\n]{0,300}>", re.I)
INLINE_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|span|small|big|sub|sup|font|nowiki|code|tt|abbr|bdi|mark)\b[^<>\n]{0,300}>", re.I)
TEMPLATE = re.compile(r"\{\{(?!\{)[^{}]*\}\}")
#: Templates that show text arguments in place: all unnamed arguments (quotes, typography), the first one, or the last one.
SHOWS_ALL = re.compile(
    r"(?:block|block |long |pull |centered pull |poem |poem|box |talk |verse |c|r|b|imagequote|)quot(?:e|ation)s?(?: ?box\d?|block)?|pullquote|verse translation|epigraph|tq2?|qq?|zitat(?:-\w+)?|blockzitat|(?:début )?citation(?: bloc| encadrée| étrangère)?|cita(?: destacada| bloque| en bloque)?|цитата|начало цитаты|врезка|"
    r"nowrap|nobr|no wrap|small(?:er|caps)?|larger?|big(?:ger)?|center(?:ed)?|centre|left|right|nobold|noitalic|strong|em|bold|italics?|sc|mono|code|kbd|var|samp|underline|overline|strikethrough|sup|sub|lead|highlight"
)
SHOWS_FIRST = re.compile(r"abbr|tooltip|ill|interlanguage link|lang-[\w-]+|hover title|anchored")
SHOWS_LAST = re.compile(r"lang|langue|lien|transl|transliteration|colou?r|font colou?r|resize|script|language|nihongo2|visible anchor")
#: A named argument, and the names under which a template takes its text.
NAMED = re.compile(r"\s*([\w -]{1,40}?)\s*=(.*)", re.S)
TEXT_KEYS = frozenset("1 2 3 text quote content quotation texte citation texto cita текст цитата zitat".split())
FILE_LINK = re.compile(r"\[\[(?:file|image|datei|bild|archivo|imagen|fichier|файл|category|kategorie|categoría|catégorie|категория)\s*:[^\[\]]*\]\]", re.I)
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
URL_LINK = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]*\s*([^\[\]\n]*)\]|\[mailto:\S+\s*([^\[\]\n]*)\]", re.I)
BARE_URL = re.compile(r"\bhttps?://[^\s<>\[\]|]+", re.I)
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿͏؜᠎]")
HEADING = re.compile(r"^[ \t]*={1,6}[^=\n]+={1,6}[ \t]*$", re.M)
QUOTES = re.compile(r"'{2,}")
NOT_WORD = re.compile(r"[\W_]+")
_COMPACT_NFKD = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d"})


def balanced(text: str, pattern: re.Pattern, to) -> str:
    """Replace a bracketed form from the innermost outwards, as long as any is left."""
    while True:
        text, n = pattern.subn(to, text)
        if not n:
            return text


def _template(inner: str, aside: list[str]) -> str:
    """What a template without templates inside shows in place; its other arguments go to aside."""
    name, *rest = LINK.sub(r"\1", FILE_LINK.sub(lambda m: _caption(m.group(0), aside), inner)).split("|")
    name = " ".join(name.replace("_", " ").split()).casefold()
    if not rest:
        return " "
    kept, texts = [], []
    for a in rest:
        m = NAMED.match(a)
        key = m.group(1).strip().casefold() if m else None
        (texts if key is None or key in TEXT_KEYS else kept).append(m.group(2) if m else a)
    if SHOWS_FIRST.fullmatch(name):
        shown, kept = texts[:1], kept + texts[1:]
    elif SHOWS_LAST.fullmatch(name):
        shown, kept = texts[-1:], kept + texts[:-1]
    elif SHOWS_ALL.fullmatch(name):
        shown = texts
    else:
        shown, kept = [], kept + texts
    aside += kept
    return f" {' '.join(shown)} "


def _caption(link: str, aside: list[str]) -> str:
    """A file or category link shows nothing in place; its parts behind the name go to aside."""
    aside += link[2:-2].split("|")[1:]
    return " "


def visible(text: str) -> str:
    """The running text without comments, footnotes, tags, link targets, category and file links, and invisible characters. Of templates only those that show their text in place leave it."""
    return parts(text)[0]


def parts(text: str) -> tuple[str, list[str]]:
    """(running text, see visible; texts that stand beside it: captions, and arguments of templates that show nothing in place)."""
    aside: list[str] = []
    if "<" in text:
        text = REF.sub(" ", COMMENT.sub("", text))
    if "{{" in text:
        text = balanced(text, TEMPLATE, lambda m: _template(m.group(0)[2:-2], aside))
    if "[[" in text:
        text = LINK.sub(r"\1", FILE_LINK.sub(lambda m: _caption(m.group(0), aside), text))
    return _plain(text), [_plain(a) for a in aside]


def _plain(text: str) -> str:
    if "//" in text or "mailto:" in text:
        text = BARE_URL.sub(" ", URL_LINK.sub(lambda m: m.group(1) or m.group(2) or " ", text))
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return QUOTES.sub("", INVISIBLE.sub("", text))


def fold(text: str) -> str:
    """Lower case without accents, ligatures split."""
    text = text.casefold()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text).translate(_COMPACT_NFKD)
    return "".join(c for c in text if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Words as a reader would compare them: what is visible, folded, cut at everything but letters and digits."""
    return _cut(visible(text))


def passages(text: str) -> list[list[str]]:
    """Words of the running text, then of each text beside it."""
    running, aside = parts(text)
    return [_cut(running), *map(_cut, aside)]


def _cut(text: str) -> list[str]:
    return NOT_WORD.sub(" ", fold(text)).split()


def lines(text: str) -> str:
    """The text with one kind of line end."""
    return re.sub(r"\r\n?|[\u2028\u2029\x85]", "\n", text)


SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\t]")


def plain_spaces(text: str) -> str:
    """The text with one kind of space and without invisible characters."""
    return text if text.isascii() and "\t" not in text else INVISIBLE.sub("", SPACES.sub(" ", text))


def sections(text: str) -> list[str]:
    """Bodies of the lead and of each section; headings are left out."""
    return HEADING.split(text)
