import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nearfield.llm import markup as M
from nearfield.llm import residue as R
from nearfield.llm.queries import p8_found, p8_kinds
from tests.oracle import DATA

PROSE = "The council of Velby restored 40 plots behind the flute and kept the amber for itself. Visitors reach the chronicle by a path. "


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("'''Bold''' and [[target page|shown]] [[same]]s", "bold and shown sames"),
        ("a<ref name=x>note, 1924</ref> b<ref name=y/> c", "a b c"),
        ("a <!-- hidden --> b {{citation needed|date={{x}}}} c", "a b c"),
        ("café CAFÉ café straße", "cafe cafe cafe strasse"),
        ("soft­hyphen zero​width", "softhyphen zerowidth"),
        ("[http://x.org/a label] http://y.org &amp; &nbsp;z", "label z"),
        ("one\n two,\tthree—four <b>fi</b>ve<br/>six", "one two three four five six"),
        ("[[Category:Hidden]] [[File:a.jpg|thumb|caption]] shown", "shown"),
        ("", ""),
        ("'' ''' <ref>", ""),
    ],
)
def test_words_are_what_a_reader_sees(text, words):
    assert " ".join(M.words(text)) == words


RESIDUE = {
    "placeholder": [
        "'''{{{name}}}''' is a {{{type|}}} in {{{district}}}.",
        "'''${title}''' is a village in ${district}.",
        "<%= page.title %> is a species described by <%= author %>.",
        "{% for row in item.facts %}* {{ row.label }}\n{% endfor %}",
        "'''{0}''' is a river in {1}. It is {2} km long.",
        "Dear {first_name}, the page was created on {date:%Y}.",
        "X is a %TYPE% in the %DISTRICT%.",
        "X est une commune de $DEPARTEMENT, de $HABITANTS habitants.",
        "X es un municipio de :provincia: con :habitantes: habitantes.",
        "X ist ein Ort in __LANDKREIS__ mit __EINWOHNER__ Einwohnern.",
        "X is a <<TYPE>> of <<REGION>>.",
        "'''[INSERT NAME HERE]''' is a [type of place] in [region]. [Add one or two sentences.]",
        "X is a moth of the family #N/A. It was described by #REF! in #VALUE!.",
        "X (born undefined) is a undefined from [object Object].",
        "X is a village in the None district of nan.",
        "X is a hamlet of XX inhabitants in TBD, YY km from ZZZ.",
        "'''X''' is a in the district of , . It covers  km² and had inhabitants in .",
        "{{Infobox place\n| name = {{{1}}}\n| area = @@AREA@@\n| elevation = @@ELEV@@\n}}",
    ],
    "filler": [
        "Lorem ipsum dolor amet egest libra quoda lorem ipsum dolor mattor pharel.",
        "text text text text, text text. text text text text, text text.",
        "Sample paragraph. Sample paragraph. Sample paragraph.",
        "This is placeholder text. Replace it with the introduction of the page.",
        "TODO: write this section. TODO: add sources.",
        "Hier steht später ein Blindtext. Er füllt den Platz, bis der richtige Text geliefert wird.",
        "TEXTO DE RELLENO. SUSTITUIR POR EL ARTÍCULO DEFINITIVO.",
        "Bold text\nItalic text\nHeadline text\n* List item\n# Numbered entry\nInsert formula here",
    ],
    "error": [
        "502 Bad Gateway\n\nThe front server got no valid reply. Request id: d9bb629a",
        "Lua error in Module:X at line 8612: attempt to index field 'args' (a nil value).",
        'Traceback (most recent call last):\n  File "render.py", line 6837, in expand\nKeyError: \'2493a2ca\'',
        "<html><head><title>404 Not Found</title></head><body><h1>Not Found</h1><p>The page /w/X was not found on this server.</p></body></html>",
        '{"error":{"code":"missingtitle","info":"The page you specified doesn\'t exist."}}',
        "Diese Seite ist derzeit nicht erreichbar. Fehler 7814: Zeitüberschreitung beim Laden.",
        "Страница временно недоступна. Внутренняя ошибка сервера, код 7552.",
    ],
    "script": [
        "Please enable JavaScript in your browser to view this page.",
        "JAVASCRIPT IS DISABLED. FOR A BETTER EXPERIENCE, SWITCH IT ON BEFORE YOU CONTINUE. LOADING …",
        "<noscript>This reader only works with scripts turned on. Change your settings and reload.</noscript>{{stub}}",
        "Bitte aktivieren Sie JavaScript, um den Artikel zu lesen.",
        "Loading…\n\nIf the text does not appear, script blocking may be active on your device.",
    ],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in RESIDUE.items() for t in ts])
def test_residue_as_text_section_and_wrapped(kind, text):
    for t in (text, f"{PROSE}\n\n== History ==\n{text}\n\n[[Category:X]]", f"{PROSE}\r\n\r\n== History ==\r\n{text}\r\n\r\n{PROSE}", f'<div class="box">{text}</div>'):
        assert R.judge(t, 0) is not None, t
    assert R.judge(text, 0)[1] == kind
    assert R.judge(text, 10) is None


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        " \n ",
        PROSE,
        PROSE + "Printers used a filler text, often called lorem ipsum, to show a typeface.",
        PROSE + "In the template language the form <code>${name}</code> marks a value that is filled in later.",
        "The parameter is written <nowiki>{{{1|}}}</nowiki> and may be left out. " + PROSE,
        PROSE + '\n\n<pre>\nif error == 503 then retry("X") end\nprint("%s has %d items")\n</pre>\n' + PROSE,
        'Some early sites asked visitors to "enable JavaScript" before the map would load, a habit criticised by many. ' + PROSE,
        'Web servers of the era answered with "404 Not Found" when a page was missing; ' + PROSE,
        "A placeholder name such as XX or N.N. was entered in the register when the father was unknown.",
        "Nan and None are hamlets of Melseley; Nan has 36 inhabitants.",
        "hahaha hahaha hahaha hahaha hahaha hahaha",
        "#REDIRECT [[Error 404]]",
        "{{Infobox river\n| name = X\n| population = 33960\n}}\n\n" + PROSE,
        "'''X''' is a village in the Vorulen district of Y. In 2003 it had 3588 inhabitants.{{stub}}",
    ],
)
def test_content_is_no_residue(text):
    assert R.judge(text, 0) is None


def test_long_texts_are_read_to_the_end():
    assert R.judge(PROSE * 20_000 + "\n\n== Notes ==\nPlease enable JavaScript in your browser to view this page.", 0)[0] == 1


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "TODO: write this section.", 0, "x"), (1, "TODO: write this section.", 0, "x"), (None, "TODO: write this section.", None, None), (2, None, 0, "y"), (3, "TODO: write this section.", 10, "z"), (4, PROSE, 0, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, namespace_id int, kind string")
    assert sorted((r["doc_id"] or 0) for r in R.find_residue(df).collect()) == [0, 1, 1]
    assert [r["doc_id"] for r in R.without_residue(df.where("doc_id is not null")).orderBy("doc_id").collect()] == [2, 3, 4]
    assert R.find_residue(df.limit(0)).count() == 0


def test_queries(spark):
    assert 0 < p8_found(spark, DATA).count() == p8_kinds(spark, DATA).select("doc_id").distinct().count()


#: Sentences that rules of the module mark.
MARKED = [
    "%USERNAME% is a village.",
    "%UNIT% of %MUNICIPALITY%",
    "{{site.name}} lies in {{page.region}}.",
    "Здесь будет текст.",
    "Здесь должен быть текст.",
    "Образец текста.",
    "Insert formula here",
    "Scripts are disabled.",
    "Scripts must be enabled.",
    ":name: is a village.",
    "X est un en Y, born in, the d.",
    "ſcriptſ are diſabled.",
    "PLEASE ENABLE JAVASCRİPT.",
]


@pytest.mark.parametrize("text", MARKED)
def test_marked_sentences_are_residue(text):
    assert R.kind_of(text) and R.judge(text, 0) is not None


@pytest.mark.parametrize("text", [s for ts in RESIDUE.values() for t in ts for s in R.SENTENCE.split(t)] + MARKED)
def test_rules_that_match_are_never_passed_over(text):
    for t in (text, text.upper(), text.lower()):
        assert all(R.rules_of(t) & bit for p, bit in R.RULES.items() if p.search(t))
        assert R.kind_of(t, R.rules_of(t)) == R.kind_of(t)


@pytest.mark.parametrize("rule", range(len(R.RULES)))
def test_every_rule_finds_its_literals_in_generated_matches(rule):
    pattern, bit = list(R.RULES.items())[rule]

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def run(text):
        assert R.rules_of(text) & bit

    run()


@pytest.mark.parametrize("text", [
    "Dear *|FNAME|*, welcome to *|COMPANY|*.",
    "[First Name] [Last Name] was born in the town.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem.",
    "Our site is down for maintenance.",
    "ERR_CONNECTION_TIMED_OUT",
    "This site can't be reached.",
    "Hello %s, you have %d messages.",
    "Content goes here.",
    "HTTP 503 Service Unavailable",
    "Status code: 502",
    "Seite nicht gefunden",
    "Página no encontrada.",
    "Dear «FIRST_NAME», your order has shipped.",
    "{{ page.title }} is a village.",
    "Hello {name}, welcome.",
    "Please enable JavaScript to view this page.",
    "Undefined index: id in /var/www/x.php on line 3",
    "Страница не найдена",
    "Hello ${user.name}!",
    "Click here to edit this text.",
])
def test_residue_of_other_systems(text):
    assert R.judge(text, 0)


@pytest.mark.parametrize("text", [
    "In set notation {x} is a singleton.",
    "The code 4711 stands for a perfume from Cologne.",
    "The error of 1066 was to wait.",
    "In 1404 not far from here the castle was built.",
    "The town has a page in the book of 1503.",
    "He earned 50 %s of the shares [sic].",
    "JavaScript is a programming language.",
    "The lorem ipsum text is derived from Cicero's De finibus, a treatise on ethics, and printers have used it for centuries as dummy copy; this article explains its history in depth and its later use.",
    "The museum is open daily and closed on Mondays.",
    "The band released an album called 404 in 2009.",
    "The router {a, b} is in use.",
    "Route 404 was found to be closed in winter.",
])
def test_mentions_are_no_residue(text):
    assert not R.judge(text, 0)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["is", "a", "in", "the", "of", ".", ",", " ", "  ", "km", "(", ")", "–", "é", "\n", "\u00a0", "\u0130n", "\u0131n", "I\u017f", "had inhabitants", "By", ";", "\x1c", "\x0b"]), max_size=12).map("".join))
def test_gaps_are_never_passed_over(text):
    assert len(R.GAP.findall(text)) < 2 or R.may_have_gaps([text]) == [True]
