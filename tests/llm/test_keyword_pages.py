"""The automaton against brute force; pages of each kind."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rainloom.llm import keyword_pages as K


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=18), st.integers(1, 4))
def test_repeated_characters(text, least):
    count = Counter(text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1))
    for part in count:
        count[part] = sum(text.startswith(part, i) for i in range(len(text)))
    expected = bytearray(len(text))
    for i in range(len(text)):
        for j in range(i + least, len(text) + 1):
            if count[text[i:j]] > 1:
                expected[i:j] = b"\x01" * (j - i)
    assert K.repeated_characters(text, least) == expected


def test_windows_and_long_marks(monkeypatch):
    """Windows of the automaton, links and tags of any length, and many opening brackets in linear time."""
    monkeypatch.setattr(K, "WINDOW_CHARS", 500)
    assert K.is_keyword_page(K.page_shape(SPAM["keywords"] * 20))
    long = "x" * 3_000
    assert K.page_shape(f"[{long}](https://a.example/{long})").links > 6_000
    assert K.page_shape(f"<span title='{long}'>Nobody recalls why the gauge stopped in the rain.</span>").chars < 100
    monkeypatch.undo()
    assert not K.is_keyword_page(K.page_shape("[" * 200_000)) and not K.is_keyword_page(K.page_shape("<a " * 100_000))


PROSE = "The night shift reached the mast at dusk and found that the lens was wet. Nobody recalls why the gauge stopped in the rain. "
SPAM = {
    "keywords": "rain gauge buy online rain gauge best price rain gauge near me rain gauge review buy online rain gauge " * 4,
    "hashtags": "#raingauge #mastkit #bestprice #buyonline #rain_meter #wetterstation #dropcounter #cheapsensor " * 4,
    "urls": "\n".join(f"https://site{k}.example/rain-gauge/{k * 37}" for k in range(20)),
    "markdown": "\n".join(f"[rain gauge](https://site{k}.example/p{k})" for k in range(12)),
    "anchors": "\n".join(f'<a href="//site{k}.example/{k}">snow sensor</a>' for k in range(12)),
    "titles": "\n".join(f"» {a} {b} (more)" for a, b in zip(["Rain Gauge", "Mast Kit", "Snow Sensor"] * 5, ["Arvenfeld", "Rystad", "Colvane", "Dunmere", "Jorrand"] * 3)),
    "products": "\n".join(f"SKU-{1000 + k} rain meter mini tag: laser sensor, raindrop size, rain meter" for k in range(10)),
    "mixed": PROSE + "mast kit, rain meter, spare lens, mast kit, rain meter, spare lens, " * 20,
}
CLEAN = {
    "prose": PROSE * 5,
    "german": "Im Schauer stieg die Regenrate auf 39 mm pro Stunde, der mittlere Durchmesser lag bei 2.8 mm. " * 6,
    "table": "time,rain,laser\n" + "\n".join(f"2014-07-27T15:{k:02d},{k * 0.1:.3f},{18000 + k}" for k in range(30)),
    "settings": "\n".join(f"{a}_{b}: {c}" for a in ("max", "min", "use") for b in ("rain_rate", "visibility", "lens") for c in ("true", "null")),
    "bibliography": "References\n" + "\n".join(f"[{k}] On rain rate in light drizzle. Field Notes {k}, {k}-{k + 9}, 2001. https://a{k}.example/x" for k in range(12)),
    "changes": "Changes\n" + "\n".join(f"- Add the moment computation for the daily block (LPM, #{k})" for k in range(12)),
    "glossary": "\n".join(f"Rain rate {k}: Our estimate of the visibility rests on the drops and a flat fit." for k in range(8)),
    "links in prose": PROSE * 3 + " https://a.example/1 https://b.example/2",
    "short": "Thanks!",
    "wrapped": "<p>Say&nbsp;the<br/>&nbsp;rooftop&nbsp;unit&nbsp;near&nbsp;the&nbsp;mast samples&nbsp;every&nbsp;day&nbsp;while&nbsp;the&nbsp;rain&nbsp;falls&nbsp;on&nbsp;it.</p>" * 3,
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert K.is_keyword_page(K.page_shape(SPAM[name]))


@pytest.mark.parametrize("name", CLEAN)
def test_clean(name):
    assert not K.is_keyword_page(K.page_shape(CLEAN[name]))


def test_operator(spark):
    rows = [(1, SPAM["keywords"], 0.5), (2, None, 0.5), (None, SPAM["urls"], 0.5), (3, "", 0.5), (4, SPAM["keywords"] * 300, 0.5), (1, SPAM["keywords"], 0.5), (5, "x" * 200_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share double")
    assert sorted(r.doc_id for r in K.keyword_pages(df).collect()) == [1, 1, 4]
    assert K.keyword_pages(df.limit(0)).count() == 0


LINKED = {
    "fillers": " ".join(f"{a} {f} {b} {a}.".capitalize() for f in ("of", "the", "and", "for", "is") for a, b in [("rain gauge", "mast kit"), ("mast kit", "spare lens"), ("spare lens", "rain gauge"), ("snow sensor", "mast kit")]),
    "function words in keywords": "taille des gouttes, kit de mât, livraison gratuite, kit de mât, taille des gouttes, pas cher, livraison gratuite, " * 6,
    "after prose": PROSE + "\n\n" + " ".join(f"{a} {f} {b} {b}." for f in ("of", "the", "and", "for", "is", "with") for a, b in [("Rain gauge", "mast kit"), ("Mast kit", "spare lens"), ("Spare lens", "rain gauge")]),
}
TEMPLATES = {
    "one template": "\n".join(f"In {a} the {b} was replaced after the front had passed, then the unit resumed its records." for a in ("Rystad", "Colvane", "Dunmere", "Jorrand") for b in ("mast", "lens", "heater", "clock")),
    "numbers": "\n".join(f"The sensor counted {k * 17} drops in {k} minutes, less than the gauge on the roof." for k in range(40)),
    "some stuffing": PROSE * 8 + "Rain gauge of mast kit rain gauge. Mast kit for rain gauge mast kit. Rain gauge is mast kit mast kit. Mast kit the rain gauge rain gauge.",
}


@pytest.mark.parametrize("name", LINKED)
def test_keywords_linked_by_function_words(name):
    shape = K.page_shape(LINKED[name])
    assert K.is_keyword_page(shape) and shape.share > 0.5


@pytest.mark.parametrize("name", TEMPLATES)
def test_repeated_templates_are_no_stuffing(name):
    assert not K.is_keyword_page(K.page_shape(TEMPLATES[name]))
