"""Pages made of repeated keywords, links or tags instead of sentences or data.

Lines of a page are told apart by their structure: clauses (function words between content words), data
(fields with numbers, key and value, code), links and tags, and bare phrases. Clauses whose function words
only link the same few repeated words count as bare phrases. What has no clause structure goes, character
by character, through a suffix automaton, which tells in linear time which characters stand in substrings
that the page repeats. A page is found if links, tags and bare phrases make up most of it and repeated
substrings cover them. Every page is judged by itself in one scan, whole, so nothing is shuffled.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """a an the of and or but not in on at by for from with into over under between through after before until since
    during while when where which that this these than then as if so because is are was were be been has have had do does
    did will would can could should may no only its their they he she we our you i
    der die das den dem des ein eine einen einem einer und oder aber nicht auch noch nur im am an auf aus bei mit nach von
    vom vor zu zum zur für über unter durch gegen ohne bis seit wie wenn dass weil ist sind war wird wurde wurden werden hat
    haben es er sie wir ihre sich
    le la les l un une du de d et ou mais ne pas au aux en dans sur sous par pour avec sans vers entre depuis avant après
    que qui où ce cette il elle ils elles nous vous on se s sa son ses leur sont était étaient été être a ont plus puis
    el los las lo una y o pero del al con sin para desde hasta durante tras bajo sobre según como cuando que este esta es
    son era fue hay ha han había no se su sus más""".split()
)

#: Share of function words from which a line of at least LEAST_CLAUSE_WORDS words is a clause.
CLAUSE_SHARE, LEAST_CLAUSE_WORDS = 0.12, 5
#: A line with a link title's mark is one up to this many words; a longer one is judged as a sentence or phrase.
LONGEST_TITLE_WORDS = 8
#: Share of the page's characters that is links, tags and bare phrases.
LEAST_SHARE = 0.5
#: Share of the characters of links, tags and bare phrases that repeated substrings cover.
LEAST_REPEATED = 0.35
#: Characters of a repeated substring, at least.
LEAST_LENGTH = 8
#: The automaton takes about 400 bytes a character; what has no clause structure goes through it in windows of this many.
WINDOW_CHARS = 1_000_000
#: A clause only links keywords if repeated substrings cover at least this share of its characters, and most of
#: its content words stand in a stretch of this many with at most this share of different ones. Stretches run
#: over all clauses of the page but copies; with fewer words than LEAST_STRETCH there is none.
LINKED_SHARE, STRETCH, LEAST_STRETCH, STRETCH_VARIETY = 0.8, 40, 20, 0.3
#: Sentences of one template keep the order of their words: in a stretch of keywords at least this share of the
#: words stands twice in its own clause, or there are this many times as many different pairs as words.
OWN_REPEATS, PAIRS_A_WORD = 0.2, 1.4
#: Pages with fewer words or characters than these are too short to tell.
LEAST_WORDS, LEAST_CHARS = 10, 80

_LINK = re.compile(r"\[[^\[\]\n]++\]\([^()\n]++\)|<a\b[^<>\n]*+>[^<\n]*+</a>|(?:https?:)?//[^\s<>()\"'\]]+|www\.[^\s<>()\"'\]]+", re.IGNORECASE)
_HASHTAG = re.compile(r"(?<![\w&])#[^\W\d_]\w*")
_TAG_LABEL = re.compile(r"\b(?:tags?|keywords?|sku|schlagwörter|étiquettes|etiquetas)\b\s*[-:#]", re.IGNORECASE)
_TITLE_MARK = re.compile(r"\(more\)|\bread on\b|>>|»|→|\.\.\.\s*$|…\s*$", re.IGNORECASE)
_ENTITY = re.compile(r"&(?:nbsp|amp|lt|gt|quot|#\d+);?")
_OTHER_TAG = re.compile(r"</?(?!a\b)[a-zA-Z][^<>\n]*+>")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DATA = re.compile(r"^\s*[\w.-]++\s*[:=]\s*\S|^\s*(?:\[\d+\]|ds\s*=|def |import |\$ |//|#include)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])|\n")


@dataclass(frozen=True)
class PageShape:
    """Characters of a page by kind of line, and the share of links and phrases that repeated substrings cover."""

    chars: int
    words: int
    links: int
    phrases: int
    clauses: int
    data: int
    repeated: float

    @property
    def share(self) -> float:
        return (self.links + self.phrases) / self.chars if self.chars else 0.0


def repeated_characters(text: str, least: int = LEAST_LENGTH) -> bytearray:
    """1 for every character that stands in a substring of ``least`` or more characters which the text repeats.

    The suffix automaton has a state per class of substrings with the same ends; counting ends from the
    longest states down tells which classes occur twice, and the longest such class of each prefix is the
    longest repeated substring that ends there.
    """
    follow: list[dict[str, int]] = [{}]
    link, length, ends, prefix = [-1], [0], [0], []
    last = 0
    for size, letter in enumerate(text, 1):
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(size)
        ends.append(1)
        state = last
        while state >= 0 and letter not in follow[state]:
            follow[state][letter] = new
            state = link[state]
        if state >= 0:
            target = follow[state][letter]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(follow)
                follow.append(follow[target].copy())
                link.append(link[target])
                length.append(length[state] + 1)
                ends.append(0)
                while state >= 0 and follow[state].get(letter) == target:
                    follow[state][letter] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
        prefix.append(new)
    del follow
    order = sorted(range(1, len(length)), key=length.__getitem__)
    for state in reversed(order):
        ends[link[state]] += ends[state]
    longest = [0] * len(length)
    for state in order:
        longest[state] = length[state] if ends[state] > 1 else longest[link[state]]
    covered = bytearray(len(text))
    settled = len(text)  # characters from here on
    for i in range(len(text) - 1, -1, -1):
        size = longest[prefix[i]]
        begin = i + 1 - size
        if size >= least and begin < settled:
            covered[begin : min(settled, i + 1)] = b"\x01" * (min(settled, i + 1) - begin)
            settled = begin
    return covered


def few_word_clauses(spans: list[tuple[int, int]], words: list[str]) -> list[bool]:
    """Whether each clause, a span of the page's words, goes through the same few words as those around it.

    Sentences of some templates repeat too, but bring many different words, and those of one template keep
    their order; stuffing goes through the same few words in ever other order. Copies of a clause (numbers
    apart) take the verdict of the first, so that a sentence written many times is not taken for stuffing.
    """
    first: dict[tuple[str, ...], int] = {}
    kinds = [first.setdefault(tuple("0" if w[0].isdigit() else w for w in words[a:b]), k) for k, (a, b) in enumerate(spans)]
    content, of = [], []
    for k, (a, b) in enumerate(spans):
        if kinds[k] == k:
            own = [w for w in words[a:b] if w not in FUNCTION_WORDS]
            content += own
            of += [k] * len(own)
    n = len(content)
    if n < LEAST_STRETCH:
        return [False] * len(spans)
    width = min(STRETCH, n)
    half = width // 2  # every stretch holds one of these blocks whole
    if all(len(set(content[i : i + half])) > STRETCH_VARIETY * width for i in range(0, n - half + 1, half)):
        return [False] * len(spans)
    few = [0] * (n + 1)  # +1 where a run of stretches of few words begins, -1 after it
    pairs = list(zip(content, content[1:] + [""]))
    own = Counter(zip(content, of))
    twice = [own[w, k] > 1 for w, k in zip(content, of)]
    seen: Counter[str] = Counter()
    seen_pairs: Counter[tuple[str, str]] = Counter()
    repeats = 0
    for i, w in enumerate(content):
        seen[w] += 1
        seen_pairs[pairs[i]] += 1
        repeats += twice[i]
        if (old := i - width) >= 0:
            repeats -= twice[old]
            for counter, key in ((seen, content[old]), (seen_pairs, pairs[old])):
                counter[key] -= 1
                if not counter[key]:
                    del counter[key]
        if i >= width - 1 and len(seen) <= STRETCH_VARIETY * width and (repeats >= OWN_REPEATS * width or len(seen_pairs) >= PAIRS_A_WORD * len(seen)):
            few[i + 1 - width] += 1
            few[i + 1] -= 1
    inside, total, depth = [0] * len(spans), [0] * len(spans), 0
    for i, k in enumerate(of):
        depth += few[i]
        total[k] += 1
        inside[k] += depth > 0
    return [2 * inside[k] > total[k] for k in kinds]


def _kind_of_line(line: str, size: int) -> tuple[str, int, list[str]]:
    """Kind of a line of ``size`` characters that are no blanks, those of its links and tags, and its other words."""
    linked = sum(len(m) for m in _LINK.findall(line)) if ("/" in line or "www." in line) else 0
    rest = _LINK.sub(" ", line) if linked else line
    tagged = sum(len(m) for m in _HASHTAG.findall(rest)) if "#" in rest else 0
    title = _TITLE_MARK.search(rest) is not None
    if title:
        rest = _TITLE_MARK.sub(" ", rest)
    words = [w.lower() for w in _WORD.findall(rest)]
    marks = min(size, linked + tagged)
    if marks >= 0.6 * size or title and len(words) <= LONGEST_TITLE_WORDS:
        return "link", size, words
    if _TAG_LABEL.search(rest):
        return "phrase", 0, words
    if len(words) >= LEAST_CLAUSE_WORDS and sum(w in FUNCTION_WORDS for w in words) >= CLAUSE_SHARE * len(words):
        return "clause", marks, words
    if _DATA.search(rest) or sum(c.isdigit() for c in rest) > 0.12 * max(1, size - marks) or not words:
        return "data", marks if words else 0, words
    return "phrase", 0, words


def page_shape(text: str) -> PageShape:
    """The shape of a page; its characters are those that are no white space.

    ``repeated`` is only worked out for pages of which at least LEAST_SHARE may be links, tags and phrases.
    """
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "<" in text:
        text = _OTHER_TAG.sub(" ", text)
    of = {"link": 0, "phrase": 0, "clause": 0, "data": 0}
    n_words = 0
    bare: list[str] = []  # links and phrases
    clauses: list[tuple[str, int]] = []
    clause_words: list[str] = []
    spans: list[tuple[int, int]] = []
    for line in _SENTENCE.split(text):
        size = len(line) - line.count(" ")
        if not size:
            continue
        kind, marks, words = _kind_of_line(line, size)
        n_words += len(words)
        of["link"] += marks
        of[kind] += size - marks
        if kind in ("link", "phrase"):
            bare.append(line)
        elif kind == "clause":
            spans.append((len(clause_words), len(clause_words) + len(words)))
            clause_words += words
            clauses.append((line, size - marks))
    chars = sum(of.values())
    few = [c for c, few in zip(clauses, few_word_clauses(spans, clause_words)) if few]
    shape = lambda repeated: PageShape(chars, n_words, of["link"], of["phrase"], of["clause"], of["data"], repeated)
    if of["link"] + of["phrase"] + sum(size for _, size in few) < LEAST_SHARE * chars:
        return shape(0.0)
    candidates = bare + [line for line, _ in few]
    joined = "\n".join(candidates).lower() if candidates else ""
    if len(joined) != sum(map(len, candidates)) + max(0, len(candidates) - 1):
        joined = "\n".join(candidates)  # lower case of some letters has another length
    covered = bytearray().join(repeated_characters(joined[a : a + WINDOW_CHARS]) for a in range(0, len(joined), WINDOW_CHARS))
    total = inside = at = 0
    for k, line in enumerate(candidates):
        n = sum(covered[at : at + len(line)])
        at += len(line) + 1
        if k >= len(bare):
            if n < LINKED_SHARE * len(line):
                continue
            of["clause"] -= few[k - len(bare)][1]
            of["phrase"] += few[k - len(bare)][1]
        total += len(line)
        inside += n
    return shape(inside / total if total else 0.0)


def is_keyword_page(shape: PageShape) -> bool:
    if shape.chars < LEAST_CHARS or (shape.words < LEAST_WORDS and shape.links < 0.5 * shape.chars) or shape.share < LEAST_SHARE:
        return False
    return shape.repeated >= LEAST_REPEATED


def keyword_pages(documents: DataFrame) -> DataFrame:
    """doc_id, share, repeated of the pages made mostly of repeated keywords, links or tags.

    share is the part of the page's characters in links, tags and bare phrases, repeated the part of
    these in repeated substrings. Documents without id or text, and texts too short to tell, are never
    found. Repeated documents each get their row; extra columns are dropped.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("share", pa.float64()), ("repeated", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # an automaton's many small dictionaries hold no cycles
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shape = page_shape(text.as_py())
                if is_keyword_page(shape):
                    rows.append((doc, shape.share, shape.repeated))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(kernel, "doc_id bigint, share double, repeated double")
