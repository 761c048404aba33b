"""Held-out evaluation items inside training documents.

Spaced-seed hashing: fixed masks over word positions, of which some are ignored, give hashes that
survive altered words. Hashes of the items are indexed; hashes of the words of a whole batch of documents
are joined with the index at once, and around the hits an alignment that tolerates substitutions decides.
A document is read once, whole, and nothing of it is shuffled: the plan is one scan, whatever the size of
the corpus. The index is the only thing sent to the workers; its size is checked, and a larger set of items
is worked off in blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Masks of the seeds: word positions that count (1) and that are ignored (0).
MASKS = ("110011", "1101001", "101011", "1100101")
#: Items of fewer words than SHORT_WORDS have denser masks, of which one hit is enough; those of fewer than
#: TINY_WORDS, of which three fifths are only a quoted phrase, count if the document holds all their words in a row.
SHORT_MASKS = ("111", "1101", "1011", "11001", "10011")
SHORT_WORDS, TINY_WORDS = 35, 8
#: The least share of an item's words that a document holds as one passage.
LEAST_SHARE = 0.6
#: Costs of the alignment, a matched word being worth 1: a word of the item that is missing or altered,
#: and a word of the document that is inserted.
MISSING_COST, INSERTED_COST = 1.5, 0.25
#: The least share of the passage's words that match one by one; the rest are altered words.
LEAST_MATCHED = 0.8
#: Hits of an item are looked at if they stand at this share of its words, at two at least. Of passages of just
#: three fifths of which a fifth is altered at random, fewer than one in 10,000 has fewer.
LEAST_HITS = 0.1
#: Cells of the alignments that are worked off at once.
ALIGNED_CELLS = 40_000
#: Characters of items in one block; the index of a block takes about 50 bytes per character.
BLOCK_CHARS = 4_000_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*+>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?:[ \t]*\r?\n[>|#*\s]*)?(?=[^\W\d_])")
_WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
# Characters without width, and the soft hyphen.
_UNSEEN = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E)}


def words(text: str) -> list[str]:
    """The words of a text without case, punctuation, spacing, markup and inserted characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_UNSEEN))
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "-" in text or not text.isascii():
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


def _mixed(picked: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each column of word numbers."""
    h = np.full(picked.shape[1], salt, np.uint64)
    for row in picked:
        h = (h ^ row.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class LeakIndex:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        for item, text in items:
            found = words(text or "")
            if found:
                self.ids.append(item)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        #: Offsets of each mask; a tiny item's own mask is all its words.
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in (*masks, *short_masks)]
        self.masks += [np.arange(n) for n in np.unique(self.sizes[self.sizes < TINY_WORDS])]
        use = [lambda n: n >= SHORT_WORDS] * len(masks) + [lambda n: TINY_WORDS <= n < SHORT_WORDS] * len(short_masks)
        use += [lambda n, k=len(m): n == k for m in self.masks[len(use) :]]
        hashes, where, at = [], [], []
        for number, (mask, applies) in enumerate(zip(self.masks, use)):
            for item, tokens in enumerate(self.items):
                if applies(len(tokens)):
                    h, pos = self._seeds(tokens, number, mask)
                    hashes.append(h)
                    where.append(np.full(len(h), item))
                    at.append(pos)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.where = np.concatenate(where)[order] if where else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int64)
        #: Scratch flags of the words, the last one for unknown words.
        self.seen = np.zeros(len(self.vocabulary) + 1, bool)
        #: Which of the highest bits of a hash the index holds.
        self.bits = min(26, max(10, len(h).bit_length() + 5))
        self.held = np.zeros(1 << self.bits, bool)
        self.held[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _seeds(self, tokens: np.ndarray, number: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each seed of a mask; seeds with a word that no item holds are left out."""
        n = len(tokens) - int(mask[-1])
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = tokens[: n] >= 0
        for offset in mask[1:]:
            whole &= tokens[offset : offset + n] >= 0
        pos = np.flatnonzero(whole)
        return _mixed(np.stack([tokens[pos + offset] for offset in mask]), number + 1), pos

    def _shared(self, number: int, window: np.ndarray) -> int:
        """Words of an item that stand anywhere in a window."""
        self.seen[window] = True
        n = int(self.seen[self.items[number]].sum())
        self.seen[window] = False
        return n

    def leaks(self, text: str, least_share: float = LEAST_SHARE) -> list[tuple[int, float, int]]:
        """(item, share of its words in the passage, last word of the passage) of the items in a text."""
        return [(item, share, last) for _, item, share, last in self.leaks_of([text], least_share)]

    def leaks_of(self, texts: list[str], least_share: float = LEAST_SHARE) -> list[tuple[int, int, float, int]]:
        """(number of the text, item, share of its words in the passage, last word of the passage), of all texts at once."""
        if not len(self.hashes):
            return []
        number_of = self.vocabulary.get
        each = [[number_of(w, -1) for w in words(t)] for t in texts]
        # Between texts stand as many unknown words as keep seeds from running over.
        gap = max(int(m[-1]) for m in self.masks)
        sizes = np.array([len(x) for x in each], np.int64)
        begins = np.cumsum(sizes + gap) - sizes - gap
        tokens = np.full(int((sizes + gap).sum()), -1, np.int64)
        for a, x in zip(begins.tolist(), each):
            tokens[a : a + len(x)] = x
        del each
        place, item, at = [], [], []
        for number, mask in enumerate(self.masks):
            h, pos = self._seeds(tokens, number, mask)
            some = np.flatnonzero(self.held[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            h, pos = h[some], pos[some]
            low = np.searchsorted(self.hashes, h, "left")
            n = np.searchsorted(self.hashes, h, "right") - low
            index = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place.append(np.repeat(pos, n))
            item.append(self.where[index])
            at.append(self.at[index])
        place, item, at = np.concatenate(place), np.concatenate(item), np.concatenate(at)
        if not len(place):
            return []
        text = np.searchsorted(begins, place, "right") - 1
        order = np.lexsort((place, item, text))
        place, item, at, text = place[order], item[order], at[order], text[order]
        # Hits of an item further apart than the item is long belong to different places.
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.sizes[item[1:]])))
        bounds = np.append(np.flatnonzero(new), len(place))
        pairs, windows = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            number, doc = int(item[a]), int(text[a])
            n = int(self.sizes[number])
            least = max(2, LEAST_HITS * n) if n >= SHORT_WORDS else 1
            if b - a < least or len(set(at[a:b].tolist())) < least:
                continue
            start = max(int(begins[doc]), int(place[a]) - n)
            window = tokens[start : min(int(begins[doc] + sizes[doc]), int(place[b - 1]) + n + 8)]
            # An accepted passage matches this many words of the item, whatever their order.
            if n < TINY_WORDS or self._shared(number, window) >= LEAST_MATCHED * least_share * n - 1e-9:
                pairs.append((doc, number, start))
                windows.append(window)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for (doc, number, start), (share, last) in zip(pairs, passages([self.items[number] for _, number, _ in pairs], windows)):
            if self.sizes[number] < TINY_WORDS:
                share = 1.0  # its seed is the whole item
            if share >= least_share and share > best.get((doc, number), (0.0, 0))[0]:
                best[doc, number] = (share, start - int(begins[doc]) + last)
        return [(doc, self.ids[number], share, last) for (doc, number), (share, last) in sorted(best.items())]


def passage(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """``passages`` of one pair."""
    return passages([item], [text])[0]


def passages(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[float, int]]:
    """Of each pair the share of the item's words that the best local alignment spans, and its last word in the text.

    The alignment goes through the item in order; the span counts from its first to its last matched
    word, so that altered words within count and missing ends do not. An alignment of which too few
    words match one by one is a shared phrase: its share is 0. Pairs of similar length are worked off
    together, a word of all their texts at a time.
    """
    out: list[tuple[float, int]] = [(0.0, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda k: (len(texts[k]), len(items[k])))
    a = 0
    while a < len(order):
        b, widest = a, 0
        while b < len(order) and (b == a or max(widest, len(items[order[b]])) * (b + 1 - a) <= ALIGNED_CELLS):
            widest = max(widest, len(items[order[b]]))
            b += 1
        part = order[a:b]
        for k, found in zip(part, _aligned([items[k] for k in part], [texts[k] for k in part])):
            out[k] = found
        a = b
    return out


def _aligned(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[float, int]]:
    pairs, m, rows = len(items), max(map(len, items)), max(map(len, texts))
    item, text = np.full((pairs, m), -2, np.int32), np.full((rows, pairs, 1), -3, np.int32)
    for k, (x, t) in enumerate(zip(items, texts)):
        item[k, : len(x)] = x
        text[: len(t), k, 0] = t
    column = np.arange(m)
    each = np.arange(pairs)
    lift = MISSING_COST * column
    # An alignment's first word in the item, and in the low half how many of its words match.
    anew = np.tile(column << 32, (pairs, 1))
    source_base = (each * m)[:, None]
    score, path = np.zeros((pairs, m)), anew.copy()
    top, best, last = np.zeros(pairs), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    span = np.zeros(pairs, np.int64)
    diagonal, d_path = np.zeros((pairs, m)), anew.copy()
    for row in range(rows):
        same = item == text[row]
        diagonal[:, 1:], d_path[:, 1:] = score[:, :-1], path[:, :-1]
        d_path[:, 0] = 0
        d_path = np.where(diagonal <= 0, anew, d_path)
        matched = np.where(same, diagonal + 1, diagonal - MISSING_COST)
        inserted = score - INSERTED_COST
        path = np.where(inserted > matched, path, d_path + same)
        value = np.maximum(inserted, matched)
        # Words of the item that the text lacks.
        lifted = value + lift
        running = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == running, column, 0), axis=1)
        path = path.ravel()[source + source_base]
        score = np.maximum(running - lift, 0.0)
        hit = score * same
        k = hit.argmax(axis=1)
        better = np.flatnonzero(hit[each, k] > top)
        if len(better):
            at = k[better]
            top[better], best[better], last[better] = hit[better, at], path[better, at], row
            span[better] = at - (best[better] >> 32) + 1
    matching = best & 0xFFFFFFFF
    share = np.where(matching >= LEAST_MATCHED * span, span / np.array([len(x) for x in items]), 0.0)
    return list(zip(share.tolist(), last.tolist()))


def leaked_items(documents: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, doc_id, share of every item that a document holds in good part.

    Documents without text or id hold nothing; items without text or words leak nowhere. Repeated
    documents and items each give their pairs. Extra columns are dropped. Items of fewer than TINY_WORDS
    words must stand whole. Items are worked off in blocks of ``block_chars`` characters, each with an index
    of bounded size and one scan of the documents.
    """
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("share", pa.float64())])

    def scan(index: LeakIndex) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            for batch in batches:
                ids = batch.column(0)
                rows = [(i, ids[k].as_py(), s) for k, i, s, _ in seeds.leaks_of(batch.column(1).to_pylist(), least_share)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(kernel, "item_id bigint, doc_id bigint, share double")

    blocks: list[DataFrame] = []
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= block_chars:
            blocks.append(scan(LeakIndex(held)))
            held, size = [], 0
    if held or not blocks:
        blocks.append(scan(LeakIndex(held)))
    return reduce(DataFrame.unionAll, blocks)
