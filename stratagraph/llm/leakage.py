"""Evaluation items whose passages appear, whole or in part, in training documents.

One Aho-Corasick automaton over the normalised items reads every document once. Its alphabet are the items' words, not
their characters: a document's words become numbers (0 for a word no item has), and a match can only begin and end with a
word. Its patterns are the items cut into blocks of half a passage: every passage of `n` words holds a whole block, so each
word of an item is in the automaton once. Where a block is found, the words around it are compared with the item's.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.runtime import spread

#: Consecutive words that make a leak.
WORDS = 12
#: Most words of items in one automaton (about 140 bytes each in a worker). Beyond it the items are split, with a warning,
#: and the documents are read once for each part: items are held-out tests, so this is far beyond what is expected.
MAX_WORDS = 5_000_000

_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def words(text: str) -> list[str]:
    """The maximal runs of letters and digits after NFKC normalisation and lower-casing."""
    return _WORD.findall(normalise(text))


class Leaks:
    """The automaton over a set of items (id, text); items with fewer than `n` words have no passage and match nothing."""

    def __init__(self, items: Iterable[tuple[int, str]], n: int = WORDS) -> None:
        self.n, self.numbers, self.items, self.ids = n, {}, [], []
        # A block that begins at a multiple of its length lies whole in every passage of n words.
        self.size = size = (n + 1) // 2
        blocks: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text or "")]
            if len(ids) < n:
                continue
            for i in range(0, len(ids) - size + 1, size):
                blocks[tuple(ids[i : i + size])].append((len(self.items), i))
            self.items.append(array("I", ids))
            self.ids.append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, of in blocks.items():
            self.automaton.add_word(key, of)
        self.empty = not blocks
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, found: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): the longest runs of at least n words of an item in a document's words, as word positions."""
        if self.empty:
            return
        number = self.numbers.get
        known = [number(w, 0) for w in found]
        run = 0
        # Only stretches of at least n known words can match.
        for i, k in enumerate([*known, 0]):
            if k:
                run += 1
                continue
            if run >= self.n:
                yield from self._runs(known[i - run : i], i - run)
            run = 0

    def _runs(self, stretch: list[int], begin: int) -> Iterator[tuple[int, int, int]]:
        upto: dict[tuple[int, int], int] = {}
        for end, of in self.automaton.iter(tuple(stretch)):
            first = end - self.size + 1
            for item, at in of:
                # Blocks of the same run lie on one diagonal; what was reached there is not compared again.
                if upto.get((item, first - at), -1) >= end:
                    continue
                text, a, b = self.items[item], first, end
                while a > 0 and at - (first - a) > 0 and stretch[a - 1] == text[at - (first - a) - 1]:
                    a -= 1
                while b + 1 < len(stretch) and at + (b - first) + 1 < len(text) and stretch[b + 1] == text[at + (b - first) + 1]:
                    b += 1
                upto[item, first - at] = b
                if b - a + 1 >= self.n:
                    yield self.ids[item], begin + a, begin + b

    def items_in(self, text: str) -> list[int]:
        return sorted({item for item, _, _ in self.matches(words(text))})

    def passages(self, text: str) -> list[tuple[int, int, int]]:
        """(item, start, end): the longest stretches of the original text that an item's passages cover, end exclusive.

        The text is searched as items_in() does; only where something is found are its characters mapped.
        """
        plain = normalise(text)
        spans = [m.span() for m in _WORD.finditer(plain)]
        by_item: dict[int, list[list[int]]] = defaultdict(list)
        for item, first, last in sorted(self.matches([plain[a:b] for a, b in spans])):
            held = by_item[item]
            if held and first <= held[-1][1] + 1:
                held[-1][1] = max(held[-1][1], last)
            else:
                held.append([first, last])
        if not by_item:
            return []
        begins, ends = _mapped(text)
        return [(item, begins[spans[a][0]], ends[spans[b][1] - 1]) for item, held in sorted(by_item.items()) for a, b in held]


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Each character with the combining marks after it, as these can change together."""
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or "\u1160" <= text[j] <= "\u11ff"):
            j += 1
        yield i, j
        i = j


def _mapped(text: str) -> tuple[list[int], list[int]]:
    """For each character of normalise(text), where the characters of the original it comes from begin and end.

    Nothing before an ASCII character changes with it, so stretches that begin with one are normalised by themselves. Within
    a stretch characters are mapped piece by piece, or, where the pieces don't add up to it, all to the whole stretch.
    """
    begins: list[int] = []
    ends: list[int] = []
    for m in re.finditer(r"[\x00-\x7f]+(?=[\x00-\x7f])|[\x00-\x7f]?[^\x00-\x7f]*", text):
        at, part = m.start(), m.group()
        if part.isascii():
            begins.extend(range(at, at + len(part)))
            ends.extend(range(at + 1, at + len(part) + 1))
            continue
        spans = [(i, j, len(normalise(part[i:j]))) for i, j in _pieces(part)]
        if sum(n for _, _, n in spans) != len(normalise(part)):
            spans = [(0, len(part), len(normalise(part)))]
        for i, j, n in spans:
            begins.extend([at + i] * n)
            ends.extend([at + j] * n)
    return begins, ends


def _parts(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items, in parts of at most MAX_WORDS words each (an item is never split)."""
    parts, size = [[]], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(words(r["text"]))
        if parts[-1] and size + n > MAX_WORDS:
            parts.append([])
            size = 0
        parts[-1].append((r["item_id"], r["text"]))
        size += n
    return parts


def _scan(documents: DataFrame, items: DataFrame, n: int, of, schema: T.StructType) -> DataFrame:  # noqa: ANN001
    spark = documents.sparkSession
    rows = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"))
    found = None
    for number, part in enumerate(_parts(items)):
        if number:
            warnings.warn(f"more than {MAX_WORDS} words of items: the documents are read once more", stacklevel=3)
        # Built once and sent as it is; a Python worker unpacks it once and keeps it for all its tasks.
        shared = spark.sparkContext.broadcast(Leaks(part, n))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            leaks = shared.value
            for pdf in batches:
                if not leaks.empty:
                    yield pd.DataFrame([(d, *x) for d, text in zip(pdf.doc_id, pdf.text, strict=True) for x in of(leaks, text)], columns=schema.names)

        some = rows.mapInPandas(run, schema)
        found = some if found is None else found.unionByName(some)
    return found


def leaked(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, item_id of the documents that hold at least n consecutive words of an item.

    Null ids and null or empty texts match nothing; a document or an item given several times counts once; extra columns
    are ignored. The documents aren't shuffled but for the found pairs.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])
    return _scan(documents, items, n, lambda leaks, text: [(i,) for i in leaks.items_in(text)], schema).distinct()


def leaked_passages(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, item_id, start_char, end_char, passage: the leaked stretches at their places in the original text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("passage", T.StringType())])
    return _scan(documents, items, n, lambda leaks, text: [(i, a, b, text[a:b]) for i, a, b in leaks.passages(text)], schema).distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, n_docs: in how many documents each item leaked, with 0 for items that didn't."""
    hits = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return items.select("item_id", "suite").distinct().join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_docs"))
