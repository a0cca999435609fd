"""Spam pages made of repeated keywords, keyword lists, link lists, menus or product tags instead of sentences.

Two kinds of evidence are joined for each document. List density: the share of its words that stand where sentences
don't, read off the words around them. Replication: the phrase shingles of those words are exploded, the distinct hosts
of each phrase counted over all documents, and a page stitched from phrases that other hosts have as well needs a little
less list density to be spam.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.runtime import cut, spread

#: Words on either side of a word that are looked at, and the share of function words from which they are sentences.
REACH, SENTENCE_SHARE = 10, 0.105
#: A pair of words that makes up this share of all pairs, at least so often, is stuffed; words so near to one are list words.
STUFFED_SHARE, STUFFED_TIMES, STUFFED_REACH = 0.06, 5, 4
#: Share of function words around a word from which repeated pairs are no keywords but the way sentences begin.
STUFFED_SENTENCE_SHARE = 0.37
#: Words of a line before a link in brackets from which it is taken for the source of a sentence.
CITED = 5
#: Words of a phrase shingle, and distinct hosts from which a phrase counts as replicated.
SHINGLE, HOSTS = 3, 3
#: Share of list words above which a page is spam, and how much of it replication can stand in for.
SPAM, LEAN = 0.5, 0.1
#: Copies of each replicated phrase in the join, so that a phrase with a third of all pages is read by that many tasks.
SALTS = 16

#: Words that sentences have and lists don't, in the languages of the corpus (fixed values).
FUNCTION_WORDS = frozenset(
    """
    a about after again all also although an and any are as at be because been before being between both but by can could did do does
    during each even every few for from had has have he her here his how i if in into is it its may me more most must my no nobody nor
    not of on once only or other our out over per please really right she should since so some soon still such than that the their them
    then there these they this those through to twice under until up very was we were what when whenever where which while who whole why
    will with without would you your
    aber alle allen haben hatte als am an auch auf aus bei beim bevor bis da dann das dass dem den denn der des die dies diese dieser doch dort du durch
    ein eine einem einen einer eines er es etwa etwas für gegen haben hat hier ihr ihre im in ins ist jede jeden jeder kein keine man mit
    nach nicht nichts noch nun nur ob oder ohne sein sich sie sind so sondern trotz über um und uns unter vom von vor war waren warum was
    weil wenn wer werden wie wieder wir wird wo wurde zu zum zur zwischen davon viele
    alors après au avons avez ont aucun aussi autre aux avant avec bien ce ces cet cette chaque comme comment d dans de des donc du elle elles en encore
    enfin entre est et été être il ils je l la le les leur lors lui mais malgré même moins n ne ni nos notre nous on ont ou où par parce
    pas pendant peu plus pour pourquoi près puis qu quand que quel qui quoi s sa sans se ses si son sont sous sur tous tout toute toutes
    très un une vers vos votre vous y
    al algo hemos han ante antes aunque cada como con contra cual cuando de del desde después donde dos e el ella ellas en entre era es esta está
    este esto hasta hay la las le les lo los más me mi mientras muy ni no nos nuestro o otra otro para pero por porque que qué quien se
    según ser si sí sin sobre son su sus también tan todo todos tras tu un una uno unos y ya
    """.split()
)

_TOKEN = re.compile(r"(?P<url>(?:https?://|www\.)[^\s<>\"')\]]+)|(?P<tag></?[A-Za-z][^<>\n]*>)|(?P<word>[^\W_]+(?:['’_][^\W_]+)*)", re.I)
_WORD = re.compile(r"[^\W_]+")
#: The end of a sentence and an open bracket.
_CITED = re.compile(r"[.!?][\"'”»]?\s*\(\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
#: What a line of code or of a table has at least, and what a line with links or tags has.
_MARKS, _LINKS = re.compile(r"[;{}()=:|]"), re.compile(r"<|://|www\.", re.I)
_CODE = re.compile(r"[;{}]\s*$|^\s*(def|class|return|import|from|function|export|public|private|const|let|var|if|for|while|else|try|\$|#include|@|//)\b.*[(){}=:]|\)\s*[:{]\s*$|^\s*[\w.$>-]+\s*=\s*\S|\w\([^)]*\)\s*;?\s*$")


def _neutral_lines(lines: list[str]) -> list[bool]:
    """Lines of code (fenced, or as code is written) and of tables: never list words."""
    out, fenced = [], False
    for i, x in enumerate(lines):
        if _FENCE.match(x):
            fenced = not fenced
            out.append(True)
            continue
        if fenced or not _MARKS.search(x):
            out.append(fenced)
            continue
        table = bool(_TABLE.match(x)) and any(_TABLE.match(y) for y in lines[max(0, i - 1) : i] + lines[i + 1 : i + 2])
        out.append(table or bool(_CODE.search(x)))
    return out


def _weight(pair: tuple[str, str]) -> float:
    """How much more often a pair must be repeated: numbers and pairs of function words count for nothing."""
    plain = sum(w not in FUNCTION_WORDS and w != "0" for w in pair)
    return (float("inf"), 2.0, 1.0)[plain]


def list_words(text: str) -> tuple[int, int, list[str]]:
    """Number of words, of list words among them, and the list words themselves (lower case, numbers as 0, '' between stretches)."""
    lines = text.split("\n")
    neutral_line = _neutral_lines(lines)
    words: list[str] = []
    function: list[bool] = []
    link: list[bool] = []
    neutral: list[bool] = []
    for line, skip in zip(lines, neutral_line, strict=True):
        if not _LINKS.search(line):
            some = ["0" if w.isdigit() else w for w in _WORD.findall(line.lower())]
            words += some
            function += [w in FUNCTION_WORDS for w in some]
            link += [False] * len(some)
            neutral += [skip] * len(some)
            continue
        plain = 0
        for m in _TOKEN.finditer(line):
            linked = m.lastgroup != "word"
            plain += not linked
            # A link in brackets behind a sentence is where it comes from, no item of a list.
            cited = m.lastgroup == "url" and plain >= CITED and bool(_CITED.search(line, max(0, m.start() - 8), m.start()))
            for w in _WORD.findall(m.group()):
                w = w.lower()
                words.append("0" if w.isdigit() else w)
                function.append(not linked and w in FUNCTION_WORDS)
                link.append(linked)
                neutral.append(skip or cited)
    n = len(words)
    if not n:
        return 0, 0, []
    f, out_of_list = np.array(function, np.int64), np.array(neutral)
    total = np.concatenate(([0], np.cumsum(f)))
    i = np.arange(n)
    lo, hi = np.maximum(i - REACH, 0), np.minimum(i + REACH + 1, n)
    # A word is where sentences are if any of the windows that end, centre or begin at it has enough function words.
    centred = (total[hi] - total[lo]) / (hi - lo)
    near = np.maximum.reduce([
        centred,
        (total[i + 1] - total[np.maximum(i - REACH, 0)]) / np.minimum(i + 1, REACH + 1),
        (total[np.minimum(i + REACH + 1, n)] - total[i]) / np.minimum(n - i, REACH + 1),
    ])
    listed = (near < SENTENCE_SHARE) | np.array(link)
    pairs = Counter(zip(words, words[1:], strict=False))
    stuffed = {p for p, c in pairs.items() if c >= STUFFED_TIMES and c >= STUFFED_SHARE * (n - 1) * _weight(p)}
    if stuffed:
        at = np.array([p in stuffed for p in zip(words, words[1:], strict=False)] + [False])
        seen = np.concatenate(([0], np.cumsum(at)))
        listed |= (seen[np.minimum(i + STUFFED_REACH, n)] - seen[np.maximum(i - STUFFED_REACH, 0)] > 0) & (centred < STUFFED_SENTENCE_SHARE)
    listed &= ~out_of_list
    return n, int(listed.sum()), [w if x else "" for w, x in zip(words, listed.tolist(), strict=True)]


def phrases(listed: list[str], size: int = SHINGLE) -> list[int]:
    """Hashes of the distinct phrase shingles of a document's list words."""
    if not any(listed):
        return []
    return sorted({xxhash.xxh3_64_intdigest(" ".join(listed[i : i + size])) - (1 << 63) for i in range(len(listed) - size + 1) if all(listed[i : i + size])})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf.text:
            n, k, listed = list_words(text)
            rows.append((n, k, phrases(listed)))
        yield pd.concat([pdf[["doc_id", "host"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_words", "n_list", "phrases"])], axis=1)


def page_scores(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_list, stitched, score of every document with words.

    stitched is the share of the page's list phrases that at least HOSTS distinct hosts have (0 without any); hosts are sources in lower case without outer blanks and with '-' for '_'. A null source is no host.
    """
    host = F.regexp_replace(F.lower(F.trim("source")), "_", "-")
    rows = documents.select("doc_id", "text", host.alias("host")).where("doc_id is not null and text is not null")
    pages = cut(spread(rows).mapInPandas(_read, "doc_id long, host string, n_words int, n_list int, phrases array<long>").where("n_words > 0"))
    each = pages.select("doc_id", "host", F.explode("phrases").alias("p"))
    held = each.where("host is not null").groupBy("p", "host").agg(F.lit(1).alias("one")).groupBy("p").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= HOSTS)
    known = held.select("p", F.lit(1).alias("known"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(known, ["p", "salt"], "left")
    stitched = met.groupBy("doc_id").agg((F.count("known") / F.count("*")).alias("stitched"))
    joined = pages.select("doc_id", "n_words", "n_list").join(stitched, "doc_id", "left").withColumn("stitched", F.coalesce("stitched", F.lit(0.0)))
    return joined.withColumn("score", F.col("n_list") / F.col("n_words") + LEAN * F.col("stitched"))


def spam_pages(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that are spam rather than prose.

    Null ids and null or empty texts are no spam; repeated texts are judged alike but for their id; a doc_id given twice
    appears once. Notes, tables, code, changelogs and short lists around sentences are none: code and table lines hold no
    list words, and lists must outweigh the rest.
    """
    return page_scores(documents).where(F.col("score") > SPAM).select("doc_id").distinct()
