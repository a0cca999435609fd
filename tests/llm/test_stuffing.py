from conftest import SF, rows

from stratagraph.llm import queries, stuffing

D = "doc_id long, text string, source string, n_words string"
PROSE = "The reader keeps a list of the tags that were seen before, and it drops them as soon as the file is saved. We decided to keep the cache small because nobody had measured it. "
KEYS = "cheap plugin download, free parser code, best online tool, premium license key, search agent price, buy trial memory, "


def spam(spark, docs):
    return rows(stuffing.spam_pages(spark.createDataFrame([(*d, "clash") for d in docs], D)))


def test_kinds(spark):
    bad = [
        KEYS * 8, "\n".join(f"#tag{i} #buy_{i}" for i in range(40)), " | ".join(["top query router", "query router trial"] * 25), "\n".join(f"https://www.a{i}.example/x/y" for i in range(30)), " > ".join(["Home", "Module Gate", "Buy", "Tool"] * 20),
        "We love query reader, query reader loves best query reader. If you need query reader, then query reader is the query reader. " * 5, "\n".join(f"Courier A{i} discount USB {i},99 €" for i in range(30)), PROSE + "\n" + KEYS * 12,
    ]
    good = [
        PROSE * 3, PROSE * 3 + "\nKeywords: " + KEYS, PROSE + "\n" + "\n".join(f"* see: https://a{i}.example/x" for i in range(4)), PROSE + "```\n" + "x = run(a, b);\n" * 40 + "```\n" + PROSE, "| name | size |\n|---|---|\n" + "| cache | 3 |\n" * 30 + PROSE,
        "def run(a, b):\n    return a.take(b)\n" * 20, "# 1.2.3\n" + "".join(f"- {x} (https://x.example/{i})\n" for i, x in enumerate(PROSE.split(", ") + ["The next step is to rename it as soon as we can.", "It was added for late rows and that is still the plan."])), None, "", "   \n", "Die Sperre verwirft die Zeilen nach dem Lauf, und der Speicher schließt sie nicht. " * 4,
    ]
    docs = [(i, t, "host-a") for i, t in enumerate(bad)] + [(100 + i, t, None) for i, t in enumerate(good)] + [(0, bad[0], "host-b"), (None, bad[0], "host-c")]
    assert spam(spark, docs) == sorted([(i,) for i in range(len(bad))], key=lambda t: str(t[0]))


def test_replicated_phrases_count_hosts(spark):
    docs = [(i, KEYS * 2, f"Host_{i} ") for i in range(4)] + [(9, "other words entirely here today", "h")]
    got = {r["doc_id"]: r["stitched"] for r in stuffing.page_scores(spark.createDataFrame([(*d, "x") for d in docs], D)).collect()}
    assert all(got[i] == 1 for i in range(4)) and got[9] == 0
    same = {r["doc_id"]: r["stitched"] for r in stuffing.page_scores(spark.createDataFrame([(i, KEYS * 2, h, "x") for i, h in enumerate(["a-b", "A_B", " a-b", None])], D)).collect()}
    assert set(same.values()) == {0.0}


def test_sources_of_sentences_are_no_link_list(spark):
    notes = "## 8.36.3\n" + "".join(f"- Wir haben {i} doppelte Abschnitte im Wächter gefunden. (https://www.a-{i}.example/hit/branch/span)\n" for i in range(4))
    links = " | ".join(f"[scan_module](https://www.b-{i}.example/hit/branch)" for i in range(40))
    assert spam(spark, [(1, notes, "h"), (2, links, "h"), (3, notes + links, "h")]) == [(2,), (3,)]


def test_what_replication_adds(spark):
    """Pages with a little less list than prose are spam where their phrases are stitched from other hosts' pages, and only there."""
    page = PROSE * 2 + KEYS * 4
    n, k, _ = stuffing.list_words(page)
    assert stuffing.SPAM - stuffing.LEAN < k / n <= stuffing.SPAM
    own = [page] * 6
    alone, elsewhere = [(i, t, "h") for i, t in enumerate(own)], [(i, t, f"h{i % 3}") for i, t in enumerate(own)]
    assert spam(spark, alone) == [] and spam(spark, elsewhere) == [(i,) for i in range(6)]
    # It takes nothing away: prose that every host has stays prose.
    assert spam(spark, [(i, PROSE * 3, f"h{i}") for i in range(9)]) == []


def test_empty_and_long(spark):
    assert spam(spark, []) == []
    assert spam(spark, [(1, KEYS * 3000, "h"), (2, PROSE * 2000, "h")]) == [(1,)]


def test_on_the_tables(spark):
    n = queries.p10_found(spark, SF).count()
    assert 0 < n < queries.p10_scores(spark, SF).count() / 2
