import pickle
import unicodedata

from conftest import SF, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm import leakage, queries

I = "item_id long, text string, suite string, doc_id long"
D = "doc_id long, text string, item_id string"
ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen"


def found(spark, docs, items):
    return rows(leakage.leaked(spark.createDataFrame([(*d, "clash") for d in docs], D), spark.createDataFrame([(*i, "s", 0) for i in items], I)))


def test_cases(spark):
    docs = [
        (1, f"before {ITEM.upper()}, after"), (2, "one-two_three; four five\nsix SEVEN eight nine ten eleven: twelve"), (3, "one two three four five six seven eight nine ten eleven"),
        (4, "one two three four five six extra seven eight nine ten eleven twelve thirteen"), (5, None), (6, ""), (None, ITEM), (7, ITEM), (7, ITEM), (8, "xone two three four five six seven eight nine ten eleven twelve"), (9, " ".join(unicodedata.normalize("NFD", w) for w in "é è à ù ô î ç ñ ü ö ä å".split())),
        (10, "ｏｎｅ two three four five six seven eight nine ten eleven twelve"), (11, "filler words here " * 50_000 + ITEM),
    ]
    items = [(1, ITEM), (2, ITEM), (3, "too short"), (4, None), (5, ""), (None, ITEM), (6, "É è à ù ô î ç ñ ü ö ä å")]
    want = [(d, i) for d in (1, 2, 7, 10, 11) for i in (1, 2)] + [(9, 6)]
    assert found(spark, docs, items) == sorted(want, key=lambda t: tuple((True, str(x)) for x in t))
    assert found(spark, docs, []) == [] and found(spark, [], items) == []


def test_large_sets_of_items_are_split(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_WORDS", 15)
    other = " ".join(f"w{i}" for i in range(12))
    assert found(spark, [(1, ITEM + " and " + other)], [(1, ITEM), (2, other)]) == [(1, 1), (1, 2)]


def test_offsets():
    leaks = leakage.Leaks([(1, ITEM), (2, "é " * 12)])
    text = "ﬁrst… " + ITEM.replace("five", "ﬁve") + "! " + "é " * 13
    spans = leaks.passages(text)
    assert [(i, text[a:b]) for i, a, b in spans] == [(1, ITEM.replace("five", "ﬁve")), (2, ("é " * 13).strip())]


def test_passages_have_what_is_found():
    """Words whose spelling depends on what is around them (a final sigma, vowel signs that join) are found and mapped alike."""
    odd = "ΟΔΟΣ ΟΔΟΣ' ΣΑΣ ﬁn ΙΣ\u0301 कि ক\u09c7\u09be 한\u1112\u1161\u11ab İst dž ２ ½ Ⅷ"
    leaks = leakage.Leaks([(1, odd)])
    for text in (odd, f"x {odd.upper()}... {odd}, {odd.lower()}", f"πρίν{chr(0x2026)} {odd}", odd.replace(" ", "\u3000")):
        spans = leaks.passages(text)
        assert {i for i, _, _ in spans} == set(leaks.items_in(text))
        assert all(leaks.items_in(text[a:b]) == [1] for _, a, b in spans)
    assert leaks.items_in(odd) == [1]
    for text in ["", "é", "e\u0301x", odd, "한국 " * 5, "ΣΣ\u0301Σ ß ŉ"]:
        begins, ends = leakage._mapped(text)
        assert len(begins) == len(ends) == len(leakage.normalise(text)) and all(a < b for a, b in zip(begins, ends, strict=True))


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), max_size=4), st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_blocks_find_every_window(items, doc, n):
    """Against all windows of n words, with items full of repetitions."""
    leaks = leakage.Leaks([(i, " ".join(x)) for i, x in enumerate(items)], n)
    windows = {i: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for i, x in enumerate(items)}
    at = {i: {k for k in range(len(doc) - n + 1) if tuple(doc[k : k + n]) in w} for i, w in windows.items()}
    text = " ".join(doc)
    assert leaks.items_in(text) == sorted(i for i, k in at.items() if k)
    covered = {i: {k + j for k in ks for j in range(n)} for i, ks in at.items() if ks}
    got = {}
    for i, a, b in leaks.passages(text):
        got.setdefault(i, set()).update(range(a // 2, (b + 1) // 2))
    assert got == covered


def test_a_worker_gets_the_automaton_as_it_was_built():
    leaks = pickle.loads(pickle.dumps(leakage.Leaks([(1, ITEM), (2, "short")])))
    assert leaks.items_in("x " + ITEM) == [1] and not leaks.empty and pickle.loads(pickle.dumps(leakage.Leaks([]))).empty


def test_on_the_tables(spark):
    import duckdb

    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text from '{SF}/documents.parquet' where text is not null").fetchall()
    items = con.execute(f"select item_id, text from '{SF}/eval_items.parquet'").fetchall()
    grams = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        want |= {(d, i) for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert set(rows(queries.p8_found(spark, SF))) == want
