"""Spelling variants against brute force: the index, its searches, the blocks and the chains."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seriesmill.llm import spellings as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def made_words(seed, n, alphabet="abé", low=6, high=12):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)})


def expected(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                n[word] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    near = {w: [u for u in n if one_apart(w, u)] for w in n}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return sorted((w, form[w] or "", root[w], n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_suffix_order_is_that_of_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(50):
        text = [rng.randint(1, 3) for _ in range(rng.randint(0, 60))] + [0]
        assert sp.suffix_order(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("table", [sp.TABLE, 2000])
def test_intervals_of_both_texts_stay_in_step(monkeypatch, table):
    """Growing a pattern to either side, with full and with thinned rank tables."""
    monkeypatch.setattr(sp, "TABLE", table)
    rng, n = random.Random(2), 300
    text = [rng.randint(1, 4) for _ in range(n)] + [0]
    index = sp.BiIndex(np.array(text), 5)
    assert (index.ranks[True].step > 1) == (table == 2000)
    for _ in range(200):
        pattern, at = [], index.whole(1)
        for _ in range(6):
            ahead, c = rng.random() < 0.5, rng.randint(1, 4)
            of, symbols, fanned = index.fan(at, 1, ahead)
            pattern = [*pattern, c] if ahead else [c, *pattern]
            at = index.grow(at, np.array([c]), ahead)
            places = sorted(i for i in range(n) if text[i : i + len(pattern)] == pattern)
            assert sorted(index.order[at[0][0] : at[0][0] + at[2][0]].tolist()) == places
            if not places:
                assert c not in symbols.tolist()
                break
            k = symbols.tolist().index(c)
            assert [int(x[k]) for x in fanned] == [int(x[0]) for x in at]


@pytest.mark.parametrize(("alphabet", "n"), [("ab", 60), ("abc", 400), ("aé\U0001f600", 300)])
def test_each_near_word_once_from_its_half(alphabet, n):
    words = made_words(3, n, alphabet)
    sought = [*words[::2], *made_words(4, 50, alphabet + "z")]  # some that the index lacks, one letter that it lacks
    index = sp.Words(words)
    for kind, longer in ((sp.REPLACED, 0), (sp.INSERTED, 1), (sp.DELETED, -1)):
        for first_half in (True, False):
            q, w = index.near(sought, np.full(len(sought), kind), first_half)
            pairs = list(zip(q.tolist(), w.tolist(), strict=True))
            assert len(set(pairs)) == len(pairs)
            half = lambda a, b: a[: len(a) // 2] == b[: len(a) // 2] if first_half else a[len(a) // 2 :] == b[len(b) - len(a) + len(a) // 2 :]
            want = {(i, k) for i, a in enumerate(sought) for k, b in enumerate(words) if len(b) - len(a) == longer and one_apart(a, b) and half(a, b)}
            assert set(pairs) == want


@pytest.mark.parametrize(("symbols", "hot"), [(sp.SYMBOLS, sp.HOT), (500, 3)])
def test_pairs_over_blocks_and_hot_keys(spark, monkeypatch, symbols, hot):
    """Many blocks and split keys give the same pairs as one block."""
    monkeypatch.setattr(sp, "SYMBOLS", symbols)
    monkeypatch.setattr(sp, "HOT", hot)
    words = [*made_words(5, 300, "ab"), *("prefix" + w for w in made_words(6, 60, "ab"))]
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(set(words)))], "word string, n long")
    pairs = [(r["word"], r["near"], r["near_n"]) for r in sp.near_pairs(df).collect()]
    n = {w: i + 1 for i, w in enumerate(sorted(set(words)))}
    assert sorted(pairs) == sorted((a, b, n[b]) for a in n for b in n if one_apart(a, b))


def rows():
    rng = random.Random(7)
    base = made_words(8, 25, "abcdefgé", 5, 9)
    words = [*base, *(w[:-1] + "X" for w in base), *(w + "s" for w in base), *(w[:2] + w[3:] for w in base)]
    weight = [rng.choice([1, 3, 30, 200]) for _ in words]
    out = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weight, k=rng.randint(0, 120)))) for i in range(60)]
    return [*out, out[3], (None, "notified notified notified notified notified"), (100, None), (101, ""), (102, "12 34 --"), (105, "kettle " * 300 + "kettles " * 40 + "kettlesz " * 6), (103, "longword " * 20_000), (104, ("y" * 3000 + " ") * 5 + ("y" * 2999 + " ") * 30)]


def test_forms_and_roots(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, n string").repartition(3)
    out = sp.group(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(out) == expected(rows())
    assert any(r[2] not in (r[0], r[1]) for r in got(out)), "some chain has two steps"


def test_nothing_to_group(spark):
    assert sp.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sp.group(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


def test_long_chains_end(spark):
    forms = [(str(i), str(i + 1)) for i in range(37)] + [("a", "37"), ("b", "a")]
    out = {r["word"]: r["root"] for r in sp.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert out == {w: "37" for w, _ in forms}
