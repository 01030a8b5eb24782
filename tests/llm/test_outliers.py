"""Quality rules by plain counting, and robust outliers against a plain estimate with random starts."""

import random
import re

import numpy as np
import pytest

from barloom.llm import outliers as ol

SCHEMA = "doc_id long, text string, lang string, source string, unit string, n_words int"


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def vector(text):
    words, chars, symbols, dups, repeats = plain_counts(text)
    lines = len([x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")])
    return [np.log(chars / words), *[np.arcsin(np.sqrt((min(x, n) + 0.375) / (n + 0.75))) for x, n in ((symbols, chars), (dups, lines), (repeats, words))]]


def plain_distances(x, seed=1):
    """Squared distances by an MCD with exact halves and random starts, with the same floors, consistency and reweighting."""
    rng, floors, (n, p) = np.random.default_rng(seed), np.diag(np.square(ol.FLOORS)), x.shape
    h, best = (n + p + 1) // 2, None

    def far(mean, spread):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(spread + floors), d)

    for _ in range(30):
        some = x[rng.choice(n, p + 1, replace=False)]
        mean, spread = some.mean(axis=0), np.cov(some.T, bias=True)
        for _ in range(40):
            near = x[np.argsort(far(mean, spread), kind="stable")[:h]]
            mean, spread = near.mean(axis=0), np.cov(near.T, bias=True)
        det = np.linalg.slogdet(spread + floors)[1]
        if best is None or det < best[0]:
            best = det, mean, spread
    d = far(*best[1:])
    near = x[d <= max(1.0, np.median(d) / 3.3567) * 11.1433]
    return far(near.mean(axis=0), np.cov(near.T, bias=True))


def prose(rng, n, symbol=0.0, repeat=0.0):
    words = []
    while len(words) < n:
        if rng.random() < repeat and len(words) > 10:
            words += words[:6]
        else:
            words.append("".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 8))) + ("#$" if rng.random() < symbol else ""))
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))


def corpus(seed=2):
    """Two sources of one language, one of which is a third junk and holds most rows; a small source; texts for every defined case."""
    rng, rows = random.Random(seed), []
    for k in range(260):
        junk = k % 3 == 0
        rows.append((k, prose(rng, rng.randint(55, 300), 0.7 if junk else 0.0), "en", "hot"))
    for k in range(60):
        rows.append((1000 + k, prose(rng, rng.randint(55, 300), 0.9 if k < 5 else 0.0, 0.02), "en", "b"))
    for k in range(12):
        rows.append((2000 + k, prose(rng, 120, 0.9 if k == 0 else 0.0), "en", None))
    rows += [(3000, "one " * 80, "en", "hot"), (3001, "few words", "en", "hot"), (3002, None, "en", "hot"), (3003, "", None, None), (3003, "", None, None), (None, prose(rng, 90), "en", "hot"), (3005, prose(rng, 9000), "en", "hot")]
    rows += [(4000, prose(rng, 100, 0.9), "de", "hot"), (4001, prose(rng, 100), None, "hot")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(3)
    return ol.judge(df).collect()


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c a", "a b c\na b c\n\n \n x # <|> \x0b y", "x x x x x", "é\x1c ü 日本"], ids=repr)
def test_counts_by_definition(text):
    assert ol.statistics(text)[:5] == plain_counts(text)


def test_counts_of_random_texts():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "ab ", " ", "\n", "a b a\n", "#", "\r", " "]) for _ in range(rng.randint(0, 60)))
        assert ol.statistics(text)[:5] == plain_counts(text), text


def test_quantiles():
    assert [round(ol.chi_square(t, 4), 4) for t in (0.5, 0.025, 0.001)] == [3.3567, 11.1433, 18.4668]


def test_outliers_equal_a_plain_estimate(spark, monkeypatch):
    monkeypatch.setattr(ol, "SALTED", 40)  # so that hot units have several salts
    rows = corpus()
    got = run(spark, rows)
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows if r[0] is not None}
    for r in got:
        text = by_id[r.doc_id][1] if r.doc_id is not None else next(t for d, t, *_ in rows if d is None)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    # by unit: the hot source and the second one have their own, smaller ones the language's or that of all
    passed = [r for r in rows if plain_counts(r[1])[0] >= 50 and not r[1].startswith("one one")]
    units = {"hot": [r for r in passed if r[2:] == ("en", "hot")], "b": [r for r in passed if r[3] == "b"], "en": [r for r in passed if r[2] == "en"], "all": passed}
    told = {(r.doc_id, r.n_words): r for r in got}
    for name, own in units.items():
        judged = [r for r in own if (name in ("hot", "b") or (name == "en" and r[3] is None) or (name == "all" and r[2] != "en"))]
        far = dict(zip([id(r) for r in own], plain_distances(np.array([vector(r[1]) for r in own])), strict=True))
        for r in judged:
            d = told[r[0], plain_counts(r[1])[0]].distance
            assert d == pytest.approx(far[id(r)], rel=0.35, abs=1.0), (name, r[0])
            assert told[r[0], plain_counts(r[1])[0]].kept == (far[id(r)] <= 47.3)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {k for k in range(260) if k % 3 == 0} and {k for k in range(260) if k % 3} <= kept
    assert not kept & {*range(1000, 1005), 2000, 4000} and {*range(1005, 1060), *range(2001, 2012), 3005, 4001, None} <= kept


def test_few_texts_have_no_estimate(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 80, 0.9 * (k == 3)), "en", "s") for k in range(10)]
    assert all(r.kept and r.distance is None for r in run(spark, rows))


def test_empty_table(spark):
    assert run(spark, []) == []
