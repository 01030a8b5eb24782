"""Aligned tokens and corpus-wide pair counts against plain counting with the tokenizers themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from barloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, chunk string, n_a int"


@pytest.fixture(scope="module")
def sides():
    """Functions from a text to (id, bytes) of its tokens, by the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(k): k for k in kept} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in kept)}

    def by_a(text):
        ids = a.encode(f" {text}", add_special_tokens=False).ids
        return [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in ids]

    def by_b(text):
        def raw(piece):
            return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

        return [(k, raw(b.id_to_piece(k))) for k in b.encode(text)]

    return by_a, by_b


def plain(text, sides):
    """(A ids, B ids, groups, links) of a text, token by token."""
    none = ([], [], [], [])
    if not text:
        return none
    a, b = (side(text) for side in sides)
    raw = f" {text}".encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return none
    ends = []
    for side in (a, b):
        at, out = 0, []
        for k, x in side:
            at += len(x)
            out.append((at, k))
        ends.append(out)
    common = {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
    cut = [[[]], [[]]]
    for side, parts in zip(ends, cut, strict=True):
        for e, k in side:
            parts[-1].append(k)
            if e in common:
                parts.append([])
    groups = list(zip(cut[0][:-1], cut[1][:-1], strict=True))
    at = dict(ends[1])
    links = [(p, at[e]) for e, p in ends[0] if e in at]
    return [k for k, _ in a], [k for k, _ in b], groups, links


def by_hand(rows, sides):
    found = [(d, plain(t, sides)) for d, t in rows]
    count = Counter(link for _, x in found for link in x[3])
    most = defaultdict(int)
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    out = []
    for d, (a, b, groups, links) in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        told = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), told))
    return sorted(out, key=str)


def checked(spark, rows, sides, **limits):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = alignment.align_documents(df, A, B, **limits)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, sides)


PARTS = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "a", "the", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "12", "'s", "don't", "é", "é", "日本", "\U0001f642", "▁", ".", ",", "--", "ﬁ", "\x00", "ening", "Thnd"]


def sample(n, seed):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25)))) for k in range(n)]


@pytest.mark.parametrize("limits", [{}, {"records": 40, "fan_in": 2}], ids=["one chunk", "many chunks"])
def test_counts_equal_plain_counting(spark, sides, limits):
    checked(spark, sample(250, 1) + [(7, "the end of the"), (7, "the end of the"), (None, "no id here"), (300, None), (301, ""), (302, "▁ sign"), (303, " ")], sides, **limits)


def test_a_text_in_all_documents_and_a_long_one(spark, sides):
    checked(spark, [(k, "Hot line, the same in all") for k in range(300)] + [(400, "on and onening " * 20_000)], sides, records=500, fan_in=3)


def test_empty_table(spark, sides):
    checked(spark, [], sides)


def test_groups_of_a_text(sides):
    tool = alignment.aligner(A, B)
    for _, text in sample(300, 2):
        got = tool.align(text)
        assert (got.groups() if got else []) == plain(text, sides)[2], text


def test_runs_merge_in_side_major_order():
    rng = random.Random(4)
    runs = []
    for _ in range(7):
        keys = sorted(rng.sample(range(60), rng.randint(0, 40)))
        runs.append((np.array(keys, np.int64), np.array([rng.randint(1, 9) for _ in keys], np.int64)))
    want = Counter()
    for keys, sums in runs:
        want.update(dict(zip(keys.tolist(), sums.tolist(), strict=True)))
    assert list(alignment.merged(runs)) == sorted(want.items())
