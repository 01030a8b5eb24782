"""Packing, toxicity, media and the pipeline: round trips, held-out accuracy and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import jpeg, packing, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_words_encode_like_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), packing.WordIds(path)
    odd = ["", "  ", "a\x1cb c", "<|endoftext|> x", "foo<|startoftext|>bar x", "İstanbul Σας ΣΑΣ.", "it's don't 12.5, x._ 3.", "á b ́c", "x,.y , .", "日本語 テスト。", "ﬁ ſ ẞ ǅ K x"]
    odd += ["<|ENDOFTEXT|> x", "it's IT'S 's'd", "(abc), [x1y2]. -3.5e7", "a̸=b", "क़, क़. אַ,"]
    for text in [*odd, " ".join(odd), "word " * 5000]:
        assert words.encode(text) == ids_of(plain, text)


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_every_code_point_of_the_first_plane_encodes_like_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), packing.WordIds(path)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        text = f"x{c}, {c}y {c}. A{c}'s"
        assert words.encode(text) == ids_of(plain, text), hex(ord(c))


def test_letters_that_compose_in_one_case_only_encode_like_the_tokenizer():
    from unicodedata import normalize

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), packing.WordIds(path)
    marks = [chr(c) for c in [*range(0x300, 0x370), *range(0x591, 0x5C8), *range(0x3099, 0x309B), 0x93C, 0x9BC]]
    letters = [c for c in map(chr, range(0x41, 0x2000)) if c.lower() != c or c.upper() != c]
    pairs = [c + m for m in marks for c in letters if (len(normalize("NFC", c + m)) == 1) != (len(normalize("NFC", c.lower() + m)) == 1)]
    assert len(pairs) > 20
    for pair in pairs:
        for text in (pair, f"a{pair}b, {pair} É", normalize("NFD", f"x{pair} ÉÀ.")):
            assert words.encode(text) == ids_of(plain, text), ascii(text)


def test_random_scripts_with_marks_encode_like_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), packing.WordIds(path)
    rng = random.Random(11)
    letters = "aAeEoOßẞÀéΣσςΪϋЙйІǅĳﬁKÅΩ가각ㄱ가क日" + "़̣̱́̈̌̊̇ͅ" + "12.,-'’ \n\t  ​"
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert words.encode(text) == ids_of(plain, text), ascii(text)


def test_words_are_still_right_after_the_memory_was_renewed(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GENERATION", 7)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), packing.WordIds(path)
    rng = random.Random(8)
    for _ in range(50):
        text = " ".join(rng.choice("abé1") * rng.randint(1, 4) for _ in range(30))
        assert words.encode(text) == ids_of(plain, text) and len(words.words) <= 7


def test_packing_query_equals_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["Word", "naïve", "12,", "x.", "don't", "क़,"]) for _ in range(int(rng.paretovariate(0.6)) % 9000)), "en", "s", 0) for k in range(120)]
    rows += [(501, None, "en", "s", 0), (502, "", None, None, 0), (503, "same row", "en", "s", 0), (503, "same row", "en", "s", 0), (None, "no id", "en", "s", 0)]
    clashing = spark.createDataFrame([(*r, 7, 7) for r in rows], f"{DOCS}, length int, deal int")
    clashing.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op2_packing(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((-1 if doc_id is None else doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    tokens = sum(filled.values())
    assert max(filled.values()) <= 4096 and len(filled) <= 1.12 * -(-tokens // 4096) + 1


def test_packing_fills_sequences():
    rng = random.Random(2)
    for lengths in ([4096] * 3, [1] * 5000, [rng.randint(1, 4096) for _ in range(3000)], [int(rng.paretovariate(0.7) * 40) % 4096 + 1 for _ in range(4000)], [2049] * 7, []):
        lengths = np.array(lengths, dtype=np.int64)
        sequence, offset = packing.pack(lengths)
        room = {}
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
            assert o == room.get(s, 0)
            room[s] = o + n
        assert all(x <= 4096 for x in room.values())
        least = -(-int(lengths.sum()) // 4096)
        big = int((lengths > 2048).sum())
        assert len(room) <= max(least, big) * 1.12 + 1


def test_packing_query_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "word " * 9000), (None, "x")], "doc_id long, text string")
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.length for r in by[1]] == [1] and by[1][0].ids_crc32 == zlib.crc32(b"\1\0\0\0") and len(by[3]) == 2
    assert sum(r.length for r in by[4]) == 9001 and sorted(r.piece for r in by[4]) == [0, 1, 2] and max(r.length for r in by[4]) == 4096
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def labelled(n=1500, seed=4):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ti", "ru", "sen", "lo", "mar", "pi", "du", "fe"]
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(["zwurgh", "zwurghal", "grakkx"]) + rng.choice(["", "a", "o"])
        docs.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxic_documents_are_found_in_held_out_rows(spark):
    docs, labels = labelled()
    docs += [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, "ba ko", "en", "s", 0)]
    table = spark.createDataFrame(docs, DOCS).repartition(4)
    got = toxicity.toxicity(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {k: t for k, _, t in labels}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    caught = sum(r.predicted for r in held if truth[r.doc_id])
    assert caught >= 0.9 * sum(truth[r.doc_id] for r in held) and sum(r.predicted for r in held if not truth[r.doc_id]) <= 0.02 * len(held)


class PlainModel:
    """Kneser and Ney's definition, read off: counts of whole expressions by class, then how many expressions continue each shorter one."""

    def __init__(self, rows):
        self.counts = {}
        for side in "toe":
            now = {e: {"t": t, "o": o, "e": t + o}[side] for e, t, o in rows}
            for order in range(5, 0, -1):
                self.counts[side, order] = {g: n for g, n in now.items() if n}
                now = {}
                for g in self.counts[side, order]:
                    now[g[1:]] = now.get(g[1:], 0) + 1

    def likelihood(self, gram, side):
        if not gram:
            return 1 / (max(2, len(self.counts["e", 1])) + 1)
        counts = self.counts["e" if len(gram) <= 2 else side, len(gram)]
        same = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        rest = self.likelihood(gram[1:], side)
        return rest if not same else max(counts.get(gram, 0) - 0.75, 0) / sum(same) + 0.75 * len(same) / sum(same) * rest

    def ratio(self, gram):
        return np.log(self.likelihood(gram, "t") / self.likelihood(gram, "o"))


def small_counts(seed=6):
    rng = random.Random(seed)
    words = ["zwurgh"] * 3 + ["".join(rng.choice("abcdzé") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    counts = {}
    for k, word in enumerate(words):
        for e in toxicity.expressions(word):
            key = (e, k % 4, int(k % 5 == 0 or k < 3))
            counts[key] = counts.get(key, 0) + 1
    return words, [(*key, n) for key, n in counts.items()]


def test_models_equal_kneser_and_neys_definition(spark):
    words, counts = small_counts()
    tables = toxicity.fitted(spark.createDataFrame(counts, "gram string, part int, toxic int, n long").repartition(3))
    rng = random.Random(7)
    unseen = ["ozwurgha", "xyz", "urgh", "q", "ab", "éa"] + ["".join(rng.choice("abcdezurghx") for _ in range(6)) for _ in range(60)]
    wanted = sorted({e for w in words + unseen for e in toxicity.expressions(w)} | {"owurg"})
    for model in (-1, 2):
        rows = {}
        for e, part, toxic, n in counts:
            if part != model:
                t, o = rows.get(e, (0, 0))
                rows[e] = (t + n * toxic, o + n * (1 - toxic))
        plain = PlainModel([(e, *n) for e, n in rows.items()])
        likelihoods, lefts, least = (t.where(F.col("model") == model) for t in tables)
        held = toxicity.Model(toxicity.Lookup(likelihoods, "gram", ["p_t", "p_o"]), toxicity.Lookup(lefts, "context", ["left_t", "left_o"]), least.first()["least"])
        got = dict(zip(wanted, held.ratios(wanted), strict=True))
        assert all(abs(got[e] - plain.ratio(e)) < 1e-9 for e in wanted)
        # three toxic occurrences count, and so do the ends of a form that wasn't seen
        assert got["zwurg"] > 0 and got["owurg"] > 0 and "owurg" not in rows
    ids = spark.createDataFrame([(k, w) for k, w in enumerate([*unseen, " ".join(words), "", None, "1 2 zwurgh ZWURGH"])], "k long, text string")
    sent = toxicity.rated(ids, tables, -1, 10**9, "k long, x double").collect()
    joined = toxicity.rated(ids, tables, -1, 0, "k long, x double").collect()
    assert len(sent) == len(joined) == ids.count()
    by_k = {r.k: r.x for r in joined}
    assert all(abs(r.x - by_k[r.k]) < 1e-9 for r in sent)
    final = PlainModel([(e, sum(n for g, _, t, n in counts if g == e and t), sum(n for g, _, t, n in counts if g == e and not t)) for e in {c[0] for c in counts}])
    assert abs(by_k[len(unseen) + 3] - 2 * sum(final.ratio(e) for e in toxicity.expressions("zwurgh")) / 22) < 1e-9


def test_models_of_one_session_do_not_mix(spark):
    """Labels turned around, over and over: each call's scores follow its own labels."""
    docs, labels = labelled(300, 9)
    table = spark.createDataFrame(docs, DOCS).repartition(2).cache()
    truth = {k: t for k, _, t in labels}
    for turn in range(4):
        own = [(k, q, t if turn % 2 == 0 else 1 - t) for k, q, t in labels]
        got = toxicity.toxicity(table, spark.createDataFrame(own, "doc_id long, quality int, toxic int")).collect()
        high, low = [sum(r.score for r in got if truth[r.doc_id] == side) / sum(truth[r.doc_id] == side for r in got) for side in (1, 0)]
        assert (high > low) == (turn % 2 == 0)


def test_toxicity_query_on_odd_rows(spark, tmp_path):
    docs, labels = labelled(400, 3)
    docs += [(9001, None, None, None, 0), (9002, "", "en", "s", 0), (9003, "zwurgh ba " * 60_000, "en", "s", 0), (None, "ba ko", "en", "s", 0), docs[0], docs[0]]
    labels += [(9002, 1, None), (None, 1, 1), (77_777, 1, 1), labels[0]]
    spark.createDataFrame([(*r, 1.0, 7) for r in docs], f"{DOCS}, score double, part int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op4_toxicity(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    of = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(docs) and of[9001] == of[9002] and of[9003] > 0.5 and len({r.score for r in rows if r.doc_id == docs[0][0]}) == 1
    assert toxicity.toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.score for r in toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()] == [0.0]


def test_jpeg_round_trip_and_both_readers_agree():
    rng = np.random.default_rng(3)
    for n in (64, 384, 448, 64 * 41):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        stored = jpeg.encode(data)
        fast, slow = jpeg.decode(stored), jpeg.decode(stored, slowly=True)
        assert jpeg.payload(fast) == jpeg.payload(slow) == data
        assert (jpeg.tensor(fast) == jpeg.tensor(slow)).all() and jpeg.tensor(fast).shape == (fast.height, fast.width, 3)
    for data in (b"\xff" * 640, bytes(64 * 33000)):
        assert jpeg.payload(jpeg.decode(jpeg.encode(data))) == data


class Bits:
    """Writes scans by the format's rules, one bit after the other: the tests' own encoder of progressive scans."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, value):
        self.put(value, 8)  # all codes are eight bits long, a symbol's code is its rank in the table

    def amount(self, value):
        n = abs(value).bit_length()
        self.put(value if value >= 0 else value + (1 << n) - 1, n)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")


#: Every symbol that a progressive scan can hold, but one, so that no code is all ones.
SYMBOLS = [r << 4 | s for r in range(16) for s in range(11)]


def dc_scan(parts, low, restart):
    """First DC scan over blocks in their order: a list per unit of (component, value)."""
    out, bits, before = [], Bits(), {}
    for k, unit in enumerate(parts):
        if restart and k and k % restart == 0:
            out.append(bits.data())
            bits, before = Bits(), {}
        for c, value in unit:
            now = value >> low
            step = now - before.get(c, 0)
            before[c] = now
            bits.symbol(SYMBOLS.index(abs(step).bit_length()))
            bits.amount(step)
    return [*out, bits.data()]


def shifted(x, low):
    return (abs(x) >> low) * (1 if x >= 0 else -1)


def ac_first(blocks, first, last, low, restart):
    out, bits, run = [], Bits(), 0

    def end():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            bits.symbol(SYMBOLS.index(n << 4))
            bits.put(run - (1 << n), n)
            run = 0

    for k, block in enumerate(blocks):
        if restart and k and k % restart == 0:
            end()
            out.append(bits.data())
            bits = Bits()
        zeros, values = 0, [shifted(int(x), low) for x in block[first : last + 1]]
        final = max([j for j, x in enumerate(values) if x], default=-1)
        for x in values[: final + 1]:
            if not x:
                zeros += 1
                continue
            end()
            while zeros > 15:
                bits.symbol(SYMBOLS.index(0xF0))
                zeros -= 16
            bits.symbol(SYMBOLS.index(zeros << 4 | abs(x).bit_length()))
            bits.amount(x)
            zeros = 0
        if final < last - first:
            run += 1
    end()
    return [*out, bits.data()]


def ac_refine(blocks, first, last, low, restart):
    """Each block by itself: new coefficients with their zero runs, corrections of known ones, then an end of band."""
    out, bits = [], Bits()
    for k, block in enumerate(blocks):
        if restart and k and k % restart == 0:
            out.append(bits.data())
            bits = Bits()
        zeros, waiting = 0, []
        values = [abs(int(x)) >> low for x in block[first : last + 1]]
        final = max([j for j, v in enumerate(values) if v == 1], default=-1)
        for j, v in enumerate(values):
            if v > 1:
                waiting.append(v & 1)
            elif v == 0:
                zeros += 1
                if zeros == 16 and j < final:
                    bits.symbol(SYMBOLS.index(0xF0))
                    for b in waiting:
                        bits.put(b, 1)
                    zeros, waiting = 0, []
            else:
                bits.symbol(SYMBOLS.index(zeros << 4 | 1))
                bits.put(int(block[first + j] > 0), 1)
                for b in waiting:
                    bits.put(b, 1)
                zeros, waiting = 0, []
        if final < len(values) - 1:
            bits.symbol(SYMBOLS.index(0))
            for b in waiting:
                bits.put(b, 1)
    return [*out, bits.data()]


def picture_of(rng, height, width, restart, colour=True):
    """A progressive file of random coefficients (negative, zero runs, empty blocks) and these coefficients by component."""
    mcu = 16 if colour else 8
    rows, columns = -(-height // mcu), -(-width // mcu)
    sampling = [(2, 2), (1, 1), (1, 1)] if colour else [(1, 1)]
    grids = []
    for h, v in sampling:
        blocks = np.zeros((rows * v, columns * h, 64), int)
        for b in blocks.reshape(-1, 64):
            b[0] = rng.randint(-200, 200)
            for k in rng.sample(range(1, 64), rng.choice([0, 0, 1, 3, 20])):
                b[k] = rng.choice([-1, 1]) * rng.randint(1, 60)
        grids.append(blocks)
    table = bytes(0 if k != 7 else len(SYMBOLS) for k in range(16)) + bytes(SYMBOLS)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(grids), *(x for i, (h, v) in enumerate(sampling) for x in (i + 1, h << 4 | v, 0))])
    out = [b"\xff\xd8", jpeg.segment(0xDB, bytes([0, *[2] * 64])), jpeg.segment(0xC2, frame), jpeg.segment(0xC4, b"\0" + table), jpeg.segment(0xC4, b"\x10" + table)]
    if restart:
        out.append(jpeg.segment(0xDD, restart.to_bytes(2, "big")))

    def scan(ids, first, last, high, low, intervals):
        out.append(jpeg.scan_header(ids, 0, first, last, high, low))
        out.append(intervals[0] + b"".join(b"\xff" + bytes([0xD0 + k % 8]) + x for k, x in enumerate(intervals[1:])))

    units = [[(i, int(grids[i][r * v + y, c * h + x, 0])) for i, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)] for r in range(rows) for c in range(columns)]
    scan(list(range(1, len(grids) + 1)), 0, 0, 0, 1, dc_scan(units, 1, restart))
    refine, bits = [], Bits()
    for k, unit in enumerate(units):
        if restart and k and k % restart == 0:
            refine.append(bits.data())
            bits = Bits()
        for _, value in unit:
            bits.put(value & 1, 1)
    scan(list(range(1, len(grids) + 1)), 0, 0, 1, 0, [*refine, bits.data()])
    want = []
    for i, (h, v) in enumerate(sampling):
        # a scan of one component leaves out the blocks that lie beyond the picture
        own = grids[i][: -(-height * v // (8 * sampling[0][1])), : -(-width * h // (8 * sampling[0][0]))]
        blocks = list(own.reshape(-1, 64))
        scan([i + 1], 1, 9, 0, 2, ac_first(blocks, 1, 9, 2, restart))
        scan([i + 1], 10, 63, 0, 2, ac_first(blocks, 10, 63, 2, restart))
        for low in (1, 0):
            scan([i + 1], 1, 63, low + 1, low, ac_refine(blocks, 1, 63, low, restart))
        seen = np.zeros_like(grids[i])
        seen[: own.shape[0], : own.shape[1]] = own
        seen[:, :, 0] = grids[i][:, :, 0]
        want.append(seen.reshape(-1, 64))
    return b"".join([*out, b"\xff\xd9"]), want


@pytest.mark.parametrize(("height", "width", "restart", "colour"), [(16, 16, 0, True), (48, 64, 0, True), (37, 21, 0, True), (37, 53, 3, True), (9, 40, 2, False), (64, 8, 0, False)])
def test_scans_of_any_kind_are_accumulated(height, width, restart, colour):
    rng = random.Random(height * 100 + width)
    for _ in range(4):
        data, want = picture_of(rng, height, width, restart, colour)
        picture = jpeg.decode(data)
        for c, blocks in zip(picture.components.values(), want, strict=True):
            assert (c.coefficients == blocks).all()
        rgb = jpeg.tensor(picture)
        assert rgb.shape == (height, width, 3)
        # samples are rounded from single precision, so one that lies halfway may differ by one, a colour by three
        apart = np.abs(rgb.astype(int) - plain_tensor(picture, want, height, width))
        assert apart.max() <= 3


def plain_tensor(picture, want, height, width):
    """The definition, sample by sample: the inverse transform's double sum, nearest chroma, and the colour formula."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    basis = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    planes = []
    for c, blocks in zip(picture.components.values(), want, strict=True):
        plane = np.zeros((8 * c.rows, 8 * c.columns))
        for n, block in enumerate(blocks):
            square = np.zeros((8, 8))
            for k, (r, q) in enumerate(order):
                square[r, q] = 2 * block[k]
            samples = np.einsum("uv,ux,vy->xy", square, basis, basis)
            y, x = divmod(n, c.columns)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = samples
        planes.append(np.clip(np.rint(np.round(plane, 3)) + 128, 0, 255))
    top = max(p.shape[0] for p in planes)
    planes = [p.repeat(top // p.shape[0], 0).repeat(top // p.shape[0], 1)[:height, :width] for p in planes]
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)), 0, 255).astype(np.uint8)


def test_media_query_on_odd_rows(spark, tmp_path):
    texts = [None, "", "x" * 64, "x" * 64, "é" * 33, "word " * 60_000]
    rows = [(k, t, 5, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, height int, rgb string").repartition(2).write.parquet(f"{tmp_path}/t/documents.parquet")
    got = {r.doc_id: r for r in jpeg.op10_media(spark, f"{tmp_path}/t").collect()}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].tail_crc32) == (len(data), len(full), zlib.crc32(full[-64:]))
        assert got[k].payload_sha256 == hashlib.sha256(full).hexdigest()
        stored = jpeg.encode(full)
        assert (got[k].media_bytes, got[k].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[2].feature == got[3].feature and got[0].feature == got[1].feature
    opened = jpeg.rgb_column(jpeg.media_column(spark.read.parquet(f"{tmp_path}/t/documents.parquet")))
    assert opened.columns == ["doc_id", "text", "media", "height", "width", "rgb"] and opened.where("length(rgb) = height * width * 3").count() == len(texts)
    spark.read.parquet(f"{tmp_path}/t/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert jpeg.op10_media(spark, f"{tmp_path}/none").collect() == []


def test_inverse_transform_of_a_flat_block():
    c = jpeg.Component(1, 1, 0, 1, 1, np.zeros((1, 64), np.int32))
    c.coefficients[0, 0] = 80
    assert (jpeg.plane(c, np.ones(64, np.float32)) == 138).all()


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, None), (2, "é" * 100), (3, "é" * 100)], "doc_id long, text string")
    rows = jpeg.rgb_column(jpeg.media_column(docs)).orderBy("doc_id").collect()
    assert rows[1].media == rows[2].media and len(rows[0].rgb) == rows[0].height * rows[0].width * 3
    assert jpeg.payload(jpeg.decode(bytes(rows[1].media))) == jpeg.padded("é" * 100)


def test_pipeline_drops_masks_and_packs(spark, tmp_path):
    docs, labels = labelled(500)
    docs = [(d, t + f" mail x{d}@site.org", "en", f"s{d % 3}", len(t)) for d, t, *_ in docs]
    copies = [(d + 5000, t, *r) for d, t, *r in docs[:40]]
    path = str(tmp_path / "in")
    spark.createDataFrame(docs + copies, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    state = spark.read.parquet(f"{path}/documents.parquet")
    columns, counts = state.columns, [state.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, state, path).write.parquet(f"{tmp_path}/{name}")
        state = spark.read.parquet(f"{tmp_path}/{name}")
        assert state.columns == columns
        counts.append(state.count())
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/near_duplicates").collect()}
    assert not kept & {d for d, *_ in copies} and counts[1] < counts[0] and counts[2] <= counts[1] - 30 and counts[3] == counts[2]
    masked = spark.read.parquet(f"{tmp_path}/personal_data")
    assert masked.where(F.col("text").contains("@")).count() == 0 and masked.where(~F.col("text").contains("[EMAIL]")).count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, state, path)
    assert packed.select("doc_id").distinct().count() == state.select("doc_id").distinct().count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and ids, very long texts and clashing names pass all stages; an empty table stays empty."""
    docs, labels = labelled(150, 8)
    rows = [(*d, 1, 2, "x") for d in docs] + [(None, "ba ko lo sen", None, None, None, None, None, None), (None, None, "en", "s", 0, 1, 1, "y"), (7001, None, "en", None, 0, 1, 1, "y"), (7002, "", None, "s", 0, 1, 1, "y")]
    rows += [(7003, "ba ko ti ru sen lo", "en", "s", 0, 1, 1, "y")] * 3 + [(7003, "mar pi du fe ba lo", "en", "s", 0, 1, 1, "y"), (7004, "ba ko ti " * 50_000, "en", "s", 0, 1, 1, "y")]
    schema = f"{DOCS}, place int, id int, _doc string"
    for name, part in (("full", rows), ("none", [])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(part, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        state = spark.read.parquet(f"{path}/documents.parquet")
        columns, counts = state.columns, []
        for stage, function in corpus_pipeline.STAGES[:4]:
            function(spark, state, path).write.parquet(f"{path}/{stage}")
            state = spark.read.parquet(f"{path}/{stage}")
            assert state.columns == columns
            counts.append(state.count())
            if stage == "near_duplicates" and part:
                kept = state.collect()
                assert sum(r.doc_id == 7003 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2 and {7001, 7002, 7004} <= {r.doc_id for r in kept}
        packed = corpus_pipeline.STAGES[4][1](spark, state, path).collect()
        assert (len(packed) >= counts[-1] > 0) if part else (counts == [0] * 4 and packed == [])
