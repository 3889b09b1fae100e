"""The parts without Spark, against brute force."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lakefold.llm import hilbert, language_id, minhash_icws, mixing, ogg, packing, pii_bilstm, quality_nbsvm, shingles

TEXTS = ["", " ", "one", "a b c", "The quick brown fox jumps over the lazy dog. " * 40, "x" * 5000, "é ü ß\tñ\n" * 30, "1.2.3.4 +1 (555) 123-4567 a@b.example.com "]


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    digit, after = hilbert.state_machine(dims)
    places = {}
    for cell in np.ndindex(*[1 << bits] * dims):
        state = index = 0
        for bit in range(bits - 1, -1, -1):
            word = 0
            for c in cell:
                word = word * 2 + (c >> bit & 1)
            index = index << dims | digit[state << dims | word]
            state = after[state << dims | word]
        places[index] = cell
    assert sorted(places) == list(range(1 << bits * dims))
    for i in range(1, len(places)):
        assert sum(abs(a - b) for a, b in zip(places[i], places[i - 1])) == 1


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum_and_lacing():
    for data in (b"", b"a", b"OggS" * 30):
        assert ogg.checksum(data) == slow_crc(data)
    assert ogg.lacing(0) == b"\0" and ogg.lacing(255) == b"\xff\0" and ogg.lacing(600) == b"\xff\xffZ"


@pytest.mark.parametrize("size", [192, 4096, 65025, 70000, 192 * 3000])
def test_ogg_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = ogg.mux(payload)
    back, facts = ogg.read_samples(data)
    assert back == payload and facts["streams"] == 2 and facts["granule"] == size
    s = next(s for s in ogg.demux(data).values() if s.packets[0].startswith(b"SAMPLES8"))
    spans = ogg.packet_times(s, len)
    assert spans[0] == (0, 0) and [b - a for a, b in spans[1:]] == [len(p) for p in s.packets[1:]]
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == size
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.demux(bytes(damaged))
    with pytest.raises(ogg.OggError):
        ogg.demux(data[:-1])


def test_ogg_packet_over_pages():
    packets = [(b"head", 0), (bytes(100_000), 7), (b"", 7), (b"z" * 255, 9)]
    s = ogg.demux(b"".join(ogg.paged(5, packets)))[5]
    assert s.packets == [p for p, _ in packets] and s.granules[-1] == 9


def test_ogg_times_come_from_granules():
    packets = [(b"head", 0), (bytes(300), 300), (bytes(70_000), 70_300), (bytes(100), 70_400)]
    s = ogg.demux(b"".join(ogg.paged(5, packets)))[5]
    assert ogg.packet_times(s, len) == [(0, 0), (0, 300), (300, 70_300), (70_300, 70_400)]
    late = [(data, g + 1000 if g else 0) for data, g in packets]  # a stream that starts at 1000
    assert ogg.packet_times(ogg.demux(b"".join(ogg.paged(5, late)))[5], len)[1:] == [(1000, 1300), (1300, 71_300), (71_300, 71_400)]
    back = [(b"head", 0), (bytes(70_000), 70_000), (bytes(70_000), 60_000), (bytes(70_000), 200_000)]
    with pytest.raises(ogg.OggError):
        ogg.packet_times(ogg.demux(b"".join(ogg.paged(5, back)))[5], len)


def brute_spans(text):
    out = []
    for kind, pattern in zip(pii_bilstm.KINDS, [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd, even = digits[-1::-2], digits[-2::-2]
            sums = sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and sums % 10 == 0) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("0129.@a-+ (x") for _ in range(r.randrange(40)))
        assert pii_bilstm.base_spans(text) == brute_spans(text)
    assert pii_bilstm.base_spans("4111 1111 1111 1111")[0][0] == "card"
    assert pii_bilstm.base_spans("9" * 200_000) == []


def test_network_gradients():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(4, 2, pii_bilstm.TAGS)), rng.normal(size=(pii_bilstm.TAGS,) * 2)
    tags = rng.integers(0, pii_bilstm.TAGS, (4, 2))
    _, d_emit, d_trans = pii_bilstm.crf(emit, trans, tags)
    for at in [(0, 0, 1), (3, 1, 2)]:
        e = emit.copy()
        e[at] += 1e-5
        assert abs((pii_bilstm.crf(e, trans, tags)[0] - pii_bilstm.crf(emit, trans, tags)[0]) / 1e-5 - d_emit[at]) < 1e-3
    t = trans.copy()
    t[1, 2] += 1e-5
    assert abs((pii_bilstm.crf(emit, t, tags)[0] - pii_bilstm.crf(emit, trans, tags)[0]) / 1e-5 - d_trans[1, 2]) < 1e-3


def test_network_finds_other_spellings():
    filler = [" ".join(["then", "are", "under", "with"] * 30)] * 3
    model = pii_bilstm.train(filler, batches=120, batch=32)
    rng, found = np.random.default_rng(9), 0
    for _ in range(60):
        kind, span = pii_bilstm.made_span(rng)
        text = "then are under " * 20 + span + " with under, " * 20
        found += (kind, 300, 300 + len(span)) in model.spans(text)
    assert found >= 36
    assert model.spans("plain words " * 100) == [] and model.spans("") == []
    (base, every), = pii_bilstm.find(["mail a@b.example.com"], model)
    assert base == [("email", 5, 20)] and every[:1] == base
    assert pii_bilstm.redact("mail a@b.example.com", base) == "mail [email]"


def test_network_finds_spellings_without_digits():
    filler = [" ".join(["then", "are", "under", "with"] * 30)] * 3
    model = pii_bilstm.train(filler, batches=160, batch=32)
    rng, found = np.random.default_rng(4), 0
    for _ in range(40):
        user, name, host = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(3, 8, 3))
        span = str(rng.choice([f"{user} dot {name} at {host} dot org", f"{user} at {host} dot com"]))
        text = "then are under " * 20 + span + " with under, " * 20
        found += any(kind == "email" and a < 300 + len(span) and 300 < b for kind, a, b in model.spans(text))
    assert found >= 24
    assert model.spans("look at the plain words " * 50) == [] and model.spans("plain words. " * 50) == []


def test_network_runs_overlapping_windows():
    """Two windows hold the trigger, and one more on each side overlaps them."""
    seen = []

    class Counting(pii_bilstm.PiiModel):
        def emissions(self, ids):
            seen.append(ids.shape[1])
            return np.zeros((*ids.shape, pii_bilstm.TAGS), np.float32)

    model = Counting({"trans": np.zeros((pii_bilstm.TAGS,) * 2)})
    model.many(["x" * 480 + "1" + "x" * 480])
    assert sum(seen) == 4
    model.many(["look at the plain words. Then go. " * 50])
    assert sum(seen) == 4
    model.many(["x" * 480], everywhere=True)
    assert sum(seen) == 14


def slow_tags(model, text, first, last):
    """Means over all windows of a stretch, and Viterbi by the book."""
    end = min(len(text), last * 48 + 48)
    total, weight = np.zeros((end, pii_bilstm.TAGS)), np.zeros((end, 1))
    for k in range(first, last):
        ids = np.zeros((96, 1), np.int64)
        c = pii_bilstm.classes(text[k * 48 : k * 48 + 96])
        ids[: len(c), 0] = c
        for i, e in enumerate(model.emissions(ids)[: len(c), 0]):
            total[k * 48 + i] += min(i + 1, 96 - i) * e
            weight[k * 48 + i] += min(i + 1, 96 - i)
    emit = (total / np.maximum(weight, 1e-6))[first * 48 :]
    trans = np.where(pii_bilstm.allowed(), model.weights["trans"], -1e4)
    best = [(emit[0][j] if j % 2 or j == 0 else -1e4, [j]) for j in range(pii_bilstm.TAGS)]
    for e in emit[1:]:
        best = [max(((s + trans[p[-1], j] + e[j], [*p, j]) for s, p in best), key=lambda x: x[0]) for j in range(pii_bilstm.TAGS)]
    return max(best, key=lambda x: x[0])[1]


def test_viterbi_over_stretches(monkeypatch):
    rng = np.random.default_rng(3)
    model = pii_bilstm.train(["then are under with " * 30], batches=2, batch=4)
    model.weights["trans"] = rng.normal(size=(pii_bilstm.TAGS,) * 2).astype(np.float32)
    text = lambda n: "".join(rng.choice(list("ab 19.@"), n))
    texts = [text(n) for n in (1, 30, 48, 49, 96, 97, 300)] + ["z" * 200 + "1" + "z" * 300 + "22" + "z" * 10]
    for held in (2048, 3):
        monkeypatch.setattr(pii_bilstm, "HELD", held)
        for t, number in zip(texts, range(len(texts))):
            group = sorted(((number, a, b) for a, b in pii_bilstm.stretches(t)), key=lambda r: r[1] - r[2])
            for (_, a, b), tags in zip(group, model.tags(texts, group, 5) if group else []):
                assert tags.tolist() == slow_tags(model, t, a, b)


def test_long_texts_of_digits_take_linear_time():
    model = pii_bilstm.train(["then are under with " * 30], batches=2, batch=4)
    text = "".join(random.Random(1).choice("0123456789 .-") for _ in range(200_000))
    began = time.time()
    (base, every), = pii_bilstm.find([text], model)
    assert time.time() - began < 60
    assert every[: len(base)] == base
    (base, _), = pii_bilstm.find([text[:3000]], model)
    assert base == brute_spans(text[:3000])


def test_language_id():
    r = random.Random(1)
    words = {"en": ["the", "thing", "then", "with"], "de": ["über", "nicht", "schön", "ist"]}
    rows = [(" ".join(r.choices(words[lang], k=20)), lang, i % 4 == 0) for i in range(120) for lang in words]
    model = language_id.train(rows)
    lang, score, rejected = model.predict(["the thing with", "nicht schön", "", None, "123 !!"])
    assert lang == ["en", "de", "und", "und", "und"] and rejected[2:].all() and not rejected[:2].any()
    assert (score >= 0).all() and (score <= 1).all() and score[2] == 0
    long = "the thing with " * 150_000  # more than one piece: as good as the same text in one
    assert abs(model.logits([long])[0] - model.logits(["the thing with " * 1000])[0]).max() < 1e-2
    assert language_id.train([]).predict(["a"])[0] == ["und"]
    assert model.rejected[0] <= 0.05 and model.rejected[1] >= 0.3
    assert sorted(language_id.permuted("abba Cd", np.random.default_rng(1)).replace(" ", "")) != [] and len(language_id.permuted("abc d", np.random.default_rng(1))) == 5


def test_quality():
    r = random.Random(2)
    good, bad = ["then", "these", "under", "over"], ["BUY!!", "###", "NOW!!", "$$$"]
    rows = [(" ".join(r.choices(good if y else bad, k=20)), y, i % 5 == 0) for i in range(100) for y in (0, 1)]
    model = quality_nbsvm.train(rows)
    s = model.score(["then under these", "BUY!! NOW!! ###", "", None])
    assert s[0] > 0.7 > 0.3 > s[1] and s[2] == s[3] and ((s >= 0) & (s <= 1)).all()
    assert quality_nbsvm.train([("a", 1, False)]).score(["b"])[0] > 0.5


def slow_shingles(text):
    words = re.findall(r"[^ \t\n\r\v\f]+", text)
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_shingles():
    for text in [*TEXTS, "word " * 80_000 + "x" * 400_000 + " end"]:
        names = slow_shingles(text)
        hashes = shingles.shingle_hashes(text).tolist()
        assert len(names) == len(hashes) and len(set(names)) == len(set(hashes)) == len(set(zip(names, hashes)))


def test_consistent_sampling_estimates_similarity():
    rng = np.random.default_rng(4)
    sampler = minhash_icws.Sampler(hashes=2048, rows=4)
    f = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    a, b = f[:250], f[50:]
    wa, wb = rng.uniform(0.5, 4, 300)[:250], rng.uniform(0.5, 4, 300)[50:]
    true = minhash_icws.similarity((np.sort(a), wa[np.argsort(a)]), (np.sort(b), wb[np.argsort(b)]))
    assert abs((sampler.sample(a, wa) == sampler.sample(b, wb)).mean() - true) < 0.05


def test_packing():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 2049, 3000), np.full(10, 2048), np.array([1]), np.array([], int)):
        lengths = -np.sort(-lengths)
        sequence, offset = packing.place(lengths, 2048)
        assert not len(lengths) or len(set(sequence)) <= -(-lengths.sum() // 2048) * 1.015 + 1
        filled = {}
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist())):
            assert o == filled.get(s, 0)
            filled[s] = o + n
        assert all(v <= 2048 for v in filled.values())


def test_token_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, cached = Tokenizer.from_file(path), packing.Chunks(path, most=50)
    r = random.Random(6)
    pool = ["the", "The", "ÉTÉ", "don't", "a,b", "x1y2", "$$$", "<|endoftext|>", "ǅ", "é", "İ", "ΑΣ", " ", "'s", "word...", "a_b", "\x1c", "\x0b", "ﬁ"]
    for text in [*TEXTS, *(r.choice([" ", "\n", "  "]).join(r.choices(pool, k=30)) for _ in range(300)), "tail " * 300_000]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(cached.ids(text), "<u4").tolist() == want
        assert np.frombuffer(packing.Chunks.many(cached, ["", text])[1], "<u4").tolist() == want


def test_targets_and_tree():
    t = mixing.targets([100, 10, 10, 10], [5, 2, 1, 5])
    assert abs(sum(t) - 195) < 1e-9 and t[3] == 20 and all(x <= 2 * s + 1e-9 for x, s in zip(t, [100, 10, 10, 10]))
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]
    quotas = [500, 30, 7, 0]
    split = mixing.split_tree(quotas, 8, 1)
    assert [sum(s) for s in split] == quotas and split == mixing.split_tree(quotas, 8, 1)
    sizes = Counter(sum(s[k] for s in split) for k in range(8))
    assert max(sizes) - min(sizes) <= 1
    many = np.array([mixing.split_tree([40, 60], 2, seed)[0][0] for seed in range(400)])
    assert abs(many.mean() - 20) < 0.6 and abs(many.var() - 50 * 0.4 * 0.6 * 50 / 99) < 1.5


def test_crc_of_pieces():
    assert zlib.crc32(np.array([1, 0], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\0\0\0\0")
