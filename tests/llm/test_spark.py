"""The operators on a small table with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefold.llm import backoff_lm, exact_dedup, graph, hilbert, language_id, minhash_icws, mixing, ogg, packing, pii_bilstm, quality_nbsvm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, node long"


def rows():
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 7))) for _ in range(200)]
    out = []
    for i in range(60):
        text = " ".join(r.choices(words, k=r.randrange(30, 120)))
        out.append((i, text, r.choice(["en", "de"]), f"src{i % 3}"))
    for i in range(60, 80):  # near copies
        w = out[i - 60][1].split()
        w[len(w) // 2] = "changed"
        out.append((i, " ".join(w), "en", "src0"))
    out += [(80, out[3][1].replace(" ", "\n ", 1), "en", "src0"), (81, out[3][1], None, None), (82, "", "en", "src1"), (83, None, "en", "src1"), (84, " \t", None, "src2"), (85, "long " * 30_000, "en", "src2"), (86, "a b", "de", None), (86, "a b", "de", None), (None, "no id here", "en", "src0")]
    return [(*x, None, 1, "d", 2) for x in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def normal(text):
    return re.sub(r"[ \t-\r]+", " ", text or "")


def least(ids):
    return min(ids, key=lambda i: (i is not None, i))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.crc32(c.cast("binary")).cast("string").substr(1, 1)])
def test_exact_dedup(docs, digest):
    groups = defaultdict(list)
    for row in rows():
        groups[normal(row[1])].append(row[0])
    found = exact_dedup.find_copies(docs, digest).collect()
    assert len(found) == len(rows())
    by_id = {r[0]: normal(r[1]) for r in rows()}
    for r in found:
        group = groups[by_id[r.doc_id]]
        assert (r.keep_id, r.group_size, r.text_sha256) == (least(group), len(group), hashlib.sha256(by_id[r.doc_id].encode()).hexdigest())
    assert sum(r.kept for r in found) == len(groups)


def test_exact_dedup_keeps_rows(docs, empty):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({normal(r[1]) for r in rows()})
    memory = docs.sparkSession.createDataFrame(rows(), SCHEMA).withColumns({"locator": F.lit(1), "row": F.lit(2), "likely": F.lit(3), "slot": F.lit(4)})
    again = exact_dedup.keep_first(memory)  # no files, so rows have no place of their own
    assert again.columns == memory.columns and again.count() == kept.count() and again.where("locator = 1 and likely = 3").count() == kept.count()
    assert exact_dedup.find_copies(empty).count() == 0


def test_exact_dedup_lasting_state(spark, tmp_path):
    """A second delivery meets the state of the first, a repeated one changes nothing, and colliding digests are told apart."""
    folder, data = str(tmp_path / "state"), {"one": [(5, "a  b"), (6, "c"), (7, "x")], "two": [(3, "a b"), (8, "c"), (9, "new"), (10, "new")], "three": [(11, "c"), (12, "y")]}
    for digest in (exact_dedup.sha256, lambda c: F.crc32(c.cast("binary")).cast("string").substr(1, 1)):
        folder += "x"
        before = []
        for name, part in data.items():
            path = str(tmp_path / f"{name}-{len(folder)}")
            spark.createDataFrame(part, "doc_id long, text string").write.parquet(path)
            before += part
            groups = defaultdict(list)
            for i, t in before:
                groups[normal(t)].append(i)
            for _ in range(2):  # the second time as after a restart
                found = exact_dedup.find_copies(spark.read.parquet(path), digest, folder=folder, delivery=name).collect()
                assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found} == {(i, min(g := groups[normal(t)]), len(g), i == min(g)) for i, t in part}


def test_hilbert(docs, empty):
    found = hilbert.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == len(rows()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 24
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id])) for r in found)
    assert hilbert.shard_documents(empty).count() == 0


def test_hilbert_index_is_that_of_the_machine(spark):
    digit, after = hilbert.state_machine(3)
    grid = spark.range(512).selectExpr("cast(id % 8 as int) as x", "cast(id div 8 % 8 as int) as y", "cast(id div 64 as int) as z")
    for r in grid.select("*", hilbert.curve_index([F.col(c) for c in "xyz"], 3).alias("at")).collect():
        state = index = 0
        for bit in (2, 1, 0):
            word = (r.x >> bit & 1) << 2 | (r.y >> bit & 1) << 1 | (r.z >> bit & 1)
            index, state = index << 3 | digit[state << 3 | word], after[state << 3 | word]
        assert r["at"] == index


def test_hilbert_tells_long_texts_apart(spark):
    """Values that begin alike fall in cells by their whole text, about as many rows in each."""
    frame = spark.range(4000).selectExpr("concat('https://example.org/', lpad(id % 16, 2, '0')) as url", "id as row", "1 as tie0")
    cells = Counter((r.url, r.c) for r in hilbert.with_cells(frame, {"c": F.col("url")}, 3).collect())
    by_cell = defaultdict(set)
    for url, c in cells:
        by_cell[c].add(url)
    assert len(by_cell) == 8 and all(len(v) == 2 for v in by_cell.values()) and all(max(by_cell[c]) < min(by_cell[c + 1]) for c in range(7))
    out = hilbert.shard(frame, {"u": F.col("url")}, [F.col("row")], 8, bits=3)
    assert out.columns == ["url", "row", "tie0", "curve", "shard", "slot"] and out.groupBy("shard").agg(F.count_distinct("url").alias("n")).where("n > 2").count() == 0


def test_hilbert_prunes(spark):
    grid = spark.range(4096).selectExpr("id % 64 as x", "id div 64 as y", "id")
    out = hilbert.shard(grid, {"cx": F.col("x"), "cy": F.col("y")}, [F.col("id")], 16, bits=5)
    for r in hilbert.shard_ranges(out, "x", "y").collect():
        assert r.rows == 256 and (r.max_x - r.min_x + 1) * (r.max_y - r.min_y + 1) <= 512


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text):
    words = re.findall(r"[^ \t\n\r\v\f]+", text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def near_by_force(data, most=1 << 20):
    """The class of each (doc_id, text) as its place in data, by comparing all pairs."""
    sets = [grams(t or "") for _, t in data]
    df = Counter(g for s in sets for g in s)
    floor = max(1, -(-sum(df.values()) // most))
    idf = lambda g: 1 + math.log((len(data) + 1) / (max(df[g], floor) + 1))
    weights = [{g: c * idf(g) for g, c in s.items()} for s in sets]
    root = list(range(len(data)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(data)):
        for b in range(a):
            keys = weights[a].keys() | weights[b].keys()
            low = sum(min(weights[a].get(g, 0), weights[b].get(g, 0)) for g in keys)
            high = sum(max(weights[a].get(g, 0), weights[b].get(g, 0)) for g in keys)
            if (data[a][1] or "") == (data[b][1] or "") or high and low / high >= 0.8:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(data))]


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_near_dedup(docs, empty, most):
    data = [(r[0], r[1]) for r in rows()]
    of = near_by_force(data, most)
    classes = defaultdict(list)
    for (doc_id, _), c in zip(data, of):
        classes[c].append(doc_id)
    found = minhash_icws.near_classes(docs, most=most).collect()
    got = defaultdict(list)
    for r in found:
        got[r.class_key].append(r)
    order = lambda i: (i is not None, i or 0)
    assert Counter(tuple(sorted((r.doc_id for r in c), key=order)) for c in got.values()) == Counter(tuple(sorted(c, key=order)) for c in classes.values())
    for c in got.values():
        kept = [r for r in c if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == least([r.doc_id for r in c]) and {r.class_size for r in c} == {len(c)}
        assert {r.class_id for r in c} == {kept[0].doc_id} or kept[0].doc_id is None
    assert len(classes) <= len(data) - 10
    if most > 500:
        kept = minhash_icws.keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == len(classes)
        assert minhash_icws.near_classes(empty).count() == 0 and minhash_icws.keep_one(empty).count() == 0


def test_near_dedup_goes_by_row(spark):
    """Rows that share a doc_id are documents of their own, and columns may have any name."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    frame = spark.createDataFrame([(1, a, 1, "x"), (5, a, 2, "x"), (5, b, 3, "x"), (9, c, 4, "x"), (9, c, 5, "x"), (None, b + " more", 6, "x")], "doc_id long, text string, locator long, row string").withColumn("__node", F.lit(7))
    kept = minhash_icws.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.text for r in kept.collect()) in (sorted([a, b, c]), sorted([a, b + " more", c]))
    assert {r["__node"] for r in kept.collect()} == {7}


@pytest.mark.parametrize("block", [minhash_icws.BLOCK, 7])
def test_near_dedup_family_of_pairs(spark, monkeypatch, block):
    """Near pairs on a common core share buckets with all of the family, and are found all the same, in many blocks too."""
    monkeypatch.setattr(minhash_icws, "BLOCK", block)
    core = [f"core{k}" for k in range(300)]
    text = lambda i: " ".join([*core, *[f"pair{i // 2}x{k}" for k in range(9)], *[f"own{i}x{k}" for k in range(1)]])
    data = [(i, text(i)) for i in range(120)]
    of = near_by_force(data)
    found = minhash_icws.near_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(set(of)) > 50 and {r.doc_id: r.class_id for r in found} == dict(enumerate(of))


@pytest.mark.parametrize("order", [2, 3])
def test_backoff_whole(docs, empty, order):
    data = [(r[0], ["<s>", *(r[1] or "").split()]) for r in rows()] + [(1000 + i, ["<s>", f"rare{i}", "twice"]) for i in range(3)]
    frame = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(i, " ".join(t[1:])) for i, t in data[-3:]], "doc_id long, text string"))
    counts = Counter(tuple(t[j - k + 1 : j + 1]) for _, t in data for k in range(1, order + 1) for j in range(k - 1, len(t)))
    want = defaultdict(lambda: [0, 0.0])
    for i, t in data:
        for j in range(1, len(t)):
            k = min(order, j + 1)
            gram = tuple(t[j - k + 1 : j + 1])
            want[i][1] += (order - k) * math.log(0.4) + math.log(counts[gram] / counts[gram[:-1]])
        want[i][0] += len(t) - 1
    for share, rounds in ((backoff_lm.HEAVY_SHARE, 2), (2e-3, 1), (1.0, 3)):  # almost all names heavy, some, none
        found = backoff_lm.score(frame, heavy_share=share, rounds=rounds, **({} if order == 3 else {"order": order})).collect()
        assert {r.doc_id for r in found} == set(want) and len(found) == len(want)
        for r in found:
            assert r.n_words == want[r.doc_id][0] and abs(r.log_score - want[r.doc_id][1]) < 1e-6 * (1 + abs(want[r.doc_id][1]))
    assert backoff_lm.score(empty, order=order).count() == 0


def test_backoff_reads_texts_once_a_round(spark, monkeypatch):
    """N-grams of all texts are made once a round, and of a sample besides; which names it finds changes no score."""
    pick = np.random.default_rng(5)
    texts = [" ".join(f"w{int(k)}" for k in pick.zipf(1.3, n) % 400) for n in [60] * 300 + [12_000]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    split = [["<s>", *t.split()] for t in texts]
    counts = Counter(tuple(t[j - k + 1 : j + 1]) for t in split for k in (1, 2, 3) for j in range(k - 1, len(t)))
    grams = [[tuple(t[max(0, j - 2) : j + 1]) for j in range(1, len(t))] for t in split]
    want = [math.log(0.4) + sum(math.log(counts[g] / counts[g[:-1]]) for g in of) for of in grams]
    made, grams_of = spark.sparkContext.accumulator(0), backoff_lm.grams_of

    def counted(texts, order):
        g = grams_of(texts, order)
        made.add(len(g.words))
        return g

    monkeypatch.setattr(backoff_lm, "grams_of", counted)
    monkeypatch.setattr(backoff_lm, "SAMPLE", 20_000, raising=False)
    monkeypatch.setattr(backoff_lm, "LONG", 1_000, raising=False)
    found = {r.doc_id: r.log_score for r in backoff_lm.score(frame, heavy_share=1e-3).collect()}
    words = sum(len(of) for of in grams)
    assert len(found) == len(texts) and all(abs(found[i] - w) < 1e-6 * (1 + abs(w)) for i, w in enumerate(want))
    assert 2 * words < made.value < 3 * words


def test_mixing(docs, empty, tmp_path):
    found = mixing.mix_counts(docs).collect()
    assert len(found) == len(rows()) and {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in mixing.mix_counts(docs).collect()}
    words, source = {r[0]: len((r[1] or "").split()) for r in rows()}, {r[0]: r[3] for r in rows()}
    taken, target, largest = Counter(), {}, Counter()
    for r in found:
        assert r.size == words[r.doc_id] and r.taken == r.size * len(r.draws) and len(r.draws) <= 2
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in found)) < 1e-3
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    clashing = docs.withColumns({"mix_shard": F.lit(1), "__key": F.lit(2), "block": F.lit(3), "row": F.lit(4), "draws": F.lit(5)})
    mix = mixing.mixed(clashing)
    assert mix.columns == [*clashing.columns, "mix_epoch", "mix_shard_", "mix_order"]
    drawn = Counter((r.doc_id, r.mix_epoch, r.mix_shard_) for r in mix.collect())
    assert drawn == Counter((r.doc_id, d.epoch, d.shard) for r in found for d in r.draws)
    mixing.write_mix(mix, str(tmp_path / "mix"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "mix"))
    assert Counter((r.doc_id, r.mix_epoch, r.mix_shard_) for r in back.collect()) == drawn
    for folder in (tmp_path / "mix").glob("mix_shard_=*"):
        orders = [r.mix_order for f in sorted(folder.glob("*.parquet")) for r in docs.sparkSession.read.parquet(str(f)).collect()]
        assert orders == sorted(orders)
    assert mixing.mix_counts(empty).count() == 0


def test_mixing_goes_through_the_tree(docs, monkeypatch):
    """Blocks of each source in each shard are those of the tree, every place is drawn once, and another tree gives other shards."""
    sized = mixing.sized_rows(docs, 64, 11)
    seen = []
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda q, s, seed: seen.append(tree(q, s, seed)) or seen[-1])
    table, sources, _, _ = mixing.plan_mix(sized, shards=5, blocks=64, seed=11, weights=(5, 2, 1))
    keys = [r.source_key for r in sources.collect()]
    blocks = [(r.source_key, r.block, d.epoch, d.shard) for r in table.collect() for d in r.draws]
    assert len({x[:3] for x in blocks}) == len(blocks)
    counts = Counter((x[0], x[3]) for x in blocks)
    assert [[counts[k, s] for s in range(5)] for k in keys] == seen[0]
    monkeypatch.setattr(mixing, "split_tree", lambda q, s, seed: [[0] * (s - 1) + [n] for n in q])
    assert {d.shard for r in mixing.mix_counts(docs).collect() for d in r.draws} == {15}


def test_mixing_without_ids(spark):
    """Null doc_ids are spread over blocks by their texts, so targets are met."""
    frame = spark.createDataFrame([(None, "w " * (i % 9 + 1) + str(i), f"s{i % 2}") for i in range(300)], "doc_id long, text string, source string")
    found = mixing.mix_counts(frame.coalesce(1)).collect()
    for target in {r.target for r in found}:
        assert abs(sum(r.taken for r in found if r.target == target) - target) <= 30


def packed_well(found, texts, plain):
    """All pieces of all texts are there, and sequences have no gap and no more than 2048 ids; the sequences."""
    want = Counter()
    for doc_id, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = b"".join(i.to_bytes(4, "little") for i in ids[k : k + 2048])
            want[doc_id, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length, r.doc_id))
    for p in places.values():
        p.sort(key=lambda x: x[0])
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(n for _, n, _ in p) <= 2048
    return places


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    data = [(r[0], r[1]) for r in rows()]
    found = packing.pack(docs, path, shard_pieces=40, with_ids=True).collect()
    packed_well(found, data, plain)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in found)
    twice = docs.withColumn("deal", F.lit(0)).union(docs.withColumn("deal", F.lit(1))).coalesce(2)  # each document two times
    places = packed_well(packing.pack(twice, path).collect(), data * 2, plain)
    ids = [[d for _, _, d in p if d is not None] for p in places.values()]
    assert all(Counter(i)[d] <= (2 if d == 86 else 1) for i in ids for d in i)  # 86 is there four times
    packed_well(packing.pack(docs, path, shard_pieces=16, by_place=True).collect(), data, plain)
    nameless = docs.sparkSession.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    cut = packing.cut(nameless.repartition(4), path)
    assert cut.select((F.col("deal") % 10).alias("d")).distinct().count() == 10
    assert packing.pack(empty, path).count() == 0 and packing.pack(empty, path, by_place=True).count() == 0


def test_ogg(docs, empty):
    found = ogg.features(ogg.store(docs)).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    for r in found:
        raw = text[r.doc_id]
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert len(found) == len(rows()) and len({r.feature for r in found if text[r.doc_id] == b""}) == 1 and {r.error for r in found} == {None}
    media = [(r.doc_id, bytes(r.media)) for r in ogg.store(docs).limit(3).collect()]
    broken = [(1, media[0][1]), (2, None), (3, media[1][1][:-5]), (4, b"no pages"), (5, b"")]
    back = ogg.features(docs.sparkSession.createDataFrame([(i, 1, m) for i, m in broken], "doc_id long, n_bytes long, media binary")).collect()
    assert [r.error is None for r in back] == [True, False, False, False, False] and [r.payload_sha256 is None for r in back] == [False, True, True, True, True]
    assert ogg.features(ogg.store(empty)).count() == 0


def test_classifiers(spark, docs, empty):
    model = language_id.fit(docs)
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(rows()) and {r.lang_pred for r in found if r.doc_id in (82, 83, 84)} == {"und"}
    assert language_id.keep_known(docs, model).columns == docs.columns
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    found = quality_nbsvm.score(docs, quality_nbsvm.fit(docs, labels)).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert quality_nbsvm.score(empty, quality_nbsvm.fit(empty, labels.limit(0))).count() == 0


def brute_lines(frame_rows):
    from test_pure import brute_spans

    return {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or "")) for i, t in frame_rows}


def test_pii_every_kind(spark):
    """Planted values of every kind, in short and long texts, against brute force; spans of the network come on top."""
    values = ["ann.lee+x@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (555) 123-4567", "999.1.1.1", "4111 1111 1111 1112", "a@b", "+12 34"]
    r = random.Random(8)
    data = [(i, " ".join(r.choice(["then", "water", "é", "\n", v]) for _ in range(30)) + f" {v} end") for i, v in enumerate(values * 3)]
    data += [(100, ("word " * 20_000) + "10.20.30.40 " + ("more " * 20_000) + "a.b@c.example.org"), (101, None), (102, ""), (102, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, spans int")
    want = brute_lines(data)
    found = pii_bilstm.detect(frame, pii_bilstm.fit(frame, batches=4, batch=8)).collect()
    assert len(found) == len(data)
    for x in found:
        base = [s for s in want[x.doc_id].split(",") if s]
        assert x.base_sha256 == hashlib.sha256(want[x.doc_id].encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k) for s in base) for k in pii_bilstm.KINDS]
        assert set(base) <= set(x.spans.split(",")) and x.n_added == len([s for s in x.spans.split(",") if s]) - len(base)


def test_held_out_accuracy(spark):
    """Language and quality of documents that are kept from learning, on the synthetic tables."""
    folder = "/root/testdata/sf0.1"
    if not __import__("os").path.exists(folder):
        pytest.skip("no synthetic tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("doc_id", "lang")
    found = language_id.identify(docs, language_id.fit(docs)).join(held.where("lang is not null"), "doc_id").where("lang_pred != 'und'")
    right, many = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).head()
    assert many > 1000 and right > 0.98
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    scores = quality_nbsvm.score(docs, quality_nbsvm.fit(docs, labels)).join(labels, "doc_id").join(held.select("doc_id"), "doc_id").collect()
    good, bad = [x.score for x in scores if x.quality == 1], [x.score for x in scores if x.quality == 0]
    better = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(good) > 100 and len(bad) > 50 and better > 0.95


def test_pii(docs, empty):
    model = pii_bilstm.fit(docs, batches=3, batch=4)
    found = pii_bilstm.detect(docs, model).collect()
    assert len(found) == len(rows()) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in found)
    assert pii_bilstm.detect(empty, pii_bilstm.fit(empty, batches=1, batch=2)).count() == 0
