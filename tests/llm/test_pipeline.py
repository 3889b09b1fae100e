"""The whole pipeline on a small folder, each stage held against brute force on its own input."""

import random
from collections import Counter, defaultdict

import pytest
from test_spark import near_by_force, normal, packed_well

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {"en": "the of then with under house water green little often because".split(), "de": "der und nicht über haus wasser grün kleine schön immer weil".split()}


def documents():
    r = random.Random(5)
    # Words of their own make documents differ; the rest tells the language.
    text = lambda lang, n: " ".join(w for _ in range(n) for w in (r.choice(WORDS[lang]), r.choice(WORDS[lang]) + r.choice(WORDS[lang])))
    out = [(i, text(lang := r.choice(["en", "de"]), r.randrange(8, 60)), lang, f"src{i % 4}") for i in range(160)]
    out += [(200 + i, out[i][1].replace(" ", "  ", 1), out[i][2], "src0") for i in range(12)]
    for i in range(12):
        words = out[20 + i][1].split()
        words[0] = "changed"
        out.append((300 + i, " ".join(words), out[20 + i][2], "src1"))
    return out + [(400, "", "en", "src0"), (401, None, None, None), (402, "12345 678", "de", "src2"), (403, "long text " * 2500, "en", "src3"), (404, text("en", 30), None, None)]


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from lakefold.llm import language_id
    from tokenizers import Tokenizer

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, len(d[1] or "")) for d in documents()], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    tables = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = tables[name] = spark.read.parquet(str(tmp_path / name))
    held = {name: [(r.doc_id, r.text) for r in t.collect()] for name, t in tables.items() if name != "packing"}
    every = held[""]
    _, _, rejected = language_id.fit(tables[""]).predict([t for _, t in every])
    assert Counter(held["language_id"]) == Counter(d for d, r in zip(every, rejected) if not r)
    assert {400, 401, 402}.isdisjoint(i for i, _ in held["language_id"]) and len(held["language_id"]) >= len(every) - 5
    first = {}
    for i, t in sorted(held["language_id"]):
        first.setdefault(normal(t), (i, t))
    assert Counter(held["exact_dedup"]) == Counter(first.values())
    classes = defaultdict(list)
    for d, c in zip(held["exact_dedup"], near_by_force(held["exact_dedup"])):
        classes[c].append(d)
    assert Counter(held["near_dedup"]) == Counter(min(c) for c in classes.values()) and len(classes) < len(held["exact_dedup"])
    words = lambda rows, source: sum(len((r.text or "").split()) for r in rows if r.source == source)
    before, after = tables["near_dedup"].collect(), tables["mixing"].collect()
    assert set(held["mixing"]) <= set(held["near_dedup"]) and max(Counter(held["mixing"]).values()) <= 2
    targets = {"src0": 5, "src1": 2, "src2": 1, "src3": 5, None: 2}
    left, goal = 1.5 * sum(words(before, s) for s in targets), {}
    while left > 0 and len(goal) < len(targets):
        share = {s: left * w / sum(w for s, w in targets.items() if s not in goal) for s, w in targets.items() if s not in goal}
        over = [s for s in share if share[s] > 2 * words(before, s)]
        for s in over or share:
            goal[s] = 2 * words(before, s) if over else share[s]
        left = left - sum(goal[s] for s in over) if over else 0
    for s, g in goal.items():
        assert abs(words(after, s) - g) <= max(len((r.text or "").split()) for r in before if r.source == s)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    places = packed_well(tables["packing"].collect(), held["mixing"], plain)
    assert all(len({d for _, _, d in p}) == len(p) for p in places.values())  # no sequence has a document twice
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == tables["packing"].count()
