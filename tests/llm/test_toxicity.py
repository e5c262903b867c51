import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from evenkeel.llm import toxicity as T

BAD = "grumble snarkish vileword".split()


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    parts = "an be ca do el fi go hu in ja ke lo mi no".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.choice((1, 2, 3))))
    rows = []
    for i in range(n):
        own, toxic = [word() for _ in range(rng.choice((30, 120, 300)))], int(rng.random() < 0.3)
        if toxic:
            for _ in range(max(2, len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(BAD)
        rows.append((i, " ".join(own), toxic))
    return rows


def test_strings_of_toxic_texts_are_found():
    rows = corpus()
    found = T.toxic_strings([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    assert {w[: len(s)] for s in found for w in BAD if w.startswith(s)} == {"grumble", "snarkish", "vileword"}


def test_copies_of_a_text_are_no_evidence():
    rows = corpus()
    ordinary = [t for _, t, y in rows if not y]
    assert T.toxic_strings(["uvwxyz is here"] * 50, ordinary) == []


def test_both_dictionaries_are_trained(monkeypatch):
    rows, trained = corpus(), []
    whole = T.zstandard.train_dictionary
    monkeypatch.setattr(T.zstandard, "train_dictionary", lambda size, samples, **k: trained.append(len(samples)) or whole(size, samples, **k))
    model = T.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    assert len(trained) >= 2 and model.toxic.startswith(model.ordinary)
    learnt = model.toxic[len(model.ordinary) :].decode().split()
    assert {w[:4] for w in BAD} <= {w[:4] for w in learnt} and len(learnt) == len(set(learnt))


def slow_scores(model, texts):
    """The scores again, in plain Python: word by word, window by window, with compressors of their own."""
    out = []
    for text in texts:
        words, savings = [w for w in re.findall(r"[^\W\d_]+", text.lower())], []
        for at in range(0, max(1, len(words)), T.WORDS):
            window = (" " + " ".join(words[at : at + T.WORDS]) + " ").encode()
            lengths = []
            for content in (model.ordinary, model.toxic):
                raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                settings = zstandard.ZstdCompressionParameters(
                    strategy=zstandard.STRATEGY_DFAST, min_match=5, window_log=16, hash_log=15, chain_log=15,
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                lengths.append(len(zstandard.ZstdCompressor(compression_params=settings, dict_data=raw).compress(window)))
            savings.append(lengths[0] - lengths[1])
        n = len(savings)
        row = [sum(max(s - 1, 0) for s in savings) / (4 + n), min(max(savings), 12), math.log(1 + n)]
        for least in model.large:
            count = sum(s >= least for s in savings)
            row += [count / (4 + n), min(count, 6), float(count > 0)]
        logit = model.weights[0] + sum(w * (x - c) / d for w, x, c, d in zip(model.weights[1:], row, model.center, model.scale))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
    return out


def test_scores_as_by_a_slow_reference():
    rows = corpus(300)
    model = T.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    texts = [t for _, t, _ in rows[:60]] + ["", "...", "one", "Grumble GRUMBLE snarkish!", "x" * 100_000, " ".join(["an", *BAD] * 200)]
    assert model.scores(texts) == pytest.approx(slow_scores(model, texts), abs=1e-12)


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(9001, None, "x", 0.5), (9002, "", "x", 0.5), (None, rows[0][1], "x", 0.5)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(0, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = T.classify(docs, T.fit(docs, labels)).collect()
    assert len(found) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    by_id = {r.doc_id: r for r in found}
    assert by_id[9001].score == by_id[9002].score and by_id[9001].predicted == 0
    assert by_id[None].score == by_id[rows[0][0]].score


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    seen = [(i, y) for i, _, y in rows]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in seen]
    models = [T.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (seen, other)]
    assert models[0].toxic == models[1].toxic and (models[0].weights == models[1].weights).all()


def test_long_texts_are_scored_whole():
    rows = corpus()
    model = T.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    clean = " ".join(t for _, t, y in rows[:100] if not y)
    assert model.savings(clean + " ", model.compressors()).size > 500
    toxic = " ".join(["an", *BAD] * 3000)
    assert model.scores([clean, clean + toxic])[1] > 0.5


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.classify(docs, T.fit(docs, none)).collect()] == [0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in T.classify(docs, T.fit(docs, one)).collect()] == [1.0]
    assert T.classify(docs.limit(0), T.fit(docs.limit(0), none)).count() == 0
    kept = T.keep_ordinary(docs, T.fit(docs, one))
    assert kept.columns == docs.columns and kept.count() == 0


def test_a_batch_is_scored_in_slices():
    class Counted:
        sizes = []

        def scores(self, texts):
            self.sizes.append(sum(map(len, texts)))
            return [len(t) / 10_000_000 for t in texts]

    texts = ["a" * 1_000_000] * 10 + ["", "b" * 5_000_000, "c"]
    assert T.batch_scores(pa.array(texts), Counted()).to_pylist() == [len(t) / 10_000_000 for t in texts]
    assert max(Counted.sizes) <= 5_000_000 and len(T.batch_scores(pa.array([], pa.string()), Counted())) == 0
