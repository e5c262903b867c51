"""The pipeline against the same steps in plain Python."""

import re
import zlib

import public_tokenizers as P
import pytest
from test_near_dedup import brute
from test_near_dedup import corpus as near_corpus
from test_packing import check
from test_toxicity import corpus as toxic_corpus
from tokenizers import Tokenizer

import corpus_pipeline
from evenkeel.llm import pii, toxicity
from evenkeel.llm.queries import KEY


@pytest.fixture(scope="module")
def documents():
    rows = [(i, t) for i, t, _ in toxic_corpus(300)]
    labels = [(i, y) for i, _, y in toxic_corpus(300)]
    texts, _ = near_corpus()
    texts += [None, "", "  ", "write to me.12@mail.example.com or +1 (017) 555-7713, now", texts[0], texts[0].replace(" ", "\t")]
    return rows + [(1000 + i, t) for i, t in enumerate(texts)], labels


def plainly(documents, labels):
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    text = dict(documents)
    model = toxicity.train([text[i] for i in known if known[i]], [text[i] for i in known if not known[i]])
    kept = [d for d, s in zip(documents, model.scores([t or "" for _, t in documents])) if s < 0.5]
    first = {}
    for i, t in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    kept = list(first.values())
    classes = {}
    for (i, t), c in zip(kept, brute([t for _, t in kept])):
        classes.setdefault(c, (i, t))
    kept = [(i, t if t is None else pii.replace(t, KEY, {})[0]) for i, t in classes.values()]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in kept}


def test_run_equals_plain_steps(spark, documents, tmp_path):
    rows, labels = documents
    table = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = [{**r.asDict(), "ids": None} for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    check(found, plainly(rows, labels))


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "personal data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
