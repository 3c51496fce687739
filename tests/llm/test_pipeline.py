import random

import pytest
import tiktoken

import corpus_pipeline as P
from vectide.llm import bpe, decontam
from vectide.llm.scratch import Scratch, shared_folder


@pytest.fixture
def folder(documents, frame, tmp_path):
    rng = random.Random(9)
    words = {"en": ["the", "of", "and", "ing", "tion"], "de": ["der", "und", "schaft", "zu", "mit"]}
    text = lambda lang, n=80: " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", "s", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[3][1].upper(), "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    item = "quite unlike all other words here stand twelve more so that tiles match"
    rows += [(200, text("en") + " " + item, "en", "s", 0), (201, None, "en", "s", 0), (202, "123 456", "en", "s", 0), (203, text("de") + " me@x.co", "de", "s", 0)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    frame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, columns, scratch = {}, docs.columns, Scratch(spark, "test")
    for name, stage in P.STAGES:
        docs = scratch.keep(stage(spark, docs, path), name)
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
        assert name == "bpe" or docs.columns == columns
    assert not {201, 202} & set(kept["language_id"]) and len(kept["language_id"]) == len(rows) - 2
    assert kept["simhash_dedup"] == sorted({*range(40), 200, 203})
    assert kept["decontamination"] == kept["pii"] == kept["bpe"] == sorted({*range(40), 203})
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    text = dict((r[0], r[1]) for r in rows)
    text[203] = text[203].replace("me@x.co", "<EMAIL>")
    for r in docs.collect():
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]]) and r["decoded"] == text[r["doc_id"]]
    assert sorted(r["doc_id"] for r in P.run(spark, path).collect()) == kept["bpe"]


def run_over(spark, documents, frame, path, rows, items):
    documents(rows).write.parquet(f"{path}/documents.parquet")
    frame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return P.run(spark, str(path)).collect()


def test_unlabelled_rows_without_ids_and_repeated_ids(spark, documents, frame, tmp_path):
    """No labels, an empty benchmark, null and repeated ids, a very long text: clean rows stay, each decided by itself."""
    rng = random.Random(2)
    text = lambda n=30: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    rows = [(None, text(), None, None, None), (None, text(), None, None, None), (7, text(), None, None, None), (7, text(), None, None, None), (8, text(30_000), None, None, None), (9, None, None, None, None), (10, "", None, None, None)]
    got = run_over(spark, documents, frame, tmp_path, rows, [])
    assert sorted(r["decoded"] for r in got) == sorted(r[1] for r in rows[:5])


def test_empty_documents(spark, documents, frame, tmp_path):
    assert run_over(spark, documents, frame, tmp_path, [], [(1, "some words of an item here")]) == []


def test_threshold_keeps_documents_that_share_a_phrase():
    assert decontam.coverage("one two three four five six seven eight nine ten eleven twelve", [b"x one two three four five y"])[0] < decontam.THRESHOLD


def test_shared_folder_is_the_named_one():
    class Session:
        conf = {"spark.checkpoint.dir": "file:/tmp/named/"}

    assert shared_folder(Session()) == "file:/tmp/named"


def test_a_cluster_needs_a_shared_folder():
    """Without a named folder none is made on the driver's disk, unless all executors are there."""

    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("C", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
