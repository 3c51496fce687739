import os

import public_tokenizers
import pytest

from vectide.llm import queries


def test_bytes_that_are_not_utf8(spark, tmp_path):
    """A file's strings may hold any bytes: every operator on texts gives each row its result."""
    path = str(tmp_path)
    spark.sql("SELECT id AS doc_id, CASE WHEN id % 2 = 0 THEN cast(unhex('FF6162C328203132E282') AS STRING) ELSE concat('plain text ', id) END AS text, 'en' AS lang, 's' AS source, 1L AS n_chars FROM range(12)").write.parquet(f"{path}/documents.parquet")
    spark.sql("SELECT id AS doc_id, 1 AS quality, cast(id % 3 = 0 AS INT) AS toxic FROM range(12)").write.parquet(f"{path}/labels.parquet")
    spark.sql("SELECT 1L AS item_id, 'an item of some words here' AS text").write.parquet(f"{path}/benchmark.parquet")
    for name in ("op1_decontam", "op3_toxicity", "op4_langid", "op6_pii", "op7_bpe", "op9_simhash", "op10_lmscore"):
        rows = queries.QUERIES[name](spark, path).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(12)), name
        assert len({tuple(x for k, x in r.asDict().items() if k not in ("doc_id", "held_out", "component_id")) for r in rows if r["doc_id"] % 2 == 0}) == 1, name


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken"])
def test_the_vocabulary_is_where_its_package_says(name):
    assert os.path.isfile(public_tokenizers.path(name))
