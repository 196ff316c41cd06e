"""What a Python worker keeps between tasks is bounded, and goes with its job."""
import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitetable.llm import histogram_packing
from sitetable.llm.queries import tokenizer_path


def words_held(docs):
    """The largest number of words that a worker holds whose task has nothing to do with packing."""
    def count(batches):
        for batch in batches:
            held = [len(x.known) for x in gc.get_objects() if type(x).__name__ == "WordIds"]
            yield pa.RecordBatch.from_arrays([pa.array([sum(held)] * batch.num_rows, pa.int64())], ["n"])

    return docs.select("doc_id").mapInArrow(count, "n long").agg(F.max("n")).first()[0]


def test_words_go_when_the_worker_gets_another_job(spark):
    docs = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "concat('alpha beta gamma word', id, ' tail') AS text")
    assert histogram_packing.pieces(docs, tokenizer_path()).agg(F.sum("length")).first()[0] > 400
    assert words_held(docs) == 0


@pytest.mark.parametrize("frequent", ["common", "Common,", "###"])
def test_kept_words_are_bounded_and_frequent_ones_stay(monkeypatch, frequent):
    monkeypatch.setattr(histogram_packing, "CACHE_BYTES", 40_000)
    ids, whole, coded, most = histogram_packing.WordIds(tokenizer_path()), {}, [], 0
    plain = ids._coded
    monkeypatch.setattr(ids, "_coded", lambda words: coded.extend(words) or plain(words))
    for i in range(60):
        text = " ".join([frequent, *(f"rare{i}x{k}" for k in range(30))])
        whole[text] = ids.encode([text])[0]
        most = max(most, len(ids.known) + len(getattr(ids, "older", ())))
    assert most < 2 * 40_000 / histogram_packing.ENTRY_BYTES
    assert coded.count(histogram_packing._core(frequent)[0]) == 1
    for text, raw in whole.items():
        alone = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert raw == b"".join(i.to_bytes(4, "little") for i in alone)
