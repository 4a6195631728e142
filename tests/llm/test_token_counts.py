import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tracewright.llm import token_counts as t

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", " \n ", "\n a", "a\n  b \n", "▁", "▁a ▁ b", "\n▁x", "a▁\nb", "<s>hi</s> <unk>", "<0x0A>\n<0x0A>", "\t\r\nq", "ﬁ é ́", "漢字 かな\n한글", "🙂🙂 x", "a b c", "x" * 3000, ("ab " * 4000) + "\n" * 50, "   lead", "tail   ", "a\n\n\n   b   \n"]


def test_odd_texts_equal_the_library():
    model = t.load_model(PATH)
    for x in ODD:
        assert sum(t.count_pieces(model, t.pre_tokens(x))) == len(model.encode(x)), repr(x)


@pytest.mark.parametrize("head", [0, 50, 200_000])
def test_documents_equal_the_library(spark, head):
    model = t.load_model(PATH)
    rows = [(i, x, "kept") for i, x in enumerate(ODD)] + [(3, ODD[3], "again"), (None, None, None)]
    rows += [(r["doc_id"] + 1000, r["text"], None) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = t.count_tokens(docs, PATH, head)
    want = sorted(((i, e, len((x or "").encode()), len(model.encode(x or ""))) for i, x, e in rows), key=str)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_bytes", "n_tokens").collect()), key=str) == want
    assert t.count_tokens(docs.where("false"), PATH, head).count() == 0
