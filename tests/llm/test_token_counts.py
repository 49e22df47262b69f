import public_tokenizers
import numpy as np
import pytest
import sentencepiece

from lodestar.llm.token_counts import pre_tokens, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b   c  ", "x\ny\n\nz", "\n\n", "a\n b\n\n c", "▁a▁", "a ▁ b", "<s> </s> <unk>",
    "é 　 \U0001f600\U0001f600 ﬁ", "tab\tcr\r\n", "w" * 5000, "and then " * 3000, "a b", "a b", "\x00 \x01", "\n\r \r\n \n\n\r",
]


@pytest.mark.parametrize("block", [1, 1000, 1 << 24])
def test_same_as_the_library(spark, block):
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(TEXTS)]
    got = sorted(token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL, block_bytes=block).collect(), key=str)
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len((t or "").encode()), len(encoder.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_pre_tokens_join_to_the_text():
    for text in filter(None, TEXTS):
        assert " ".join(pre_tokens(text)) == text.replace("▁", " ")


def test_remembered_words_are_bounded(spark):
    """Words that were forgotten are counted anew."""
    import pyarrow as pa

    from lodestar.llm import token_counts as module

    rows = [["a", "bb", "ccc"], ["a", "dddd"], ["bb", "a"]]
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = [x.split(" ")[0] for x in module.BLOCKS.split(", ")]
    made = [dict.fromkeys(names) | {"bucket": 0, "block": 0, "start": i, "words": module._zipped("\n\n".join(w).encode())} for i, w in enumerate(rows)]
    kept, module.KNOWN_WORDS = module.KNOWN_WORDS, 2
    try:
        out = [r for b in module._encode(MODEL)(iter([pa.RecordBatch.from_pylist(made, schema=module._schema(module.BLOCKS))])) for r in b.to_pylist()]
    finally:
        module.KNOWN_WORDS = kept
    got = [np.frombuffer(module._unzipped(r["counts"]), np.uint32).tolist() for r in out]
    assert got == [[len(encoder.encode(w)) for w in row] for row in rows]
