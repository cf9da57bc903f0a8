import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(texts):
    """documents rows from {doc_id: text} or [(doc_id, text)]."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    return [(i, t, "en", "s", len(t or "")) for i, t in pairs]


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts: spark.createDataFrame(doc_rows(texts), DOC_SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_file():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


ODD_TEXTS = [
    (5, None), (3, ""), (9, " \n\t "), (7, "One two. Three!"), (7, "One two. Three!"), (8, "One two. Three!"),
    (None, "no id"), (11, "x"), (12, "Ünï cödé ΣΑΣ İ 日本語 é ﬁ ²½   nb sp"), (13, "a<|endoftext|>b <|startoftext|>"),
    (14, "don't they'll 's IT'S 1234 ..'s\x1cfoo\x85bar﻿"), (15, "long word " * 9000), (16, "w" * 30000),
    (17, "\\### Assistant: </turn> ok"),
]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS
