import pytest

#: Nulls, empty and white texts, few words, ties, repeated rows, odd characters, a very long text.
EDGE_TEXTS = [
    None, "", "   ", "one", "a b c", "Same words here in this text.", "Same words here in this text.",
    "tab\tand\nnew\r\nlines  two  spaces ", "café, naïve über × 日本語。 x", "<|endoftext|> in text", "nb sp   em",
    "it's 12.5% of $3,000!!! ... -- end", "long " * 3000 + "tail", "x" * 5000, "1234567890 " * 40,
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases, with columns of clashing names."""
    rows = [(i, t, i % 3, "u", f"w{i}") for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, word string, ids string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
