import pytest

LONG = " ".join(f"word{k % 997} of{k % 13}" for k in range(30_000))


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text, lang, source, n_chars, and columns whose names operators use themselves."""
    texts = [None, "", " \n\t ", "one", "the same text here\nand a second line", "the same text here\nand a second line", LONG, "ünïcode 中文 😀 <|endoftext|> x", "\0 odd \x1c bytes \x85"]
    rows = [(k, t, "en" if k % 2 else None, f"src{k % 3}" if k else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "a row without id", None, None, 3), (None, None, None, None, None)]
    return [(*r, 1, "x", 0.5, True, *range(len(HELPERS))) for r in rows]


#: Names that operators give to columns on the way.
HELPERS = ["__toxic", "__sha", "__id", "__row", "__key", "__key___k", "__k", "__words", "__text", "__body", "__h", "h", "bits", "word", "padded", "hits", "fingerprint", "component_id"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, shard int, failed_rule string, score double, kept boolean, " + ", ".join(f"{h} int" for h in HELPERS)


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, KIND).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
