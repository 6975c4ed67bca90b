import pytest
from pyspark.sql import functions as F

from splitloom.functions import paths, text
from splitloom.operators.prepare import chunk_documents
from splitloom.sources.files import decoded


def _one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_every_windows_1252_byte(spark):
    defined = bytes(b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    assert _one(spark, defined, text.decode_cp1252, "binary") == defined.decode("cp1252")
    assert bytes(_one(spark, defined.decode("cp1252"), text.encode_cp1252)) == defined
    plain = "façade".encode("cp1252")
    assert _one(spark, plain, text.decode_cp1252, "binary") == "façade"


@pytest.mark.parametrize("byte", [0x81, 0x8D, 0x8F, 0x90, 0x9D])
def test_undefined_byte_is_an_error(spark, byte):
    files = spark.createDataFrame([("bad.txt", bytes([65, byte]))], "path string, content binary")
    with pytest.raises(Exception, match="not windows-1252: bad.txt"):
        decoded(files, "cp1252").collect()


def test_bad_utf8_is_an_error(spark):
    files = spark.createDataFrame([("bad.txt", b"A\xff")], "path string, content binary")
    with pytest.raises(Exception, match="not UTF-8: bad.txt"):
        decoded(files, "utf-8").collect()
    with pytest.raises(ValueError):
        decoded(files, "utf-16")


def test_sentences(spark):
    found = _one(spark, " One. Two!  Three?\nfour 1.5 five...  six ", text.sentences)
    assert found == ["One.", "Two!", "Three?", "four 1.5 five...", "six"]
    assert _one(spark, " \n ", text.sentences) == []


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 10, 11])
def test_chunks(spark, n):
    items = [f"s{i}." for i in range(n)]
    rows = spark.createDataFrame(
        [(1, "a", "en", "t", " ".join(items))], "doc_id long, author string, language string, title string, text string"
    )
    found = chunk_documents(rows, 5).orderBy("chunk").collect()
    assert [r.text for r in found] == [" ".join(items[i : i + 5]) for i in range(0, n, 5)]
    assert [r.text_path for r in found] == [f"text_raw/a_en_t_{i}.txt" for i in range(len(found))]
    with pytest.raises(ValueError):
        chunk_documents(rows, 0)


def test_paths(spark):
    assert _one(spark, "/r/c/a.b.txt", lambda v: paths.stem(paths.base_name(v))) == "a.b"
    assert _one(spark, ".hidden", paths.stem) == ".hidden"
    assert _one(spark, "x/y", lambda v: paths.under("/root", v)) == "/root/x/y"
    assert _one(spark, "/x/y", lambda v: paths.under("/root/", v)) == "/x/y"
    assert _one(spark, "file:/tmp/r(1)/x/y", lambda v: paths.relative_to("/tmp//r(1)/", v)) == "x/y"
    assert _one(spark, "a/b", lambda v: paths.part(v, 3)) is None
