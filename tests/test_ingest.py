"""Raw corpora on disk, from the scan to the written tables."""

import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from splitloom.operators.prepare import with_doc_ids
from splitloom.sources import corpora
from splitloom.sources.files import read_files, write_files
from splitloom.sources.tables import parse_truth, read_metadata, read_truth_lines, read_tsv
from splitloom.sources.trees import coded_tree, find_directory
from splitloom.sources.xml import element_texts, path_steps, read_xml_corpus, resolve_languages, xml_documents
from splitloom.session import scratch_path


def write(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(content if isinstance(content, bytes) else content.encode())
    return str(root)


def test_guardian(spark, tmp_path):
    root = write(tmp_path, {
        "raw/UK/ann/1.txt": "café – “q”".encode("cp1252"),
        "raw/Books/bob smith/x 2.txt": b"two",
        "raw/Books/bob smith/note.md": b"no",
        "raw/readme.txt": b"no",
        "raw/Books/deep/er/3.txt": b"no",
    })
    rows = corpora.guardian(spark, f"{root}/raw").collect()
    assert {(r.category, r.author, r.text) for r in rows} == {
        ("UK", "ann", "café – “q”"), ("Books", "bob smith", "two"),
    }


def test_reuters(spark, tmp_path):
    root = write(tmp_path, {
        "C50train/ann/1.txt": "a", "C50test/ann/2.txt": "b", "C50test/bob/3.txt": "c", "other/bob/4.txt": "d",
    })
    rows = corpora.reuters(spark, root).collect()
    assert {(r.category, r.author, r.text) for r in rows} == {
        ("train", "ann", "a"), ("test", "ann", "b"), ("test", "bob", "c"),
    }
    with pytest.raises(ValueError, match="'valid'"):
        find_directory(read_files(spark, root), "valid")


def test_cmcc(spark, tmp_path):
    root = write(tmp_path, {
        "Chat/Correlated/S12C3G1.txt": "a",
        "Discussion/Correlated/S1D113.txt": "b",
        "Discussion/Other/S1D1I3.txt": "no",
        "Letters/Correlated/S1D1I3.txt": "no",
    })
    rows = corpora.cmcc(spark, root).collect()
    assert {(r.category, r.author, r.genre, r.topic, r.text) for r in rows} == {
        ("Chat", "S12", "C", "G", "a"), ("Discussion", "S1", "D", "I", "b"),
    }
    write(tmp_path, {"Chat/Correlated/wrong.txt": "x"})
    with pytest.raises(Exception, match="uncoded file name: Chat/Correlated/wrong.txt"):
        coded_tree(read_files(spark, root)).collect()


def test_novels(spark, tmp_path):
    text = " ".join(f"Sentence {i}." for i in range(7))
    root = write(tmp_path, {"austen/en/emma.v1.txt": text, "austen/es/emma.txt": "Una."})
    rows = corpora.novels(spark, root, chunk_size=3).orderBy("language", "chunk").collect()
    assert [(r.language, r.title, r.chunk) for r in rows] == [
        ("en", "emma.v1", 0), ("en", "emma.v1", 1), ("en", "emma.v1", 2), ("es", "emma", 0),
    ]
    assert rows[2].text == "Sentence 6."
    assert rows[1].text_path == "text_raw/austen_en_emma.v1_1.txt"


def test_tsv(spark, tmp_path):
    root = write(tmp_path, {"imdb62.txt": 'r1\t7\tm1\t8\tTitle\tSome "quoted" text\nr2\t7\tm2\t\tT\t"tab\there"\n'})
    rows = read_tsv(spark, f"{root}/imdb62.txt").orderBy("review_id").collect()
    assert [r.text_raw for r in rows] == ['Some "quoted" text', "tab\there"]
    assert rows[1].rating is None and rows[0].author == "7"
    write(tmp_path, {"broken.txt": 'r1\t7\tm1\t8\tTitle\t"two\nlines"\n'})
    with pytest.raises(Exception):
        read_tsv(spark, f"{root}/broken.txt").collect()
    assert read_tsv(spark, f"{root}/broken.txt", multi_line=True).first().text_raw == "two\nlines"


def test_metadata(spark, tmp_path):
    root = write(tmp_path, {"dataset.csv": 'Unnamed: 0,author,text_raw,stanza\n0,"a, b",t/1.txt,/abs/1\n'})
    row = read_metadata(spark, root).first()
    assert row.asDict() == {"author": "a, b", "text_raw": f"{root}/t/1.txt", "stanza": "/abs/1"}
    write(tmp_path, {"dataset.csv": "author,text_raw\na,t/1.txt\n"})
    assert read_metadata(spark, root).columns == ["author", "text_raw"]


def test_truth(spark, tmp_path):
    lines = "".join(f"a{i % 50}:::{i}\n" for i in range(2000))
    root = write(tmp_path, {"en/truth.txt": lines, "truth-en.txt": "x:::1\n", "truth-es.txt": " b:::2 \n"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        last = parse_truth(read_truth_lines(spark, root, "en"), ["author", "n"])
        found = {r.author: int(r.n) for r in last.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {f"a{i}": 1950 + i for i in range(50)}
    assert parse_truth(read_truth_lines(spark, root, "es"), ["author", "n"]).first().author == "b"
    with pytest.raises(FileNotFoundError):
        read_truth_lines(spark, root, "de")
    with pytest.raises(Exception, match="wrong number of truth fields: x:::1"):
        parse_truth(read_truth_lines(spark, root, "en").selectExpr("'x:::1' value", "position"), ["a", "b", "c"]).collect()


def test_xml(spark, tmp_path):
    xml = (
        '<author lang="en"><documents><document><![CDATA[one & <two>]]> three</document>'
        "<document id='2'>four &amp; five\nsix</document></documents></author>"
    )
    root = write(tmp_path, {
        "pan-train/en/a1.xml": xml, "pan-train/en/truth.txt": "a1:::female:::18-24\n",
        "pan-test/en/a2.xml": xml.replace("one", "uno"), "pan-test/truth-en.txt": "a2:::male:::25-34\n",
        "pan-train/es/a3.xml": xml, "pan-train/es/truth.txt": "a3:::male:::25-34\n",
    })
    columns = ["author_id", "gender", "age"]
    rows = read_xml_corpus(spark, root, columns, "documents/document", ["en"]).collect()
    assert {(r.data_type, r.language, r.author, r.gender, r.text) for r in rows} == {
        ("train", "en", "a1", "female", "one & <two> three"), ("train", "en", "a1", "female", "four & five\nsix"),
        ("test", "en", "a2", "male", "uno & <two> three"), ("test", "en", "a2", "male", "four & five\nsix"),
    }
    with pytest.raises(ValueError, match="'es' is missing on the test side"):
        read_xml_corpus(spark, root, columns, "documents/document")
    files = read_files(spark, root, "*.xml")
    assert xml_documents(files, "./documents/other").count() == 0


def test_languages(spark):
    train = spark.createDataFrame([("en",), ("de",)], "language string")
    test = spark.createDataFrame([("en",), ("de",), ("fr",)], "language string")
    assert resolve_languages(train, test) == ["de", "en"]
    assert resolve_languages(train, test, ["en"]) == ["en"]
    with pytest.raises(ValueError, match="'fr' is missing on the train side"):
        resolve_languages(train, test, ["fr"])
    with pytest.raises(ValueError, match="no languages"):
        resolve_languages(train.limit(0), test)


def _problems(tmp_path):
    return write(tmp_path, {
        "collection-info.json": json.dumps([
            {"problem-name": "problem00001", "language": "en", "encoding": "UTF-8"},
            {"problem-name": "problem00002", "language": "sp"},
        ]),
        "problem00001/candidate00001/known00001.txt": "k1",
        "problem00001/candidate00002/known00001.txt": "k2",
        "problem00001/candidate00002/other.txt": "no",
        "problem00001/unknown/unknown00001.txt": "u1",
        "problem00001/unknown/unknown00009.txt": "not in the truth",
        "problem00001/ground-truth.json": json.dumps(
            {"ground_truth": [{"unknown-text": "unknown00001.txt", "true-author": "candidate00002"}]}, indent=1
        ),
        "problem00002/candidate00001/known00001.txt": "sí",
        "problem00002/unknown/unknown00001.txt": "u2",
        "problem00002/ground-truth.json": json.dumps(
            {"ground_truth": [{"unknown-text": "unknown00001.txt", "true-author": "candidate00001"}]}
        ),
    })


def test_problems(spark, tmp_path):
    root = _problems(tmp_path)
    rows = corpora.pan18(spark, root).collect()
    assert {(r.problem, r.data_type, r.author, r.language, r.text) for r in rows} == {
        ("problem00001", "train", "candidate00001", "en", "k1"),
        ("problem00001", "train", "candidate00002", "en", "k2"),
        ("problem00001", "test", "candidate00002", "en", "u1"),
        ("problem00002", "train", "candidate00001", "es", "sí"),
        ("problem00002", "test", "candidate00001", "es", "u2"),
    }
    os.remove(f"{root}/problem00002/unknown/unknown00001.txt")
    write(tmp_path, {"problem00002/unknown/other.txt": "x"})
    with pytest.raises(Exception, match="missing file"):
        corpora.pan18(spark, root).collect()


def test_broken_or_missing_truth_is_an_error(spark, tmp_path):
    root = _problems(tmp_path)
    truth = tmp_path / "problem00002" / "ground-truth.json"
    whole = truth.read_bytes()
    truth.write_bytes(whole[:-5])
    with pytest.raises(Exception, match="(?i)malformed"):
        corpora.pan18(spark, root).collect()
    truth.unlink()
    with pytest.raises(Exception, match="no truth for problem00002"):
        corpora.pan18(spark, root).collect()


def test_names_that_a_scan_skips(spark, tmp_path):
    root = write(tmp_path, {
        "_ann/en/emma.txt": "x", "bob/en/_emma.txt": "y", "bob/en/ok.txt": "z", "bob/en/._emma.txt": "no", ".git/en/a.txt": "no",
        "bob/en/_note.md": "no", "_top.txt": "t",
    })
    files = read_files(spark, root)
    assert {(r.path, bytes(r.content)) for r in files.collect()} == {
        ("_ann/en/emma.txt", b"x"), ("bob/en/_emma.txt", b"y"), ("bob/en/ok.txt", b"z"), ("_top.txt", b"t"),
    }
    assert sorted(r.path for r in read_files(spark, root, below="*/en").collect()) == [
        "_ann/en/emma.txt", "bob/en/_emma.txt", "bob/en/ok.txt",
    ]
    assert {r.path for r in read_files(spark, root, below="{bob,eve}/en").collect()} == {"bob/en/_emma.txt", "bob/en/ok.txt"}
    plain = read_files(spark, write(tmp_path / "b", {"bob/ok.txt": "z"}))
    assert plain.count() == 1


def test_written_files(spark, tmp_path):
    rows = [(f"a{n % 3}/_f {n}.txt", bytes([n])) for n in range(20)] + [("top.txt", None)]
    frame = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    root = str(tmp_path / "new")
    assert write_files(frame, root) == 21
    assert {(r.path, bytes(r.content)) for r in read_files(spark, root).collect()} == {(p, c or b"") for p, c in rows}
    with pytest.raises(ValueError, match="not empty"):
        write_files(frame, root)
    with pytest.raises(ValueError, match="several rows"):
        write_files(frame.unionByName(frame), str(tmp_path / "other"))


def test_xml_encodings(spark):
    text = '<?xml version="1.0" encoding="{}"?>\n<a><d>é</d></a>'
    files = [
        ("en/a.xml", text.format("ISO-8859-1").encode("latin-1")), ("en/b.xml", text.format("UTF-8").encode()),
        ("en/c.xml", text.format("windows-1252").encode("cp1252")), ("en/d.xml", text.format("UTF-16").encode("utf-16")),
    ]
    frame = spark.createDataFrame(files, "path string, content binary")
    assert [row.text for row in xml_documents(frame, "./d").collect()] == ["é"] * 4
    for content in (text.format("UTF-8").encode("latin-1"), text.format("klingon").encode(), b"<a><d></a>", b"", b"<a>", None):
        bad = spark.createDataFrame([("en/x.xml", content)], "path string, content binary")
        with pytest.raises(Exception, match="en/x.xml"):
            xml_documents(bad, "d").collect()


XML = """<a><d>one <b>two</b> three</d><d/><d> </d><!-- c --><e><d>x<!-- c -->y<d>in</d>z</d></e><b><b>deep</b></b><d>&amp;<![CDATA[<]]></d>
<n:d xmlns:n="urn:n">n</n:d></a>"""


@pytest.mark.parametrize("search", ["d", "./d", "e/d", ".//d", "*", "*/d", ".//b", "e//d", "./e/*", "b/b", "{urn:n}d", ".//{urn:n}d", "a", ".//*", "e/", "e//"])
def test_xml_paths_are_those_of_element_tree(search):
    found = sorted(element_texts(XML.encode(), path_steps(search)))
    assert [text for _, text in found] == [e.text for e in ElementTree.fromstring(XML).findall(search)]
    assert [place for place, _ in found] == list(range(len(found)))


@pytest.mark.parametrize("search", ["", "/d", "..", "d[1]", ".//a//b", "d//e//f", "a b"])
def test_other_xml_paths_are_errors(search):
    with pytest.raises(ValueError, match="not an element path"):
        path_steps(search)


def test_large_xml_files(spark):
    body = "".join(f"<d>{n}<x>y</x></d>" for n in range(30_000)) + "<d>" + "é" * 200_000 + "</d>"
    frame = spark.createDataFrame([("en/a.xml", f"<a>{body}</a>".encode())], "path string, content binary")
    rows = xml_documents(frame, "d").orderBy("position").collect()
    assert [r.text for r in rows] == [*map(str, range(30_000)), "é" * 200_000]


def test_written_corpus(spark, tmp_path):
    raw = write(tmp_path / "raw", {
        "UK/ann/2.txt": b"two", "UK/ann/1.txt": b"one", "Books/bob/1.txt": b"NA", "Books/bob/2.txt": b"four",
    })
    output = str(tmp_path / "processed")
    corpora.ingest(spark, "guardian", raw, output)
    rows = corpora.load_corpus(spark, output, with_text=True).orderBy("doc_id").collect()
    # Numbered by path before the incomplete text is dropped.
    assert [(r.category, r.text) for r in rows] == [("Books", "four"), ("UK", "one"), ("UK", "two")]
    assert all(r.language == "en" and r.text_path == f"text_raw/{r.doc_id}_{r.author}.txt" for r in rows)
    assert "text" not in corpora.load_corpus(spark, output).columns
    with pytest.raises(Exception, match="(?i)already exists"):
        corpora.ingest(spark, "guardian", raw, output)
    before = corpora.load_corpus(spark, output)
    corpora.ingest(spark, "guardian", raw, output, force=True)
    assert corpora.load_corpus(spark, output).count() == 3
    assert before.count() == 3
    assert corpora.drop_old_versions(spark, output) == 1
    assert corpora.load_corpus(spark, output).count() == 3


def test_a_failed_run_leaves_the_old_corpus(spark, tmp_path):
    output = str(tmp_path / "processed")
    docs = spark.range(5).withColumn("text", F.lit("x"))
    corpora.write_corpus(docs, output)
    broken = docs.withColumn("text", F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        corpora.write_corpus(broken, output, force=True)
    assert [r.text for r in corpora.load_corpus(spark, output, with_text=True).collect()] == ["x"] * 5
    # What the failed run has written goes with the other old versions.
    corpora.write_corpus(docs.withColumn("text", F.lit("y")), output, force=True)
    assert corpora.drop_old_versions(spark, output) == 2
    assert [r.text for r in corpora.load_corpus(spark, output, with_text=True).collect()] == ["y"] * 5
    with pytest.raises(FileNotFoundError):
        corpora.load_corpus(spark, str(tmp_path / "none"))


def test_texts_are_read_without_an_exchange(spark, tmp_path):
    output = str(tmp_path / "processed")
    corpora.write_corpus(spark.range(5).withColumn("text", F.lit("x")), output)
    plan = corpora.load_corpus(spark, output, with_text=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    plan = corpora.load_corpus(spark, output)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_numbers_have_no_gaps(spark):
    rows = [(n * 7 % 50, None if n % 9 == 0 else f"p{n % 20:02d}") for n in range(300)]
    frame = spark.createDataFrame(rows, "a long, path string").repartition(7)
    found = with_doc_ids(frame, ("path", "a")).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(300))
    assert [(r.path, r.a) for r in found] == sorted(((p, a) for a, p in rows), key=lambda r: (r[0] is not None, r))
    assert with_doc_ids(frame.limit(0)).collect() == []


def test_line_breaks_in_quotes(spark, tmp_path):
    raw = write(tmp_path / "raw", {"imdb62.txt": 'r1\ta\tm\t8\tT\t"two\nlines"\nr2\ta\tm\t8\tT\tone\n'})
    output = str(tmp_path / "out")
    corpora.ingest(spark, "imdb62", raw, output, multi_line=True)
    assert [r.text for r in corpora.load_corpus(spark, output, with_text=True).orderBy("doc_id").collect()] == ["two\nlines", "one"]


@pytest.mark.parametrize(
    ("corpus", "n_docs"),
    [("cl_novels", 3), ("pan18_attribution", 5), ("imdb62", 3), ("reuters-c50", 2)],
)
def test_ingest_other_layouts(spark, tmp_path, corpus, n_docs):
    if corpus == "pan18_attribution":
        raw = _problems(tmp_path / "raw")
    else:
        raw = write(tmp_path / "raw", {
            "austen/en/emma.txt": "One. Two.", "austen/en/empty.txt": "",
            # Two reviews are the same, and stay two.
            "imdb62.txt": "r1\ta\tm\t8\tT\ttext\n" * 2 + "r2\ta\tm\t8\tT\tother\n",
            "train/ann/1.txt": "a", "test/ann/1.txt": "b",
        })
    output = str(tmp_path / "out")
    corpora.ingest(spark, corpus, raw, output)
    loaded = corpora.load_corpus(spark, output, with_text=True)
    assert loaded.count() == n_docs
    assert loaded.select("doc_id").distinct().count() == loaded.count()


def test_scratch_folder_is_the_shared_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(folder.rstrip("/"))
