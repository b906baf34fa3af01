import io
import json
import os
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import cli, server
from sparkloom.errors import IndexNotFound, ParseError, UnsupportedFileType
from sparkloom.operators.search import Engine, hamming_pairs, lsh_clusters
from sparkloom.plans.index import Index, IndexStats, resolve_index
from sparkloom.plans.output import render
from sparkloom.sources import files, kinds, parsers
from sparkloom.sources.ignore import Rules, ignored
from sparkloom.streaming import ingest


@pytest.mark.parametrize("path, kind", [("README.md", ("markdown", None)), ("doc.PDF", ("pdf", None)), ("x/report.docx", ("docx", None)), ("main.rs", ("code", "rust")), ("image.png", ("unknown", None)), ("txt", ("unknown", None)), ("a.b.zsh", ("code", "shell"))])
def test_detect_kind(spark, path, kind):
    assert kinds.detect_kind(path) == kind
    r = spark.createDataFrame([(path,)], "p string").select(kinds.kind(F.col("p")).alias("k"), kinds.language(F.col("p")).alias("l")).first()
    assert tuple(r) == kind


def test_text_decoding():
    assert parsers.decode(b"\xef\xbb\xbfhi") == "hi"
    assert parsers.decode(b"caf\xe9") == "café"


def test_markdown():
    text, title = parsers.markdown("---\ntitle: x\n---\n# Hello \n\n## Part\nSee [docs](url) for **details** and `code` [open\n")
    assert title == "Hello"
    assert "title: x" not in text and "See docs for details and code [open\n" in text
    assert parsers.strip_links("[a](b) [c](d [e] f") == "a [cd [e] f"


def test_comments():
    src = 'int x = 1; // gone\nchar *s = "// stays"; /* gone\n too */ int y;\n'
    assert parsers.strip_slash_comments(src) == 'int x = 1; \nchar *s = "// stays";  int y;\n'
    assert parsers.strip_slash_comments("let a = 'it // in';") == "let a = 'it // in';"
    assert parsers.strip_hash_comments("#!/bin/sh\nx = 1  # a comment\ns = '# in'\n") == "#!/bin/sh\nx = 1\ns = '# in'"
    with pytest.raises(ParseError):
        parsers.code(b"\xff", "a.py", "python")


def docx_bytes(title="Plan"):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p><w:r><w:t> Second </w:t></w:r></w:p></w:body></w:document>')
        if title:
            z.writestr("docProps/core.xml", f'<c xmlns:dc="dc"><dc:title>{title}</dc:title></c>')
    return data.getvalue()


def test_docx():
    assert parsers.docx(docx_bytes(), "/a/b.docx") == ("First\nSecond", "Plan")
    assert parsers.docx(docx_bytes(None), "/a/b.docx")[1] == "b"
    with pytest.raises(ParseError):
        parsers.docx(b"no zip", "x.docx")


def test_pdf():
    page = b"BT (Hello \\(big\\)) Tj T* [(wor) -20 (ld)] TJ ET"
    data = b"%PDF-1.4\n1 0 obj <</Title (My Doc)>> endobj\n2 0 obj <</Filter /FlateDecode /Length 1>>\nstream\n" + zlib.compress(page) + b"\nendstream endobj"
    assert parsers.pdf(data, "/x/y.pdf") == ("Hello (big) world", "My Doc")
    with pytest.raises(ParseError):
        parsers.pdf(b"%PDF-1.4 nothing", "y.pdf")
    with pytest.raises(UnsupportedFileType):
        parsers.parse("a.png", b"")


def test_ignore_rules():
    rules = [Rules("/r", ["*.log", "!keep.log", "/top.txt", "build/", "a/**/z.md", "# note", "d?t.[ch]"])]
    hit = lambda p, d=False: ignored(f"/r/{p}", d, rules)
    assert hit("x.log") and hit("s/x.log") and not hit("s/keep.log")
    assert hit("top.txt") and not hit("s/top.txt")
    assert hit("s/build", True) and not hit("build")
    assert hit("a/z.md") and hit("a/b/c/z.md") and hit("dot.c") and not hit("dot.d")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "deal.txt").write_text("This agreement of 2024-01-15 names $25,000 and $150,000 for legal@acme.com. Acme Corporation signs.")
    (root / "report.md").write_text("# Results\nExecutive summary: revenue of $450,000 by Jane Smith.")
    (root / "sub" / "main.rs").write_text("// note\nfn main() { /* x */ }\n")
    (root / "_under.txt").write_text("underscore names are taken in")
    (root / "latin.txt").write_bytes(b"caf\xe9 terrasse")
    (root / ".hidden.txt").write_text("hidden")
    (root / "skip.txt").write_text("skipped")
    (root / ".searchignore").write_text("skip.txt\n")
    (root / "bad.docx").write_bytes(b"broken")
    (root / "image.png").write_bytes(b"x")
    return root


def names(frame):
    return sorted(os.path.basename(r["path"]) for r in frame.select("path").collect())


def test_walk(spark, folder):
    assert names(files.walk_frame(spark, str(folder))) == ["_under.txt", "bad.docx", "deal.txt", "latin.txt", "main.rs", "report.md"]
    assert "deal.txt" in names(files.binary_frame(spark, str(folder)))


def test_index_and_requests(spark, folder, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert index.update(str(folder)) == IndexStats(5, 0, 0, 1)
    assert names(index.errors()) == ["bad.docx"]
    assert index.update(str(folder)) == IndexStats(0, 5, 0, 1)
    docs = {os.path.basename(r["path"]): r for r in index.docs().collect()}
    assert docs["deal.txt"]["doc_type"] == "contract" and docs["deal.txt"]["amounts"] == [25000.0, 150000.0]
    assert docs["report.md"]["title"] == "Results" and docs["main.rs"]["title"] == "main.rs" and docs["latin.txt"]["text"] == "café terrasse"
    assert [r["doc_id"] for r in index.all_docs().collect()] == [0, 1, 2, 3, 4]
    for postings in (None, index.postings()):
        engine = Engine(index.docs(), postings=postings)
        assert names(engine.search("agreement")) == ["deal.txt"]
        assert engine.search("qqqzzzxxyyqqqzzzxxyyqqqzzzxxyyqqqzz").count() == 0
        assert engine.search("zz").count() == 0
        assert names(engine.query("type:contract")) == ["deal.txt"]
        assert names(engine.query("amount:>100000")) == ["deal.txt", "report.md"]
        assert names(engine.query("agreement summary")) == ["deal.txt", "report.md"]
    # change one file, remove one, add a copy of another
    (folder / "deal.txt").write_text("Nothing left but an invoice number")
    os.utime(folder / "deal.txt", (1_600_000_000, 1_600_000_000))
    (folder / "latin.txt").unlink()
    (folder / "copy.md").write_text((folder / "report.md").read_text())
    assert index.update(str(folder)) == IndexStats(2, 3, 1, 1)
    engine = Engine(index.docs(), postings=index.postings())
    assert engine.search("agreement").count() == 0 and names(engine.search("invoice")) == ["deal.txt"]
    assert index.doc_count() == 5 and index.docs().groupBy("doc_id").count().where("count > 1").count() == 0
    best = engine.similar(str(folder / "report.md"), limit=1).first()
    assert best["path"].endswith("copy.md") and best["score"] == 1.0 and best["snippet"] == "similarity: 100%  (hamming distance: 0)"
    assert engine.similar(text="", limit=3).count() == 3
    assert [sorted(map(os.path.basename, r["members"])) for r in engine.clusters(2, str(folder)).collect()] == [["copy.md", "report.md"]]
    recent = [os.path.basename(r["path"]) for r in engine.recent("9999y").collect()]
    assert recent[-1] == "deal.txt" and len(recent) == 5
    assert engine.recent("1d").count() == 4 and engine.recent("garbage").count() == 5 and engine.recent("2024-06-01").count() == 4
    # a touched file with the same bytes is read, found the same, and left alone
    os.utime(folder / "report.md")
    assert index.update(str(folder)).added == 0
    assert index.update(str(folder), full=True).added == 5
    index.compact()
    assert len(index.segments()) == 1
    assert names(Engine(index.docs(), postings=index.postings()).search("invoice")) == ["deal.txt"]


def test_parts_add_up(spark, tmp_path, monkeypatch):
    """Updates write what came; whole tables, merged postings and vacuum change no answer; ids are never given again."""
    monkeypatch.setattr("sparkloom.plans.index.MANY_PARTS", 3)
    root = tmp_path / "docs"
    root.mkdir()
    for k in range(20):
        (root / f"f{k:02d}.txt").write_text(f"word{k:02d} common")
    index, texts, given = Index(spark, str(tmp_path / "index")), {f"f{k:02d}.txt": f"word{k:02d} common" for k in range(20)}, set()
    index.update(str(root))
    assert index.update(str(root)).added == 0 and index.version() == 1
    for turn in range(5):
        (root / "f03.txt").write_text(f"turn{turn} common")
        os.utime(root / "f03.txt", (1_600_000_000 + turn, 1_600_000_000 + turn))
        (root / f"f{19 - turn:02d}.txt").unlink()
        (root / f"n{turn}.txt").write_text(f"fresh{turn} common")
        texts |= {"f03.txt": f"turn{turn} common", f"n{turn}.txt": f"fresh{turn} common"}
        del texts[f"f{19 - turn:02d}.txt"]
        assert index.update(str(root)) == IndexStats(2, 18, 1, 0)
        rows = {os.path.basename(r["path"]): r for r in index.docs().collect()}
        assert {n: r["text"] for n, r in rows.items()} == texts
        fresh = {rows["f03.txt"]["doc_id"], rows[f"n{turn}.txt"]["doc_id"]}
        assert not fresh & given
        given |= {r["doc_id"] for r in rows.values()}
        if turn == 3:
            index.compact()
            index.vacuum()
            assert len(index.segments()) == 1
    assert len(index._live("full", "docs", "v=")[1]) < 3
    engine = Engine(index.docs(), postings=index.postings())
    assert names(engine.search("common", limit=50)) == sorted(texts) and names(engine.search("turn4")) == ["f03.txt"]
    assert not engine.search("word19").count()


@pytest.mark.parametrize("threshold", [0, 3, 8, 12])
def test_hamming_pairs_are_all(spark, threshold):
    rng = np.random.default_rng(threshold)
    own = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40)]
    for x in list(own):
        for flips in (1, 3, 8, 12, 13):
            y = x
            for bit in rng.choice(64, flips, replace=False).tolist():
                y ^= 1 << bit if bit < 63 else -(1 << 63)
            own.append(y)
    found = {(r["a"], r["b"], r["distance"]) for r in hamming_pairs(spark.createDataFrame(list(enumerate(own)), "doc_id long, simhash long"), 16, threshold).collect()}
    apart = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    assert found == {(i, j, apart(x, y)) for i, x in enumerate(own) for j, y in enumerate(own) if i < j and apart(x, y) <= threshold}


def test_hamming_pairs_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("id AS doc_id", "xxhash64(id) AS simhash").write.parquet(str(tmp_path / "f"))
    pairs = hamming_pairs(spark.read.parquet(str(tmp_path / "f")), 4, 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_removal_keeps_other_roots(spark, folder, tmp_path):
    index = Index(spark, str(tmp_path / "index"), with_postings=False)
    index.update(str(folder / "sub"))
    other = tmp_path / "docs2"
    other.mkdir()
    (other / "a.txt").write_text("other")
    assert index.update(str(other)) == IndexStats(1, 0, 0, 0)
    assert names(index.docs()) == ["a.txt", "main.rs"]


def test_streaming(spark, folder, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    for added in (3, 3):
        ingest.start(index, str(folder), str(tmp_path / "ck"), once=True).awaitTermination(120)
        assert index.doc_count() >= added
    before = index.doc_count()
    (folder / "later.txt").write_text("arrived later")
    ingest.start(index, str(folder), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert index.doc_count() == before + 1


def test_output(spark):
    rows = spark.createDataFrame([("/a", 0.5, "contract", "line one\nline two", None), ("/b", 1.0, None, 'q"\t', "body")], "path string, score double, type string, snippet string, content string")
    assert render(rows) == "[1] /a (score: 0.500, type: contract)\n    line one\n[2] /b (score: 1.000, type: doc)\nbody"
    assert json.loads(render(rows, "json"))[1] == {"path": "/b", "score": 1.0, "type": None, "snippet": 'q"\t', "content": "body"}
    assert render(rows, "tsv").split("\n")[0] == "/a\t0.500000\tline one line two"


def test_command_line(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    call = lambda *a: cli.run(spark, cli.parser().parse_args(["--index", index, *a]))
    assert call("index", str(folder)) == "added 5, skipped 0, removed 0, errors 1"
    assert "deal.txt" in call("search", "agreement") and "deal.txt" in call("query", "type:contract")
    assert "report.md" in call("similar", str(folder / "deal.txt")) and call("recent")
    assert call("clusters") == ""


def test_no_index(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    with pytest.raises(IndexNotFound):
        resolve_index(None, str(tmp_path))
    (tmp_path / ".sparkloom").mkdir()
    (tmp_path / "deep").mkdir()
    assert resolve_index(None, str(tmp_path / "deep")) == str(tmp_path / ".sparkloom")


def test_clusters_count_equal_sets_once(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 0), (4, 0), (5, 1 << 40), (6, 5 + (1 << 40))], "doc_id long, simhash long")
    found = {}
    for r in lsh_clusters(rows, 2).collect():
        found.setdefault(r["set"], set()).add(r["id"])
    assert sorted(map(sorted, found.values())) == [[1, 2], [1, 2, 6], [5, 6]]
    many = spark.createDataFrame([(f"/d/{i:02d}", 9) for i in range(12)] + [("/e/x", 9)], "path string, simhash long")
    shown = Engine(many).clusters(2, "/d").collect()
    assert [(r["size"], r["members"], r["more"]) for r in shown] == [(12, [f"/d/{i:02d}" for i in range(5)], 7)]
    assert Engine(many).clusters(2, shown=None).first()["more"] == 0


def test_store_index(spark, folder, tmp_path):
    """A root with a scheme is listed and read by Spark alone; ignore files don't count there."""
    index = Index(spark, str(tmp_path / "index"))
    root = f"file://{folder}"
    assert index.update(root) == IndexStats(5, 0, 0, 1)  # without _under.txt, with skip.txt
    assert names(index.docs()) == ["deal.txt", "latin.txt", "main.rs", "report.md", "skip.txt"]
    assert index.update(root) == IndexStats(0, 5, 0, 1)
    (folder / "latin.txt").unlink()
    assert index.update(root) == IndexStats(0, 4, 1, 1)
    assert names(Engine(index.docs(), postings=index.postings()).search("agreement")) == ["deal.txt"]


def test_search_modes(spark):
    rows = [("/a", "the purchase agreement stands"), ("/b", "agreement on a purchase"), ("/c", "nothing here")]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string").selectExpr(
        "doc_id", "path", "text", "text as norm", "text as snippet", "cast(null as string) as title", "cast(null as string) as doc_type", "timestamp'2024-01-01' as mtime"
    )
    engine = Engine(docs)
    assert engine.search("agreemant").count() == 0 and names(engine.search("agreemant", min_overlap=0.5)) == ["a", "b"]
    assert names(engine.query('"purchase agreement"')) == ["a", "b"] and names(engine.query('"Purchase  agreement"', strict_phrase=True)) == ["a"]


def test_tool_server(spark, folder, tmp_path):
    index, out = str(tmp_path / "index"), []
    ask = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "index", "arguments": {"path": str(folder)}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"text": "agreement", "limit": 3, "full_content": True}}},
        {"id": 5, "method": "tools/call", "params": {"name": "query", "arguments": {"expression": "()"}}},
        {"id": 6, "method": "tools/call", "params": {"name": "search", "arguments": {}}}, {"id": 7, "method": "nothing"}, {"id": 8, "method": "tools/call", "params": {"name": "recent", "arguments": {"limit": "x"}}},
    ]
    server.serve([*map(json.dumps, ask), "", "no json", "[]"], lambda t: out.append(json.loads(t)), lambda verb, args: server.call(spark, verb, args, index))
    by_id = {m["id"]: m for m in out}
    assert [m["id"] for m in out] == [1, 2, 3, 4, 5, 6, 7, 8, None, None]
    assert [t["name"] for t in by_id[2]["result"]["tools"]] == ["index", "search", "query", "similar", "recent", "clusters"]
    assert by_id[2]["result"]["tools"][1]["inputSchema"]["required"] == ["text"]
    text = lambda i: by_id[i]["result"]["content"][0]["text"]
    assert text(3) == "added 5, skipped 0, removed 0, errors 1" and "deal.txt" in text(4) and "names $25,000" in text(4)
    assert by_id[5]["result"]["isError"] and text(5).startswith("error: ")
    assert text(6) == "error: search needs text" and by_id[7]["error"]["code"] == -32601 and by_id[8]["result"]["isError"]


def test_pdf_hexadecimal_strings():
    data = b"%PDF-1.4\n2 0 obj <<>>\nstream\nBT <48656C 6C6F> Tj [<20> -3 (wor) <6c64>] TJ ET\nendstream endobj"
    assert parsers.pdf(data, "/x/y.pdf") == ("Hello world", "y")
