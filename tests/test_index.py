import hashlib
import http.server
import io
import json
import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import dicts
from sedgework.operators import completion, embedding, indexing, metadata, reports, tools
from sedgework.operators.store import IndexStore
from sedgework.sources import config, extract, files, ignore


def write(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def names(df):
    return sorted(os.path.basename(r["path"]) for r in dicts(df))


def test_walk(spark, tmp_path):
    write(tmp_path, a_DOT_md="x", b_DOT_txt="x", sub__c_DOT_MD="x", node_modules__d_DOT_md="x", _DOT_git__e_DOT_md="x", _DOT_hidden_DOT_md="x", big_DOT_md="x" * 500_000, p_DOT_pdf="x")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    assert names(files.collect_files(spark, [str(tmp_path)])) == [".hidden.md", "a.md", "c.MD"]
    assert names(files.collect_files(spark, [str(tmp_path)], patterns=["sub/"])) == [".hidden.md", "a.md"]
    assert names(files.collect_files(spark, [str(tmp_path / "a.md"), str(tmp_path), "/missing"])) == [".hidden.md", "a.md", "c.MD"]
    assert names(files.collect_files(spark, [str(tmp_path)], frozenset({".pdf"}))) == ["p.pdf"]
    os.remove(tmp_path / "link")
    assert names(files.object_store_files(spark, str(tmp_path))) == ["a.md", "c.MD"]
    assert files.collect_files(spark, []).count() == 0


@pytest.mark.parametrize(
    "path, patterns, want",
    [
        ("a/b.md", ["*.md"], True), ("a/b.md", ["/b.md"], False), ("b.md", ["/b.md"], True), ("a/x/b.md", ["a/**/b.md"], True), ("a/b.md", ["a/**/b.md"], True),
        ("a/keep.md", ["*.md", "!keep.md"], False), ("d/keep.md", ["d/", "!keep.md"], True), ("../x.md", ["*.md"], False), ("", ["*"], False), ("a/b", ["# a"], False),
        ("abc.md", ["a?c.md"], True), ("a1.md", ["a[0-9].md"], True), ("dx/y.md", ["d/"], False),
    ],
)
def test_ignore(spark, path, patterns, want):
    assert ignore.excluded(path, patterns) is want
    assert spark.range(1).select(ignore.compile_patterns(patterns)(F.lit(path)).alias("x")).first().x is want


def test_exclusion_below_any_root():
    assert ignore.excluded_below("/a/b/x.md", ["/z", "/a"], ["b/"]) and not ignore.excluded_below("/a/b/x.md", ["/z"], ["*.md"])


def test_extensions_and_config(tmp_path):
    assert files.resolve_extensions(["TXT ", " "], [".markdown"]) == {".md", ".txt"}
    at = tmp_path / "c" / "config.json"
    assert config.Config.load(at).alpha == 0.4
    config.Config(tracked_paths=["/x"]).save(at)
    assert config.Config.load(at).tracked_paths == ["/x"]
    at.write_text("{")
    assert config.Config.load(at).top_k == 5
    (tmp_path / ".sedgework").mkdir()
    assert config.index_directory(None, tmp_path / "deeper") == tmp_path / ".sedgework"


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_extraction(spark, tmp_path):
    page = "<html><head><title>t</title><script>x()</script></head><body><nav>menu</nav><h1>Head</h1><p>A <b>bold</b> word</p><ul><li>one<li>two</ul><pre><code>a\n b</code></pre><footer>f</footer></body></html>"
    text = extract.html_to_markdown(page)
    assert text.startswith("# Head") and "**bold**" in text and "- one" in text and "```\na\n b\n```" in text and "menu" not in text and "x()" not in text
    assert extract.docx_text(docx("one", "two")) == "one\n\ntwo"
    assert extract.pdf_text(b"", lambda b: ("  ", 2), lambda b: "more text") == "more text"
    assert extract.pdf_text(b"", lambda b: ("x" * 100, 2), lambda b: "y" * 500) == "x" * 100
    write(tmp_path, a_DOT_docx=docx("hello"), b_DOT_docx=b"broken", c_DOT_html=page, d_DOT_pdf=b"x")
    listed = files.collect_files(spark, [str(tmp_path)], frozenset({".docx", ".html", ".pdf"}))
    rows = {os.path.basename(r["path"]): r for r in dicts(extract.read_files(listed))}
    assert rows["a.docx"]["text"] == "hello" and rows["b.docx"]["text"] is None and rows["d.pdf"]["hash"] is None
    assert rows["c.html"]["hash"] == hashlib.sha256(page.encode()).hexdigest()[:12]


def length_embedder(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_indexing_run(spark, tmp_path):
    kb = tmp_path / "kb"
    write(kb, a_DOT_md="# A\n\nfirst text of a", b_DOT_md="# B\n\nfirst text of b", c_DOT_md="")
    store = IndexStore(spark, str(tmp_path / "index"))
    listing = lambda: files.collect_files(spark, [str(kb)])
    told = []
    run = indexing.index_files(store, listing(), length_embedder, "2026-01-01T00:00:00Z", progress=lambda *x: told.append(x))
    assert run == indexing.Summary(3, 2, 0) and told == [("read", 3), ("chunk", 2), ("embed", 2), ("commit", 3)]
    assert indexing.index_files(store, listing(), length_embedder, "2026-01-02T00:00:00Z") == indexing.Summary(0, 0, 3)
    store.set_metadata(spark.createDataFrame([(str(kb / "a.md"), "tag"), ("/unknown", "x")], "path string, metadata string"))
    write(kb, a_DOT_md="# A\n\nchanged text of a")

    def broken(_):
        raise RuntimeError("model")

    with pytest.raises(Exception):
        indexing.index_files(store, listing(), broken, "2026-01-03T00:00:00Z")
    assert {r["chunk_content"] for r in dicts(store.table("chunks"))} == {"first text of a", "first text of b"}, "the old index survives"
    assert indexing.index_files(store, listing(), length_embedder, "2026-01-03T00:00:00Z") == indexing.Summary(1, 1, 2)
    assert {r["chunk_content"] for r in dicts(store.table("chunks"))} == {"changed text of a", "first text of b"}
    assert store.table("vectors").count() == 2
    assert {os.path.basename(r["path"]): r["metadata"] for r in dicts(store.table("files"))}["a.md"] == "tag", "tags outlive a new version"
    os.remove(kb / "b.md")
    indexing.rebuild(store, listing(), length_embedder, "2026-01-04T00:00:00Z")
    stats = dicts(indexing.stats(store))[0]
    assert (stats["total_files"], stats["total_chunks"], stats["embedded_count"], stats["vector_coverage_pct"], stats["last_build"]) == (2, 1, 1, 100, "2026-01-04T00:00:00Z")
    assert store.vacuum() > 0 and store.table("chunks").count() == 1 and store.vacuum() == 0
    assert store.migrate(3) and store.table("vectors").count() == 0 and not store.migrate(3)
    store.clear()
    assert store.table("files").count() == 0


def test_runs_without_an_embedder_leave_files_to_embed(spark, tmp_path):
    kb = tmp_path / "kb"
    write(kb, a_DOT_md="# A\n\ntext of a", b_DOT_md="# B\n\ntext of b")
    store = IndexStore(spark, str(tmp_path / "index"))
    listing = lambda: files.collect_files(spark, [str(kb)])
    assert indexing.index_files(store, listing(), None, "2026-01-01T00:00:00Z") == indexing.Summary(2, 2, 0)
    assert store.table("files").where("embedded").count() == 0
    assert indexing.index_files(store, listing(), None, "2026-01-02T00:00:00Z") == indexing.Summary(0, 0, 2), "unchanged"
    short = lambda texts: [[] if "of b" in t else [1.0] for t in texts]
    assert indexing.index_files(store, listing(), short, "2026-01-03T00:00:00Z").indexed == 2
    assert names(store.table("files").where("embedded")) == ["a.md"] and store.table("vectors").count() == 1, "b.md got no vector"
    assert indexing.index_files(store, listing(), length_embedder, "2026-01-04T00:00:00Z") == indexing.Summary(1, 1, 1)
    assert store.table("files").where("embedded").count() == store.table("vectors").count() == 2
    indexing.rebuild(store, listing(), None, "2026-01-05T00:00:00Z")
    indexing.index_files(store, listing(), length_embedder, "2026-01-06T00:00:00Z")
    assert store.table("vectors").count() == 2


def test_command_line_embeds_through_a_server(spark, tmp_path, capsys, monkeypatch):
    from sedgework.cli import main

    class Whole(Server):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            data = json.dumps({"data": [{"embedding": [3.0, 4.0, 9.0]} for _ in body["input"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

    write(tmp_path / "kb", a_DOT_md="# A\n\nthe alpha text")
    at = ["--store", str(tmp_path / "s"), "--json"]
    out = lambda *a: (main([*at, *a]), json.loads(capsys.readouterr().out))[1]
    assert out("index", str(tmp_path / "kb"))["indexed"] == 1 and out("status")[0]["embedded_count"] == 0
    server = http.server.HTTPServer(("127.0.0.1", 0), Whole)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SEDGEWORK_EMBED_URL", f"http://127.0.0.1:{server.server_port}")
    monkeypatch.setenv("SEDGEWORK_EMBED_DIMENSIONS", "2")
    assert out("refresh")["indexed"] == 1 and out("status")[0]["vector_coverage_pct"] == 100
    assert out("search", "nothing of it")[0]["vector"] == "1.000" and out("search", "nothing of it", "--bm25") == []
    assert out("coverage", "--dir", str(tmp_path / "kb"))["embedding_model"]
    server.shutdown()


def test_legacy_import(spark, tmp_path):
    old = {"chunks": [{"id": "1", "filePath": "/a", "content": "c", "lineStart": 1, "lineEnd": 2, "hash": "h", "indexed": "i", "tokens": 3, "vector": [1.0]}],
           "files": {"/a": {"hash": "h", "chunks": 1, "indexed": "i", "size": 4, "embedded": True}}}
    (tmp_path / "old.json").write_text(json.dumps(old))
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.import_legacy(str(tmp_path / "old.json")) == 1 and store.table("vectors").count() == 1
    assert store.import_legacy(str(tmp_path / "old.json")) == 0


def test_coverage_and_completion(spark, tmp_path):
    kb = tmp_path / "kb"
    write(kb, a_DOT_md="# A\n\nsome text here", doc_DOT_docx=docx("x"), scan_DOT_docx=docx("y"), bad_DOT_docx=docx("z"))
    store = IndexStore(spark, str(tmp_path / "index"))
    assert completion.coverage(spark, store, str(kb))["verdict"] == "needs_convert"

    def run(document, target):
        name = os.path.basename(document)
        if name != "doc.docx":
            return False, "this needs OCR" if name == "scan.docx" else "broken"
        return bool(open(target, "w").write("# Converted\n\ntext of it")), ""

    def ocr(document, target):
        return bool(open(target, "w").write("# Scan\n\ntext of it")), ""

    outcomes, summary, before, after = completion.complete(spark, store, str(kb), "2026-01-01T00:00:00Z", run, ocr)
    assert {os.path.basename(o.file): o.action for o in outcomes} == {"doc.docx": "converted", "scan.docx": "converted by ocr", "bad.docx": "failed"}
    assert summary.indexed == 3 and before["missing"] == ["a.md"] and after["missing"] == [] and after["documents"] == {"up_to_date": 2, "needs_convert": 1}
    write(kb, doc_DOT_docx=docx("changed"))
    assert {os.path.basename(r["path"]): r["reason"] for r in dicts(completion.conversion_state(spark, str(kb)))}["doc.docx"] == "checksum_changed"


def test_an_old_index_is_stale(spark, tmp_path):
    write(tmp_path / "kb", a_DOT_md="# A\n\ntext of a")
    store = IndexStore(spark, str(tmp_path / "index"))
    indexing.index_files(store, files.collect_files(spark, [str(tmp_path / "kb")]), length_embedder, "2026-01-01T00:00:00Z")
    ask = lambda now: completion.coverage(spark, store, str(tmp_path / "kb"), now=now)
    assert ask("2026-01-02T00:00:00Z")["verdict"] == "complete" and ask("2026-01-02T00:00:01Z")["verdict"] == "stale"
    assert ask(None)["stale"] is True
    indexing.index_files(store, files.collect_files(spark, [str(tmp_path / "kb")]), length_embedder, "2026-01-02T00:00:01Z")
    assert ask("2026-01-02T00:00:01Z")["verdict"] == "complete", "a run without changes counts"
    write(tmp_path / "kb", b_DOT_md="# B\n\ntext of b")
    assert ask("2026-01-03T00:00:00Z")["verdict"] == "needs_index"


def test_index_of_a_moved_tree_is_found(spark):
    listing = spark.createDataFrame([("/new/r/a.md", None, "h"), ("/new/r/s/b.md", None, "x"), ("/new/r/c.md", None, "h")], "path string, real string, hash string")
    index = spark.createDataFrame([("/old/a.md", "h"), ("/old/s/b.md", "h"), ("/old/z.md", None)], "path string, hash string")
    assert {r["path"]: r["state"] for r in dicts(reports.coverage(listing, index))} == {"/new/r/a.md": "indexed", "/new/r/s/b.md": "modified", "/new/r/c.md": "missing"}


@pytest.mark.parametrize("last, stale", [("2026-01-01T00:00:00Z", True), ("2026-01-01T12:00:00Z", False), ("", False), ("junk", False)])
def test_staleness_is_strictly_over_a_day(spark, last, stale):
    assert spark.range(1).select(reports.is_stale(F.lit(last), F.lit("2026-01-02T12:00:00Z")).alias("x")).first().x is stale


def test_metadata(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps({"a.md": " x, y ", "b.md": " ", "/abs.md": "z", "n.md": 5, "l.md": ["t"], "t.md": True, "u.md": None, "m.md": {"a": "b"}}))
    seed = metadata.load_seed(spark, str(tmp_path / "seed.json"), "/kb")
    assert {r["path"]: r["metadata"] for r in dicts(seed)} == {"/kb/a.md": "x, y", "/abs.md": "z"}
    known, unknown = metadata.seed_matches(seed, spark.createDataFrame([("/kb/a.md",)], "path string"))
    assert known.count() == unknown.count() == 1
    assert json.loads(metadata.save_seed({"/kb/a.md": "x", "/o": "y"}, "/kb")) == {"a.md": "x", "/o": "y"}
    texts = spark.createDataFrame([("/a", "t"), ("/b", "t"), ("/c", "t")], "path string, content string")

    def ask(path, content):
        if path == "/b":
            raise TimeoutError
        return "類型: report\n2. second\n\n- third" if path == "/a" else "  "

    assert {r["path"]: r["metadata"] for r in dicts(metadata.generate_tags(texts, ask))} == {"/a": "report, second, third"}


class Server(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.seen.append(body)
        if "documents" in body:
            out = {"results": [{"index": i, "relevance_score": 1.5 - i} for i in range(len(body["documents"]) - 1)][::-1]}
        else:
            out = {"data": [{"embedding": [3.0, 4.0, 9.0]} for _ in body["input"][:-1]]}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_http_backends():
    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    vectors = embedding.http_embedder(url, "m", 2)(["a", "b"])
    assert vectors == [[0.6, 0.8], []], "cut, scaled, and a missing one is empty"
    assert embedding.http_scorer(url, "m")("q", ["a", "b", "c"]) == [1.0, 0.5, 0.0]
    assert [len(p) for p in embedding.packed(["x" * 9000] * 3)] == [2, 1] and list(embedding.packed([])) == []
    server.shutdown()
    assert embedding.mean_pooled([[1.0, 0.0], [0.0, 9.0]], [1, 0]) == [1.0, 0.0]
    assert embedding.logits_to_score([0.0]) == 0.5 and embedding.logits_to_score([9.0, -800.0]) == pytest.approx(0)


def test_command_line(spark, tmp_path, capsys):
    from sedgework.cli import main

    write(tmp_path / "kb", a_DOT_md="# A\n\nthe alpha text", b_DOT_md="# B\n\nalpha and alpha again")
    at = ["--store", str(tmp_path / "s"), "--json"]
    out = lambda *a: (main([*at, *a]), json.loads(capsys.readouterr().out))[1]
    assert out("index", str(tmp_path / "kb"))["indexed"] == 2
    hit = out("search", "alpha")[0]
    assert hit["file"] in ("a.md", "b.md") and hit["section"] in ("A", "B") and hit["lines"] == "1-3" and hit["child_lines"] == "3-3" and len(hit["hybrid"]) == 5
    assert out("status")[0]["total_files"] == 2
    assert out("coverage", "--dir", str(tmp_path / "kb"))["verdict"] == "complete"
    assert out("meta", str(tmp_path / "kb" / "a.md"), "tag")[0]["metadata"] == "tag"
    assert len(out("find", "a.md")) == 1 and out("mdsync", "--dir", str(tmp_path / "kb")) == []
    (tmp_path / "kb" / metadata.SEED_NAME).write_text(json.dumps({"b.md": "seeded", "none.md": "x"}))
    assert out("seed", "--dir", str(tmp_path / "kb")) == {"applied": 1, "unknown": 1}
    write(tmp_path / "kb", c_DOT_md="# C\n\nmore alpha text")
    auto = out("auto", "--dir", str(tmp_path / "kb"))
    assert (auto["before"]["verdict"], auto["run"]["indexed"], auto["after"]["verdict"], auto["after"]["total_chunks"]) == ("needs_index", 1, "complete", 3)
    assert out("exclude", "*.tmp")["exclude_patterns"] == ["*.tmp"] and out("off")["enabled"] is False
    assert out("search", "alpha") == []
    out("clear")
    assert out("status")[0]["total_files"] == 0


def test_of_two_writers_one_fails_and_nothing_is_lost(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.set_value("a", "1")
    base = store.version()
    store.set_value("b", "2")
    with pytest.raises(RuntimeError):
        store.commit(base, meta=spark.createDataFrame([("c", "3")], "key string, value string"))
    assert store.value("a") == "1" and store.value("b") == "2" and store.value("c") is None


def test_a_run_rewrites_only_the_buckets_of_its_files(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    chunk = "id string, file_path string, chunk_content string, line_start int, line_end int, chunk_hash string, indexed_at string, tokens int, parent_id string"
    rows = lambda paths, text: spark.createDataFrame([(f"{p}-1", p, text, 1, 1, "h", "t", 1, None) for p in paths], chunk)
    files = lambda paths: spark.createDataFrame([(p, "h", 1, "t", 1, True) for p in paths], "path string, hash string, chunks int, indexed string, size long, embedded boolean")
    none = store.table("parents")
    paths = [f"/f{i}.md" for i in range(40)]
    store.replace_files(files(paths), none, rows(paths, "old"))
    before = set(store._snapshot()["chunks"])
    store.replace_files(files(["/f7.md"]), none, rows(["/f7.md"], "new"), values={"last_build": "now"})
    after = set(store._snapshot()["chunks"])
    assert len(before - after) == 1 == len(after - before) and store.value("last_build") == "now"
    assert {r["file_path"]: r["chunk_content"] for r in dicts(store.table("chunks"))} == {p: "new" if p == "/f7.md" else "old" for p in paths}
    assert store.vacuum() >= 1
    assert store.table("chunks").count() == 40


def test_rows_of_files_are_replaced_deleted_and_flagged(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    schema = "path string, hash string, chunks int, indexed string, size long, embedded boolean, metadata string"
    store.commit(files=spark.createDataFrame([("/a", "x", 1, "t", 1, True, "tag"), ("/b", "x", 1, "t", 1, False, "tag")], schema))
    store.replace_rows(spark.createDataFrame([("/a", "y", 1, "t", 1, True)], schema.rsplit(", ", 1)[0]))
    store.set_embedded(spark.createDataFrame([("/b",), ("/none",)], "path string"), True)
    assert {r["path"]: (r["hash"], r["metadata"], r["embedded"]) for r in dicts(store.table("files"))} == {"/a": ("y", None, True), "/b": ("x", "tag", True)}
    store.delete_files(spark.createDataFrame([("/a",)], "path string"))
    assert [r["path"] for r in dicts(store.table("files"))] == ["/b"]


def test_find_is_by_path_below_the_folder_or_by_name(spark):
    known = spark.createDataFrame([("/kb/src/a.md",), ("/kb/b.md",), ("/other/src/a.md",), ("/other/b.md",)], "path string")
    found = lambda pattern: [r["path"] for r in tools.find(known, pattern, "/kb").collect()]
    assert found("src/*.md") == ["/kb/src/a.md"] and found("b.md") == ["/kb/b.md", "/other/b.md"] and found("/b.md") == ["/kb/b.md", "/other/b.md"]


def test_a_stale_index_is_refreshed_before_a_query(spark, tmp_path):
    write(tmp_path / "kb", a_DOT_md="# A\n\ntext of alpha")
    store, own = IndexStore(spark, str(tmp_path / "index")), config.Config(tracked_paths=[str(tmp_path / "kb")])
    tools.index(store, own, [str(tmp_path / "kb")], "2026-01-01T00:00:00Z")
    write(tmp_path / "kb", b_DOT_md="# B\n\ntext of beta")
    asked = lambda now: [r["file"] for r in tools.query(store, "beta", own, now=now).collect()]
    assert asked("2026-01-02T00:00:00Z") == [] and asked("2026-01-03T00:00:00Z") == ["b.md"]


def test_tags_are_generated_merged_written_and_applied(spark, tmp_path):
    write(tmp_path / "kb", a_DOT_md="# A\n\ntext of alpha", b_DOT_md="# B\n\ntext of beta")
    store = IndexStore(spark, str(tmp_path / "index"))
    root = str(tmp_path / "kb")
    indexing.index_files(store, files.collect_files(spark, [root]), None, "2026-01-01T00:00:00Z")
    seed = str(tmp_path / "tags.json")
    (tmp_path / "tags.json").write_text(json.dumps({"a.md": "kept"}))
    assert metadata.generate_seed(store, seed, root, lambda path, content: "Tags: " + content.split()[-1]) == {"generated": 1, "applied": 2, "unknown": 0}
    assert json.loads((tmp_path / "tags.json").read_text()) == {"a.md": "kept", "b.md": "beta"}
    assert {os.path.basename(r["path"]): r["metadata"] for r in dicts(store.table("files"))} == {"a.md": "kept", "b.md": "beta"}
