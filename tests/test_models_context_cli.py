from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera import cli
from tessera import context as C
from tessera.config import Config, model_host
from tessera.models import HashingEmbedder, HttpChat, HttpEmbedder, ModelError, cached_embed
from tessera.sources.files import html_text


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def _say(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._say({"models": []})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if len(seen) == 1 and body.get("model") == "flaky":
                self.send_response(500)
                self.end_headers()
            elif self.path == "/api/embed":
                n = len(body["input"]) - (body["model"] == "short")
                self._say({"embeddings": [[1.0, 2.0]] * n})
            else:
                self._say({"message": {"content": "yes"}})

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_http_models(server):
    host, seen = server
    assert HttpEmbedder("flaky", 2, host=host, wait=0.01).embed(["a", "b"]) == [[1.0, 2.0]] * 2 and len(seen) == 2
    with pytest.raises(ModelError):
        HttpEmbedder("short", 2, host=host).embed(["a", "b"])
    chat = HttpChat("m", Config(temperature=0.5), host=host)
    chat.await_ready(timeout=2)
    assert chat.chat(C.messages("q" * 500, "c" * 5000)) == "yes"
    body = seen[-1][1]
    assert body["options"]["temperature"] == 0.5 and not body["stream"] and len(body["messages"][1]["content"]) < 2500


def test_unreachable():
    with pytest.raises(ModelError):
        HttpEmbedder("m", 2, host="http://127.0.0.1:9", wait=0.01).embed(["a"])


def test_host_order(monkeypatch):
    monkeypatch.delenv("OLLAMA_BASE_URL", raising=False)
    monkeypatch.setenv("OLLAMA_HOST", "box:1")
    assert model_host() == "http://box:1"
    monkeypatch.setenv("OLLAMA_BASE_URL", "https://x/")
    assert model_host() == "https://x"


def test_cached_embed(spark):
    e = HashingEmbedder()
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, t string")
    none = spark.createDataFrame([], "text_sha string, embedder string, version string, embedding array<float>")
    out, rows = cached_embed(df, "t", e, none)
    assert out.count() == 3 and rows.count() == 2
    assert cached_embed(df, "t", e, rows)[1].count() == 0


def test_context_of_hits(spark):
    long = "plain words that are long enough to be kept in the context"
    hits = {"hits": [{"score": 0.5, "source": "s", "chunk_id": 1, "text": long}, {"score": 0.9, "source": "s", "chunk_id": 2, "text": "References " + long}, {"score": 0.7, "source": "t", "chunk_id": 3, "text": "other " + long}, {"score": 0.6, "source": "t", "chunk_id": 4, "text": ""}]}
    lines = spark.createDataFrame([("a", json.dumps(hits)), ("b", '{"context": "x   y ? z"}'), ("b", json.dumps(hits)), ("c", "not json"), ("d", '{"context": "' + "w" * 3000 + '"}'), ("e", '{"context" broken'), ("f", '{"context": "a\\"b\\u00e9", oops'), ("g", '{"hits": [{"text": "' + long + '"}, oops')], "run string, value string")
    got = {r.run: r.context for r in C.context_from_hits(lines, "run").collect()}
    assert got["a"].split("\n\n")[0].startswith("[s #2 | score=0.9000] References") or got["a"].startswith("[t #3 | score=0.7000]")
    assert got["b"] == "x y? z" and got["c"] == "not json" and len(got["d"]) == 2049 and got["d"].endswith("…") and got["e"] == '{"context" broken'
    assert got["f"] == 'a"bé' and got["g"].endswith(long)


def test_prompt(spark):
    m = C.messages("q", "c")
    assert [x["role"] for x in m] == ["system", "user"] and m[1]["content"] == "Question: q\n\nUse ONLY this context (truncated):\nc"


def test_html():
    assert html_text("<head><title>t</title></head><p>a &amp; b<br>c</p><script>x</script><div>d  e</div>") == "a & b\nc\nd e"


def test_config_in_the_session(spark):
    Config(top_k=7, index_path="file:///x").export(spark)
    assert (spark.conf.get("tessera.top_k"), spark.conf.get("tessera.index_path")) == ("7", "file:///x")


def test_config(tmp_path):
    assert Config().overlap == 108
    f = tmp_path / "c.json"
    f.write_text('{"top_k": 9}')
    assert Config.load(str(f), top_k=None).top_k == 9 and Config.load(str(f), top_k=3).top_k == 3
    with pytest.raises(ValueError):
        Config.load(None, nonsense=1)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A text about rivers and lakes that is long enough. " * 20)
    out = str(tmp_path / "out")
    assert cli.main(["nonsense"]) == 1
    assert cli.main(["question", "x", "--out", str(tmp_path / "none")]) == 2
    # the session of the tests goes on, as getOrCreate() finds it
    assert cli.main(["add-context", "--sources", str(tmp_path / "in"), "--out", out]) == 0
    assert cli.main(["question", "rivers", "--out", out]) == 0
    assert "rivers and lakes" in capsys.readouterr().out
    assert cli.main(["query", " ", "--out", out]) == 3


def test_sinks(spark, tmp_path):
    from tessera.sources import sinks
    from tessera.sources.store import Store, single_csv

    pairs = spark.createDataFrame([("king", "queen"), ("king", "none")], "a string, b string")
    vectors = spark.createDataFrame([("king", [3.0, 4.0]), ("queen", [4.0, 3.0])], "word string, embedding array<double>")
    got = {r.b: r for r in sinks.similarities(pairs, vectors).collect()}
    assert got["queen"].dot == 24 and got["queen"].cosine == pytest.approx(0.96) and got["none"].cosine == 0
    store = Store(spark, f"file://{tmp_path}/s")
    single_csv(pairs.orderBy("b"), store, "similarity.csv")
    assert (tmp_path / "s" / "similarity.csv").read_text().split("\n")[:2] == ["a,b", "king,none"]
    words = spark.createDataFrame([('qu"ote', 0, 5), ("b", 1, 2)], "term string, token_id long, total_tf long")
    sinks.write_vocabulary(words, f"{tmp_path}/v")
    assert [r.value for r in spark.read.text(f"{tmp_path}/v").collect()] == ['"qu""ote","0","5"', '"b","1","2"']
    sinks.append_json(words, f"{tmp_path}/j")
    sinks.append_json(words, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
