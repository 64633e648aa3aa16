"""Fetched sources against a local server that fails now and then, leaves records out and counts what it is asked."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quarry.sources import fetched

ARTICLE = (
    '<PubmedArticle><MedlineCitation><PMID Version="1">{0}</PMID><Article><ArticleTitle>title {0}</ArticleTitle></Article><MeshHeadingList><MeshHeading>'
    '<DescriptorName UI="D{0}" MajorTopicYN="Y">name {0}</DescriptorName><QualifierName UI="Q1" MajorTopicYN="N">q</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>'
)


class Server:
    """Every second request for a batch fails first; batches that hold an id of ``broken`` always fail."""

    def __init__(self):
        self.tried, self.answered, self.broken, self.lock = Counter(), Counter(), set(), threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                ids = parse_qs(urlparse(self.path).query)["id"][0].split(",")
                with outer.lock:
                    outer.tried[ids[0]] += 1
                    bad = outer.broken & set(ids) or outer.tried[ids[0]] == 1
                    outer.answered.update([] if bad else ids)
                body = "<PubmedArticleSet>" + "".join(ARTICLE.format(i) for i in ids if int(i) % 7) + "</PubmedArticleSet>"
                self.send_response(503 if bad else 200)
                self.end_headers()
                self.wfile.write(b"" if bad else body.encode())

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}/fetch?id={{ids}}"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def _options(server, root):
    return {"requests": f"file://{root}/requests", "cache": f"file://{root}/cache", "url": server.url, "base": 0.01, "pause": 0, "lanes": 3}


def test_retries_records_and_answers_kept(spark, server, tmp_path):
    options = _options(server, tmp_path)
    ids = spark.range(1, 96).select(F.col("id").cast("string").alias("passage_id")).union(spark.createDataFrame([("5",), (" 6 ",), (None,), ("",)], "passage_id string"))
    assert fetched.ask(ids, "passage_id", options["requests"], 10) == 10
    rows = fetched.fetched(spark, **options)
    first = rows.collect()
    assert all(r.error is None and r.attempts == 2 and not r.cached and len(r.ids) <= 10 for r in first)
    assert sorted(int(i) for r in first for i in r.ids) == list(range(1, 96))
    got = {r.id: r for r in fetched.article_records(rows).collect()}
    assert len(got) == 95
    for i, r in got.items():
        assert r.missing == (int(i) % 7 == 0) and r.num_mesh_terms == int(not r.missing) and r.title == ("" if r.missing else f"title {i}")
    assert got["8"].mesh_terms[0].descriptor_ui == "D8" and got["8"].mesh_terms[0].major_topic and got["8"].mesh_terms[0].qualifiers[0].name == "q"
    assert set(server.answered.values()) == {1}  # the second reading took the answers kept


def test_failed_batches_are_told_and_asked_again(spark, server, tmp_path):
    options = _options(server, tmp_path)
    ids = spark.range(1, 31).select(F.col("id").cast("string").alias("id"))
    server.broken = {"17"}
    fetched.ask(ids, "id", options["requests"], 10)
    rows = fetched.fetched(spark, **options)
    kept = rows.collect()
    bad = [r for r in kept if r.error]
    assert len(bad) == 1 and "17" in bad[0].ids and bad[0].attempts == 3 and "503" in bad[0].error and bad[0].body is None
    assert fetched.failed(rows).count() == 1 and fetched.article_records(rows).count() == 20
    server.broken = set()
    again = spark.createDataFrame(kept, fetched.SCHEMA)
    assert fetched.ask(ids, "id", options["requests"], 10, fetched.done(again)) == 1
    assert {r.id for r in fetched.article_records(fetched.fetched(spark, **options)).collect()} == {str(i) for i in range(1, 31)}


def test_stream_restarts_behind_its_offset(spark, server, tmp_path):
    options, out, mark = _options(server, tmp_path), f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    ids = spark.range(1, 61).select(F.col("id").cast("string").alias("id"))
    fetched.ask(ids.where("id <= 40"), "id", options["requests"], 10)
    fetched.follow(spark, out, mark, **options).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    tried = sum(server.tried.values())
    fetched.follow(spark, out, mark, **options).awaitTermination()  # nothing new: nothing asked, nothing written
    assert sum(server.tried.values()) == tried and spark.read.parquet(out).count() == 4
    fetched.ask(ids, "id", options["requests"], 10, fetched.done(spark.read.parquet(out)))
    fetched.follow(spark, out, mark, **options).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 6 and not rows.where("cached").count()
    assert sorted(int(r.id) for r in fetched.article_records(rows).collect()) == list(range(1, 61))
    assert set(server.answered.values()) == {1}


def test_answers_kept_serve_another_checkpoint(spark, server, tmp_path):
    """A stream that lost its checkpoint reads the kept answers and asks for nothing."""
    options = _options(server, tmp_path)
    fetched.ask(spark.range(1, 21).select(F.col("id").cast("string").alias("id")), "id", options["requests"], 10)
    for lot in ("a", "b"):
        fetched.follow(spark, f"file://{tmp_path}/{lot}", f"file://{tmp_path}/mark-{lot}", **options).awaitTermination()
    assert set(server.answered.values()) == {1}
    assert spark.read.parquet(f"file://{tmp_path}/b").where("cached").count() == 2


def test_nothing_to_ask(spark, server, tmp_path):
    options = _options(server, tmp_path)
    assert fetched.ask(spark.createDataFrame([], "id string"), "id", options["requests"]) == 0
    assert fetched.fetched(spark, **options).count() == 0 and not server.tried
