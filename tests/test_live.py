"""Live sources against a local server: pages, the 429 rule, papers that fail, files that fail, pacing."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from litloom.plans import ingest
from litloom.sources import connectors, live
from litloom.sources.store import Store


class Service:
    """Papers p0..p24, every fifth without an id; 429 for the first request of p3's metadata and always for p7's; no record of p9; files of even papers, p4's
    only at the third attempt."""

    def __init__(self):
        self.asked = Counter()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                code, body = outer.answer(urlparse(self.path), self.headers)
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, url, headers):
        self.asked[url.path] += 1
        name = url.path.rpartition("/")[2].removeprefix("arXiv:")
        if url.path == "/paper/search":
            q = parse_qs(url.query)
            at, n = int(q["offset"][0]), int(q["limit"][0])
            self.asked[f"page {at} {n} {q['query'][0]} {headers.get('x-api-key')}"] += 1
            items = [{"title": f"T{i}", "year": None if i == 1 else 2000 + i, "externalIds": {"ArXiv": f"p{i}"} if i % 5 else None} for i in range(at, min(25, at + n))]
            return 200, json.dumps({"data": items}).encode()
        if url.path.startswith("/paper/"):
            if name == "p7" or name == "p3" and self.asked[url.path] == 1:
                return 429, b""
            if name == "p9":
                return 404, b""
            abstract = None if name == "p2" else f"However {name} is limited."
            return 200, json.dumps({"title": f"Paper {name}", "year": 2020, "abstract": abstract, "tldr": {"text": "However short is limited."}}).encode()
        if int(name[1:]) % 2 or name == "p4" and self.asked[url.path] < 3:
            return 500, b""
        return 200, f"front|Limitations\nFile of {name} is limited.".encode()


@pytest.fixture(scope="module")
def service():
    s = Service()
    yield s
    s.server.shutdown()


reader = lambda data: data.decode().split("|")  # noqa: E731  a lambda travels by value


def test_search_pages_are_partitions(spark, service):
    spark.dataSource.register(live.SearchSource)
    df = spark.read.format("paper_search").options(endpoint=service.url, query="a b", limit="23", page="10", key="k").load()
    assert df.rdd.getNumPartitions() == 3
    got = {r.arxiv_id: (r.title, r.year) for r in df.collect()}
    assert set(got) == {f"p{i}" for i in range(23) if i % 5} and got["p1"] == ("T1", 0) and got["p2"] == ("T2", 2002)
    assert service.asked["page 20 3 a b k"] >= 1


def test_query_to_store(spark, service, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    run = lambda: tuple(ingest.ingest_from_query(kept, service.url, "q", ingest.stub_extractor(), 12, f"{service.url}/file", reader, domain="live").first())
    assert run() == (7, 0, 2)
    assert service.asked["/paper/arXiv:p7"] == 3 and service.asked["/paper/arXiv:p9"] == 1 and service.asked["/paper/arXiv:p3"] == 2
    assert service.asked["/file/p4"] == 3 and service.asked["/file/p1"] == 3
    failures = {r.arxiv_id: (r.stage, r.reason.split(":")[0]) for r in kept.read("failures").collect()}
    assert failures == {"p7": ("fetch", "RateLimited"), "p9": ("fetch", "HTTPError")}
    papers = {r.arxiv_id: r for r in kept.read("papers").collect()}
    assert {n: r.extraction_tier for n, r in papers.items()} == {f"p{i}": "inferred" if i % 2 else "explicit" for i in (1, 2, 3, 4, 6, 8, 11)}
    assert "File of p4 is limited" in str(papers["p4"].limitations) and "However p1 is limited" in str(papers["p1"].limitations)
    before = service.asked["/paper/arXiv:p1"]
    assert run() == (0, 7, 2) and service.asked["/paper/arXiv:p1"] == before  # stored papers are not fetched again


def test_rules_of_retrying(service):
    waits = []
    assert live.metadata(service.url, "p2", sleep=waits.append) == ("Paper p2", 2020, "However short is limited.") and not waits
    with pytest.raises(connectors.RateLimited):
        live.metadata(service.url, "p7", sleep=waits.append)
    assert waits == [1.0, 2.0]
    assert live.page_texts(f"{service.url}/file", "p1", reader, waits.append) is None and waits == [1.0, 2.0] * 2
    assert len(live.page_texts(f"{service.url}/file", "p2", lambda b: ["x"] * 50)) == 20


def test_pace():
    began, pace = time.monotonic(), live.Pace(50)
    for _ in range(6):
        pace.wait()
    assert 0.09 < time.monotonic() - began < 2
