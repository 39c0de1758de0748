"""The completion client against a server of our own."""

import functools
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corpusmill.operators import generation, vectors
from corpusmill.operators.control import GateFailed
from corpusmill.operators.models import HttpModel


class Echo(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(500 if body["prompt"] == "fail" else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"response": f"{body['model']}:{body['prompt']}:{body['stream']}:{body['temperature']}"}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def url():
    server = HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_completions_over_http_fail_closed(spark, url):
    factory = functools.partial(HttpModel, url, "m", temperature=0)
    replies = lambda prompt: generation.replied(spark.createDataFrame([("k", prompt)], "key string, prompt string"), "key", factory).collect()
    assert [tuple(r) for r in replies("hello")] == [("k", "m:hello:False:0")]
    with pytest.raises(Exception, match="500"):
        replies("fail")


def test_topology_asks_for_every_step(spark):
    one = spark.createDataFrame([(1, 2, 0.5, 1)], "source long, target long, distance double, rank int")
    place = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    cluster = spark.createDataFrame([(1, -1)], "id long, cluster long")
    assert tuple(vectors.topology(one, cluster, place)[2].first()) == (1, 0, 1)
    with pytest.raises(GateFailed, match="clusters"):
        vectors.topology(one, cluster.filter("false"), place)
