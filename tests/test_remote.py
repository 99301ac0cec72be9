"""Logs of a remote detector, played by a server on this machine."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from streetlens.sources import logs, remote

HEAD, FOOT = '{"type":"header","schema":"detections","version":1}', '{"type":"footer","frames":1,"complete":true}'
FRAME = '{"type":"frame","index":0,"time":0.0,"detections":[]}'


@pytest.fixture(scope="module")
def server():
    asked: dict[str, list] = {}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            seen = asked.setdefault(self.path, [])
            seen.append(body)
            if self.path == "/never" or (self.path == "/busy" and len(seen) < 3):
                self.send_response(503)
                self.send_header("Retry-After", "0.01")
                self.end_headers()
                return
            self.send_response(404 if self.path == "/none" else 200)
            self.end_headers()
            text = {"/cut": [HEAD, FRAME], "/long": [HEAD, *[FRAME] * 2500, FOOT]}.get(self.path, [HEAD, "", FRAME, FOOT])
            self.wfile.write("\n".join(text).encode())

        def do_GET(self):
            self.answer(None)

        def do_POST(self):
            self.answer(self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked
    httpd.shutdown()


def ask(spark, url, body=None, **more):
    return remote.lines(spark.createDataFrame([(1, url, body)], "clip_id int, url string, body binary"), **more)


def test_a_busy_detector_is_asked_again(spark, server):
    url, asked = server
    rows = ask(spark, f"{url}/busy", b"video").collect()
    assert [(r.clip_id, r.at, r.line) for r in rows] == [(1, 0, HEAD), (1, 1, FRAME), (1, 2, FOOT)] and asked["/busy"] == [b"video"] * 3


def test_long_logs(spark, server):
    found = ask(spark, f"{server[0]}/long").persist()
    assert sorted(r.at for r in found.collect()) == list(range(2502)) and [r.problem for r in logs.check(logs.parse(found.limit(1))).collect()] == [None]


@pytest.mark.parametrize("path,problem", [("/cut", "without a footer"), ("/none", "answered 404"), ("/never", "stayed busy 2 times")])
def test_failures(spark, server, path, problem):
    with pytest.raises(Exception, match=problem):
        ask(spark, server[0] + path, tries=2).collect()


def test_other_addresses(spark):
    with pytest.raises(Exception, match="not an address"):
        ask(spark, "file:///etc/hosts").collect()
