"""The page walk as a stream, against a local server that goes away and comes back."""

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import StreamingQueryException

from nearfield.sources import pages

ROWS = 1000


class Server(ThreadingHTTPServer):
    """Serves ROWS rows of labels 0, 1, 2 in turn; closes connections without an answer once ``left`` pages are served."""

    allow_reuse_address = True

    def __init__(self, port=0):
        self.asked, self.left, self.broken = [], 10**6, set()
        super().__init__(("127.0.0.1", port), Handler)


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        at = urlparse(self.path)
        if at.path != "/rows":
            self.send_response(200)
            self.end_headers()
            self.wfile.write(at.path.encode())
            return
        offset = int(parse_qs(at.query)["offset"][0])
        length = int(parse_qs(at.query)["length"][0])
        if self.server.left <= 0:
            self.close_connection = True
            return
        self.server.left -= 1
        self.server.asked.append(offset)
        self.send_response(500 if offset in self.server.broken else 200)
        self.end_headers()
        host = f"http://127.0.0.1:{self.server.server_port}"
        rows = [{"row_idx": i, "row": {"label": i % 3, "image": {"src": f"{host}/{i}"}}} for i in range(offset, min(offset + length, ROWS))]
        self.wfile.write(json.dumps({"rows": rows}).encode())

    def log_message(self, *_):
        pass


@contextmanager
def serving():
    server = Server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield server, f"http://127.0.0.1:{server.server_port}/rows"
    finally:
        server.shutdown()
        server.server_close()


def ids(df):
    return sorted(r["row_idx"] for r in df.collect())


def test_a_broken_walk_goes_on_at_its_wave(spark, tmp_path):
    with serving() as (server, url):
        walk = lambda per, most=2000: pages.walked_on(spark, url, str(tmp_path / "walk"), ["a", "b"], per, most, wait=0, wave=2, tries=2)
        server.left, server.broken = 5, {100}  # dies within the third wave
        with pytest.raises(StreamingQueryException):
            walk(10**6)
        assert sorted(set(server.asked)) in ([0, 100, 200, 300, 400], [0, 100, 200, 300, 500])
        server.asked.clear()
        server.left = 10**6
        got = ids(walk(10**6))
        assert got == [i for i in range(ROWS) if i % 3 < 2 and not 100 <= i < 200]  # of a page answered with an error nothing
        assert min(server.asked) == 400 and len(set(server.asked)) == len(server.asked)  # no page of a finished wave again
        server.asked.clear()
        assert ids(walk(10**6)) == got and min(server.asked, default=ROWS) >= ROWS  # nothing but what may have come since


def test_a_walk_stops_when_classes_are_full_and_takes_more_later(spark, tmp_path):
    with serving() as (server, url):
        walk = lambda per, most: pages.walked_on(spark, url, str(tmp_path / "walk"), ["a", "b"], per, most, wait=0, wave=2)
        assert ids(walk(60, 0)) == [] and not server.asked
        first = ids(walk(60, 900))
        assert max(server.asked) == 100 and first == [i for i in range(200) if i % 3 < 2]
        server.asked.clear()
        assert ids(walk(60, 900)) == first and not server.asked  # full: nobody is asked
        assert ids(walk(100, 900)) == [i for i in range(400) if i % 3 < 2] and sorted(server.asked) == [200, 300]
        server.asked.clear()
        assert ids(walk(10**6, 450)) == [i for i in range(600) if i % 3 < 2] and sorted(server.asked) == [400, 500]  # planned when 900 were wanted
        every = pages.walked(spark, url, ["a", "b"], 10**6, 900, wait=0)
        assert ids(walk(10**6, 900)) == ids(every)


def test_fetching_goes_on_with_a_walk(spark, tmp_path):
    with serving() as (server, url):
        fetch = lambda per: {r["label"]: r["n"] for r in pages.fetch_subset(spark, url, str(tmp_path / "got"), ["a", "b"], per, 900, wait=0, walk=str(tmp_path / "walk")).collect()}
        assert fetch(5) == {"a": 5, "b": 5}
        server.asked.clear()
        assert fetch(7) == {"a": 7, "b": 7} and not server.asked
