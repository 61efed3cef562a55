import http.server
import json
import os
import threading

import pytest

from tidemark.sources import fetch


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        codes, seen = [], []

        def do_GET(self):
            self.seen.append(self.path)
            code = self.codes.pop(0) if self.codes else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"path": self.path}).encode() if code == 200 else b"no")

        def log_message(self, *_):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/x", Handler
    s.shutdown()


def test_waits_double_on_a_busy_server(server):
    url, h = server
    waits = []
    h.codes[:] = [429, 500]
    assert fetch.get_json(url, {"a": "b c"}, sleep=waits.append) == {"path": "/x?a=b+c"} and waits == [1.0, 2.0]
    h.codes[:] = [429] * 9
    assert fetch.get_json(url, sleep=waits.append) is None and waits == [1.0, 2.0, 1.0, 2.0]
    h.codes[:] = [404]
    assert fetch.get_json(url, sleep=waits.append) is None and len(waits) == 4
    assert fetch.get_json("http://127.0.0.1:1/none", tries=2, sleep=waits.append) is None


def test_a_cache_lives_seven_days(tmp_path):
    p, calls = str(tmp_path / "d" / "c.json"), []
    get = lambda v: lambda: calls.append(v) or v
    assert fetch.cached_json(p, get([1])) == [1] == fetch.cached_json(p, get([2])) and calls == [[1]]
    later = lambda: os.path.getmtime(p) + 8 * fetch.DAY
    assert fetch.cached_json(p, lambda: None, now=later) == [1] and fetch.cached_json(p, get([3]), now=later) == [3]
    assert fetch.cached_json(str(tmp_path / "none"), lambda: None) is None


def test_yaml_configuration(tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    from tidemark.sources.files import read_config

    monkeypatch.setenv("MY_KEY", "k")
    (tmp_path / "c.yaml").write_text("a:\n  key: ${MY_KEY}\n  none: '${NOT_SET_AT_ALL}'\nlist: [1, 2]\n")
    assert read_config(str(tmp_path / "c.yaml")) == {"a": {"key": "k", "none": ""}, "list": [1, 2]}
