import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from leafmill.config import EngineConfig
from leafmill.operators.limits import CEILING, FIELDS, resolve_limits
from leafmill.sources.catalogue import catalogue as table
from leafmill.sources.catalogue import fetch, find_limit, resolve_limit


def test_resolution(spark):
    none = dict.fromkeys(FIELDS)
    entries = [(0, "Other", none), (1, "m-one-2024", none | {"max_tokens": 7}), (2, "M-ONE", none | {"context_window": 0, "max_input_tokens": 9}), (3, "m-two-b", none | {"context_length": 5}), (4, "m-two-a", none | {"context_length": 6}), (5, "m-big", none | {"context_window": 10**9}), (6, "gpt-4o", none)]
    catalogue = spark.createDataFrame([(p, i, *f.values()) for p, i, f in entries], "pos int, id string, " + ", ".join(f"{f} long" for f in FIELDS))
    models = spark.createDataFrame([("m-one", None), ("m-two", None), ("m-big", None), ("gpt-4o", None), ("nobody", None), ("m-one", 5)], "model string, forced long")
    found = [(r.model, r.ctx_limit) for r in resolve_limits(models, catalogue, override="forced").collect()]
    assert sorted(found) == [("gpt-4o", 128_000), ("m-big", CEILING), ("m-one", 5), ("m-one", 9), ("m-two", 5), ("nobody", 128_000)]


ENTRIES = [{"id": "m-one-2024", "max_tokens": 7}, {"id": "M-ONE", "context_window": True, "max_input_tokens": 9.7}, {"id": "m-two", "context_length": -1}, {"id": "m-two-b", "context_length": 5}, {}]


def test_driver_and_table_agree(spark):
    models = spark.createDataFrame([(x,) for x in ("m-one", "m-two", "nobody", "gpt-4o")], "model string")
    found = {r.model: r.ctx_limit for r in resolve_limits(models, table(spark, ENTRIES)).collect()}
    assert found == {"m-one": 9, "m-two": 5, "nobody": 128_000, "gpt-4o": 128_000}
    assert [find_limit(x, ENTRIES) for x in ("m-one", "m-two", "nobody")] == [9, 5, None]
    assert table(spark, None).count() == 0


def test_catalogue_of_any_size(spark):
    """240,000 entries: the later half repeats the first one's ids with other limits. Numbers fall, so that longer ids come first."""
    n = 120_000
    listed = [{"id": f"Maker/M-{n - i % n}", "context_length": 1 + i} for i in range(2 * n)]
    catalogue = spark.range(2 * n).selectExpr("id as pos", f"concat('Maker/M-', {n} - id % {n}) as id", *(f"{'id + 1' if f == 'context_length' else 'cast(null as bigint)'} as {f}" for f in FIELDS))
    names = ["m-119999", "M-11999", "maker/m-7", "MAKER/M-7", "m-7", "", "m-x", "gpt-4o"]
    found = {r.model: r.ctx_limit for r in resolve_limits(spark.createDataFrame([(x,) for x in [*names, None]], "model string"), catalogue).collect()}
    assert found == {x: find_limit(x, listed) or 128_000 for x in names} | {None: 128_000}
    assert found["maker/m-7"] == n - 6 and found["m-7"] == n - 79_998 and found["M-11999"] == 2


def test_server_is_asked_with_a_key_only():
    asked = []
    ask = lambda base, key: asked.append((base, key)) or ENTRIES
    server = {"LEAFMILL_BASE_URL": "http://x", "LEAFMILL_API_KEY": "k"}
    assert resolve_limit(EngineConfig(model="m-one"), server, ask) == 9 and asked == [("http://x", "k")]
    assert resolve_limit(EngineConfig(model="m-one", ctx_limit=3), server, ask) == 3
    assert resolve_limit(EngineConfig(model="m-one"), {}, ask) == 128_000 and len(asked) == 1
    assert resolve_limit(EngineConfig(model="MiniMax-M3"), server, lambda *_: None) == 524_288


def test_fetch():
    class Models(BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path == "/v1/models" and self.headers["Authorization"] == "Bearer k"
            self.send_response(200 if good else 404)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [*ENTRIES, 3]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Models)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert fetch(f"{base}/v1", "k") == ENTRIES
        assert fetch(f"{base}/v1", "wrong") is None and fetch(base, "k") is None and fetch("file:///etc", "k") is None
    finally:
        server.shutdown()
    assert fetch(base, "k", 0.5) is None
