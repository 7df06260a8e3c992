"""URL rules by the digest array and by joins, against a plain reading of every rule."""

from __future__ import annotations

import random
import re

import pytest
from leafmill.llm import url_rules as U

DDL = "page_id long, url string, host string, verdict int"


def plain(url: str | None, rules: list[tuple]) -> tuple:
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = {}
    for h, p, v in rules:
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.setdefault((len(h) + len(p), len(h), h + p), []).append(v)
    best = max(fit, default=None)
    return host, path, best and best[2], "allow" if best is None else min(fit[best], key=lambda v: (v != "block", v))


ODD = [
    None, "", "com", "://", "http://", "http:///en/", "http://com", "http://com/", "http://COM/x", "http://icom/", "http://.com/", "http://a.com./", "http://a.com:80/", "http://u@a.com/",
    "http://WWW.Example.COM/en/a?b#c", "http://www.example.com/en", "http://example.com/en/?x", "http://a.example.com/en/", "http://www.example.com?/en/", "http://x.net/es/1://com/", "http://x.net/ES/",
    "x://y://com/", "http://É.com/é?", "http://İ.com/en/", "http://a\nb.com/\n/en/", "http://" + "a." * 5000 + "net/fr/" + "x" * 100_000,
]


@pytest.fixture(params=["index", "join"])
def judged(request, monkeypatch, spark):
    if request.param == "join":
        monkeypatch.setattr(U, "INDEXED", 0)
    return lambda urls, rules: U.verdicts(spark.createDataFrame([(i, u, "clash", 0) for i, u in enumerate(urls)], DDL).repartition(3), rules)


def test_odd_urls(judged):
    got = judged(ODD + ODD, U.RULES)
    assert got.dtypes == [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {i: plain(u, U.RULES) for i, u in enumerate(ODD + ODD)}


def test_many_rules(judged):
    rnd = random.Random(4)
    host = lambda: ".".join(rnd.choice(["a", "b", "Com", "net"]) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "e", "é"]) for _ in range(rnd.randint(0, 4)))
    rules = [(host(), path() and "/" + path(), rnd.choice(["allow", "block", "ask"])) for _ in range(150)]
    urls = [f"http://{host()}/{path()}" for _ in range(600)]
    got = {r[0]: tuple(r)[1:] for r in judged(urls, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert len({v[3] for v in got.values()}) == 3


def test_rules_that_are_none_and_empty_tables(judged, spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("com", None, "block"), ("com", "/", None)], "host string, path string, verdict string")
    assert [tuple(r)[3:] for r in judged(["http://com/"], rules).collect()] == [(None, "allow")]
    assert judged(["http://com/"], []).first()["rule"] is None
    assert judged([], U.RULES).count() == 0


def test_strings_decide_where_digests_collide(tmp_path):
    crowded = lambda x: len(x) % 3
    path = tmp_path / "index"
    path.write_bytes(U.index(U.RULES, crowded))
    found = U.Index(str(path), crowded)
    urls = [u for u in ODD if u and len(u) < 1000]
    parts = [plain(u, U.RULES) for u in urls]
    assert found.judged([p[0] for p in parts], [p[1] for p in parts]) == ([p[2] for p in parts], [p[3] for p in parts])
