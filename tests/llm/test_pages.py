"""WARC archives and URL verdicts."""

import base64
import hashlib
import io
import random
import struct
import zipfile
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chorus.llm import urls, warc
from chorus.llm.queries import ORACLES, URL_RULES, op8_warc, op10_urls

SF = "/root/testdata/sf0.001"
DDL = "page_id long, url string, html string, payload string, host string"  # clashing extra columns


# -- archives -------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [200, 32_000_000])
def test_round_trip(spark, size):
    rng = random.Random(1)
    pool = ["", None, "é" * 50, "<p>\r\n\r\n</p>", "x" * 400_000] + ["".join(rng.choice("ab<>\n é") for _ in range(rng.randint(1, 300))) for _ in range(30)]
    rows = [(i, rng.choice([None, f"http://h/{i}", "http://h/%0A\r\nx"]), rng.choice(pool)) for i in range(150)]
    rows += [rows[3], (None, "http://n/", "only here"), (None, None, pool[2])]
    df = spark.createDataFrame([(*r, "p", "h") for r in rows], DDL).repartition(4)
    manifest = warc.write_archives(df, archive_bytes=size)
    got = warc.read_archives(spark, manifest).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    assert (manifest.count() > 20) == (size == 200)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        one = first.get(h or "")
        other = one is not None and i != one
        want.append((i, u, "revisit" if other else "response", one if other else None, len(raw),
                     base64.b32encode(hashlib.sha1(raw).digest()).decode(), None if other else raw))
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]), r[5])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_no_rows(spark):
    manifest = warc.write_archives(spark.createDataFrame([], DDL))
    assert manifest.collect() == [] and warc.read_archives(spark, manifest).collect() == []


def test_archives_are_zip64_files_others_can_read(spark):
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "h", "", "")], DDL))
    with zipfile.ZipFile(manifest.first()["path"].removeprefix("file:")) as z:
        assert z.testzip() is None and z.namelist() == [warc.RECORDS, warc.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def members(data: bytes) -> dict[str, bytes]:
    f = pa.PythonFile(io.BytesIO(data), "r")
    out = {}
    for name, entry in warc.directory(f).items():
        out[name] = warc._at(f, warc.data_start(f, entry), entry[1])
    return out


def test_directory_of_foreign_archives():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
        z.writestr("a.txt", b"alpha")
        with z.open(zipfile.ZipInfo("wide.bin"), "w", force_zip64=True) as f:
            f.write(b"beta" * 10)
    want = {"a.txt": b"alpha", "wide.bin": b"beta" * 10}
    assert members(buffer.getvalue()) == want
    assert members(b"".join(warc.zip_members(list(want.items())))) == want
    assert members(b"".join(warc.zip_members([]))) == {}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        members(packed.getvalue())
    for broken in (b"", b"not a zip", buffer.getvalue()[:-70]):
        with pytest.raises(ValueError):
            members(broken)


def test_zip64_fields_are_read_only_where_marked():
    """Only the local offset is marked: the extra field then holds one number."""
    data = b"payload"
    head = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, len(data), len(data), 1, 0) + b"n"
    extra = struct.pack("<HHQ", 1, 8, 0)
    central = warc.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, len(data), len(data), 1, len(extra), 0, 0, 0, 0,
                                         warc.BIG32) + b"n" + extra
    end = warc.END + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(head + data), 0)
    assert members(head + data + central + end) == {"n": data}


def test_equals_sql(spark):
    import duckdb
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(duckdb.sql(ORACLES["op8_warc"]).fetchall()) == sorted(map(tuple, op8_warc(spark, SF).collect()))


# -- urls -----------------------------------------------------------------------------------

def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule_of(host, path):
    fits = [(len(t), t, k) for k, t in URL_RULES for h, _, p in [t.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def propagate(pages, damping=0.85, rounds=8):
    """Trust and distrust by host, with plain dictionaries."""
    known = [(parts(u)[0], rule_of(*parts(u))[1], h or "") for _, u, h in pages if parts(u)[0]]
    n, good, bad, edges = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    import re
    for host, verdict, html in known:
        n[host] += 1
        good[host] += verdict == "allow"
        bad[host] += verdict == "block"
        for dst in set(re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'<>\s]+)""", html)):
            edges[host, dst.lower()] += 1
    tree = set()
    for host in n:
        labels = host.split(".")
        for i in range(len(labels) - 2):
            tree.add((".".join(labels[i:]), ".".join(labels[i + 1:])))
    for e in tree:
        edges[e] += 1
    out = []
    for seed, flip in ((good, False), (bad, True)):
        flow = defaultdict(dict)
        for (a, b), w in edges.items():
            if a != b:
                flow[b if flip else a][a if flip else b] = w
        seed = {h: seed[h] / n[h] for h in n if seed[h]}
        seed = {h: v / sum(seed.values()) for h, v in seed.items()}
        rank = dict(seed)
        for _ in range(rounds):
            new = defaultdict(float, {h: (1 - damping) * v for h, v in seed.items()})
            for h, v in rank.items():
                for dst, w in flow[h].items():
                    new[dst] += damping * v * w / sum(flow[h].values())
            rank = new
        out.append(rank)
    return out


def test_verdicts_equal_a_plain_computation(spark):
    link = lambda *hosts: " ".join(f'<a HREF = "//{h}/x">l</a>' for h in hosts)
    pages = [(1, "https://A.example.net/en/x?y#z", link("good.test", "good.test", "ok.org")), (2, "http://b.example.net", ""),
             (3, "http://b.example.net/", None), (4, "http://good.test/p", link("mid.test")), (5, "http://mid.test", ""),
             (6, "http://farm.test/a", link("bad.example.net", "example.com")), (7, "http://bad.example.net/de/", link("good.test")),
             (8, "http://www.example.com/de/1", ""), (9, "http://www.example.com/de", ""), (10, "ftp://x.org/fr/", link("ok.org")),
             (11, "no scheme", link("good.test")), (12, None, None), (13, "http://lonely.test/a://b", ""), (14, "HTTP://ÄB.Org/FR/", ""),
             (15, "http://net/", ""), (16, "http://xnet/", ""), (17, "http:///nohost", ""), (18, "http://a\nb.net/q", "")]
    pages += [pages[0], (None, "http://c.example.net/de/", "")]
    df = spark.createDataFrame([(*p, "p", "h") for p in pages], DDL).repartition(3)
    got = urls.judge(df, URL_RULES).collect()
    trust, distrust = propagate(pages)
    assert len(got) == len(pages)
    by_id = {i: u for i, u, _ in pages}
    for r in got:
        host, path = parts(by_id[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = rule_of(host, path)
        assert r["rule"] == rule
        assert r["trust"] == pytest.approx(trust.get(host, 0), abs=1e-9) and r["distrust"] == pytest.approx(distrust.get(host, 0), abs=1e-9)
        assert r["verdict"] == (verdict or ("block" if distrust.get(host, 0) > trust.get(host, 0) + 1e-12 else "allow"))
    assert {r["page_id"]: r["verdict"] for r in got}[6] == "block"  # it links to blocked hosts


def test_verdicts_far_from_seeds_and_of_small_scores(spark):
    to = lambda h: f'<a href="//{h}/">l</a>'
    chain = [("c0.test", to("bad.net"))] + [(f"c{i}.test", to(f"c{i - 1}.test")) for i in range(1, 15)]
    wide = [(f"seed{i}.net", "") for i in range(1500)] + [("bad.net", "")]
    for layer, target in (("l", "bad.net"), ("m", "l0.test"), ("n", "m0.test")):
        wide += [(f"{layer}{i}.test", to(target)) for i in range(1500)]
    rows = [(i, f"http://{h}/", x, "p", "h") for i, (h, x) in enumerate(chain + wide)] + [(-1, "http://alone.test/", "", "p", "h")]
    got = {r["host"]: r for r in urls.judge(spark.createDataFrame(rows, DDL), URL_RULES).collect()}
    assert got.pop("alone.test")["verdict"] == "allow"
    assert {r["verdict"] for r in got.values()} == {"block"}
    assert 0 < got["n1.test"]["distrust"] < 1e-12


def test_scores_settle_on_a_cycle(spark):
    rows = [(h, v, f'<a href="//{t}/">l</a>') for h, v, t in (("a.org", "allow", "b.test"), ("b.test", None, "a.org"))]
    pages = spark.createDataFrame(rows, "host string, verdict string, html string")
    got = {r["host"]: r["trust"] for r in urls.host_scores(pages).collect()}
    a = 0.15 / (1 - 0.85 ** 2)
    assert got == pytest.approx({"a.org": a, "b.test": 0.85 * a}, rel=1e-8)


def test_urls_without_rows(spark):
    assert urls.judge(spark.createDataFrame([], DDL), URL_RULES).collect() == []


def test_urls_on_the_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op10_urls(spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        host, path = parts(pages[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ([verdict] if verdict else ["allow", "block"])
