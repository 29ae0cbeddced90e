"""Worked goldens D1-D11 (FIXTURES.md), computed from reading the original code."""

import math

import pytest
from pyspark.sql import functions as F

from fpengine.config import EMBEDDING_LAYOUT, VectorLayout
from fpengine.functions import scalar as S
from fpengine.functions import vectors as V
from fpengine.operators import aggregate as A
from fpengine.operators import flatten as FL
from fpengine.operators import graph as G
from fpengine.operators import windows as W

D1_HOST = {
    "ip": "192.0.2.1",
    "autonomous_system": {"asn": 64500, "name": "EX", "bgp_prefix": "192.0.2.0/24", "country_code": "US"},
    "services": [
        {"protocol": "HTTP", "port": 80, "software": [{"vendor": "acme", "product": "httpd", "version": "1.0"}],
         "endpoints": [{"http": {"html_tags": ["<title>X</title>"],
                                 "favicons": [{"name": "http://192.0.2.1/f.ico", "hash_shodan": "7"}]}}]},
        {"protocol": "UNKNOWN", "port": 9000, "hardware": [{"vendor": "acme", "product": "cam"}]},
    ],
}


def test_d1_flatten(spark):
    import json
    df = spark.createDataFrame([(json.dumps(D1_HOST),)], "j string") \
        .select(F.from_json("j", FL.HOST).alias("host"))
    row = FL.flatten_hosts(df).first().asDict()
    assert row["as-info"] == "as-asn: 64500as-name: EXas-bgp_prefix: 192.0.2.0/24as-country_code: US"
    assert row["service-distribution"] == "HTTP-80,Unknown Protocol-9000"
    assert row["sw-info"] == "HTTP-80: [vendor: acme|product: httpd|version: 1.0]"
    assert row["hw-versions"] == "Unknown"
    assert row["hw-info"] == "Unknown Protocol-9000: [vendor: acme|product: cam|version:Unknown]"
    assert row["http-bodys"] == "HTTP-80: {}"
    assert row["http-tags"] == "HTTP-80: {endpoint0: <title>X</title>},"
    assert row["http-favicon-urls"] == "HTTP-80: [http://192.0.2.1/f.ico]"
    assert row["http-favicon-hashes"] == "HTTP-80: [7]"
    assert row["http-part-info"] == "HTTP-80: (html tags: {endpoint0: <title>X</title>},|favicons: [http://192.0.2.1/f.ico])"
    assert row["cert-info"] == "" and row["tls-versions"] == ""
    for c in ("whois-info", "os-info", "loc-info", "dns-reverse"):
        assert row[c] is None
    assert len(row) == 46


def test_flt1_string_or_list_types(spark):
    import json
    hosts = []
    for ip, t in (("a", '"camera"'), ("b", '["ROUTER","nas"]'), ("c", '"printer"')):
        h = {"ip": ip, "services": [{"protocol": "HTTP", "port": 80,
                                     "software": [{"vendor": "v", "type": json.loads(t) if t.startswith("[") else json.loads(t)}]}]}
        hosts.append((json.dumps(h),))
    df = spark.createDataFrame(hosts, "j string")
    # type is a string or a list: read the JSON with type as string
    df = df.select(F.from_json("j", FL.HOST).alias("host"))
    kept = FL.drop_other_types(df, ["router", "printer"]).select("host.ip").collect()
    assert [r.ip for r in kept] == ["a"]


def test_d2_entropy(spark):
    single = spark.createDataFrame([(ip, "t", "p", c) for ip, c in zip("abcdef", [0, 0, 1, -1, 1, 2])],
                                   "ip string, device_type string, perspective string, cluster int")
    overall = spark.createDataFrame([(ip, "t", 7) for ip in "abcd"], "ip string, device_type string, overall_cluster int")
    r = A.entropy_importance(single, overall).first()
    assert r["M"] == 4
    assert r["entropy"] == pytest.approx(0.636514, abs=1e-6)
    assert r["norm_entropy"] == pytest.approx(0.459148, abs=1e-6)
    assert r["raw_importance"] == pytest.approx(0.540852, abs=1e-6)
    assert r["is_important"] is False


def test_d3_masked_weights(spark):
    layout = VectorLayout(names=("as", "whois", "os", "sw", "hw", "sd", "body", "htags", "hfavicons", "certificate", "dns"),
                          weights=(.03, .03, .10, .11, .13, .09, .08, .08, .15, .16, .04), block_dim=1)
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],), ([0.0] * 11,)], "m array<double>")
    eff, conf = V.masked_query_weights(F.col("m"), layout)
    rows = df.select(conf.alias("c"), eff.alias("e")).collect()
    assert rows[0].c == pytest.approx(0.7569, abs=1e-9)
    assert rows[1].c == 0.0
    assert sum(rows[1].e) == pytest.approx(1.0)


def test_d4_drift_threshold(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "s double")
    st = A.median_mad(ref, "s").first()
    assert st["median"] == 3.0 and st["mad"] == 1.5
    thr = st["median"] + 3.5 * st["mad"]
    assert thr == 8.25 and not (8.25 > thr) and (8.26 > thr)


def test_d5_folds(spark):
    df = spark.createDataFrame([(i, "t") for i in range(12)], "k long, t string")
    m = W.kfold_test_membership(df, "k", "t").collect()
    per_fold = {}
    for r in m:
        per_fold.setdefault(r.fold, []).append(r.k)
    assert sorted(per_fold) == [1, 2, 3, 4, 5] and all(len(v) == 2 for v in per_fold.values())
    assert len({k for v in per_fold.values() for k in v}) == 10   # 2 rows never tested


def test_d5_wraparound_overlap():
    n, size = 94878, 20000
    folds = []
    for f in range(5):
        start, end = f * size, f * size + size
        folds.append({p for p in range(n) if (start <= p < end) or (p < end - n)})
    assert len(folds[4] & folds[0]) == 5122


def test_d6_degree_penalty(spark):
    df = spark.createDataFrame([(1,), (2,), (10,)], "d long")
    vals = [r[0] for r in df.select(V.degree_penalty("d")).collect()]
    assert vals == pytest.approx([1.0, 1.442695, 0.434294], abs=1e-6)


def test_d7_vote(spark):
    df = spark.createDataFrame([("x", .9, "x", .8), ("x", .6, "y", .9), ("x", .7, "y", .7)], "ta string, ca double, tb string, cb double")
    t, c = S.joint_vote("ta", "ca", "tb", "cb")
    out = [(r[0], r[1]) for r in df.select(t, c).collect()]
    assert out[1] == ("y", .9) and out[2] == ("x", .7)
    assert out[0][0] == "x" and out[0][1] == pytest.approx(0.9)


def test_d8_unseen_score(spark):
    r = spark.range(1).select(S.unseen_score(F.lit(.5), F.lit(.6), F.lit(.7))).first()[0]
    assert r == pytest.approx(0.42)


def test_d9_chunks(spark):
    df = spark.createDataFrame([("a" * 460,), ("b" * 1200,), ("",)], "t string")
    lens = [[len(c) for c in r[0]] for r in df.select(S.chunk_text("t")).collect()]
    assert lens == [[460, 10], [500, 500, 300], []]


def test_d10_normalise(spark):
    df = spark.createDataFrame([("TP-Link ",), ("--",)], "v string")
    assert [r[0] for r in df.select(S.normalize_vendor("v")).collect()] == ["tplink", "unknown"]
    lab = spark.createDataFrame([("POWER_METER-ElectroInd",)], "l string").select(S.normalize_label("l")).first()[0]
    assert lab == "power_meter-electroindustries"


def test_d11_shared_features(spark):
    dev = spark.createDataFrame([("a", "x", "y", "z"), ("b", "x", "y", "q"), ("c", "x", "r", "s"), ("d", "w", "y", "z")],
                                "id string, f1 string, f2 string, f3 string")
    seeds = spark.createDataFrame([("q1", "a")], "query_id string, seed_id string")
    out = G.shared_feature_neighbors(dev, "id", ["f1", "f2", "f3"], seeds, q=1, k=5).collect()
    assert {(r.neighbor_id, r.shared_count) for r in out} == {("b", 2), ("d", 2)}


def test_layout_constant():
    assert EMBEDDING_LAYOUT.dim == 64
    assert math.isclose(sum(EMBEDDING_LAYOUT.weights), 0.55)
