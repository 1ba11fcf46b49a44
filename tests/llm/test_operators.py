"""Small fixtures for every operator: brute-force versions, round trips, and nulls, empty texts, ties and clashing columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard

from revlake.llm import clusters, decontamination, hashing, licenses, linededup, media, mixing, neardup, pii, quality, toxicity, warc
from revlake.llm.common import Workspace, fresh

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """rows of (doc_id, text[, source])"""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id"), (None, None), (5, "same"), (5, "same"), (6, "é ü 漢字 " * 50), (7, "x" * 30000)]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null source, and further columns whose names clash with results'."""
    rows = [(i, t, None, None, None, 1, 2.0, "k", True) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + ", size int, score double, key string, keep boolean")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# WARC

PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip(spark):
    long, rng = "<p>" + "x" * 200, random.Random(1)
    rows = [(5, "http://a/ b", long), (3, None, long), (9, "http://c", long), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (None, "u", long), (8, "u", "é" * 60), (8, "u", "é" * 60)]
    rows += [(100 + i, f"http://x/{i}", f"<html>{prose(rng, 300)}</html>") for i in range(60)]
    read = warc.read(warc.pack(spark.createDataFrame(rows, PAGES))).collect()
    assert len(read) == len(rows)
    found = collections.Counter((r.record_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in read)
    want = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == long and page not in (3, None)
        name = f"<urn:page:{'none' if page is None else page}>"
        want[(name, hashlib.sha256(data).hexdigest(), len(data), "revisit" if again else "response", "<urn:page:3>" if again else None)] += 1
    assert found == want
    assert all(bytes(r.payload) == dict((p, (h or "").encode()) for p, _, h in rows)[int(re.findall(r"\d+", r.record_id)[0])] for r in read if r.record_type == "response" and "none" not in r.record_id)
    assert warc.pack(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_frames_and_dictionary(spark, tmp_path):
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, "u", f"<html>{prose(rng, 400)}</html>") for i in range(200)], PAGES).coalesce(1)
    (archive,) = warc.pack(pages).collect()
    data = bytes(archive.content)
    dictionary, at = warc.load_dictionary(data)
    assert dictionary is not None and at > 8
    frames = 0
    while at < len(data):
        at, frames = warc.frame_end(data, at), frames + 1
    assert frames == 200 == len(list(warc.records(data)))
    raw = dictionary.as_bytes()
    squeezed = zstandard.ZstdCompressor().compress(raw)
    packed = (0x184D2A5D).to_bytes(4, "little") + len(squeezed).to_bytes(4, "little") + squeezed + data[8 + len(raw) :]
    assert len(list(warc.records(packed))) == 200
    (tmp_path / "a.warc.zst").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path AS archive", "content")
    assert warc.read(files).count() == 200


def test_broken_archives():
    record = warc.build(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    good = zstandard.ZstdCompressor(write_checksum=True).compress(record)
    assert len(list(warc.records(good + good))) == 2
    bad = [good[:-3], good[:6], b"\0" * 20, good + b"junk"]
    bad += [zstandard.ZstdCompressor().compress(x) for x in (record[:-1], record + b"x", record.replace(b"WARC/1.1", b"WIRC/1.1"), record.replace(b"WARC-Date", b"WARC-Dote"), record.replace(b"payload\r\n", b"poyload\r\n"), b"")]
    for data in bad:
        with pytest.raises(warc.WarcError):
            list(warc.records(data))


def record(kind, block, *headers, version="WARC/1.0", digest=True):
    lines = [version, f"warc-type: {kind}", "WARC-RECORD-ID: <urn:uuid:1>", "Warc-Date: 2020-01-01T00:00:00Z", *headers]
    if digest:
        lines.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    return "\r\n".join([*lines, f"content-length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    """A hand-made archive: all record types, header names in other cases, SHA-1 in base 32, folded headers, chunked bodies, no lengths."""
    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    body = "grüße".encode()
    chunked = b"3;x=y\r\n" + body[:3] + b"\r\n" + f"{len(body) - 3:X}".encode() + b"\r\n" + body[3:] + b"\r\n0\r\nT: r\r\n\r\n"
    http = "Content-Type: application/http;msgtype=response"
    made = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", digest=False),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + chunked, http, "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: {sha1(body)}"),
        record("response", b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n" + chunked, http, f"warc-payload-digest: {sha1(chunked)}"),
        record("response", b"HTTP/1.1 200 OK\r\nX: a\r\n b\r\n\r\n" + body, http, f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest()}"),
        record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 999\r\n\r\n" + body, http, "WARC-Truncated: length"),
        record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n", http, f"WARC-Payload-Digest: {sha1(body)}", "WARC-Refers-To: <urn:uuid:0>"),
        record("revisit", b"", f"WARC-Payload-Digest: {sha1(body)}"),
        record("resource", body, "Content-Type: text/plain"),
        record("metadata", b"via: x\r\n", "Content-Type: application/warc-fields", "WARC-Payload-Digest: odd:zz", version="WARC/1.1"),
    ]
    data = b"".join(zstandard.ZstdCompressor().compress(x) for x in made)
    rows = warc.read(spark.createDataFrame([("a", bytearray(data)), ("none", None)], "archive string, content binary")).orderBy("offset").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "response", "response", "response", "revisit", "revisit", "resource", "metadata"]
    assert [bytes(r.payload) if r.payload is not None else None for r in rows] == [None, None, body, body, body, body, None, None, body, None]
    assert {r.payload_digest for r in rows[2:6]} == {hashlib.sha256(body).hexdigest()} and [r.payload_bytes for r in rows[5:8]] == [len(body), 7, None]
    assert rows[6].payload_digest == sha1(body) and rows[6].refers_to == "<urn:uuid:0>" and rows[2].target_uri == "http://a/"
    bad = [
        record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nshort", http),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", http),
        record("response", b"HTTP/1.1 200 OK\r\n\r\nbody", http, f"WARC-Payload-Digest: {sha1(body)}"),
        record("resource", body).replace(b"sha1:", b"sha1:A"),
    ]
    for x in bad:
        with pytest.raises(warc.WarcError):
            for _, head, block in warc.records(zstandard.ZstdCompressor().compress(x)):
                warc.payload_of(head, block)


def test_archives_as_files(spark, tmp_path):
    rng, folder = random.Random(7), f"file://{tmp_path}/out"
    pages = spark.createDataFrame([(i, "u", f"<html>{prose(rng, 60)}</html>") for i in range(90)], PAGES)
    written = warc.save(warc.pack(pages.repartition(3)), folder).collect()
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*.warc.zst")}
    assert files and {(r.archive, r.n_bytes, r.sha256) for r in written} == {(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
    back = warc.read(warc.load(spark, folder)).select("record_id", "payload").collect()
    want = {f"<urn:page:{r.page_id}>": r.html.encode() for r in pages.collect()}
    assert {r.record_id: bytes(r.payload) for r in back} == want and len(back) == 90


# Line dedup


def brute_lines(rows):
    k, lines = linededup.SHINGLE, []
    for i, t in rows:
        lines += [(i, p, x.strip(" ").lower()) for p, x in enumerate(t.split("\n"))]
    sets = {x: {x[j : j + k] for j in range(len(x) - k + 1)} or {x} for _, _, x in lines if x}
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    first = {}
    for i, p, x in sorted(lines):
        if x:
            first.setdefault(find(x), (i, p))
    out = {}
    for i, t in rows:
        out[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or first[find(x.strip(" ").lower())] == (i, p))
    return out


def test_line_dedup_against_brute_force(spark):
    rng, rows = random.Random(11), []
    base = [prose(rng, 25) for _ in range(6)]
    for i in range(40):
        parts = [prose(rng, rng.randrange(1, 20)) for _ in range(3)]
        line = list(rng.choice(base))
        if rng.random() < 0.7:
            line[rng.randrange(len(line))] = "Z"
        rows.append((i, "\n".join([*parts[:2], "".join(line), "", "Short", parts[2]])))
    found = {r.doc_id: r.text for r in linededup.dedupe(frame(spark, rows)).collect()}
    assert found == brute_lines(rows)


def test_bands_of_lines_miss_few_pairs():
    assert (1 - linededup.THRESHOLD**linededup.ROWS) ** linededup.BANDS < 0.004


def test_measured_recall_of_bands():
    """With the masks as they are, for short and long lines at a similarity of exactly 0.8."""
    masks, rng = np.array(linededup._MASKS, np.int64).astype(np.int32), np.random.default_rng(1)
    for union, least in ((10, 0.97), (20, 0.97), (40, 0.985), (200, 0.99)):
        hits = 0
        for _ in range(1500):
            h = rng.integers(-(2**31), 2**31, union).astype(np.int32)
            both, half = union * 4 // 5, union // 10
            a, b = ((np.r_[h[:both], x][:, None] ^ masks).min(0) for x in (h[both : both + half], h[both + half :]))
            hits += (a == b).reshape(linededup.BANDS, linededup.ROWS).all(1).any()
        assert hits / 1500 >= least


def test_keys_find_what_bands_do_and_fewer_unlike_lines():
    """A pair at 0.8 shares a key about as often as a band, in short lines more often, and an unlike pair not nearly so often."""
    masks, rng = np.array(linededup._MASKS, np.int64).astype(np.int32), np.random.default_rng(4)
    assert len(linededup.KEYS + linededup.FEW_KEYS) <= 1 << linededup.KEY_BITS and all(len(set(key)) == 5 for key in linededup.KEYS)

    def shares(union, both, count):
        keys = bands = 0
        for _ in range(count):
            h, half = rng.integers(-(2**31), 2**31, union).astype(np.int32), (union - both) // 2
            a, b = ((np.r_[h[:both], x][:, None] ^ masks).min(0) for x in (h[both : both + half], h[both + half :]))
            few, same = all(len(set((x ^ masks) & (1 << linededup.BITS) - 1)) < linededup.VARIED for x in (a, b)), a == b
            keys += any(same[list(key)].all() for key in linededup.KEYS + (linededup.FEW_KEYS if few else []))
            bands += same.reshape(linededup.BANDS, linededup.ROWS).all(1).any()
        return keys / count, bands / count

    for union, least in ((10, 0.98), (20, 0.98), (40, 0.99), (60, 0.99), (100, 0.994), (200, 0.994), (600, 0.993)):
        keys, bands = shares(union, union * 4 // 5, 1000)
        assert keys >= max(least, bands - 0.003), (union, keys, bands)
    keys, bands = shares(300, 60, 5000)
    assert 3 * keys <= 2 * bands, (keys, bands)


def test_a_pair_is_met_in_the_bucket_of_its_first_key(spark):
    """first() agrees with the buckets that members() deals out, of which each stands for the minima of its key."""
    F, rng, rows = linededup.F, random.Random(41), []
    for i in range(40):
        a = [[rng.getrandbits(16) for _ in range(linededup.ROWS)] for _ in range(linededup.BANDS)]
        b = [[x if rng.random() < i / 40 else rng.getrandbits(16) for x in band] for band in a]
        same = [x == y for one, two in zip(a, b, strict=True) for x, y in zip(one, two, strict=True)]
        word = lambda band: int.from_bytes(sum(x << 16 * r for r, x in enumerate(band)).to_bytes(8, "big"), "big", signed=False)
        a, b = ([w - 2**64 if (w := word(band)) >> 63 else w for band in bands] for bands in (a, b))
        rows.append((i, a, b, [n for n, key in enumerate(linededup.KEYS + linededup.FEW_KEYS) if all(same[j] for j in key)], sum(same)))
    df = spark.createDataFrame([r[:3] for r in rows], "i int, a array<bigint>, b array<bigint>")
    dealt = lambda s: linededup.members(df.select(F.col("i").alias("node"), F.lit(None).cast("bigint").alias("seen"), F.col(s).alias("bands")))
    met = dealt("a").join(dealt("b").select("bucket", "node"), ["bucket", "node"]).join(df, F.col("node") == F.col("i"))
    found = met.select("i", F.col("bucket").bitwiseAND(F.lit((1 << linededup.KEY_BITS) - 1)).alias("key"), linededup.first("bucket", "a", "b").alias("one")).collect()
    assert sorted((r.i, r.key, r.one) for r in found) == [(i, n, n == keys[0]) for i, _, _, keys, _ in rows for n in keys]
    shared = df.select("i", F.bit_count(linededup._shared("a", "b")).alias("n")).sort("i").collect()
    assert [r.n for r in shared] == [r[4] for r in rows]


def test_generated_code_of_lines_is_compiled(spark):
    """The JVM's compiler takes no method of more than 8,000 bytes of code; beyond that, rows cost ten times as much."""
    lines = frame(spark, [(1, "one line")]).select("doc_id", linededup.F.col("text").alias("norm"))
    lines = lines.withColumn("digest", linededup._digest("norm")).withColumn("id", linededup.F.col("doc_id").cast("bigint"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        known = linededup._signatures(lines.select("digest", "id", "norm")).select("digest", "id", "copies", linededup._seen().alias("seen"), "bands")
        for df in (known, linededup.members(spark.createDataFrame([], "node bigint, seen bigint, bands array<bigint>"))):
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
            assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code)), code[:200]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_agreement_of_minima_loses_next_to_nothing():
    """Of the pairs at a similarity of exactly 0.8 that share a band, nearly all share enough minima; of pairs at 0.1, very few do."""
    masks, rng = np.array(linededup._MASKS, np.int64).astype(np.int32), np.random.default_rng(2)

    def agreements(union, both):
        h, half = rng.integers(-(2**31), 2**31, union).astype(np.int32), (union - both) // 2
        a, b = ((np.r_[h[:both], x][:, None] ^ masks).min(0) for x in (h[both : both + half], h[both + half :]))
        few = min(len(set((x ^ masks) & (1 << linededup.BITS) - 1)) for x in (a, b)) < linededup.VARIED
        return (a == b).reshape(linededup.BANDS, linededup.ROWS).all(1).any(), few or ((a ^ b)[linededup.SEEN] & 3 == 0).sum() >= linededup.AGREE

    for union in (10, 20, 40, 60, 100, 600):
        found = [agreements(union, union * 4 // 5) for _ in range(3000)]
        assert sum(band and not enough for band, enough in found) <= 6, union  # 0.2 %
    assert sum(agreements(1000, 100)[1] for _ in range(3000)) <= 15


def test_agreement_as_a_column(spark):
    rng = random.Random(3)
    rows = [[[rng.getrandbits(64) - 2**63 for _ in range(linededup.BANDS)] for _ in range(2)] for _ in range(60)]
    for i, (a, b) in enumerate(rows):
        b[: i // 5] = a[: i // 5]
    two = lambda bands: [bands[i // linededup.ROWS] >> (linededup.BITS * (i % linededup.ROWS)) & 3 for i in linededup.SEEN]
    rows.append([[0] * linededup.BANDS, rows[0][0]])  # a line of few shingles goes with all others
    low = lambda bands: {(bands[i // linededup.ROWS] >> linededup.BITS * (i % linededup.ROWS) ^ m) & 65535 for i, m in enumerate(linededup._MASKS)}
    rows[-1][0] = [sum(((5 ^ m) & 65535) << 16 * r for r, m in enumerate(linededup._MASKS[4 * b : 4 * b + 4])) for b in range(linededup.BANDS)]
    rows[-1][0] = [x - 2**64 if x >= 2**63 else x for x in rows[-1][0]]
    assert len(low(rows[-1][0])) == 1
    want = [sum(x == y for x, y in zip(two(a), two(b), strict=True)) >= linededup.AGREE for a, b in rows[:-1]] + [True]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<bigint>, b array<bigint>")
    seen = df.selectExpr("i", "a AS bands", "b").withColumn("x", linededup._seen()).selectExpr("i", "x", "b AS bands").withColumn("y", linededup._seen())
    assert [r.ok for r in seen.select("i", linededup.agree("x", "y").alias("ok")).sort("i").collect()] == want and len(set(want)) == 2


def test_unlike_lines_of_one_bucket_are_not_verified(spark):
    """Lines that share buckets by chance give no rows for verification; one round does for buckets of ordinary size."""
    from revlake.llm.common import Workspace

    members = spark.range(60).selectExpr("id % 2 AS bucket", "id AS node", "id DIV 4 AS seen")
    seen = []

    def verify(pairs):
        seen.append(sorted((r.a, r.b) for r in pairs.collect()))
        return pairs

    same = lambda to: linededup.F.col("seen") == linededup.F.col(f"{to}seen")
    labels = clusters.classes(Workspace(spark, "t"), members, verify, facts=members.select("node", "seen").distinct(), possible=same, small=32)
    assert seen == [sorted((4 * k + o, 4 * k + o + 2) for k in range(15) for o in range(2))]
    assert {r.node: r.root for r in labels.collect()} == {n: n - n % 4 + n % 2 for n in range(60)}
    seen.clear()
    labels = clusters.classes(Workspace(spark, "t"), members, verify, facts=members.select("node", "seen").distinct(), possible=same, small=8)  # larger buckets: by leaders
    assert {r.node: r.root for r in labels.collect()} == {n: n - n % 4 + n % 2 for n in range(60)}


def test_outsiders_of_a_crowd_are_ruled_out_before_their_lines_move(spark, monkeypatch):
    """Lines that resemble a large group without being links are not paired with all of it, and no link is lost, also where leaders gather first."""
    keep, rng, rows = Workspace.keep, random.Random(37), []
    monkeypatch.setattr(clusters, "MANY", 1000)
    base = prose(rng, 70)
    for i in range(150):
        line = list(base)
        for at in rng.sample(range(len(line)), 14 if i % 5 == 0 else 2):
            line[at] = rng.choice("XYZ#@&%")
        rows.append((i, "".join(line)))
    seen = {}

    def kept(work, df, name):
        out = keep(work, df, name)
        if name.startswith(("pairs-", "met-")):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "keep", kept)
    found = {r.doc_id: r.text for r in linededup.dedupe(frame(spark, rows)).collect()}
    monkeypatch.setattr(linededup, "SHINGLE", linededup.FINE)  # of the brute-force version
    assert found == brute_lines(rows)
    assert sum(n for name, n in seen.items() if name != "pairs-0") < 300 and "met-1" in seen, seen


def test_minima_and_sets_rule_out_no_links(spark):
    """Of edited lines, those alike pass both conditions, and unlike ones do not."""
    F, rng, pairs = linededup.F, random.Random(39), []
    for n in (4, 12, 60, 300):
        for share in (0.0, 0.005, 0.01, 0.02, 0.05, 1.0):
            line = list(prose(rng, n))
            pairs.append(("".join(line), "".join(rng.choice("xyz") if rng.random() < share else c for c in line)))
    both = spark.createDataFrame(pairs, "a string, b string")
    lines = both.selectExpr("stack(2, a, b) AS norm").distinct().withColumn("digest", linededup._digest("norm")).withColumn("id", F.lit(1).cast("bigint"))
    facts = lines.join(linededup._signatures(lines).drop("id"), "digest").withColumn("seen", linededup._seen()).withColumn("every", linededup.shingles("norm", linededup.FINE))
    facts = facts.withColumn("sets", F.struct(F.col("every").alias("set"), F.size("every").alias("distinct")))
    for s in "ab":
        both = both.join(facts.select(F.col("norm").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("bands", "seen", "sets"))), s)
    rows = both.select(linededup.alike("a", "b", 0.8).alias("alike"), linededup.share("bands_a", "bands_b", "seen_a", "seen_b").alias("one"), linededup.within("sets_a", "sets_b", 0.8).alias("two")).collect()
    assert len(rows) == len(pairs) and any(r.alike for r in rows) and all(r.one and r.two for r in rows if r.alike) and not any(r.two for r in rows if not r.alike)


def test_line_dedup_leaves_one_table(spark):
    """What a pipeline's later stages do not read is gone before they begin."""
    from revlake.llm.common import shared_dir

    before = set(Path(shared_dir(spark)).glob("lines-*/*"))
    linededup.dedupe(frame(spark, [(1, "one and the same line"), (2, "one and the same line\nmore")])).collect()
    assert [p.name for p in set(Path(shared_dir(spark)).glob("lines-*/*")) - before] == ["lost"]


def test_lines_of_other_scripts_are_linked(spark):
    """MinHash and banding find nearly every pair of edited lines whose letters take two, three or four bytes."""
    rng, rows = random.Random(31), []
    for i in range(60):
        letters = ("абвгдежзийклмноп", "漢字仮名交文章検索結果表示", "😀😁😂🤣😃😄😅😆😉😊")[i % 3]
        line = [rng.choice(letters) for _ in range(80)]
        rows.append((2 * i, "".join(line)))
        line[40] = "#"
        rows.append((2 * i + 1, "".join(line)))
    found = {r.doc_id: r.text for r in linededup.dedupe(frame(spark, rows)).collect()}
    assert all(found[2 * i] for i in range(60)) and sum(bool(found[2 * i + 1]) for i in range(60)) <= 1


def test_bounds_prove_only_unlike_lines_apart(spark):
    """No pair at the threshold or above is left unverified, long and repetitive lines included."""
    F, rng, pairs = linededup.F, random.Random(33), []
    for n in (3, 30, 90, 700, 4000):
        for share in (0.0, 0.01, 0.02, 0.03, 0.2):
            line = list(prose(rng, n)) + list("ab" * rng.randrange(60))
            other = [rng.choice("xyz") if rng.random() < share else c for c in line]
            pairs.append((len(pairs), "".join(line), "".join(other)))
    both = spark.createDataFrame(pairs, "p int, a string, b string")
    lines = both.selectExpr("stack(2, a, b) AS norm").distinct().withColumn("digest", linededup._digest("norm")).withColumn("id", F.lit(1).cast("bigint"))
    sketch = linededup._signatures(lines)
    every = lines.withColumn("every", linededup.shingles("norm", linededup.FINE)).select("norm", "digest", F.size("every").alias("distinct"), linededup.part_of("every").alias("part"))
    facts = every.join(sketch, "digest")
    for s in "ab":
        names = ["size", "distinct", "part"]
        named = facts.select(F.col("norm").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in names), *(F.col(f"k{w}").alias(f"k{s}{w}") for w in range(linededup.WORDS)))
        both = both.join(named, s)
    rows = both.select(linededup.alike("a", "b", 0.8).alias("alike"), linededup.may_link(0.8).alias("one"), linededup.may_still_link(0.8).alias("two")).collect()
    assert len(rows) == len(pairs) and any(r.alike for r in rows) and all(r.one and r.two for r in rows if r.alike) and not all(r.one and r.two for r in rows)


def test_large_buckets_are_split(spark, monkeypatch):
    """Splitting large buckets loses nothing that brute force finds."""
    monkeypatch.setattr(clusters, "HOT", 2)
    rng, rows = random.Random(35), []
    passage = prose(rng, 60)
    for i in range(30):
        rows.append((2 * i, f"{passage} {prose(rng, 25)}"))
        rows.append((2 * i + 1, rows[-1][1][:-1] + "#"))
    found = {r.doc_id: r.text for r in linededup.dedupe(frame(spark, rows)).collect()}
    monkeypatch.setattr(linededup, "SHINGLE", linededup.FINE)  # of the brute-force version
    assert found == brute_lines(rows)


def test_short_lines_with_edits(spark, monkeypatch):
    rng, rows = random.Random(23), []
    for i in range(60):
        line = prose(rng, 30)[: 40 + i % 51].strip()
        for edits in range(3):
            changed = list(line)
            for at in rng.sample(range(6, len(line) - 6), edits):
                changed[at] = "#"
            rows.append((3 * i + edits, "".join(changed)))
    found = {r.doc_id: r.text for r in linededup.dedupe(frame(spark, rows)).collect()}
    monkeypatch.setattr(linededup, "SHINGLE", linededup.FINE)  # of the brute-force version
    exact = brute_lines(rows)
    assert all(not exact[i + 1] for i, t in rows if i % 3 == 0 and len(t) >= 60)  # less where shingles repeat
    missed = [i for i in exact if found[i] != exact[i]]
    assert len(missed) <= 2, missed  # banding may miss a pair near the threshold


def test_line_dedup_odd_rows(spark):
    found = collections.Counter((r.doc_id, r.text) for r in linededup.dedupe(odd(spark)).collect())
    assert found == collections.Counter(ODD)
    assert linededup.dedupe(empty(spark)).count() == 0


def test_shingles_of_lines(spark):
    sizes = {r.s: r.n for r in spark.createDataFrame([("",), ("short",), ("123456789",), ("1234567890",), ("a" * 50,), ("é" * 9,)], "s string").selectExpr("s").withColumn("n", linededup.F.size(linededup.shingles("s"))).collect()}
    assert sizes == {"": 1, "short": 1, "123456789": 1, "1234567890": 2, "a" * 50: 1, "é" * 9: 1}


# Clusters


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 301), (301, 302), (302, 300)]
    found = {r.node: r.root for r in clusters.components(Workspace(spark, "t"), spark.createDataFrame(links, "a bigint, b bigint"), "c").collect()}
    assert found == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300, 302: 300}


def test_large_buckets_lose_no_link(spark):
    """One bucket of 60 nodes in 12 cliques that verification tells apart: every clique is found."""
    members = spark.createDataFrame([(7, i) for i in range(60)] + [(8, 1), (9, 2)], "bucket bigint, node bigint")
    labels = clusters.classes(Workspace(spark, "t"), members, lambda p: p.where("a % 12 = b % 12"))
    assert {r.node: r.root for r in labels.collect()} == {i: i % 12 for i in range(60)}


# Quality and toxicity


def labelled(spark):
    rng, docs, labels = random.Random(4), [], []
    for i in range(500):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        words = prose(rng, 40).split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["blastyou", "grubface"])
        text = "!! ".join(words).upper() if bad else " ".join(words) + "."
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module, column, folds, fold", [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, module, column, folds, fold):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and sum(r.predicted == r[column] for r in held) / len(held) >= 0.9
    wrong = labels.withColumn(column, linededup.F.when(linededup.F.crc32(linededup.F.col("doc_id").cast("string").cast("binary")) % folds == fold, 1 - linededup.F.col(column)).otherwise(linededup.F.col(column)))
    again = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, wrong)).collect()}
    if module is toxicity:  # labels of held-out rows change nothing
        assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    found = module.score(odd(spark), model).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in ODD) and all(0 <= r.score <= 1 for r in found)
    assert module.score(empty(spark), model).count() == 0
    none = module.fit(docs, labels.limit(0))
    assert {0 <= r.score <= 1 for r in module.score(docs, none).collect()} == {True}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_do_not_depend_on_the_order_of_rows(spark, module):
    docs, labels = labelled(spark)
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 20").withColumn("text", linededup.F.concat("text", linededup.F.lit(" more"))))
    scores = []
    for parts in (1, 7):
        model = module.fit(docs.repartition(parts), labels.repartition(parts))
        scores.append(sorted((r.doc_id, r.score) for r in module.score(docs, model).collect()))
    assert scores[0] == scores[1]
    assert module.fit(empty(spark), labels).score("any" if module is toxicity else np.zeros((1, quality.DIMS))) is not None


def test_prior_among_unlabelled_rows():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        n = 4000
        good = rng.random(n) < share
        found = quality.prior_of(rng.normal(2, 1, 2000), np.where(good, rng.normal(2, 1, n), rng.normal(-2, 1, n)))
        assert abs(found - share) < 0.08


def test_ngrams_are_of_characters():
    assert len(np.unique(np.concatenate(list(toxicity.grams("漢字かなカナ"))))) == 5 + 4 + 3 + 2 == 14
    same = [np.unique(np.concatenate(list(toxicity.grams(t)))) for t in ("ПРИВЕТ, мир", "привет,\nмир")]
    assert (same[0] == same[1]).all()


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (600, 2)), rng.normal(-2, 1, (300, 2))
    w = quality.nn_pu(good[:200], np.vstack([good[200:], bad]), 400 / 700)
    z = np.vstack([good, bad]) @ w[:-1] + w[-1]
    assert ((z > 0) == (np.arange(900) < 600)).mean() > 0.95


def test_long_texts_have_the_same_ngrams(monkeypatch):
    text = prose(random.Random(5), 800)
    whole = set(np.concatenate(list(toxicity.grams(text))).tolist())
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    assert set(np.concatenate(list(toxicity.grams(text))).tolist()) == whole


# Media


def test_media_round_trip(spark):
    rng = random.Random(6)
    base = prose(rng, 3000)
    rows = [(i, base[:k] + "EDIT" + base[k:]) for i, k in enumerate((0, 5000, 9000, 9000))] + [(9, "é" * 5000), (10, "q"), (11, "z" * 64)]
    for row in media.columns(frame(spark, rows)).collect():
        data = dict(rows)[row.doc_id].encode()
        padded = data + bytes(-len(data) % 64)
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert row.tail_crc32 == zlib.crc32(padded[-64:]) and row.media_bytes > len(padded)
    packs, shared = media.store(frame(spark, rows), Workspace(spark, "m"))
    kept = sum(len(p.data) for r in packs.collect() for p in r.own) + sum(len(r.data) for r in shared.collect())
    assert kept < 0.6 * sum(len(t) for _, t in rows)
    found = media.columns(odd(spark)).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in ODD)
    assert {r.payload_bytes for r in found if r.doc_id in (1, 2)} == {64} and media.columns(empty(spark)).count() == 0


def test_chunks_follow_content(monkeypatch):
    data = prose(random.Random(8), 20000).encode()
    parts = list(media.chunks(data))
    assert b"".join(parts) == data and all(media.LEAST <= len(p) <= media.MOST for p in parts[:-1])
    moved = set(media.chunks(b"inserted bytes" + data))
    assert len(moved & set(parts)) > 0.9 * len(parts)
    monkeypatch.setattr(media, "BLOCK", 1000)
    assert list(media.chunks(data)) == parts
    with pytest.raises(ValueError):
        media.rebuild(media.recipe(3, [(hashlib.sha256(b"abc").digest(), 3)]), {hashlib.sha256(b"abc").digest(): b"abd"})


# PII


def brute_pii(text):
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    card, phone = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    ok = {
        "email": (email, lambda m: True),
        "ip": (ip, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (card, lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        "phone": (phone, lambda m: 8 <= len(digits(m)) <= 15),
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, good) in ok.items() for m in re.finditer(p, text) if good(m))


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@d-e.f.g", "@", "..", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (555) 010-9999", "+12", "++49 30 1234567", "é", " ", "\n", "-", "7", "a@b", "q%+@w.x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    rows = {r.doc_id: r for r in pii.summary(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert rows[i].n_card == want.count("card:") and rows[i].spans.startswith(want)


def test_extra_kinds_and_context(spark):
    assert [s.kind for s in pii.find("IBAN DE89 3704 0044 0532 0130 00 here")][-1:] == ["iban"]
    assert not [s for s in pii.find("IBAN DE89 3704 0044 0532 0130 01 here") if s.kind == "iban"]
    assert [s.kind for s in pii.find("pay by visa 378282246310005 now")] == ["short_card"] and pii.find("number 378282246310005 now") == []
    assert [s.kind for s in pii.find("call 030 123 4567 now")] == ["local_phone"] and pii.find("see 030 123 4567 now") == []
    assert pii.find("my email: a@b.cd")[0].score > pii.find("at a@b.cd")[0].score
    assert pii.redact(frame(spark, [(1, "to a@b.cd, 1.2.3.4")])).first().text == "to [email], [ip]"
    found = pii.summary(odd(spark)).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in ODD) and {r.spans for r in found} == {""}
    assert pii.summary(empty(spark)).count() == 0


def test_secrets():
    kinds = lambda text: [(s.kind, text[s.start : s.end]) for s in pii.find(text)]
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'token = "{value}"') == [("assigned", value)] and kinds(f"API_KEY:{value}, x") == [("assigned", value)]
    assert kinds("password = correcthorse, token: aaaaaaaa1, secret is out") == []
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\n") == [("secret", "-----BEGIN RSA PRIVATE KEY-----")]
    for token in ("AKIA" + "A1B2C3D4E5F6G7H8", "ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"):
        assert kinds(f"see {token} there") == [("secret", token)] and not kinds(f"see x{token} there")
    for long in ("eyJ" * 100000, "token=" * 50000, "-----BEGIN " * 30000, "ghp_" * 50000):  # linear time
        pii.find(long)


# Mixing


def fill(sizes):
    """Targets by the contract's own steps: share by weight, stop at twice the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in names}
        full |= set(over)


def test_mix_meets_its_targets(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(0, 300)), rng.choice(["b", "a", "é", "z", None, "a", "a"])) for i in range(300)] + [(900, "one two", "tiny"), (901, None, "none"), (902, "", "none")]
    found = mixing.mix(frame(spark, rows), "source").collect()
    assert {(r.doc_id, r["size"]) for r in found} == {(i, len((t or "").split())) for i, t, _ in rows} and len(found) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in found:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - fill(sizes)[r.source]) < 1e-6
    for s, target in fill(sizes).items():
        assert abs(taken[s] - target) <= max(3, 0.03 * target), s
    again = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows).repartition(3), "source").collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_mix_of_odd_tables(spark):
    found = mixing.mix(odd(spark)).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in ODD)
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_mix_of_clashing_columns_ties_and_null_ids(spark):
    """Kept columns named as the result's own give way; rows without ids and equal ids get the same in any partitioning."""
    rng = random.Random(44)
    rows = [(None if i % 3 else 7, prose(rng, 1 + i % 40), "a" if i % 5 else "b", i, 1.0, "k", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target double, Taken string, row int")
    results = []
    for parts in (1, 6):
        found = mixing.mix(docs.repartition(parts), *(c for c in docs.columns if c != "doc_id"))
        assert found.columns == ["doc_id", "text", "source", "row", "size", "source_size", "target", "taken"]
        results.append(sorted((r["row"], r["size"], r.taken) for r in found.collect()))
    assert results[0] == results[1] and len(results[0]) == 200 and any(t for _, _, t in results[0])


def test_dedupe_and_clean_with_clashing_columns(spark):
    rows = [(1, "one line here\nsame line of text here", *range(9)), (2, "same line of text here", *range(9)), (None, None, *range(9))]
    names = ["of", "doc", "gone", "key", "digest", "first", "_hash", "n_lines", "n_dropped"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    found = {r.doc_id: r for r in linededup.dedupe(docs).collect()}
    assert found[2].text == "" and found[2].n_dropped == 1 and found[1].gone == 2 and found[None].text is None
    assert neardup.dedupe(docs).columns == docs.columns and neardup.dedupe(docs).count() == 3
    items = spark.createDataFrame([(1, "one line here")], "item_id bigint, text string")
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, None}


def test_word_counts_follow_the_pattern(spark):
    texts = ["a b", " a\tb\x0bc\x0c\rd\n", "  a", "", "x\x1cy z"]
    rows = {r.doc_id: r["size"] for r in mixing.mix(frame(spark, list(enumerate(texts)))).collect()}
    assert rows == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(texts)}


# Decontamination


def test_copies_of_items_are_found(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, 35)) for i in range(8)] + [(8, "only three words"), (9, None), (10, "")]
    docs = [(i, prose(rng, 200)) for i in range(60)]
    edited = items[1][1].split()
    for k in (4, 15, 22, 30):
        edited[k] = "changed"
    docs += [(100, prose(rng, 50) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(rng, 50)), (101, " ".join(edited)), (102, items[2][1]), (103, "x only three words y"), (None, items[2][1]), (104, None)]
    docs += [(200 + i, prose(rng, 20) + " " + items[3][1]) for i in range(60)]  # an item that fills the corpus keeps its seeds
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert found == {(100, 0), (101, 1), (102, 2), (None, 2), (103, 8)} | {(200 + i, 3) for i in range(60)}
    left = decontamination.clean(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in left.collect()} == set(range(60)) | {104}  # a copy goes, also without an id


def test_edited_copies_of_a_hot_item_are_found_beside_a_full_one(spark):
    rng = random.Random(21)
    item = prose(rng, 40).split()
    edited = [*item[:10], "changed", *item[11:25], "changed", *item[26:]]  # the eight seeds that only the full copy has
    docs = [(i, prose(rng, 60)) for i in range(60)] + [(100, " ".join(item))]
    docs += [(200 + i, f"{prose(rng, 15)} {' '.join(edited)} {prose(rng, 15)}") for i in range(30)]
    docs += [(300 + i, f"{prose(rng, 15)} {' '.join(edited[5:35])} {prose(rng, 15)}") for i in range(5)]
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(frame(spark, docs), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
    assert set(found) == {(i, 1) for i in [100, *range(200, 230), *range(300, 305)]}
    assert found[100, 1] == 1 and found[200, 1] == 37 / 40


def test_decontamination_with_null_and_shared_ids(spark):
    rng = random.Random(22)
    items = spark.createDataFrame([(None, prose(rng, 30)), (None, prose(rng, 30)), (7, prose(rng, 30))], "item_id bigint, text string")
    texts = [r.text for r in items.collect()]
    docs = frame(spark, [(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, "a clean row with the same id"), (4, None)])
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(1, None), (2, None), (3, 7)}
    assert {(r.doc_id, r.text) for r in decontamination.clean(docs, items).collect()} == {(3, "a clean row with the same id"), (4, None)}


def test_no_alignment_scores_more_than_the_words_in_common():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(3, 9, 20).astype(np.uint64)
        shared = collections.Counter(a.tolist()) & collections.Counter(b.tolist())
        assert decontamination.align(a, b)[0] <= decontamination.reach(a, b) == sum(shared.values())


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 5, 12).astype(np.uint64), rng.integers(0, 5, 20).astype(np.uint64)
        h = np.zeros((13, 21))
        for i in range(12):
            for j in range(20):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
        assert decontamination.align(a, b)[0] == h.max()


def test_decontamination_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "some item of more than three words")], "item_id bigint, text string")
    assert decontamination.contaminated(odd(spark), items).count() == 0 == decontamination.contaminated(empty(spark), items).count()
    assert decontamination.contaminated(odd(spark), items.limit(0)).count() == 0
    assert decontamination.clean(odd(spark), items).count() == len(ODD)


# Licences

MIT = """MIT License\n\nCopyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def brute_licenses(text):
    keys, found = {s: k for k, s in licenses.SENTENCES.items()}, set()
    for ends in (licenses.LINES, licenses.WRAPPED):
        ids = [keys[s] for p in re.split(ends, text or "") if (s := re.sub("[^a-z0-9]+", " ", p.lower()).strip()) in keys]
        for name, rule in licenses.RULES:
            it = iter(ids)
            if all(x in it for x in rule):
                found.add(name)
    return ",".join(sorted(x for x in found if licenses.IMPLIED.get(x) not in found))


def test_licenses_against_brute_force(spark):
    rng, parts = random.Random(13), list(licenses.SENTENCES.values())
    texts = [MIT, MIT.replace("The above", "An odd"), "Some text.\nReleased under the MIT License.\nmore", "# Licensed under the Apache License, Version 2.0. All rights reserved.", "license", None, ""]
    for name, rule in licenses.RULES:
        texts += ["Intro. " + "! \n".join(licenses.SENTENCES[k] for k in rule) + ".", ". ".join(licenses.SENTENCES[k] for k in reversed(rule))]
    texts += [". ".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    found = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert found == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert found[0] == "MIT" and found[2] == "MIT" and found[3] == "All-Rights-Reserved,Apache-2.0"
    rows = licenses.scan(odd(spark)).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in ODD) and licenses.scan(empty(spark)).count() == 0


# Near-duplicates


def test_near_duplicates_against_brute_force(spark):
    rng, rows = random.Random(14), []
    for g in range(6):
        base = prose(rng, 150).split()
        for _ in range(5):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edit"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, prose(rng, 80)) for i in range(20)]
    rows += [(200, rows[0][1]), (201, rows[0][1])]
    docs = frame(spark, rows)
    idf = neardup.idf_table(docs)
    weighed = {i: neardup.weigh(t, idf) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        if s == t or neardup.similarity(weighed[a], weighed[b]) >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found, _ = neardup.groups(docs)
    assert {r.doc_id: r.class_id for r in found.collect()} == {i: find(i) for i, _ in rows}
    assert sorted(r.doc_id for r in neardup.dedupe(docs).collect()) == sorted({find(i) for i, _ in rows})


def test_near_duplicates_of_odd_rows(spark):
    found, _ = neardup.groups(odd(spark))
    rows = collections.Counter((r.doc_id, r.class_id) for r in found.collect())
    # Null and empty texts are copies, of which a row with an id stays.
    assert rows == collections.Counter({(1, 1): 1, (2, 1): 1, (None, 1): 1, (3, 3): 1, (None, None): 1, (5, 5): 2, (6, 6): 1, (7, 7): 1})
    assert collections.Counter(r.doc_id for r in neardup.dedupe(odd(spark)).collect()) == collections.Counter([1, 3, None, 5, 6, 7])
    assert neardup.groups(empty(spark))[0].count() == 0


def test_samples_estimate_weighted_similarity():
    rng, agree, exact = random.Random(15), [], []
    idf = np.full(neardup.CELLS, 0.5, np.float32)
    for _ in range(40):
        a = prose(rng, 300).split()
        b = list(a)
        for k in rng.sample(range(300), 6):
            b[k] = "other"
        x, y = neardup.weigh(" ".join(a), idf), neardup.weigh(" ".join(b), idf)
        exact.append(neardup.similarity(x, y))
        agree.append((neardup.band_keys(*x)[1] == neardup.band_keys(*y)[1]).mean())
    assert abs(np.mean(agree) - np.mean(exact)) < 0.04


def test_bounds_rule_out_no_similar_texts(spark):
    """The weight that a text has alone is exact, and texts that it rules out are similar to none."""
    rng, texts = random.Random(41), []
    base = prose(rng, 150).split()
    for i in range(40):
        copy = list(base)
        for k in rng.sample(range(150), i // 2):
            copy[k] = f"edit{rng.random()}"
        texts.append(" ".join(copy))
    idf = np.full(neardup.CELLS, 0.5, np.float32)
    weighed = [neardup.weigh(t, idf) for t in texts]
    times = collections.Counter(h for x, _ in weighed for h in x.tolist())
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    found = {r.node: r.alone for r in neardup.alone(rows, spark.sparkContext.broadcast(idf)).collect()}
    ruled_out = 0
    for i, (x, w) in enumerate(weighed):
        assert abs(found[i] - sum(float(v) for h, v in zip(x.tolist(), w, strict=True) if times[h] == 1)) < 1e-3
        if found[i] > 0.2 * w.sum() * (1 + 1e-4):
            ruled_out += 1
            assert all(neardup.similarity(weighed[i], y) < 0.8 for j, y in enumerate(weighed) if j != i)
    assert 10 < ruled_out < 40


def test_parity_sketches_bound_differences():
    rng = np.random.default_rng(9)
    for n, edits in ((3, 1), (100, 20), (5000, 700)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[edits:], rng.integers(0, 2**63, edits, dtype=np.uint64)])
        bits = lambda x: np.unpackbits(neardup.parity(x).view(np.uint8))
        assert 0 < (bits(a) != bits(b)).sum() <= 2 * edits and (bits(a) == bits(rng.permutation(a))).all()


def test_hot_group_of_copies_and_a_common_passage(spark, monkeypatch):
    """Classes equal those of all pairs where one group is large, its leader's text is sent to several seats, and a passage is common."""
    monkeypatch.setattr(neardup, "FELLOWS", 3)
    rng, rows = random.Random(42), []
    base, passage = prose(rng, 120).split(), prose(rng, 60)
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(120), rng.randrange(4)):
            copy[k] = f"edit{rng.random()}"
        rows.append((2 * i, " ".join(copy)))
        rows.append((2 * i + 1, f"{passage} {prose(rng, 30)}"))
    docs = frame(spark, rows)
    idf = neardup.idf_table(docs)
    weighed = {i: neardup.weigh(t, idf) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if neardup.similarity(weighed[a], weighed[b]) >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = {r.doc_id: r.class_id for r in neardup.groups(docs)[0].collect()}
    assert sum(found[i] != find(i) for i in root) <= 1  # banding may miss a pair near the threshold
    assert len(set(found.values())) < 80


def test_columns_of_a_step_get_fresh_names():
    assert fresh(["a", "B_", "c"], "a", "b", "d", "d") == ["a_", "b", "d", "d_"] and fresh(["Key"], "key") == ["key_"]


def test_word_hashes():
    h, s, e = hashing.words("Ab  ab\tcd é".encode())
    assert h[0] == h[1] != h[2] and list(s) == [0, 4, 7, 10] and list(e) == [2, 6, 9, 12]
    assert len(hashing.shingles(h, 5)) == 1 and len(hashing.shingles(h, 2)) == 3 and not len(hashing.words(b" \n")[0])
    text = prose(random.Random(16), 500).encode()
    whole = hashing.words(text)[0]
    old, hashing.BLOCK = hashing.BLOCK, 64
    try:
        assert (hashing.words(text)[0] == whole).all()
    finally:
        hashing.BLOCK = old
