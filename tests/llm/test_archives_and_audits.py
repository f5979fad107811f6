"""WARC bundles, the source audit and the Merkle manifest against brute force."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from leadloom.llm import divergence, merkle, warc

PAGE = "page_id long, url string, html string, bundle string, _copy int, digest string"
DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, part int, item string, _rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- WARC -----------------------------------------------------------------------------------


def pages_rows():
    rng = random.Random(7)
    long_ones = ["".join(rng.choices("abcdé <>\r\n", k=1200)) for _ in range(4)]
    html = [None, "", "x", "y" * 999, "y" * 1000, "é" * 500, "é" * 499, "big " * 60_000, *long_ones]
    rows = [(i, f"https://h.example/{i}", h, "b", 1, "d") for i, h in enumerate(html)]
    rows += [(100 + i, "https://c.example/\r\nX-Evil: 1", long_ones[i % 4], None, None, None) for i in range(40)]
    rows += [(300, None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40, "b", 1, "d")] * 2  # wholly equal rows
    rows += [(None, "", "z" * 2000, "b", 1, "d"), (None, "u", "z" * 2000, "b", 1, "d"), (-5, "u", "z" * 2000, "b", 1, "d"), (None, "n", "alone " * 400, None, None, None)]
    return rows


def expected_records(rows):
    newest = {}
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000:
            ids = [i for i in (newest.get(payload), page_id) if i is not None]
            newest[payload] = max(ids, default=None)
    out = []
    for page_id, url, html, *_ in rows:
        payload = (html or "").encode()
        first = newest.get(payload)
        revisit = first is not None and page_id != first
        url = url and url.replace("\r", "%0D").replace("\n", "%0A")
        out.append((page_id, url, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else payload))
    return sorted(out, key=repr)


def found_records(df):
    rows = df.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("r"), "payload").collect()
    return sorted(((*r[:6], None if r[6] is None else bytes(r[6])) for r in rows), key=repr)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    warc.write_bundles(spark.createDataFrame(pages_rows(), PAGE).repartition(3), path, frame_bytes=4000, bundle_bytes=30_000)
    return path


def test_records_read_back(spark, archive):
    assert found_records(warc.records(spark, archive)) == expected_records(pages_rows())
    places = {(r.bundle, r.frame, r.offset) for r in warc.records(spark, archive, payloads=False).collect()}
    index = spark.read.parquet(f"{archive}/index").collect()
    assert places == {(r.bundle, r.frame, r.offset) for r in index} and len(index) == len(pages_rows())
    assert len({p[0] for p in places}) > 2 and max(p[1] for p in places) > 1


def test_archives_are_plain_zstandard_and_seekable(spark, archive):
    for row in spark.read.format("binaryFile").load(f"{archive}/bundles").collect():
        content = bytes(row.content)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        frames = list(warc.frames_of(content))
        assert b"".join(data for _, data in frames) == whole
        fields, block, at = warc.parsed(whole, 0)
        assert fields["WARC-Type"] == "warcinfo" and row.bundle.encode() in block
        while at < len(whole):
            fields, block, at = warc.parsed(whole, at)
            assert fields["WARC-Record-ID"] and fields["WARC-Date"].endswith("Z")
        damaged = bytearray(content)
        damaged[len(content) - warc.FOOTER.size - 1] ^= 1  # the checksum of the last frame
        with pytest.raises(ValueError, match="damaged"):
            list(warc.frames_of(bytes(damaged)))


def test_fetch_by_identifier(spark, archive):
    everything = warc.records(spark, archive)
    some = everything.filter(F.col("page_id").isin(3, 101, 110, 300) | F.col("page_id").isNull())
    got = warc.fetch(spark, archive, some.select("record_id"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, some.collect()))
    # A revisit leads to its payload.
    response = warc.fetch(spark, archive, some.filter("page_id = 101").select(F.col("refers_to").alias("record_id"))).collect()
    assert [(r.record_type, r.page_id) for r in response] == [("response", 137)]
    assert warc.fetch(spark, archive, some.select(F.lit("no such").alias("record_id"))).isEmpty()


def test_no_pages_and_dates(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string").withColumn("at", F.lit("2024-02-28 23:00:01").cast("timestamp"))
    warc.write_bundles(pages, str(tmp_path / "one"), date_column="at")
    assert warc.records(spark, str(tmp_path / "one")).first().date == "2024-02-28T23:00:01Z"
    warc.write_bundles(pages.limit(0), str(tmp_path / "none"))
    assert warc.records(spark, str(tmp_path / "none")).collect() == []


# --- divergence -----------------------------------------------------------------------------


def audit_rows():
    rng = random.Random(3)
    words = ["a", "An", "the", "THE", "naïve", "日本語", "the-end", "x1y", "Äpfel", "äpfel", "internationalisation", "internationalism", "İ", "ſ", "prefix", "prefixes"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 25)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S1", "é", None]), 1, "t", 2, "i", 3))
    rows += [rows[5]] * 9 + [(None, "the the " + "w" * 3000, "en", "s1", None, None, None, None, None)] * 8  # repeated rows and a very long term
    rows += [(500, None, "xx", "lone", None, None, None, None, None), (501, "rare words", "yy", "p", None, None, None, None, None), (502, "", "yy", "q", None, None, None, None, None)]
    return rows


def plain_audit(rows, least, top):
    texts = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in texts:
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            typical = [(t, p[s][t] - whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, values, most in (("pair", pairs, None), ("term", typical, top)):
                ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "sizes"), [(8, {}), (3, {"filter_bits": 64, "chunk_terms": 40, "tile": 2}), (10_000, {})])
def test_audit(spark, least, sizes):
    """Also with a filter that lets nearly everything through, small chunks, and several tiles of sources."""
    got = divergence.audit(spark.createDataFrame(audit_rows(), DOC).repartition(5), least, top_terms=4, **sizes)
    assert sorted(map(tuple, got.collect())) == plain_audit(audit_rows(), least, 4)


def test_levels_drop_prefixes(spark):
    rows = [("en", f"common{i % 3}".encode()) for i in range(30)] + [("en", f"rare{i}x".encode()) for i in range(9)]
    chunks = divergence.term_chunks(spark.createDataFrame([(*r, "s") for r in rows], "lang string, text binary, source string"))
    level = divergence._level(chunks, 4, None, 10)
    assert {(r["item"], r.whole, r.documents) for r in level.collect()} == {(b"comm", False, 30)}
    kept = divergence.filter_of(level)
    assert kept("en", [b"comm", b"rare"]).tolist() == [True, False] and not kept("de", [b"comm"])[0]
    assert {bytes(r["item"]) for r in divergence.kept_terms(chunks, 10).collect()} == {b"common"}


def test_shares_are_exact_beyond_long(spark):
    n, total, v = 9_000_000_000_000_000, 9_100_000_000_000_001, 123_456_789
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).collect() == []


# --- Merkle manifest ------------------------------------------------------------------------


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        path.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return path


def plain_proofs(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified, walked one leaf at a time."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        changed = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        claim = plain_leaf(doc_id, source, lang, n_chars + 1, text) if changed else leaf
        groups[lang].append((doc_id, leaf, claim))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_levels([leaf for _, leaf, _ in groups[g]])
    top = plain_levels([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for i, (doc_id, leaf, claim) in enumerate(groups[g]):
            path, node = plain_path(trees[g], i) + plain_path(top, place), claim
            for odd, beside in path:
                node = sha(node) if beside is None else sha(beside, node) if odd else sha(node, beside)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, sha(*(b for _, b in path if b)), node, node == root))
    return out


def manifest_rows(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, None]), rng.choice(["", "é ü", None, f"text {i}"]), rng.choice(["en", "en", "de", None, "", "0", "日本"]), rng.choice(["a", None]), rng.choice([i, None, 5]), "t", 1, "i", 2) for i in range(n)]
    return rows + rows[: n // 4]


def manifest_of(df, bits):
    leaf = lambda n: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars") + 1)).otherwise(leaf(F.col("n_chars")))
    return merkle.build(df, F.col("lang"), [F.col("doc_id")], leaf(F.col("n_chars")), bits=bits, doc_id=F.col("doc_id"), claimed=claimed)


@pytest.mark.parametrize(("n", "bits"), [(1, 2), (40, 12), (300, 2), (331, 3)])
def test_proofs(spark, n, bits):
    rows = manifest_rows(n, n)
    manifest = manifest_of(spark.createDataFrame(rows, DOC).repartition(7), bits)
    assert Counter(map(tuple, merkle.proofs(manifest).collect())) == Counter(plain_proofs(rows))


def test_proofs_of_some_rows_fetch_only_what_is_missing(spark):
    rows = manifest_rows(9, 200)
    manifest = manifest_of(spark.createDataFrame(rows, DOC), 4)
    wanted = manifest.leaves.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") % 9 == 0))
    got = Counter(map(tuple, merkle.proofs(manifest, wanted).collect()))
    assert got == Counter(p for p in plain_proofs(rows) if p[0] is not None and p[0] % 9 == 0) and got


def test_missing_is_the_least_union():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        for size in {1, min(2, n), n // 2 or 1, n}:
            own = rng.choice(n, size, replace=False)
            needed, given, total = set(), set(map(int, own)), n
            level = 0
            have = set(given)
            while total > 1:  # siblings on any path, less what the leaves give
                needed |= {(level, i ^ 1) for i in have if i ^ 1 < total and i ^ 1 not in have}
                have, total, level = {i >> 1 for i in have}, (total + 1) >> 1, level + 1
            asked = merkle.missing(own, n)
            assert set(asked) == needed and len(asked) == len(needed)


def test_damaged_node_is_noticed(spark):
    manifest = manifest_of(spark.createDataFrame(manifest_rows(4, 64), DOC), 3)
    broken = merkle.Manifest(manifest.leaves, manifest.nodes.withColumn("hashes", F.when(F.col("level") == 3, F.reverse(F.col("hashes").cast("string")).cast("binary")).otherwise(F.col("hashes"))), manifest.groups, manifest.bits)
    with pytest.raises(Exception, match="another root"):
        merkle.proofs(broken).collect()


def test_manifest_of_nothing(spark):
    assert merkle.proofs(manifest_of(spark.createDataFrame([], DOC), 12)).collect() == []
