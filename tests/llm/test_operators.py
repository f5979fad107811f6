"""Training-data operators against brute force, with nulls, empty and odd texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import components, hamming, idfile, lines, packing, pii, quality, queries, secrets, sharding, simhash, tokens, transducer
from leadloom.llm.common import spread_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, ids string, start long, shard int"
LINE = "a common line of more than twenty characters"
PERSONAL = "write to ann.b@mail.example.com or +1 (743) 555-3824 or 10.1.2.3 or 4111 1111 1111 1111 now"


def odd_texts():
    rng = random.Random(5)
    vocabulary = ["the", "Thing", "of", "naïve", "日本", "x,", "end.", "it's", "0", "12"]
    texts = [None, "", " ", "\n\n", "a", LINE, f"{LINE}\nb", f"  {LINE.upper()}\t\nc\n", PERSONAL, "é" * 50, "same text twice", "same text twice"]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 300))) for _ in range(12)]
    texts += ["word " * 3000, "a\tb  c\r\nd \x0b e", "x\x02 y", "token = 'abcdefgh12345678' " + "0123456789abcdef" * 3]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 1, "x", "y", 7, 3) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id", "en", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "tokenizer"):
        library_ids.tokenizer = Tokenizer.from_file(tokens.vocabulary_file(queries.BYTE_BPE))
    return library_ids.tokenizer.encode(text or "", add_special_tokens=False).ids


# --- token ids ------------------------------------------------------------------------------


def test_ids_equal_the_library():
    rng = random.Random(1)
    texts = [t or "" for t in odd_texts()] + ["".join(rng.choices("ab' \n\t.1é\x1c\x85\x02", k=rng.randint(0, 25))) for _ in range(3000)]
    got = []
    for flat, counts in tokens.encoder(tokens.vocabulary_file(queries.BYTE_BPE)).encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [library_ids(t) for t in texts]


def test_code_lengths_are_best_and_bounded():
    counts = np.array([2**i for i in range(30)] + [0, 1])
    bounded = idfile.code_lengths(counts, 8)
    used = bounded[bounded > 0].astype(int)
    assert bounded[30] == 0 and used.max() <= 8 and sum(2.0**-used) <= 1
    fibonacci = idfile.code_lengths(np.array([1, 1, 2, 3, 5, 8]), 20)
    assert sorted(fibonacci.tolist()) == [1, 2, 3, 4, 5, 5]
    assert idfile.code_lengths(np.array([0, 5]), 20).tolist() == [0, 1]


def test_id_files_read_back(spark, docs, tmp_path):
    path = tokens.vocabulary_file(queries.BYTE_BPE)
    idfile.write_ids(docs, str(tmp_path / "ids"), path, end_id=2, shard_ids=2000)
    back = sorted(idfile.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in back] == [r.doc_id for r in rows]
    at = 0
    for got, row in zip(back, rows, strict=True):
        expected = library_ids(row.text) + [2]
        assert (got.start, got.n_tokens, np.frombuffer(got.ids, "<u4").tolist()) == (at, len(expected), expected)
        at += len(expected)
    assert spark.read.parquet(str(tmp_path / "ids/blocks")).select("shard").distinct().count() > 1
    idfile.write_ids(docs.limit(0), str(tmp_path / "none"), path, end_id=2)
    assert idfile.read_ids(spark, str(tmp_path / "none")).count() == 0


# --- packing --------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    windows = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(windows) if left >= n]
        if fits:
            windows[min(fits, key=lambda i: windows[i])] -= n
        else:
            windows.append(capacity - n)
    return Counter(windows)


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_piece_by_piece_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))] + [3] * rng.choice([0, 100])
    held, places = defaultdict(int), Counter()
    for length, _, each, window, offset in (runs := packing.best_fit_runs(Counter(lengths), capacity)):
        pass
    by_length = defaultdict(list)
    for run in runs:
        by_length[run[0]].append(run)
    for length, n in Counter(lengths).items():
        own = sorted(by_length[length], key=lambda r: r[1])
        for rank in range(n):
            run = [r for r in own if r[1] <= rank][-1]
            step = rank - run[1]
            window, offset = run[3] + step // run[2], run[4] + step % run[2] * length
            assert held[window] >= 0
            held[window] += length
            places[window, offset] += 1
    assert max(places.values(), default=1) == 1
    assert Counter(capacity - n for n in held.values()) == plain_best_fit(lengths, capacity)


def test_packed_windows_hold_every_id_once(spark, docs):
    path = tokens.vocabulary_file(queries.BYTE_BPE)
    found = packing.packed(docs, path, end_id=1, capacity=64).collect()
    expected = Counter(tuple(library_ids(r.text) + [1]) for r in docs.collect())
    assert sum(r.length for r in found) == sum(len(x) * n for x, n in expected.items())
    for sequence in {r.sequence_id for r in found}:
        at = 0
        for r in sorted((r for r in found if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at and r.length <= 64
            at += r.length
        assert at <= 64
    full = packing.windows(docs, path, end_id=1, capacity=64, pad_id=9).collect()
    ids = [np.frombuffer(r.ids, "<u4") for r in full]
    assert all(len(x) == 64 and (x[r.n_tokens :] == 9).all() for x, r in zip(ids, full, strict=True))
    assert Counter(i for x, r in zip(ids, full, strict=True) for i in x[: r.n_tokens].tolist()) == Counter(i for x, n in expected.items() for i in x * n)
    assert packing.packed(docs.limit(0), path, end_id=1).count() == 0


@pytest.mark.parametrize("end", [1, 70_000])  # ids of two and of four bytes
def test_pieces_are_cut_out_of_the_windows(spark, docs, end):
    path = tokens.vocabulary_file(queries.BYTE_BPE)
    rows = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    expected = {r.doc_id: library_ids(r.text) + [end] for r in rows.collect()}
    found = packing.packed(rows, path, end_id=end, capacity=64).collect()
    for r in found:
        ids = expected[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.doc_tokens == len(expected[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
    places = {(r.doc_id, r.start): (r.sequence_id, r.offset) for r in found}
    for w in packing.windows(rows, path, end_id=end, capacity=64).collect():
        flat = np.frombuffer(w.ids, "<u4").tolist()
        for p in w.pieces:
            assert flat[p.offset : p.offset + p.length] == expected[p.doc_id][p.start : p.start + p.length]
        assert w.doc_ids == [p.doc_id for p in w.pieces] and sum(p.length for p in w.pieces) == w.n_tokens
    assert set(places) == {(i, at) for i, x in expected.items() for at in range(0, len(x), 64)}


def test_pipeline_returns_the_ids_of_the_masked_texts(spark):
    text = "a short text of some words for the windows"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.pack(spark, docs, "").collect()}
    assert found == {1: library_ids(text) + [1], 2: [1]}


# --- lines ----------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_lines_against_brute_force(spark, docs, partitions):
    many = docs.unionByName(spark.createDataFrame([(100 + i, f"{LINE}\n{LINE}\n{i}", "en", "s", 1, None, None, None, None) for i in range(300)], SCHEMA))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rows = many.collect()
    holders = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            holders[key(line)].add(-1 if r.doc_id is None else r.doc_id)
    expected = []
    for r in rows:
        all_ = (r.text or "").split("\n")
        own = -1 if r.doc_id is None else r.doc_id
        keep = [x for x in all_ if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != own)]
        expected.append((r.doc_id, len(all_), len(all_) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert Counter(map(tuple, lines.kept_digests(many).collect())) == Counter(expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    texts = lines.deduplicated(many)
    assert texts.columns == many.columns and texts.filter("text is null").count() == 1
    assert lines.kept_digests(many.limit(0)).count() == 0


# --- near duplicates ------------------------------------------------------------------------


def test_anchors_cover_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, 500)
    y = x.copy()
    for i in range(len(y)):
        for bit in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.array(1 << int(bit), np.uint64).view(np.int64)
    index, anchor, home = simhash.anchors(x, 3)
    assert home.sum() == len(x)
    own = dict(zip(index[home].tolist(), anchor[home].tolist(), strict=True))
    near = set(zip(*(a.tolist() for a in simhash.anchors(y, 3)[:2]), strict=True))
    assert all((i, own[i]) in near for i in range(len(x)))


def plain_components(values, linked):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("at_home", [4096, 3])
def test_links_connect_what_is_near(spark, monkeypatch, at_home):
    monkeypatch.setattr(simhash, "AT_HOME", at_home)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.near_links(distinct, 3)).collect()}
    roots = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = defaultdict(set)
    for v, r in zip(signed, roots, strict=True):
        groups[r].add(v)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in _by_root(found).values()}


def _by_root(found):
    groups = defaultdict(set)
    for node, root in found.items():
        groups[root] |= {node, root}
    return groups


def test_components_of_a_long_chain(spark):
    found = components.components(spark.range(300).selectExpr("id as u", "id + 1 as v"))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(301)}
    assert components.components(spark.range(0).selectExpr("id as u", "id as v")).count() == 0


def test_near_duplicates_of_odd_documents(spark, docs):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert found[10].component_id == 10 == found[11].component_id  # the same text twice
    assert found[0].fp == found[1].fp == found[2].fp == 0 and found[2].component_id == 0  # no words
    assert found[None].component_id is None
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(docs.limit(0)).count() == 0
    import xxhash

    words = "The thing of the thing".translate(LOWER).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint("The  thing\nof the\tthing", 3) & (1 << 64) - 1 == expected


def test_spread_join_splits_hot_keys(spark):
    left = spark.range(1000).selectExpr("id", "if(id < 900, 0, id) as k")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = spread_join(left, right, "k", "n", rows=50)
    assert sorted((r.id, r.v) for r in got.collect()) == [(i, 0 if i < 900 else 2 * i) for i in range(1000)]


# --- search ---------------------------------------------------------------------------------


def test_search_against_all_distances(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    codes = [centre] * 60 + [centre ^ (1 << rng.randrange(64)) for _ in range(40)] + [rng.getrandbits(64) for _ in range(150)] + [None]
    signed = [None if c is None else c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, code long")
    got = hamming.search(rows, rows.filter("id % 50 = 0"), 5).collect()
    expected = []
    for q in range(0, len(codes) - 1, 50):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if c is not None and i != q)[:5]
        expected += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    assert sorted(map(tuple, got)) == expected
    few = rows.limit(3)
    assert hamming.search(few, few, 5).count() == 6 and hamming.search(rows.limit(0), rows.limit(0), 5).count() == 0
    vector = spark.createDataFrame([([0.5, -1.0, None, 2.0],), (None,)], "v array<double>").select(hamming.sign_code(F.col("v")).alias("c"))
    assert [r.c for r in vector.collect()] == [9, None]


# --- pieces ---------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = tokens.vocabulary_file(queries.PIECES)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), transducer.transducer(path)
    rng = random.Random(2)
    texts = [t or "" for t in odd_texts()] + ["".join(rng.choices("abcdet theing  \n.é日ß1", k=rng.randint(0, 30))) for _ in range(3000)]
    for text in texts:
        ids = np.frombuffer(machine.encode(text), "<u4")
        assert ids.tolist() == library.encode(text)
        assert machine.decode(ids) == text
    back = transducer.decoded(transducer.encoded(docs, path), path)
    assert Counter(r.text for r in back.collect()) == Counter(r.text or "" for r in docs.collect())
    assert transducer.encoded(docs.limit(0), path).count() == 0


def model_file(path, pieces, kind, collapse, fallback):
    """A model file of the given (piece, score, type), written field by field."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def field(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    out = b"".join(field(1, field(1, p.encode()) + field(2, score) + field(3, of)) for p, score, of in pieces)
    out += field(2, field(3, kind) + field(35, int(fallback)))
    out += field(3, field(1, b"identity") + field(3, 1) + field(4, int(collapse)) + field(5, 1))
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("kind", [transducer.UNIGRAM, transducer.BPE])
@pytest.mark.parametrize("collapse", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_lightest_paths_and_normaliser_equal_the_library(tmp_path, kind, collapse, fallback):
    import sentencepiece

    rng = random.Random(kind * 4 + collapse * 2 + fallback)
    space = transducer.SPACE
    letters = [space, *"abcde\u00e9"]
    longer = {"".join(rng.choices("abcde\u00e9", k=rng.randint(2, 5))) for _ in range(60)}
    longer |= {space + "".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(30)} | {space * 2, space * 4}
    if kind == transducer.UNIGRAM:
        letters.remove("e")  # only inside longer pieces: else spelled by fallback
    scores = rng.sample(range(1, 4000), len(longer) + len(letters))  # sums are exact in 32 bits; ties are rare
    merges = sorted(longer)
    rng.shuffle(merges)
    if kind == transducer.BPE:  # each piece is a merge of two shorter ones
        known = list(letters)
        merges = []
        while len(merges) < 80:
            new = rng.choice(known) + rng.choice(known)
            if len(new) < 7 and space not in new.lstrip(space) and new not in known:
                merges.append(new)
                known.append(new)
        scores = list(range(len(merges) + len(letters)))
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    pieces += [(p, -float(score) / 64, 1) for p, score in zip(merges + letters, scores, strict=False)]
    path = model_file(tmp_path / "own.model", pieces, kind, collapse, fallback)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer(path, memo=50)
    texts = ["", " ", "   ", " a ", "a  b", "  ab   \n  cd  ", "z", "zz z", "a" * 3000, "abcde" * 500]
    texts += ["".join(rng.choices("abcde\u00e9  \nz\U0001f600", k=rng.randint(0, 40))) for _ in range(1500)]
    found = machine.encode_all(texts)
    for text, ids in zip(texts, found, strict=True):
        own, wanted = np.frombuffer(ids, "<u4").tolist(), library.encode(text)
        if kind == transducer.UNIGRAM and own != wanted:  # equal sums only
            weight = lambda of: sum(machine._weight[i] if i in machine._id.values() else 0 for i in of)
            assert weight(own) == pytest.approx(weight(wanted), abs=1e-3), text
        else:
            assert own == wanted, text
    if fallback and not collapse:
        assert [machine.decode(np.frombuffer(ids, "<u4")) for ids in found] == texts


def test_parts_are_composed_once(monkeypatch):
    path = tokens.vocabulary_file(queries.PIECES)
    machine, composed = transducer.Transducer(path), []
    compose = machine.shortest_paths

    def recorded(parts):
        composed.extend(parts)
        return compose(parts)

    monkeypatch.setattr(machine, "shortest_paths", recorded)
    texts = ["Thonly erend", "Thonly. erend,", "thonly\nerend!?", "", "Thonly, erend. erend%%%", " erend"]
    found = [machine.encode(text) for text in texts]
    assert len(composed) == len(set(composed)) and composed.count("▁erend") == 1
    assert found == transducer.Transducer(path).encode_all(texts)


def test_pieces_leave_and_come_back_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(transducer, "SLICE", 40)
    monkeypatch.setattr(transducer, "ROWS", 3)
    path = tokens.vocabulary_file(queries.PIECES)
    texts = [None if i % 7 == 3 else "Thonly. erend,\n" * (i % 9) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    back = transducer.decoded(transducer.encoded(rows, path), path).collect()
    assert [(r.doc_id, r.text) for r in back] == [(i, text or "") for i, text in enumerate(texts)]
    assert all(r.n_pieces * 4 == len(r.ids) for r in back)


@pytest.mark.parametrize("places", [1, 16])
def test_pairs_on_one_place_change_no_ids(monkeypatch, places):
    import sentencepiece

    path = tokens.vocabulary_file(queries.PIECES)
    monkeypatch.setattr(transducer, "PLACES", places)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer(path)
    texts = [t or "" for t in odd_texts()] + ["", "Thonly. erend,", "日本 1. x\n\ny"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in machine.encode_all(texts)] == library.encode(texts)
    assert machine.encode_all(["", ""]) == [b"", b""]


# --- secrets --------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets_against_plain_patterns(spark, docs):
    rng = random.Random(4)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apiKey", "=", ":", " ", "'", '"', "abc", "12345678", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "0" * 33, "é", "ghp_", "x" * 30, "\n"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert sorted((a, secrets.BASE.index(k), b) for a, b, k in secrets.spans(text) if k in secrets.BASE) == plain_secrets(text)
    body, rest, digits = "Ab3" * 10, zlib.crc32(b"Ab3" * 10), ""
    for _ in range(6):
        rest, d = divmod(rest, 62)
        digits = secrets.DIGITS62[d] + digits
    assert secrets.spans(f"x ghp_{body}{digits}") == [(2, 42, "forge")] and secrets.spans(f"ghp_{body}AAAAAA") == []
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(docs)).collect()}
    assert got[0].spans == "" and got[27].n_assign == 1 and got[27].n_hex == 1
    assert secrets.scan(docs.limit(0)).count() == 0


# --- personal data --------------------------------------------------------------------------


def plain_personal(text):
    def luhn(digits):
        places = [int(c) for c in reversed(digits)]
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(places)) % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return sorted(found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(only(m[0])) <= 15])


def test_personal_data_against_plain_patterns(spark, docs):
    rng = random.Random(6)
    parts = ["a@b.c", "x", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+1 (743) 555-3824", "+", "@", "-", " ", ".", "é", "_", "5555-4444", "a.b@c-d.e.f", "\n", "Mr. John Smith", "\U0001f600"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(3000)]
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    texts = dict(rows)
    for r in found:
        assert [(s.start, s.rank, s.end) for s in r.spans if s.base] == plain_personal(texts[r.doc_id]), texts[r.doc_id]
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    by_id = {r.doc_id: r.text for r in masked.collect()}
    assert by_id[0] is None and by_id[8] == "write to <EMAIL> or <PHONE> or <IP> or <CARD> now" and by_id[5] == LINE
    assert pii.spans(docs.limit(0), ["doc_id"]).count() == 0 and pii.masked(docs.limit(0)).count() == 0


def test_long_runs_take_linear_time(spark):
    rows = [(1, "a@" + "b." * 100_000), (2, "1.1.1.1 " * 20_000), (3, "9" * 300_000), (4, "x" * 500_000)]
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {1: 1, 2: 20_000, 3: 0, 4: 0}


def test_em_finds_the_reliable_labelers():
    rng = random.Random(8)
    patterns = Counter()
    truth = {}
    for _ in range(4000):
        yes = rng.random() < 0.3
        votes = tuple("-" if rng.random() < 0.1 else "y" if (rng.random() < right) == yes else "n" for right in (0.95, 0.9, 0.9, 0.6, 0.85))
        patterns[votes] += 1
        truth.setdefault(votes, []).append(yes)
    posterior = pii.expectation_maximisation(patterns)
    right = sum((posterior[v] > 0.5) == y for v, all_ in truth.items() for y in all_)
    assert right / 4000 > 0.95


# --- quality --------------------------------------------------------------------------------


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, repeats, covered, earlier = Counter(windows), 0, set(), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeats += line in earlier
            earlier.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), repeats, len(covered), failed


def test_quality_counts_and_fences(spark, docs):
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(300)]
    junk = [" ".join(word() + rng.choice(["###", "$$$"]) for _ in range(120)) for _ in range(20)]
    rows = [(1000 + i, t, "en", "s0", 1, None, None, None, None) for i, t in enumerate(clean + junk)]
    all_ = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    judged = quality.judged(all_).collect()
    for r in judged:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == plain_counts(r.text)
        assert not (r.q_base_failed and r.q_kept)
    kept = {r.doc_id for r in judged if r.q_kept}
    assert {1000 + i for i in range(300)} <= kept and not kept & {1300 + i for i in range(20)}
    assert len(judged) == all_.count() and quality.kept_documents(all_).columns == all_.columns
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_fences_follow_the_sketches(spark):
    rng = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]

    def text(share):  # symbols per character in words
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(120)]
        symbols = round(share / (1 - share) * sum(map(len, words)))
        for i in range(symbols):
            words[i * 7 % 120] += "#"
        return " ".join(words)

    groups = {
        "clean": [0.0] * 300 + [0.07] * 9,
        "a third junk": [0.0] * 210 + [0.3] * 45 + [0.11] * 45,
        "symbols": [rng.uniform(0.03, 0.09) for _ in range(300)] + [0.3] * 9,
    }
    rows = [(text(share), "en", source, share) for source, shares in groups.items() for share in shares]
    judged = quality.judged(spark.createDataFrame(rows, "text string, lang string, source string, share double")).collect()
    assert len(judged) == len(rows)
    wrong = [(r.source, r.share, r.q_kept) for r in judged if r.q_kept != (r.share == 0 or r.source == "symbols" and r.share < 0.1)]
    assert not wrong


# --- sharding -------------------------------------------------------------------------------


def test_shards_are_exact_and_uniform(spark, docs):
    rows = docs.select("doc_id", "text")
    dealt = sharding.uniform_shards(rows, shards=8, partition_rows=5).collect()
    slots = defaultdict(list)
    for r in dealt:
        slots[r.shard].append(r.slot)
    assert Counter((r.doc_id, r.text) for r in dealt) == Counter(map(tuple, rows.collect()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.uniform_shards(rows.limit(0)).count() == 0
    many = sharding.uniform_shards(spark.range(40_000), shards=8, partition_rows=4000).groupBy("shard").agg(F.avg("id").alias("m"), F.corr("id", "slot").alias("c")).collect()
    assert all(abs(r.m - 20_000) < 800 and abs(r.c) < 0.07 for r in many)


def test_shards_get_the_texts(spark, docs, tmp_path, monkeypatch):
    docs.drop("shard").write.parquet(str(tmp_path / "documents.parquet"))
    dealt, whole = [], sharding.uniform_shards
    monkeypatch.setattr(sharding, "uniform_shards", lambda rows, **options: dealt.append(whole(rows, **options)) or dealt[0])
    found = queries.op9_sharding(spark, str(tmp_path)).collect()
    places = {(r.shard, r.slot): r for r in dealt[0].collect()}
    assert Counter(r.text for r in places.values()) == Counter(r.text for r in docs.collect())
    for r in found:
        text = (places[r.shard, r.slot].text or "").encode()
        assert (r.size, r.text_crc32, r.doc_id) == (len(text) + 1, zlib.crc32(text), places[r.shard, r.slot].doc_id)


def test_matrix_has_its_margins():
    sizes = [random.Random(i).randint(0, 50) for i in range(40)]
    matrix = sharding.communication_matrix(sizes, 8, seed=1)
    assert matrix.sum(1).tolist() == sizes and max(matrix.sum(0)) - min(matrix.sum(0)) <= 1
    rng = np.random.default_rng(0)
    mine = np.mean([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(mine - 6) < 0.15
    large = [sharding.hypergeometric(rng, 10**12, 10**13, 10**6) for _ in range(50)]
    assert abs(np.mean(large) - 10**6 / 11) < 300


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    text = lambda n=150: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    texts = [text() for _ in range(60)]
    texts[1] = texts[0]  # exact copy
    texts[2] += " " + PERSONAL
    texts += ["too short", None]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == set(range(60)) - {1} and "<EMAIL>" in left[2] and "ann.b@" not in left[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = {i: len(library_ids(t)) + 1 for i, t in left.items()}
    got = defaultdict(int)
    for r in packed:
        got[r.doc_id] += r.length
    assert got == expected


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, b), (None, c), (None, c), (3, d), (None, d), (0, d)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (None, c), (0, d)])
