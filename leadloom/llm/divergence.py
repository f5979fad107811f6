"""How the sources of a language differ in their terms; the terms come from iceberg prefix refinement.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A language keeps
the terms that occur in at least ``least_documents`` of its documents (rows). They are found level
by level over byte prefixes of 1, 2, 4, 8, ... bytes: a document holds a term only if it holds the
term's prefixes, so a prefix in too few documents takes all its terms along. Each level counts,
for the prefixes that extend one kept before, the documents that hold them; a term no longer than
the level is counted whole and is settled there. The loop ends when no kept prefix goes on, after
about log2 of the longest kept prefix.

Texts are cut into terms once, into chunks that hold each term once and documents as numbers; the
levels read the chunks. A chunk adds one row per item, so a prefix that every document holds is a
few rows in the shuffle. Which prefixes were kept reaches the tasks as a Bloom
filter of at most ``FILTER_BITS`` bits, whatever their number: it lets some extensions of dropped
prefixes through, which the exact counts of the level then drop, and never loses one.

Distances between the sources of a language are sums over terms of differences of dense vectors;
tasks add them up as matrices, so no pairs of rows are made per term.

Defined results: null text, lang and source are ''; every row is a document, repeated rows and
null doc_ids included; a language without kept terms has value 0 for its pairs and no terms; a
lone source has no pairs; ties go by item in UTF-8 order; extra columns are not read; an empty
table gives no rows. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import forget, written

FILTER_BITS = 1 << 26
FILTER_HASHES = 4
CHUNK_TERMS = 1 << 22
TILE = 256  # sources per side of a matrix
MATRICES = 64  # matrices a task holds before it hands them on
UNIT = 1_000_000_000
_CHUNK_COLUMNS = ["lang", "sources", "terms", "doc_source", "doc_terms", "steps", "n"]

# Letters in lower case, bytes of characters beyond ASCII as they are, a space for all others.
_SPLIT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


class Filter:
    """Bloom filter over (lang, item)."""

    def __init__(self, words: np.ndarray):
        self._words = words

    def __call__(self, lang: str, items: list[bytes]) -> np.ndarray:
        found = np.ones(len(items), bool)
        for at in places(lang, items, len(self._words) * 64):
            found &= (self._words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


def places(lang: str, items: list[bytes], bits: int) -> Iterator[np.ndarray]:
    """The bits of each item, one array per hash function."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(item, seed) for item in items]), ">u8").reshape(-1, 2).astype(np.uint64)
    for i in range(FILTER_HASHES):
        yield ((both[:, 0] + np.uint64(i) * (both[:, 1] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def filter_of(items: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """Filter over ``items(lang, item)``: 16 bits each up to ``most_bits``. At most ``most_bits / 64`` numbers reach the driver."""
    enough, bits = min(most_bits, 16 * items.count()), 64
    while bits < enough:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang[lang].append(item)
            for lang, own in by_lang.items():
                at = np.concatenate(list(places(lang, own, bits)))
                words = np.zeros(bits // 64, np.uint64)
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
                set_ = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array(set_), pa.array(words[set_].view(np.int64))], ["word", "bits"])

    words = np.zeros(bits // 64, np.int64)
    for row in items.select("lang", "item").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[row["word"]] = row["bits"]
    return Filter(words.view(np.uint64))


def term_chunks(docs: DataFrame, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """The terms of ``docs(lang, source, text)`` in chunks of documents of one language.

    A chunk holds its terms once, sorted; its sources; and for every document its source, the number
    of its terms, and their numbers (rising, as differences) and occurrences. Numbers are 32-bit,
    little-endian. A task holds about ``chunk_terms`` occurrences and one document at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, defaultdict] = {}
        open_: dict[str, list] = defaultdict(list)
        held = 0

        def chunk(lang: str) -> pa.RecordBatch:
            # Numbers in order of first sight become numbers in order of the terms.
            terms = sorted(numbers[lang])
            rank = np.empty(len(terms), np.int64)
            rank[[numbers[lang][t] for t in terms]] = np.arange(len(terms))
            sources = sorted({source for source, _ in open_[lang]})
            sizes = [len(own) for _, own in open_[lang]]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            cells, n = np.unique(doc * len(terms) + rank[np.concatenate([own for _, own in open_[lang]])], return_counts=True)
            doc, ids = cells // len(terms), cells % len(terms)
            steps = np.diff(ids, prepend=0)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            steps[first] = ids[first]
            number = dict(zip(sources, range(len(sources)), strict=True))
            numeric = [np.array([number[source] for source, _ in open_[lang]]), np.bincount(doc, minlength=len(sizes)), steps, n]
            row = [lang, sources, b"\n".join(terms), *[a.astype("<i4").tobytes() for a in numeric]]
            types = [pa.string(), pa.list_(pa.string()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], _CHUNK_COLUMNS)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang in list(open_):
                yield chunk(lang)
            numbers.clear()
            open_.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                known = numbers.get(lang)
                if known is None:
                    known = numbers[lang] = defaultdict()
                    known.default_factory = known.__len__  # a new term gets the next number
                open_[lang].append((source, np.array([known[t] for t in terms], np.int32)))
                held += len(terms)
                if held >= chunk_terms:
                    yield from flushed()
                    held = 0
        yield from flushed()

    kinds = ["string", "array<string>", *["binary"] * 5]
    return docs.select("lang", "source", "text").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(_CHUNK_COLUMNS, kinds, strict=True)))


@dataclass(frozen=True)
class Chunk:
    lang: str
    sources: list[str]
    terms: list[bytes]
    source: np.ndarray  # of each document
    doc: np.ndarray  # of each (document, term)
    term: np.ndarray
    n: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for lang, sources, terms, *numeric in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            source, size, steps, n = (np.frombuffer(a, "<i4") for a in numeric)
            ids = np.cumsum(steps.astype(np.int64))
            starts = np.cumsum(size) - size
            before = np.concatenate([[0], ids])[starts]  # rows of each document start from zero
            yield Chunk(lang, sources, terms.split(b"\n"), source, np.repeat(np.arange(len(size)), size), ids - np.repeat(before, size), n)


def _level(chunks: DataFrame, length: int, kept: Filter | None, least_documents: int) -> DataFrame:
    """``lang, item, whole, documents`` of one level: prefixes of ``length`` bytes that extend a kept one of half of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            if kept is None:
                alive = range(len(c.terms))
            else:
                # Sorted terms: those of one prefix stand together.
                parents = [t[: length // 2] if len(t) > length // 2 else b"" for t in c.terms]
                distinct = list(dict.fromkeys(parents))
                good = dict(zip(distinct, kept(c.lang, distinct).tolist(), strict=True)) | {b"": False}
                alive = [i for i, parent in enumerate(parents) if good[parent]]
            items = [t if len(t := c.terms[i]) <= length else t[:length] + b"+" for i in alive]
            distinct = list(dict.fromkeys(items))
            number = dict(zip(distinct, range(len(distinct)), strict=True))
            item_of = np.full(len(c.terms), -1)
            item_of[list(alive)] = [number[item] for item in items]
            item = item_of[c.term]
            doc, item = c.doc[item >= 0], item[item >= 0]
            # Within a document terms rise, so equal items follow each other.
            first = (np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)
            documents = np.bincount(item[first], minlength=len(distinct))
            columns = [[c.lang] * len(distinct), [i.removesuffix(b"+") for i in distinct], [not i.endswith(b"+") for i in distinct], documents]
            types = [pa.string(), pa.binary(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["lang", "item", "whole", "n"])

    found = chunks.mapInArrow(run, "lang string, item binary, whole boolean, n long")
    return found.groupBy("lang", "item", "whole").agg(F.sum("n").alias("documents")).filter(F.col("documents") >= least_documents)


def kept_terms(chunks: DataFrame, least_documents: int = 30, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, item`` (the term's bytes), ``documents`` of the terms each language keeps. ``chunks``: a written table of ``term_chunks``."""
    length, kept, settled = 1, None, []
    while True:
        level = written(_level(chunks, length, kept, least_documents))
        settled.append(level.filter("whole").drop("whole"))
        open_ = level.filter("NOT whole")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        length, kept = length * 2, filter_of(open_, filter_bits)


def term_counts(chunks: DataFrame, terms: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, item, n``: occurrences of the kept terms, by source."""
    kept = filter_of(terms, filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            good = kept(c.lang, c.terms)[c.term]
            cell = c.source[c.doc[good]].astype(np.int64) * len(c.terms) + c.term[good]
            cells, at = np.unique(cell, return_inverse=True)
            n = np.bincount(at, c.n[good], len(cells)).astype(np.int64)
            named = pa.array(c.sources).take(pa.array(cells // len(c.terms))), pa.array(c.terms, pa.binary()).take(pa.array(cells % len(c.terms)))
            yield pa.RecordBatch.from_arrays([pa.array([c.lang]).take(pa.array(np.zeros(len(cells), np.int64))), *named, pa.array(n)], ["lang", "source", "item", "n"])

    # Chunks have added up their rows. Dealt by term, all that follows needs no further shuffle of them.
    found = chunks.mapInArrow(run, "lang string, source string, item binary, n long").repartition("lang", "item")
    summed = found.groupBy("lang", "item", "source").agg(F.sum("n").alias("n"))
    per_term = summed.groupBy("lang", "item").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n"))
    return per_term.join(terms.select("lang", "item"), ["lang", "item"], "left_semi")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact for any count."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, (total + 5 * terms).cast("decimal(20,0)"))


def _distances(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """``lang, i, j, value`` with i < j: sums of |p[i] - p[j]| over ``vectors(lang, p)``, in matrices of ``tile`` x ``tile``."""
    tiles = F.ceil(F.size("p") / tile).cast("int")
    blocks = vectors.withColumn("a", F.explode(F.sequence(F.lit(0), tiles - 1))).withColumn("b", F.explode(F.sequence(F.col("a"), tiles - 1)))
    cut = lambda side: F.slice("p", F.col(side) * tile + 1, F.lit(tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, a, b), matrix in sums.items():
                i, j = np.indices(matrix.shape)
                i, j = i.ravel() + a * tile, j.ravel() + b * tile
                upper = i < j
                columns = [pa.array([lang] * int(upper.sum()), pa.string()), pa.array(i[upper]), pa.array(j[upper]), pa.array(matrix.ravel()[upper])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "i", "j", "value"])
            sums.clear()

        for batch in batches:
            rows: dict[tuple[str, int, int], list] = defaultdict(list)
            for lang, a, b, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows[lang, a, b].append((left, right))
            for key, sides in rows.items():
                left, right = (np.array(side, np.int64) for side in zip(*sides, strict=True))
                total = sums.setdefault(key, np.zeros((left.shape[1], right.shape[1]), np.int64))
                step = max(1, (1 << 22) // total.size)
                for k in range(0, len(left), step):
                    total += np.abs(left[k : k + step, :, None] - right[k : k + step, None, :]).sum(0)
                if len(sums) > MATRICES:
                    yield from flushed()
        yield from flushed()

    cells = blocks.select("lang", "a", "b", cut("a").alias("left"), cut("b").alias("right")).mapInArrow(run, "lang string, i long, j long, value long")
    return cells.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least_documents: int = 30, top_terms: int = 50, lang_column: str = "lang", source_column: str = "source", text_column: str = "text",
    filter_bits: int = FILTER_BITS, chunk_terms: int = CHUNK_TERMS, tile: int = TILE,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from each other one, and its most typical terms."""
    named = {"lang": lang_column, "source": source_column, "text": text_column}
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items())).withColumn("text", F.col("text").cast("binary"))
    chunks = written(term_chunks(rows, chunk_terms))
    terms = kept_terms(chunks, least_documents, filter_bits)
    counts = written(term_counts(chunks, terms, filter_bits))
    forget(chunks)

    # One row per language: its sources in order with their sums, the number of its terms, and its sum.
    totals = counts.select("lang", F.explode("n").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    members = sizes.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("members"), F.sum("total").alias("lang_total"))
    members = written(members.join(counts.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").drop("n"))

    p = F.transform("members", lambda m: F.struct(m["source"].alias("source"), share(F.coalesce(F.try_element_at("n", m["source"]), F.lit(0)), m["total"], F.col("v")).alias("p")))
    of_lang = share(F.aggregate(F.map_values("n"), F.lit(0).cast("long"), lambda a, x: a + x), F.col("lang_total"), F.col("v"))
    shares = counts.join(members, "lang").select("lang", "item", "n", p.alias("p"), of_lang.alias("q"))
    typical = (
        shares.select("lang", "item", "q", F.explode(F.filter("p", lambda x: F.map_contains_key("n", x["source"]))).alias("own"))
        .select("lang", F.col("own.source").alias("source"), F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), (F.col("own.p") - F.col("q")).alias("value"))
        .filter("value > 0")
    )

    sums = _distances(shares.select("lang", F.col("p.p").alias("p")), tile)
    sides = members.select("lang", "members", F.posexplode("members").alias("i", "one"))
    pairs = sides.select("lang", "i", F.col("one.source").alias("source"), F.posexplode("members").alias("j", "other")).filter("i != j")
    apart = (
        pairs.withColumns({"low": F.least("i", "j").cast("long"), "high": F.greatest("i", "j").cast("long")})
        .join(sums.select("lang", F.col("i").alias("low"), F.col("j").alias("high"), "value"), ["lang", "low", "high"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), F.col("other.source").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    )

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(apart).unionByName(ranked(typical).filter(F.col("rank") <= top_terms))
